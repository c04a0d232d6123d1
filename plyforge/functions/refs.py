"""Columns that bring references, categories and names to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories, longest name first, and the upper bound in seconds of base + 40 increments of each.
CATEGORIES = ("UltraBullet", "Bullet", "Blitz", "Rapid", "Classical", "Correspondence")
CLOCK_BOUNDS = ((29, "UltraBullet"), (179, "Bullet"), (479, "Blitz"), (1499, "Rapid"))

#: Characters that count as blank at the ends of a value.
BLANKS = " \t\n\x0b\f\r\u00a0"


def stripped(col: Column) -> Column:
    """Without blanks of any kind at either end (``trim`` takes the space only)."""
    return F.btrim(col, F.lit(BLANKS))


def game_ref(col: Column) -> Column:
    """The eight-character game id a reference names, bare or inside an address; null where it names none.

    An address may have a scheme, a trailing slash, a point of view, a query or a fragment. Letter case is kept.
    """
    got = F.regexp_extract(
        col, r"^[\s\u00a0]*(?:(?:[A-Za-z]+://)?[^/\s]+/)?([A-Za-z0-9]{8})(?:/(?:white|black)?)?(?:[?#]\S*)?[\s\u00a0]*$", 1
    )
    return F.when(got != "", got)


def clock_category(clock: Column) -> Column:
    """Category of a ``base+increment`` clock; ``-`` is Correspondence; null for anything else."""
    text = stripped(clock)
    base = F.regexp_extract(text, r"^(\d{1,9})\+(\d{1,9})$", 1)
    inc = F.regexp_extract(text, r"^(\d{1,9})\+(\d{1,9})$", 2)
    seconds = F.expr("1L") * F.when(base != "", base).cast("long") + 40 * F.when(inc != "", inc).cast("long")
    out = F.when(text == "-", F.lit("Correspondence"))
    for bound, name in CLOCK_BOUNDS:
        out = out.when(seconds <= bound, F.lit(name))
    return out.when(seconds.isNotNull(), F.lit("Classical"))


def named_category(text: Column, any_case: bool = False) -> Column:
    """The first category named anywhere in ``text``."""
    hay = F.lower(text) if any_case else text
    out = None
    for name in CATEGORIES:
        hit = F.contains(hay, F.lit(name.lower() if any_case else name))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def header_category(event: Column, clock: Column) -> Column:
    """Category of a game from its headers: the event's, else the clock's, else null."""
    return F.coalesce(named_category(event), clock_category(clock))


def label_category(label: Column) -> Column:
    """Category of a written label in any letter case, else of a clock, else ``Unknown``; never null."""
    return F.coalesce(named_category(label, any_case=True), clock_category(label), F.lit("Unknown"))


def split_name(col: Column) -> Column:
    """train, val or test, however spelt; null for other words."""
    word = F.lower(stripped(col))
    return (
        F.when(word.rlike(r"^(train|training|tr)$"), "train")
        .when(word.rlike(r"^(val|valid|validation|dev)$"), "val")
        .when(word.rlike(r"^(test|testing|tst)$"), "test")
    )


def dump_name(col: Column) -> Column:
    """The ``YYYY-MM`` a dump name holds; null where it holds none."""
    got = F.regexp_extract(col, r"(\d{4})[-_](\d{2})(?!\d)", 0)
    return F.when(got != "", F.replace(got, F.lit("_"), F.lit("-")))


def source_name(col: Column) -> Column:
    """Source name without regard to letter case, outer blanks and the kind of separator."""
    return F.regexp_replace(F.lower(stripped(col)), r"[-_ ]", "_")
