"""Position keys: 64-bit digests, in every notation in which writers give them."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions.refs import stripped


def digest64(text: str) -> int:
    """blake2b with eight bytes of output, big-endian, as signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(T.LongType())
def digest(text: pd.Series) -> pd.Series:
    """``digest64`` of each text; null for null. Spark has no blake2b, so this leaves the JVM once per batch."""
    return pd.Series([None if t is None else digest64(t) for t in text], dtype="Int64")


def first_four_as_written(fen: Column) -> Column:
    """The first four fields, split at single blanks and joined by them again: nothing is normalised."""
    return F.array_join(F.slice(F.split(fen, " "), 1, 4), " ")


def parse_key(text: Column) -> Column:
    """The 64 bits a written key stands for, as signed number; null where it is no key.

    Digits only are decimal, signed or unsigned (leading zeros allowed); otherwise hexadecimal, with or without
    ``0x``, in either case. Outer blanks do not count. Values outside 64 bits are no keys.
    """
    word = stripped(text)
    decimal = F.when(word.rlike(r"^[+-]?0*\d{1,20}$"), word).cast("decimal(38,0)")
    top = F.lit("18446744073709551616").cast("decimal(38,0)")
    signed = F.when(decimal.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")), decimal)
    signed = signed.when((decimal > 0) & (decimal < top), decimal - top).cast("long")
    short = F.when(word.rlike(r"^[+-]?0*\d{1,18}$"), word).cast("long")
    hexa = F.regexp_extract(F.lower(word), r"^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    is_hex = (hexa != "") & ~word.rlike(r"^[+-]?\d+$")
    padded = F.lpad(hexa, 16, "0")
    high = F.conv(F.substr(padded, F.lit(1), F.lit(8)), 16, 10).cast("long")
    low = F.conv(F.substr(padded, F.lit(9), F.lit(8)), 16, 10).cast("long")
    return F.coalesce(short, signed, F.when(is_hex, F.shiftleft(high, 32).bitwiseOR(low)))


def unit_hash(seed: Column | int, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of SHA-256 of ``seed:text``: JVM-side, and the same in any SQL engine."""
    joined = F.concat_ws(":", (F.lit(seed) if isinstance(seed, int) else seed).cast("string"), text)
    return F.conv(F.substr(F.sha2(joined, 256), F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))
