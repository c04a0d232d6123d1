"""Encoding with a public byte-level BPE tokenizer by a tokenization automaton.

The automaton accepts, of all token sequences that spell a text, exactly the one that byte-pair encoding gives. It
starts as one state that loops on all bytes. Each merge (a, b) -> c, in order of rank, inserts a gadget: the state
that a leads to is split into a copy without the arc b (a bare a is never again followed by a bare b), and wherever a
was allowed, c now is too, leading where b led. A state is kept as what was removed from the state it was split from,
so the automaton for 50,000 merges is two small tables; a transition is looked up once and then read from a table.

Every state accepts, so the token that ends a prefix is determined by that prefix: a pre-split word is encoded left to
right, following for each reached position the arcs whose bytes come next. The time is linear in the word's length.
Decoding emits the arcs' labels.

Nulls: a null text, like an empty one, has the empty list of ids. Bytes that are no UTF-8 count as U+FFFD. Special
tokens' strings are ordinary text. Vocabulary files are read where they lie (``path``) and never copied.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_SPACE = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of a text: contractions, letters, digits and other signs with at most one blank before them, runs of blanks.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)
CACHED_WORDS, CACHED_LENGTH = 300_000, 64
#: Transitions kept; the table is begun anew beyond, as it can be filled again from the gadgets.
CACHED_ARCS = 2_000_000


def _printable_bytes() -> dict[str, int]:
    """The characters in which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + n): b for n, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a vocabulary (token bytes -> id) and its merges ((left id, right id) by rank)."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[int, int]]):
        self.ids = vocabulary
        self.label = {i: b for b, i in vocabulary.items()}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        self.removed: dict[int, dict[int, int]] = {}  # token -> arcs removed from the state it leads to, with the rank
        self.table: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._insert(rank, a, b)
        starts = set()
        for token in self.ids:
            starts.update(token[:n] for n in range(1, len(token) + 1))
        self.starts = starts
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> Automaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _printable_bytes()
        token = {word: bytes(to_byte[ch] for ch in word) for word in model["vocab"] if all(ch in to_byte for ch in word)}
        ids = {token[word]: i for word, i in model["vocab"].items() if word in token}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        reached = {b"".join(map(token.get, p)) for p in pairs} | {bytes([b]) for b in range(256)}
        ids = {t: i for t, i in ids.items() if t in reached}
        return cls(ids, [(ids[token[a]], ids[token[b]]) for a, b in pairs])

    def _insert(self, rank: int, a: int, b: int) -> None:
        """The gadget of one merge; it does nothing where b cannot follow a (then the merge never applies)."""
        c = self.ids[self.label[a] + self.label[b]]
        if c in self.made or not self._follows(a, b, rank):
            return
        self.removed.setdefault(a, {})[b] = rank
        self.made[c] = (rank, a, b)

    def _gone(self, state: int, arc: int) -> int:
        """Rank from which ``arc`` is missing in the state that token ``state`` leads to; a large number if never."""
        before = 1 << 30
        while True:
            rank = self.removed.get(state, {}).get(arc)
            if rank is not None and rank < before:
                return rank
            origin = self.made.get(state)
            if origin is None:
                return 1 << 30
            before, state = min(before, origin[0]), origin[2]

    def _follows(self, state: int, arc: int, rank: int = 1 << 29) -> bool:
        """Whether the state after token ``state`` has ``arc`` at ``rank``: each left part was there when it was merged."""
        until = rank
        while True:
            if self._gone(state, arc) <= until:
                return False
            origin = self.made.get(arc)
            if origin is None:
                return True
            until, arc = min(until, origin[0]), origin[1]

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-split word."""
        whole = self.ids.get(data)
        if whole is not None and (whole in self.made or len(data) == 1):
            return [whole]
        n = len(data)
        last = [-1] * (n + 1)
        ids, starts, table, made = self.ids, self.starts, self.table, self.made
        for j in range(n):
            state = last[j]
            for i in range(j + 1, n + 1):
                piece = data[j:i]
                if piece not in starts:
                    break
                if last[i] >= 0:
                    continue
                arc = ids.get(piece)
                if arc is None or (arc not in made and i - j > 1):
                    continue
                if j:
                    key = state << 20 | arc
                    good = table.get(key)
                    if good is None:
                        if len(table) >= CACHED_ARCS:
                            table.clear()
                        good = table[key] = self._follows(state, arc)
                    if not good:
                        continue
                last[i] = arc
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.label[last[at]])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for word in WORDS.findall(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.word(word.encode("utf-8", "replace"))
                if len(word) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, Automaton] = {}


def automaton(path: str = DEFAULT_VOCABULARY) -> Automaton:
    """The automaton of a vocabulary file, built once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Automaton.load(path)
    return _LOADED[path]


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[str | None]:
    for value in batch.column(at):
        data = value.as_py()
        yield None if data is None else data.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every document; one row for each row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = automaton(path)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in _texts(batch, 1):
                flat += coder.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    rows = docs.select(key, F.col(text).cast("binary"))
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, kept: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``kept`` and ``tokens``, the number of ids of each document (0 for null and empty texts)."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = automaton(path)
        for batch in batches:
            counts = [len(coder.encode(t)) for t in _texts(batch, len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64())], names=[*kept, "tokens"])

    rows = docs.select(*kept, F.col(text).cast("binary"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], T.StructField("tokens", T.LongType())]))
