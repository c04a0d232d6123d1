"""Language of documents and of the segments of mixed texts, by a linear-chain conditional random field over words.

A text is cleaned (markup, entities, bytes read in the wrong encoding, invisible characters), cut into lines of words,
and each word labelled with a language by forward-backward: emissions are sums of learned weights of the word itself
(lexicon), its prefixes, suffixes and character trigrams; transitions are learned apart for words within a sentence
and for the first word of the next. Words with digits or other signs (names, moves, fields of logs) say nothing.

The field is fitted to a bounded sample of the labelled documents. Labels being wrong at times, the sample is first
relabelled sentence by sentence with word counts, so that a wrong label is outvoted. Everything else sees all texts.

A segment is a maximal run of words of one language; its confidence is the mean posterior of its words. A *whole
sentence* is a segment of at least ``MIN_WORDS`` words of a sentence ended as such (or of twice as many words), in which no other language has as
many (these are borrowed words), or else one of twice as many words at the sentence's beginning or end.

Nulls: a null, empty or blank text has no segments, and its document no language. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions.refs import stripped

LANGUAGES = ("de", "en", "es", "fr", "it", "pt", "ru")
# What names a language, besides its two letters: three-letter codes, English and own names.
NAMES = {
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "it": ("ita", "italian", "italiano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
}

#: Labelled documents the field is fitted to, each with its whole text.
SAMPLE_DOCUMENTS = 3000
#: Words of a padded batch of lines, and characters up to which a word's features are kept for the next time.
BATCH_WORDS, CACHED_LENGTH = 20_000, 64
BITS = 16
MIN_WORDS = 4
EPOCHS = 6


def named_language(lang: Column) -> Column:
    """The language a label names: two- or three-letter codes with or without region, or names; null otherwise."""
    word = F.lower(stripped(lang))
    head = F.regexp_extract(word, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    out = None
    for code, names in NAMES.items():
        hit = head.isin(code, *[n for n in names if len(n) == 3]) | word.isin(*names)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_MOJIBAKE = re.compile("[ÂÃÐÑâ][\u0080-¿Œ-™]")
_BYTES = {bytes([b]).decode("cp1252", "ignore"): b for b in range(128, 256)}
_UNIT = re.compile(r"[\n\r{}()\[\]«»“”„|<>]+|(?:^|(?<=\s))\"|\"(?=\s|$)")
_TOKEN = re.compile(r"[^\s.,;:!?…]+|[.!?…]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’‘`´-][^\W\d_]+)*['’]?")
_INTEGER = re.compile(r"\d+")
#: A bracket without any word of two small letters (a move, an evaluation) is part of the sentence around it.
_ASIDE = re.compile(r"\((?:(?![^\W\d_A-Z]{3})[^()\n])*\)")
_CASTLES = re.compile(r"o-o(?:-o)?")


def _mended(match: re.Match) -> str:
    run = match[0]
    data = bytes(_BYTES.get(c, ord(c) & 255) for c in run)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return run


_RUN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-•…‰‹›€™]{2,}")


def clean(text: str) -> str:
    """Text without markup, entities and invisible characters, with doubly encoded characters mended."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    if _MOJIBAKE.search(text):
        text = _RUN.sub(_mended, text)
    return _INVISIBLE.sub("", text)


_JUDGED: dict[str, str | None] = {}


def _word_of(token: str) -> str | None:
    """The word a token is, in lower case; none for moves, numbers and other signs."""
    word = token.lower().replace("’", "'") if _WORD.fullmatch(token) and not _CASTLES.fullmatch(token.lower()) else None
    if len(token) <= CACHED_LENGTH:
        if len(_JUDGED) > 500_000:
            _JUDGED.clear()
        _JUDGED[token] = word
    return word


def sentences(text: str) -> Iterator[tuple[int, list[str], bool]]:
    """(line, words, ended) of every sentence; only words of letters are kept, in lower case.

    Lines, comments, brackets and quotes hold sentences of their own. A full stop after a whole number ends none.
    """
    judged = _JUDGED.get
    for line, unit in enumerate(_UNIT.split(_ASIDE.sub(" ", clean(text)))):
        words: list[str] = []
        before = ""
        for token in _TOKEN.findall(unit):
            if token[0] in ".!?…":
                if token != "." or not _INTEGER.fullmatch(before):
                    if words:
                        yield line, words, True
                    words = []
            else:
                word = judged(token, token)
                if word is token:  # not judged yet, or a word as it stands
                    word = _word_of(token)
                if word is not None:
                    words.append(word)
            before = token
        if words:
            yield line, words, False


_FEATURES: dict[str, np.ndarray] = {}


def _features(word: str) -> np.ndarray:
    """Places of the word's features in the table of weights."""
    got = _FEATURES.get(word)
    if got is None:
        names = ["w:" + word] + [f"p:{word[:n]}" for n in (1, 2, 3) if len(word) > n] + [f"s:{word[-n:]}" for n in (1, 2, 3, 4) if len(word) > n]
        ends = f"^{word}$"
        names += [f"t:{ends[i : i + 3]}" for i in range(len(ends) - 2)]
        got = np.unique(np.array([zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names]))
        if len(_FEATURES) > 500_000:
            _FEATURES.clear()
        if len(word) <= CACHED_LENGTH:
            _FEATURES[word] = got
    return got


class Field:
    """Weights of the field: emission (features x languages), transition within and between sentences."""

    def __init__(self) -> None:
        k = len(LANGUAGES)
        self.emit = np.zeros((1 << BITS, k), np.float32)
        self.inside = np.zeros((k, k))
        self.between = np.zeros((k, k))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, k), np.float32)

    def emission(self, word: str) -> np.ndarray:
        return self.emit[_features(word)].sum(0)

    def emissions(self, words: list[str]) -> np.ndarray:
        """The emissions of words, of which those met before are rows of a table."""
        if len(self.rows) > 500_000:
            self.rows.clear()
        rows, places = self.rows, []
        for word in words:
            key = word if len(word) <= CACHED_LENGTH else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            row = rows.get(key)
            if row is None:
                row = rows[key] = len(rows)
                if row == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[row] = self.emission(word)
            places.append(row)
        return self.table[places]

    def posterior(self, score: np.ndarray, fresh: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over padded sequences (n, length, languages); ``fresh`` marks first words of sentences.

        Gives the posteriors of words, and both messages: the one from the words before and the one from those after.
        Only vectors are kept for a word, so a sequence may be as long as a text.
        """
        n, length, k = score.shape
        local = np.exp(score - score.max(2, keepdims=True))
        inside, between = np.exp(self.inside), np.exp(self.between)
        first = fresh[:, :, None]
        ahead, back = np.empty((n, length, k)), np.ones((n, length, k))
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            before = ahead[:, t - 1]
            a = np.where(first[:, t], before @ between, before @ inside) * local[:, t]
            ahead[:, t] = a / a.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            after = local[:, t + 1] * back[:, t + 1]
            b = np.where(first[:, t + 1], after @ between.T, after @ inside.T)
            back[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        word = ahead * back
        word /= word.sum(2, keepdims=True)
        return word, ahead, local * back

    def transitions(self, ahead: np.ndarray, after: np.ndarray, fresh: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The expected transitions within and between sentences, from the messages of ``posterior``."""
        step = np.exp(np.stack([self.inside, self.between]))[fresh[:, 1:].astype(int)]
        moves = ahead[:, :-1, :, None] * step * after[:, 1:, None, :]
        moves /= np.maximum(moves.sum((2, 3), keepdims=True), 1e-300)
        moves *= mask[:, 1:, None, None]
        later = fresh[:, 1:, None, None]
        return (moves * ~later).sum((0, 1)), (moves * later).sum((0, 1))


def _padded(lines: list[tuple[list, list[bool]]], emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = max(len(w) for w, _ in lines)
    score = np.zeros((len(lines), length, len(LANGUAGES)))
    fresh, mask = np.zeros((len(lines), length), bool), np.zeros((len(lines), length), bool)
    for i, (words, starts) in enumerate(lines):
        score[i, : len(words)] = emissions(words)
        fresh[i, : len(words)], mask[i, : len(words)] = starts, True
    return score, fresh, mask


def _relabelled(docs: list[tuple[str, int]], rounds: int = 3) -> list[list[tuple[int, list[str], int]]]:
    """Sentences (line, words, language) of labelled texts, labelled by word counts; doubtful ones are left out."""
    k = len(LANGUAGES)
    split = [[(line, words) for line, words, _ in sentences(text)] for text, _ in docs]
    flat = [words for s in split for _, words in s]
    if not flat:
        return [[] for _ in docs]
    ids: dict[str, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for words in flat for w in words])
    sizes = np.array([len(words) for words in flat])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    label = np.repeat([lang for _, lang in docs], [len(s) for s in split])
    sure = np.ones(len(flat), bool)
    for _ in range(rounds):
        kept = np.repeat(sure, sizes)
        counts = np.bincount(word[kept] * k + np.repeat(label, sizes)[kept], minlength=len(ids) * k).reshape(-1, k).astype(float)
        total, met = counts.sum(0), counts.sum(1) > 0
        total = total if met.any() else np.ones(k)
        known = total > 0
        log = np.where(known, np.log((counts + 0.05) / (total + 0.05 * met.sum())), -50.0) * met[:, None]
        score = np.add.reduceat(log[word], starts) + np.where(known, 0.0, -1e9)
        label = score.argmax(1)
        top = np.partition(score, k - 2, axis=1)
        sure = top[:, k - 1] - top[:, k - 2] > 3.0
    each = iter(zip(label.tolist(), sure.tolist()))
    out = []
    for s in split:
        judged = [(line, words, *next(each)) for line, words in s]
        out.append([(line, words, y) for line, words, y, ok in judged if ok])
    return out


def fit(docs: list[tuple[str, int]], epochs: int = EPOCHS, batch: int = 256, rate: float = 0.3, seed: int = 7) -> Field:
    """Fit the field to labelled texts (text, index of language) by stochastic gradient (AdaGrad) on the log-likelihood."""
    field, k = Field(), len(LANGUAGES)
    lines: list[tuple[list[str], list[bool], list[int]]] = []
    for doc in _relabelled(docs):
        # consecutive sentences of a document make sequences of about 60 words; a longer sentence is one by itself
        words: list[str] = []
        fresh: list[bool] = []
        gold: list[int] = []
        for _, s, y in doc:
            if words and len(words) + len(s) > 60:
                lines.append((words, fresh, gold))
                words, fresh, gold = [], [], []
            words, fresh, gold = words + s, fresh + [bool(words)] + [False] * (len(s) - 1), gold + [y] * len(s)
        if words:
            lines.append((words, fresh, gold))
    if not lines:
        return field
    coin = np.random.default_rng(seed)
    squares, turned = np.full(field.emit.shape, 1e-8, np.float32), [np.full((k, k), 1e-8), np.full((k, k), 1e-8)]
    for _ in range(epochs):
        order = coin.permutation(len(lines))
        order = order[np.argsort([len(lines[i][0]) // 8 for i in order], kind="stable")]
        batches: list[list[int]] = [[]]
        widest = 0
        for i in order:
            widest = max(widest, len(lines[i][0]))
            if batches[-1] and (len(batches[-1]) == batch or widest * (len(batches[-1]) + 1) > BATCH_WORDS):
                batches.append([])
                widest = len(lines[i][0])
            batches[-1].append(i)
        coin.shuffle(batches)
        for chosen in batches:
            some = [lines[i] for i in chosen]
            types: dict[str, int] = {}
            places = [[types.setdefault(w, len(types)) for w in words] for words, _, _ in some]
            feats = [_features(w) for w in types]
            flat, owner = np.concatenate(feats), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
            ends = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
            table = np.add.reduceat(field.emit[flat].astype(float), ends, axis=0)
            score, fresh, mask = _padded([(p, f) for p, (_, f, _) in zip(places, some)], table.__getitem__)
            word, ahead, after = field.posterior(score, fresh, mask)
            inside, between = field.transitions(ahead, after, fresh, mask)
            gold = np.zeros_like(word)
            for i, (_, _, y) in enumerate(some):
                gold[i, np.arange(len(y)), y] = 1
            error = (gold - word) * mask[:, :, None]
            n = mask.sum()
            where, wrong = np.concatenate([np.array(p) for p in places]), error[mask]
            grad = np.stack([np.bincount(where, wrong[:, y], len(feats)) for y in range(k)], axis=1)[owner] / n
            step = np.stack([np.bincount(flat, grad[:, y], 1 << BITS) for y in range(k)], axis=1).astype(np.float32)
            step -= 1e-6 * field.emit
            squares += step**2
            field.emit += rate * step / np.sqrt(squares)
            pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
            later = fresh[:, 1:, None, None]
            for w, expected, seen, sq in ((field.inside, inside, (pair * ~later).sum((0, 1)), turned[0]), (field.between, between, (pair * later).sum((0, 1)), turned[1])):
                g = (seen - expected) / n - 1e-5 * w
                sq += g**2
                w += rate * g / np.sqrt(sq)
        # transitions are kept within bounds so that one word never decides a line
        field.inside, field.between = np.clip(field.inside, -6, 6), np.clip(field.between, -3, 3)
    field.emit = field.emit.astype(np.float32)
    return field


def segments(field: Field, texts: Iterable[str | None]) -> list[list[tuple[int, str, float, int, bool]]]:
    """For each text its segments: (sentence, language, confidence, words, whole)."""
    lines: list[tuple[list[str], list[bool]]] = []
    spans: list[tuple[int, int, int, int, bool]] = []  # text, line, from, to, ended
    for d, text in enumerate(texts):
        if not text:
            continue
        last = None
        for line, words, ended in sentences(text):
            if last != line:
                lines.append(([], []))
                last = line
            have = lines[-1]
            spans.append((d, len(lines) - 1, len(have[0]), len(have[0]) + len(words), ended))
            have[1].extend([bool(have[0])] + [False] * (len(words) - 1))
            have[0].extend(words)
    posts: list[np.ndarray | None] = [None] * len(lines)
    bests: list[np.ndarray | None] = [None] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i][0]))
    at = 0
    while at < len(order):
        some = [order[at]]  # lines of like length, as many as fill a batch
        while len(some) < 512 and at + len(some) < len(order) and len(lines[order[at + len(some)]][0]) * (len(some) + 1) <= BATCH_WORDS:
            some.append(order[at + len(some)])
        word, _, _ = field.posterior(*_padded([lines[i] for i in some], field.emissions))
        for i, p, b in zip(some, word, word.argmax(2)):
            posts[i], bests[i] = p[: len(lines[i][0])], b[: len(lines[i][0])]
        at += len(some)
    out: list[list[tuple[int, str, float, int, bool]]] = []
    numbers: dict[int, int] = defaultdict(int)
    result: dict[int, list] = defaultdict(list)
    for d, line, a, b, ended in spans:
        p, best = posts[line][a:b], bests[line][a:b]
        numbers[d] += 1
        lang, n = int(best[0]), b - a
        if (best == lang).all():
            whole = n >= MIN_WORDS and (ended or n >= 2 * MIN_WORDS)
            result[d].append((numbers[d], LANGUAGES[lang], float(np.add.reduce(p[:, lang])) / n, n, whole))
            continue
        edges = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), n]
        longest = sorted(y - x for x, y in zip(edges, edges[1:]))
        for x, y in zip(edges, edges[1:]):
            lang = int(best[x])
            whole = (ended or n >= 2 * MIN_WORDS) and y - x >= MIN_WORDS and (y - x == longest[-1] and longest[-2] < MIN_WORDS or y - x >= 2 * MIN_WORDS and (x == 0 or y == n))
            result[d].append((numbers[d], LANGUAGES[lang], float(np.add.reduce(p[x:y, lang])) / (y - x), y - x, bool(whole)))
    for d in range(max(result, default=-1) + 1):
        out.append(result.get(d, []))
    return out


SEGMENT = "array<struct<sentence:int,lang:string,confidence:double,words:int,whole:boolean>>"


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Field:
    """Fit to at most ``documents`` labelled documents (doc_id, text, lang), whole, those of the smallest hashes; 0 is none."""
    named = docs.select("doc_id", "text", named_language(F.col("lang")).alias("lang")).filter("lang is not null and text is not null")
    rows = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).collect()
    return fit([(r.text, LANGUAGES.index(r.lang)) for r in rows])


def label_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, lang, confidence, segments) for each document; ``lang`` is that of most words, null without any."""
    spark = docs.sparkSession
    field = field or train(docs)
    shared = spark.sparkContext.broadcast((field.emit, field.inside, field.between))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.emit, own.inside, own.between = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [None if v is None else v.decode("utf-8", "replace") for v in part.column(1).to_pylist()]
                found = segments(own, texts)
                found += [[] for _ in range(len(texts) - len(found))]
                main = []
                for segs in found:
                    weight: dict[str, list[float]] = defaultdict(lambda: [0, 0.0])
                    for _, lang, conf, words, _ in segs:
                        weight[lang][0] += words
                        weight[lang][1] += words * conf
                    lang = max(weight, key=lambda x: (weight[x][0], x), default=None)
                    main.append((lang, weight[lang][1] / sum(n for n, _ in weight.values()) if lang else None))
                names = ("sentence", "lang", "confidence", "words", "whole")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([m[0] for m in main], pa.string()),
                        pa.array([m[1] for m in main], pa.float64()),
                        pa.array([[dict(zip(names, s)) for s in segs] for segs in found], out_segments),
                    ],
                    names=["doc_id", "lang", "confidence", "segments"],
                )

    out_segments = pa.list_(
        pa.struct([("sentence", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("whole", pa.bool_())])
    )
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, lang string, confidence double, segments {SEGMENT}")


def unnamed(docs: DataFrame, labelled: DataFrame, confidence: float = 0.6) -> DataFrame:
    """(doc_id, lang): each language of a whole sentence that the document's own label does not name."""
    whole = F.filter("segments", lambda s: s["whole"] & (s["confidence"] >= confidence))
    found = labelled.select("doc_id", F.explode(F.array_distinct(F.transform(whole, lambda s: s["lang"]))).alias("lang"))
    named = docs.select("doc_id", named_language(F.col("lang")).alias("named"))
    return found.join(named, "doc_id").filter("named is null or named != lang").select("doc_id", "lang")
