import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plyforge.llm import bpe, language

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not Path(bpe.DEFAULT_VOCABULARY).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def coder():
    return bpe.automaton()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


PIECES = ["a", "aa", "aaaa", "ab", "the", "ing", " ", "  ", "\n", "é", "ß", "日本", "🙂", "​", "\x1c", "\x85", "\xa0", "0", "12", "'s", "'S", "!!", "--", "e", "r", " the", "ж", "ение", "\t", "<|endoftext|>", "　"]


def test_automaton_equals_the_library(coder, library):
    coin = random.Random(9)
    texts = ["".join(coin.choice(PIECES) for _ in range(coin.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(coin.choice([coin.randint(97, 101), coin.randint(32, 0x2FFF)])) for _ in range(coin.randrange(50))) for _ in range(3000)]
    texts += ["ab" * 20_000, "a" * 5000, " " * 3000, "", "\n\n  x"]
    for t in texts:
        ids = coder.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids) == t


def test_small_merge_gadgets():
    vocabulary = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"aba": 257, b"aa": 258, b"aaa": 259}
    merges = [(97, 98), (256, 97), (97, 97), (258, 97)]
    auto = bpe.Automaton(vocabulary, merges)

    def by_merging(data):
        ids = list(data)
        for rank, (a, b) in enumerate(merges):
            out, i = [], 0
            while i < len(ids):
                if ids[i : i + 2] == [a, b]:
                    out.append(256 + rank)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    coin = random.Random(0)
    for _ in range(3000):
        word = bytes(coin.choice(b"aab") for _ in range(coin.randrange(1, 14)))
        assert auto.word(word) == by_merging(word)


def test_documents_have_defined_ids(spark, coder):
    rows = [(1, None), (2, ""), (3, " "), (4, "Hello <|endoftext|> " * 3000), (5, "é" * 70_000), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("x"), "tokens": F.lit(1)})
    got = {(r.doc_id, len(r.ids)): r.ids for r in bpe.encode_documents(df).collect()}
    assert len(got) == 6 and got[1, 0] == [] and got[2, 0] == [] and got[3, 1] == coder.encode(" ")
    assert coder.decode(next(v for (d, _), v in got.items() if d == 4)) == rows[3][1]
    counts = sorted(r.tokens for r in bpe.count_tokens(df, ["doc_id"]).collect())
    assert counts == sorted(len(v) for v in got.values())
    assert bpe.encode_documents(df.limit(0)).count() == 0


WORDS = {
    "en": "the knight went to a better square before white could answer with that move and nobody had seen it".split(),
    "es": "el caballo fue hacia una casilla mejor antes de que las blancas pudieran contestar con esa jugada nadie".split(),
    "fr": "le cavalier est parti vers une case meilleure avant que les blancs ne puissent répondre avec ce coup".split(),
    "ru": "конь ушёл на лучшее поле прежде чем белые могли ответить этим ходом и никто этого не видел".split(),
}


def sentence(lang, coin):
    start = coin.randrange(0, 6)
    words = WORDS[lang][start : start + coin.randrange(8, 12)]
    return (" ".join(words)).capitalize() + "."


@pytest.fixture(scope="module")
def field():
    coin = random.Random(3)
    docs = []
    for _ in range(200):
        lang = coin.choice(list(WORDS))
        said = lang if coin.random() > 0.15 else coin.choice(list(WORDS))  # some labels are wrong
        docs.append((" ".join(sentence(lang, coin) for _ in range(5)), language.LANGUAGES.index(said)))
    return language.fit(docs)


def test_held_out_sentences(field):
    coin = random.Random(77)
    right = total = 0
    for _ in range(200):
        lang = coin.choice(list(WORDS))
        (segs,) = language.segments(field, [sentence(lang, coin)])
        right += [s[1] for s in segs if s[4]] == [lang]
        total += 1
    assert right / total > 0.98


def test_mixed_texts(spark, field):
    coin = random.Random(5)
    en, es, fr, ru = (sentence(x, coin) for x in ("en", "es", "fr", "ru"))
    texts = [
        (1, f"{en} ({es}) {en}", "en"), (2, f"1. e4 e5 {{ {fr} }} 2. Nf3 {{ [%eval 0.3] }} Nc6 1-0", None), (3, f"<p>{ru.replace('.', '')} (Kd4, -1.21).</p>", "en"), (4, en.upper(), "EN-us"),
        (5, "2025-05-24T04:39:19 shard=00101 pos=15331", "zxx"), (6, None, "en"), (7, "", None), (8, " \n\t", ""), (9, f"{en} caballo {en}", "English"), (10, f"{es} " * 3000, "Spanish"),
        (11, fr.encode("utf-8").decode("cp1252", "replace"), "es"), (12, "amber-fox12 | salt_owl3 | 1-0", "en"), (13, f"{en}\n{fr}", "mul"),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").withColumns({"segments": F.lit(1), "confidence": F.lit(2)})
    labelled = language.label_documents(docs, field)
    found = sorted(tuple(r) for r in language.unnamed(docs, labelled).collect())
    assert found == [(1, "es"), (2, "fr"), (3, "ru"), (11, "fr"), (13, "en"), (13, "fr")]
    rows = {r.doc_id: r for r in labelled.collect()}
    assert len(rows) == 13 and rows[6].lang is None and rows[6].segments == [] and rows[8].lang is None and rows[5].segments == []
    assert rows[1].lang == "en" and 0.5 < rows[1].confidence <= 1 and len(rows[10].segments) == 3000
    assert language.label_documents(docs.limit(0), field).count() == 0


def test_labels_name_languages(spark):
    cases = {"en": "en", " EN ": "en", "en-US": "en", "en_GB": "en", "eng": "en", "English": "en", "español": "es", "fra": "fr", "Deutsch": "de", "русский": "ru", "pt-BR": "pt", "italiano": "it",
             "und": None, "mul": None, "xx": None, "??": None, "": None, None: None, "unknown": None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert [r[0] for r in df.select(language.named_language(F.col("l"))).collect()] == list(cases.values())


def test_training_on_nothing(spark):
    docs = spark.createDataFrame([(1, "some words without a label here", None)], "doc_id bigint, text string, lang string")
    assert language.label_documents(docs).count() == 1


def long_text(words, seed=5):
    """One sentence of the words the field was fitted to, in the order of its sentences."""
    start = seed % 5
    return " ".join((WORDS["en"] * (words // len(WORDS["en"]) + 2))[start : start + words]) + "."


@pytest.mark.parametrize("words", [450, 5000, 60_000])
def test_a_long_sentence_is_one(field, words):
    """However long, a sentence is one with one number, and its words have the posteriors of one lattice."""
    (got,) = language.segments(field, [long_text(words)])
    assert sum(s[3] for s in got) == words and {s[0] for s in got} == {1} and got[0][1] == "en"
    assert all(s[4] for s in got if s[3] == words)


def test_messages_do_not_depend_on_padding(field):
    """Posteriors of a batch of lines of different lengths equal those of each line by itself, to 1e-9."""
    import numpy as np

    texts = [long_text(n, n).rstrip(".").split() for n in (3, 40, 700, 2500)]
    lines = [(w, [i > 0 and i % 9 == 0 for i in range(len(w))]) for w in texts]
    together, *_ = field.posterior(*language._padded(lines, field.emissions))
    for k, line in enumerate(lines):
        alone, *_ = field.posterior(*language._padded([line], field.emissions))
        assert np.abs(together[k, : len(line[0])] - alone[0]).max() < 1e-9


def test_long_words_tags_and_asides_are_taken_whole(field):
    tag = "<a href='" + "x" * 5000 + "'>"
    assert language.clean(f"one {tag} two").split() == ["one", "two"]
    (sentence,) = list(language.sentences("Black was better (" + "12. Qd4 +0.31 " * 30 + ") in the final position."))
    assert sentence[1] == ["black", "was", "better", "in", "the", "final", "position"] and sentence[2]
    a, b = "a" * 40 + "ing" * 50, "a" * 40 + "ung" * 50
    assert len(set(language._features(a)) ^ set(language._features(b))) > 4
