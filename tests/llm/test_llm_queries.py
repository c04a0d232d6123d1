import pytest
from compare import DATA, needs_data, rows_of_query, rows_of_sql

import __spark_entry__
from plyforge.functions.keys import digest64
from plyforge.functions.position import usual_text
from plyforge.llm import queries

pytestmark = needs_data


def run(spark, name):
    return __spark_entry__.queries()[name](spark, str(DATA))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert rows_of_query(run(spark, name)) == rows_of_sql(queries.SQL[name])


def table(name, columns):
    return rows_of(f"SELECT {columns} FROM '{DATA}/{name}.parquet' ORDER BY rec_id")


def rows_of(sql):
    import duckdb

    return duckdb.sql(sql).fetchall()


def signed(text):
    text = text.strip()
    n = int(text) if text.lstrip("+-").isdigit() else int(text, 16)
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def all_records():
    """(rec_id, key, fen) of the three tables in order of rec_id."""
    old = [r for t in ("openings", "positions") for r in table(t, "rec_id, pos_key, fen")]
    return sorted(old + [(r, None if k is None else signed(k), f) for r, k, f in table("arrivals", "rec_id, pos_key, fen")])


def test_seen_keys_by_brute_force(spark):
    arrivals = {r for r, in table("arrivals", "rec_id")}
    seen, want = set(), []
    for rec, key, fen in all_records():
        key = key if key is not None or fen is None else digest64(" ".join(fen.split(" ")[:4]))
        if key is not None:
            if rec in arrivals and key in seen:
                want.append(rec)
            seen.add(key)
    assert sorted(r.rec_id for r in run(spark, "p1_found").collect()) == want


def test_linkage_by_brute_force(spark):
    arrivals = {r for r, in table("arrivals", "rec_id")}
    first, want = {}, []
    for rec, key, fen in all_records():
        ident = key if fen is None else digest64(usual_text(fen) or " ".join(fen.split(" ")[:4]))
        if ident is not None:
            if rec in arrivals and ident in first:
                want.append((first[ident], rec))
            first.setdefault(ident, rec)
    assert sorted(tuple(r) for r in run(spark, "p5_found").collect()) == sorted(want)


def test_encoding_and_mix_by_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from plyforge.llm import bpe

    library = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    docs = rows_of(f"SELECT doc_id, text, lower(trim(source)), src_dump FROM '{DATA}/documents.parquet'")
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t, _, _ in docs}
    assert {r.doc_id: list(r.ids) for r in run(spark, "p6_ids").collect()} == ids
    have = {}
    for d, _, source, dump in docs:
        if source is not None:
            at = (dump, source.replace("-", "_").replace(" ", "_"))
            have[at] = have.get(at, 0) + len(ids[d])
    targets = rows_of(f"SELECT target_id, mix_id, src_dump, source_name, target_weight, max_uses, budget_tokens FROM '{DATA}/mix_targets.parquet'")
    whole = {}
    for _, mix, _, _, weight, _, _ in targets:
        whole[mix] = whole.get(mix, 0) + weight
    want = sorted(t for t, mix, dump, s, w, uses, budget in targets if w / whole[mix] * budget > uses * have.get((dump, s), 0))
    assert sorted(r.target_id for r in run(spark, "p7_found").collect()) == want


@pytest.mark.parametrize("name", ["p1_rates", "p2_splits", "p3_report", "p3_sample", "p4_percentiles", "p4_all_dumps", "p7_mix", "p8_found"])
def test_other_queries_have_rows(spark, name):
    assert run(spark, name).count() > 0
