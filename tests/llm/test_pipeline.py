import os

import helpers as H
import numpy as np
import pytest

import corpus_pipeline as pipeline
from ledgerline.llm import decontam, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.materialize(stage(spark, docs, DATA), name)
        out[name] = (before, docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay_until_the_last(spark, stages):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_lines_stage_equals_brute_force(stages):
    before, after = stages["line_dedup"]
    want = {d: kept for d, (_, _, kept) in H.repeated_lines(list(texts(before).items())).items()}
    assert texts(after) == want and all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_dedup_stage_equals_brute_force(stages):
    before, after = stages["near_dedup"]
    want = H.near_duplicates(list(texts(before).items()), 5, 80, 100)
    assert set(texts(after)) == {d for d, (_, c) in want.items() if c == d}


def copies(texts, items):
    """Every text aligned with every item, and nothing sifted before."""
    split, found = {d: decontam.words(t or "") for d, t in texts.items()}, set()
    for i, item in items:
        target = decontam.words(item or "")
        number = {w: n for n, w in enumerate(dict.fromkeys(target), 1)}
        if target:
            scores = decontam.align(np.array([number[w] for w in target]), *(np.array([number.get(w, 0) for w in ws], np.int64) for ws in split.values()))
            n = len(target)
            found |= {(d, i) for d, score in zip(split, scores.tolist(), strict=True) if score >= max(n, 2 * min(n, 3))}
    return found


def test_decontamination_stage_equals_brute_force(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = copies(texts(before), items)
    assert found and set(texts(after)) == set(texts(before)) - {d for d, _ in found}


def test_decontamination_query_equals_brute_force(spark):
    every = texts(spark.read.parquet(f"{DATA}/documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {(r["doc_id"], r["item_id"]) for r in queries.op6_decontamination(spark, DATA).collect()} == copies(every, items)


def test_quality_stage_keeps_clean_documents_and_drops_others(spark):
    """On a table large enough for the models to tell them apart; on the smallest one all stay."""
    data = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = set(texts(pipeline.quality(spark, docs, data)))
    assert kept < set(texts(docs))
    rows = spark.read.parquet(f"{data}/labels.parquet").collect()
    clean = {r["doc_id"] for r in rows if r["quality"] == 1 and not r["toxic"]}
    bad = {r["doc_id"] for r in rows} - clean
    assert len(clean & kept) >= 0.99 * len(clean) and len(bad - kept) >= 0.4 * len(bad)
    assert {r["doc_id"] for r in queries.op4_quality(spark, data).collect()} == kept


@pytest.mark.parametrize("rows", [H.odd_documents(), []])
def test_stages_on_odd_tables(spark, rows):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and no rows at all."""
    docs = H.frame(spark, rows).selectExpr("*", "cast(length(text) as int) n_chars", "1 as _w", "2 as key", "3 as log_weight", "4 as _kept", "5 as n_removed", "6 as n_lines", "7 as salt")
    given = {r["doc_id"] for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.materialize(stage(spark, docs, DATA), name)
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= given and (name == "packing" or docs.columns == before.columns)
        assert name in ("quality", "near_dedup", "decontamination") or left == {r["doc_id"] for r in before.collect()}


def test_packing_stage_holds_all_documents(stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == set(texts(before))


def test_run_gives_the_last_stage(spark, stages):
    assert pipeline.run(spark, DATA).count() == stages["packing"][1].count()


def test_every_operator_has_a_query(spark):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_line_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op2_line_dedup"])
    got = queries.op2_line_dedup(spark, DATA)
    key = lambda names, r: tuple(r[names.index(c)] for c in sorted(names))
    assert sorted(key(got.columns, r) for r in got.collect()) == sorted(key(want.columns, r) for r in want.fetchall())
    assert os.path.exists(DATA)
