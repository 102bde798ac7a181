"""Registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ridgeline.llm.queries import ORACLES, QUERIES
from ridgeline.llm.sharding import SHARDS
from tests.llm.test_llm import brute_contamination, brute_groups, jump
from tests.test_oracles import _norm


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    # The SQL of repeated strings hashes every window of 200 bytes, so it gets the smallest tables.
    sf = "/root/testdata/sf0.001" if name == "op13_suffix_dedup" else "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols, df = [d[0] for d in cur.description], QUERIES[name](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cur.fetchall(), cols)


def test_all_operators_are_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit("mine"), "_key": F.lit(1), "found": F.lit(None).cast("string")})
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf).cache()
        kept[name] = docs.collect()
        assert docs.columns[:len(columns)] == columns if name != "sharding" else set(columns) < set(docs.columns)
    rows = [(r.doc_id, r.text) for r in kept["quality"]]
    groups = dict(eval(g)[::2] for g in brute_groups(rows, 5, 80))
    assert sorted(r.doc_id for r in kept["near_copies"]) == sorted(i for i, c in groups.items() if i == c)
    clean = sorted(r.doc_id for r in kept["near_copies"] if not brute_contamination(r.text, items)[1])
    assert sorted(r.doc_id for r in kept["decontamination"]) == clean
    mixed = [r.doc_id for r in kept["mixing"]]
    assert set(mixed) <= set(clean) and max(map(mixed.count, mixed)) <= 3
    assert sorted((r.doc_id, r["shard"]) for r in kept["sharding"]) == sorted((i, jump(i, SHARDS)) for i in mixed)


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_rows_that_are_awkward(spark, sf):
    rows = [(None, "a b c d e f", None, None, None), (None, None, "en", "x", 0), (1, None, None, "x", 0), (1, None, None, "x", 0), (2, "", None, None, 0), (3, "word " * 30000, "en", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in P.STAGES[1:]:
        docs = stage(spark, docs, sf)
    assert docs.count() >= 1
