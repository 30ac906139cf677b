"""Nulls, empty tables, repeated rows and clashing columns for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import decontam, divergence, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, queries, runs, sharding, token_count, toxicity, warc
from netloom.storage import Store

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "src0", 10),
    (1, "the quick brown fox jumps over the lazy dog again", "en", "src0", 10),
    (2, None, None, None, None),
    (None, "text without an id", "fr", "src3", 1),
    (None, None, None, None, None),
    (3, "", "en", "src1", 0),
    (4, " \n\t ", "de", "other", 4),
    (5, "x" * 200_000, "en", "src2", 200_000),
    (6, "word " * 30_000, "en", "src12", 150_000),
    (7, "\0▁😀é", "es", "src19", 4),
]
CLASH = (
    *("key", "class", "gram", "content", "salt", "pii", "tokens", "label", "shard", "part", "block", "votes", "level_0", "draw", "epoch"),
    *("stays", "end", "leaf_0", "dropped", "row", "parts", "first", "place", "n", "at", "text_key", "check", "item_id", "hot", "head", "digest"),
    *("keep", "copied", "free", "revisit", "refers_to", "archive", "runs", "collapsed", "term", "docs", "gid", "tile", "v", "own", "all"),
    *("__stays", "__last", "__leaf_0", "__shard", "size", "doc", "total", "features", "weight", "places", "least"),
)


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 1), (5, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "brown fox jumps over the lazy dog"), (2, None), (None, "zzz"), (3, ""), (4, "ab")], "item_id long, text string")


def archived(spark, docs):
    folder = Store(spark).folder()
    warc.write_archives(docs, folder, "doc_id", "source", "text")
    return warc.index_of(warc.read_archives(spark, folder))


OPERATORS = {
    "runs": lambda s, d: runs.find_runs(d),
    "archives": archived,
    "pii": lambda s, d: pii.pii_report(d),
    "tokens": lambda s, d: token_count.count_tokens(d, queries.tokenizer_file()),
    "jaccard": lambda s, d: jaccard_join.near_duplicates(d, 4, 85),
    "quality": lambda s, d: quality.score_quality(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "dedup": lambda s, d: exact_dedup.dedup_exact(d),
    "shards": lambda s, d: sharding.assign_shards(d),
    "lines": lambda s, d: line_dedup.drop_boilerplate(d, "doc_id", line_dedup.host_of(F.col("source")), line_dedup.lines_of_html(F.col("text"))),
}
OTHERS = {
    "audit": lambda s, d: divergence.audit_sources(d, min_docs=1),
    "mixing": lambda s, d: mixing.mix(d, queries.TREE, queries.TREE_WEIGHTS, 0.8, 2, queries.TREE_DEFAULTS),
    "passages": lambda s, d: decontam.contaminated(d, benchmark(s)),
    "redact": lambda s, d: pii.redact(pii.find_pii(d)),
    "unique": lambda s, d: exact_dedup.unique_rows(d),
}


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.mark.parametrize("name", [*OPERATORS, *OTHERS])
def test_odd_rows(spark, name):
    run = {**OPERATORS, **OTHERS}[name]
    df = spark.createDataFrame(ROWS, DOCS).repartition(3)
    plain = sorted(map(str, run(spark, df).collect()))
    assert len(plain) == len(ROWS) or name in OTHERS
    got = run(spark, clashing(df))
    if name in ("redact", "unique"):
        got = got.drop(*CLASH)
        plain = [x for x in plain] if name == "unique" else sorted(map(str, run(spark, df).drop("pii").collect()))
    assert sorted(map(str, got.collect())) == plain


@pytest.mark.parametrize("name", [*OPERATORS, *OTHERS])
def test_empty_table(spark, name):
    assert {**OPERATORS, **OTHERS}[name](spark, spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, tmp_path, k):
    d = str(tmp_path)
    labels(spark).write.parquet(f"{d}/labels.parquet")
    benchmark(spark).write.parquet(f"{d}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    df = spark.createDataFrame(ROWS, DOCS)
    last = k == len(corpus_pipeline.STAGES) - 1
    out = stage(spark, clashing(df), d)
    if not last:
        assert out.columns == clashing(df).columns
        assert sorted(map(str, out.drop(*CLASH).collect())) == sorted(map(str, stage(spark, df, d).collect()))
    assert stage(spark, spark.createDataFrame([], DOCS), d).collect() == []
    ids = [r.doc_id for r in out.collect()]
    if name == "decontamination":
        assert 1 not in ids and len(ids) == len(ROWS) - 2
