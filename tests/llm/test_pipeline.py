"""The stages against plain versions of what they decide, each on its own input."""

from __future__ import annotations

import ast
from pathlib import Path

import corpus_pipeline
from netloom.llm import decontam, queries, toxicity
from netloom.storage import Store

from .test_operators import components


def test_pipeline(spark, sf):
    store = Store(spark)
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = store.put(stage(spark, before, sf))
        kept[name] = (before, after)
        before = after
    for name, (a, b) in kept.items():
        if name != "sharding":
            assert b.columns == columns
            assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()}
    a, b = kept["toxicity"]
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(a, queries.table(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in b.collect()} == {d for d, p in scores.items() if not p}
    a, b = kept["ngram_jaccard"]
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert {r.doc_id for r in b.collect()} == {d for d, _, c in components(rows, 5, 80) if d == c}
    a, b = kept["decontamination"]
    items = [decontam.plain(r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    gone = {r.doc_id for r in a.collect()} - {r.doc_id for r in b.collect()}
    assert gone == {r.doc_id for r in a.collect() if any(p in decontam.plain(r.text) for p in items)}
    a, b = kept["mixing"]
    size = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert 0.5 * size(a) < size(b) <= queries.PIPELINE_SHARE * size(a)
    a, b = kept["sharding"]
    assert sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())
    assert {r.doc_id: (r.shard, r.slot) for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: (r.shard, r.slot) for r in b.collect()}


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).parents[2]
    for path in (root / "netloom").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), path
