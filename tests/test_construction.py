"""Networks from raw links to groups, on tables small enough to follow by hand."""

from __future__ import annotations

import pytest

from netloom.operators import construction

LINK = "protein1 string, protein2 string, combined_score int, experimental int, coexpression int, database int, textmining int, row_id long"
MAP = "uniprot string, db string, db_id string, line_no long"


def link(a, b, i, score=900, **channels):
    return (a, b, score, channels.get("experimental", 200), channels.get("coexpression"), 0, 0, i)


@pytest.fixture(scope="module")
def sources(spark):
    links = [link("4932.Y1", "4932.Y2", 1), link("4932.Y2", "4932.Y1", 2), link("4932.Y2", "4932.Y3", 3), link("4932.Y1", "4932.Y3", 4), link("4932.Y3", "4932.Y4", 5), link("4932.Y4", "4932.Y5", 6), link("4932.Y1", "4932.Y9", 7), link(None, "4932.Y1", 8), link("4932.Y5", "4932.Y1", 9, 699), link("4932.Y5", "4932.Y2", 10, experimental=90), link("4932.Y5", "4932.Y2", 11, experimental=None)]
    mapping = [(f"P{i}", "STRING", f"4932.Y{i}", i) for i in (1, 2, 3, 4)] + [("P4", "STRING", "4932.Y5", 5), ("Q1", "STRING", "4932.Y1", 6), ("P1", "Gene_OrderedLocusName", "YA", 7), ("P2", "ORF", "YB", 8), ("P3", "Gene_Name", "Gc", 9), ("P4", "Gene_Name", "gd", 10), ("P1", "Gene_Name", "second", 11)]
    expression = [("YA", [1.0, 2.0, 3.0], 1), ("YB", [2.0, 4.0, 6.5], 2), ("gC", [3.0, 1.0, 2.0], 3), ("GD", [1.0, 1.0, 1.0], 4), ("second", [9.0, 1.0, 0.0], 5), ("nobody", [1.0, 2.0, 3.0], 6), (None, None, 7)]
    terms = [("P1", "a"), ("P1", "b"), ("P2", "a"), ("P2", "a"), ("P3", "b"), ("P4", "b"), (None, "a"), ("P1", None)]
    places = [("P1", "n"), ("P2", "n"), ("P3", "n"), ("P3", "m"), ("P4", "m"), ("X", "n"), (None, "n")]
    f = spark.createDataFrame
    return construction.Sources(f(links, LINK), f(mapping, MAP), f(expression, "gene string, v array<double>, row_id long"), f(terms, "protein string, term string"), f(places, "protein_id string, term string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_links_count_once_and_keep_loops(sources):
    assert rows(construction.mapped_links(sources.links, sources.mapping)) == [("P1", "P2"), ("P1", "P3"), ("P2", "P3"), ("P3", "P4"), ("P4", "P4")]


def test_links_below_other_thresholds(sources):
    got = rows(construction.mapped_links(sources.links, sources.mapping, min_score=600, min_channel=80))
    assert ("P1", "P4") in got and ("P2", "P4") in got


def test_the_first_gene_of_an_accession_gives_its_profile(sources):
    got = dict(rows(construction.expression_profiles(sources.expression, sources.mapping, "yeast")))
    assert got == {"P1": [1.0, 2.0, 3.0], "P2": [2.0, 4.0, 6.5], "P3": [3.0, 1.0, 2.0], "P4": [1.0, 1.0, 1.0]}


def test_network_of_both_ways_to_fuse(sources):
    # P2 and P3 share no term, P4 is constant: one has no functional score, the other no correlation.
    fused = {(a, b): w for a, b, w in rows(construction.build_network(sources))}
    assert set(fused) == {("P1", "P2"), ("P1", "P3")}
    cosine, place, apart = 1 / 2**0.5, 1.0, 1 / (2 * 2 * 3)
    pcc = 0.5 * (1 + (1 * 4.5) / (2**0.5 * ((2 - 12.5 / 3) ** 2 + (4 - 12.5 / 3) ** 2 + (6.5 - 12.5 / 3) ** 2) ** 0.5))
    assert fused["P1", "P2"] == pytest.approx((cosine + place + pcc + apart) / 4)
    union = {(a, b) for a, b, _ in rows(construction.build_network(sources, fused="union"))}
    assert union == {("P1", "P2"), ("P1", "P3"), ("P2", "P3"), ("P3", "P4"), ("P4", "P4")}
    with pytest.raises(ValueError):
        construction.build_network(sources, fused="other")


def test_groups_and_summaries(spark, sources):
    network = construction.build_network(sources)
    members = spark.createDataFrame([(g, p) for g, x in (("kept", "123"), ("small", "12"), ("missing", "124")) for p in ("P" + c for c in x)], "complex_id string, protein string")
    assert rows(construction.groups_of_network(members, network)) == [("kept", 3, "kept"), ("missing", 3, "missing"), ("small", 2, "small")]
    got = rows(construction.network_summaries({"one": network, "none": network.limit(0)}))
    assert [r[:3] for r in got] == [("one", 3, 2)] and got[0][4] == pytest.approx(2 / 3)


@pytest.mark.parametrize("empty", ["links", "mapping", "expression", "terms", "compartments"])
def test_a_source_without_rows_leaves_no_edge_with_all_scores(sources, empty):
    parts = {**sources.__dict__, empty: getattr(sources, empty).limit(0)}
    assert construction.build_network(construction.Sources(**parts)).count() == 0


def test_scores_of_an_edge_are_one_row(spark, sources):
    """No term, place or score of an edge is a row of its own, and both ways to fuse go by the same scores."""
    scored = construction.scored_network(sources)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not any("hashpartitioning(protein1" in line for line in plan.splitlines())
    got = {(r.protein1, r.protein2): [r.FS, r.SL, r.CO, r.HCN] for r in scored.collect()}
    assert set(got) == {("P1", "P2"), ("P1", "P3"), ("P2", "P3"), ("P3", "P4"), ("P4", "P4")}
    assert got["P2", "P3"][0] is None and got["P4", "P4"][2] is None and got["P4", "P4"][0] == 1
    assert len(rows(construction.fused_network(scored))) == 2 and len(rows(construction.fused_network(scored, "union"))) == 5


def test_links_by_number_are_links_by_name(spark, sources):
    edges, nodes = construction.numbered_links(sources.links, sources.mapping, construction.Store(spark))
    name = {r.id: r.protein for r in nodes.collect()}
    assert sorted(name.values()) == [name[i] for i in range(len(name))]
    assert sorted((name[r.u], name[r.v]) for r in edges.collect()) == rows(construction.mapped_links(sources.links, sources.mapping))
