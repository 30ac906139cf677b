"""The network operators on small frames with known answers, and the readers and writers on small files."""

from __future__ import annotations

import datetime
import itertools
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from netloom.functions import registered, text
from netloom.operators import clean, clusters, evaluation, fusion, ga, graph, idmap, similarity, sketches, tabu, versions
from netloom.plans import catalog
from netloom.sources import archives, readers, sinks
from netloom.streaming.best import best_pairs
from netloom.streaming.evidence import evidence_counts


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def write(path, content):
    path.write_text(content)
    return str(path)


# Cleaning and text


def test_accessions(spark):
    df = spark.createDataFrame([("a|uniprot/swiss-prot:p12345|x",), ("UniProt:Q99999",), ("zz:p1234567.2",), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(text.accession(F.col("x"), text.ACCESSION_PATTERNS["yeast"], True)).collect()] == ["P12345", "Q99999", "P1234567", None, None]
    assert df.select(text.accession(F.col("x"), text.ACCESSION_PATTERNS["human"])).head()[0] == "p12345"


def test_evidence(spark):
    df = spark.createDataFrame([("X-ray crystallography|two hybrid", "psi-mi:direct", "a|b"), (None, "direct interaction", None), ("psi-mi:x", "Complex|other", "a")], "Method string, IntType string, PubIDs string")
    assert rows(clean.evidence(df), "MethodScore", "TypeScore", "PubCount", "Total") == sorted([(10, 1, 2, 34), (1, 6, 1, 16), (1, 4, 1, 12)], key=repr)
    assert [r.Total for r in clean.evidence(df, "human").collect()] == [4 * 3 + 2 + 2, None, 3 + 4 + 1]


def test_confidence_and_links(spark):
    df = spark.createDataFrame([(1, None), (2, "0.8"), (3, "0.81"), (4, "bad")], "i int, confidence string")
    assert rows(clean.confident(df), "i") == [(1,), (3,)]
    links = spark.createDataFrame([(1, 700, None, 91, 0, 0), (2, 699, 99, 99, 0, 0), (3, 900, 90, 90, 90, None)], "i int, combined_score int, experimental int, coexpression int, `database` int, textmining int")
    assert rows(clean.supported_links(links), "i") == [(1,)] and rows(clean.supported_links(links, 600), "i") == [(1,), (2,)]


def test_undirected_duplicates(spark):
    df = spark.createDataFrame([("a", "b", 1, 5), ("b", "a", 2, 9), ("c", "a", 3, 1), ("b", "a", 4, 9)], "protein1 string, protein2 string, i int, score int")
    assert rows(clean.undirected_first(df, "i"), "protein1", "protein2", "i") == [("a", "b", 1), ("c", "a", 3)]
    assert rows(clean.undirected_best(df, "score", "i"), "protein1", "i") == [("b", 2), ("c", 3)]
    assert rows(clean.pair_set(df)) == [("a", "b"), ("a", "c")]


@pytest.mark.parametrize(("at_top", "n", "want"), [(3, 8, 8), (9, 20, 9), (5, 20, 10), (11, 12, 12), (11, 20, 10), (0, 0, 0)])
def test_dynamic_cut(spark, at_top, n, want):
    df = spark.createDataFrame([(i, 9 if i < at_top else 1) for i in range(n)], "i int, score int")
    assert clean.dynamic_cut(df, "score", "i", 10).count() == want


# Mapping


def test_mapping_of_edges(spark):
    lines = [("P1", "Gene_Name", "x", 1), ("P2", "Gene_Name", "x", 2), ("P3", "Gene_Name", "y", 3)]
    m = spark.createDataFrame(lines, "uniprot string, db string, db_id string, line_no long")
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z"), ("x", "x")], "protein1 string, protein2 string")
    first, last = idmap.lookup(m, "Gene_Name"), idmap.lookup(m, "Gene_Name", keep="last")
    assert rows(idmap.map_edges(edges, first)) == [("P1", "P1"), ("P1", "P3"), ("P3", "P1")]
    assert rows(idmap.map_edges(edges, last, "keep")) == [("P2", "P2"), ("P2", "P3"), ("P2", "z"), ("P3", "P2")]
    assert rows(idmap.map_edges(edges, first, canonicalize=True)) == [("P1", "P3")]


def test_compartments(spark):
    m = spark.createDataFrame([("P1", "STRING", "9606.ENSP1", 1), ("P2", "STRING", "9606.ENSP1", 2), ("P3", "Ensembl_PRO", "ENSP2.4", 3), ("P4", "Gene_OrderedLocusName", "YAL001C", 4)], "uniprot string, db string, db_id string, line_no long")
    df = spark.createDataFrame([("P1",), ("ENSP1",), ("ENSP2",), ("YAL001C",), ("?",)], "protein_id string")
    human, yeast = idmap.map_compartments(df, m, "human"), idmap.map_compartments(df, m, "yeast")
    assert rows(human, "protein_id", "Mapped_UniProtKB_ID") == sorted([("P1", "P1"), ("ENSP1", "P2"), ("ENSP2", "P3"), ("YAL001C", None), ("?", None)], key=repr)
    assert rows(yeast.where("Mapping_Status = 'Success'"), "protein_id", "Mapped_UniProtKB_ID") == [("P1", "P1"), ("YAL001C", "P4")]
    assert rows(idmap.mapping_stats(human)) == [(5, 3, 2, "60.0%", "40.0%")]


# Similarity


def random_graph(seed, n=14, p=0.35, loops=True):
    rng = random.Random(seed)
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    return edges + ([(i, i) for i in range(0, n, 5)] if loops else [])


@pytest.mark.parametrize(("part", "hub"), [(1, False), (2, True), (1000, True)])
def test_shared_neighbours(spark, part, hub):
    edges = random_graph(3)
    if hub:
        edges = sorted({*edges, *((0, i) for i in range(1, 80)), *((1, i) for i in range(2, 60, 3)), (2, 70)})
    near = {i: set() for i in range(80)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = []
    for a, b in edges:
        c, u = len(near[a] & near[b]), len(near[a] | near[b])
        want.append((a, b, round(c * c / (len(near[a]) * len(near[b]) * u), 12), c, len(near[a]), len(near[b])))
    got = similarity.hcn(spark.createDataFrame(edges, "u long, v long"), part).withColumn("HCN_score", F.round("HCN_score", 12))
    assert rows(got) == sorted(want, key=repr)


def test_correlation(spark):
    profiles = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [2.0, 4.0, 6.0]), ("c", [3.0, 2.0, 1.0]), ("d", [5.0, 5.0, 5.0]), ("e", [1.0, None, 2.0, 9.0]), ("f", [1.0])], "protein string, v array<double>")
    edges = spark.createDataFrame([("a", x) for x in "bcdefz"], "protein1 string, protein2 string")
    assert {r.protein2: round(r.PCC, 12) for r in similarity.coexpression(edges, profiles).collect()} == {"b": 1.0, "c": 0.0, "e": 1.0}


def test_annotation_overlap(spark):
    terms = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("c", "z")], "protein string, term string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "q"), ("b", "b")], "protein1 string, protein2 string")
    assert rows(similarity.annotation_cosine(edges, terms)) == [("a", "b", pytest.approx(1 / math.sqrt(2))), ("b", "b", 1.0)]
    assert similarity.annotation_cosine(edges, terms, False).count() == 4
    assert rows(similarity.localization_edges(edges, terms)) == [("a", "b", 0.5), ("b", "b", 1.0)]
    assert rows(similarity.localization_matrix(terms)) == [("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0), ("c", "c", 1.0)]
    df = spark.createDataFrame([("p", "gn", "g", "t", 1.0), ("p", None, "g", "u", 2.0), ("q", "Q", "g", "t", 0.5)], "protein_id string, gene_name string, go_id string, go_term string, score double")
    assert rows(similarity.localization_terms(df)) == [("GN", "t"), ("p", "t"), ("p", "u")]


def test_fusion(spark):
    kind = "protein1 string, protein2 string, weight double"
    a, b = spark.createDataFrame([("a", "b", 0.4), ("b", "a", 0.4), ("c", "d", 0.0)], kind), spark.createDataFrame([("b", "a", 0.0), ("d", "c", 0.0), ("e", "f", float("nan"))], kind)
    assert rows(fusion.fuse_intersection({"x": a, "y": b})) == [("a", "b", 0.4)]
    assert rows(fusion.fuse_union({"x": a, "y": b})) == [("a", "b", 0.2), ("c", "d", 0.0)]
    assert rows(fusion.fuse_intersection({"x": a, "y": b.where("false")})) == []
    assert rows(graph.network_stats(a.limit(0)))[0][0] == 0 and rows(graph.network_stats(a.limit(0)), "density") == [(0.0,)]


# Groups


def test_connected_groups(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("c", "c")]
    both = graph.symmetric(spark.createDataFrame(edges, "u string, v string"))
    sets = {1: "abc", 2: "acd", 3: "de", 4: "a", 5: "ac", 6: "abx", 7: "abde"}
    m = spark.createDataFrame([(k, p) for k, v in sets.items() for p in v], "complex_id int, protein string")
    assert dict(rows(graph.connected_groups(m, both))) == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert {r.complex_id: r.status for r in graph.filter_groups(m, both).collect()} == {1: "kept", 2: "disconnected", 3: "small", 4: "small", 5: "small", 6: "missing", 7: "disconnected"}
    assert rows(graph.filter_counts(graph.filter_groups(m, both))) == [(7, 1, 3, 1, 2)]
    path = spark.createDataFrame([(9, i) for i in range(60)], "complex_id int, protein long")
    line = graph.symmetric(spark.createDataFrame([(i, i + 1) for i in range(59)], "u long, v long"))
    assert rows(graph.connected_groups(path, line)) == [(9, True)]


@pytest.mark.parametrize(("held", "merged"), [(1_000_000, 1_000_000), (3, 1_000_000), (10, 100), (1_000_000, 0)])
def test_connected_groups_of_any_size(spark, monkeypatch, held, merged):
    """Whatever tasks remember of forests, and whether one of them merges a group's or its nodes are labelled."""
    monkeypatch.setattr(graph, "HELD_NODES", held)
    monkeypatch.setattr(graph, "MERGED_EDGES", merged)
    n = 300
    star = [(0, i) for i in range(1, n)]
    sets = {1: range(n), 2: range(1, n), 3: [*range(n - 1), n + 7], 4: range(3), 5: [1, 2, 3], 6: range(n + 9, 2 * n + 9), 7: [5], 8: [None], 9: [0, None, 5, 5]}
    both = graph.symmetric(spark.createDataFrame([*star, (1, 2), (n + 7, n + 8), (4, 4)], "u long, v long"))
    m = spark.createDataFrame([(k, p) for k, v in sets.items() for p in v], "complex_id int, protein long")
    assert dict(rows(graph.connected_groups(m, both))) == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: True, 9: True}
    assert dict(rows(graph.connected_groups(m, both, empty=False, single=False).where("complex_id > 6"))) == {7: False, 8: False, 9: True}
    assert {r.complex_id: r.status for r in graph.filter_groups(m.where("complex_id < 7"), both).collect()} == {1: "kept", 2: "disconnected", 3: "disconnected", 4: "kept", 5: "disconnected", 6: "missing"}


@pytest.mark.parametrize("held", [1_000_000, 4])
def test_connected_groups_are_those_of_a_walk(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD_NODES", held)
    rng = random.Random(11)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(28)}
    sets = {k: rng.sample(range(25), rng.randint(1, 9)) for k in range(60)}
    want = {}
    for k, own in sets.items():
        seen, todo = {own[0]}, [own[0]]
        while todo:
            x = todo.pop()
            for y in own:
                if y not in seen and ((x, y) in edges or (y, x) in edges):
                    seen.add(y)
                    todo.append(y)
        want[k] = len(seen) == len(own)
    m = spark.createDataFrame([(k, p) for k, v in sets.items() for p in v], "complex_id int, protein long").repartition(4)
    assert dict(rows(graph.connected_groups(m, graph.symmetric(spark.createDataFrame(sorted(edges), "u long, v long"))))) == want


def test_a_term_that_all_have(spark):
    """Its proteins meet in blocks; the pairs are the same, and no block pair has many of them."""
    terms = [(i, "all") for i in range(90)] + [(i, f"t{i % 7}") for i in range(0, 90, 2)] + [(3, "all"), (None, "all"), (5, None)]
    df = spark.createDataFrame(terms, "protein long, term string")
    sets: dict = {}
    for p, t in terms:
        if p is not None and t is not None:
            sets.setdefault(p, set()).add(t)
    sim = lambda a, b: len(sets[a] & sets[b]) ** 2 / (len(sets[a]) * len(sets[b]))
    want = sorted((a, b, sim(a, b)) for a in sets for b in sets if a <= b and sets[a] & sets[b])
    for block in (1, 10, 1000):
        assert rows(similarity.localization_matrix(df, block=block)) == sorted(want, key=repr)
        assert rows(similarity.localization_matrix(df, 0.5, block)) == sorted((w for w in want if w[2] >= 0.5), key=repr)


def test_unique_groups(spark):
    m = spark.createDataFrame([("x", "a", 2), ("x", "b", 2), ("y", "b", 1), ("y", "a", 1), ("z", "a", 3)], "complex_id string, protein string, source int")
    assert rows(graph.unique_groups(m, "source")) == [("a", "z"), ("a;b", "y")]


def measures(c, adj):
    win = wout = ein = eout = 0
    for x in c:
        for y, w in adj.get(x, {}).items():
            if y in c:
                win, ein = win + w, ein + 1
            else:
                wout, eout = wout + w, eout + 1
    q = lambda a, b: a / b if b else 0.0
    n, i, o = len(c), q(win, ein), q(wout, eout)
    return q(win, win + wout) + (2 * win / (n * (n - 1)) if n > 1 else 0.0) + i - o + q(i, i + o)


def climb(c, adj, most):
    c, step, changed = set(c), 0, True
    while changed and step < most:
        changed, now = False, measures(c, adj)
        inner = sorted(x for x in c if any(y not in c for y in adj[x]))
        if inner:
            worst = min(inner, key=lambda x: (round(measures(c - {x}, adj), 11), x))
            if measures(c - {worst}, adj) > now + 1e-11:
                c, changed = c - {worst}, True
                continue
        edge = sorted({y for x in c for y in adj[x] if y not in c})
        if edge:
            best = max(edge, key=lambda x: (round(measures(c | {x}, adj), 11), -x))
            if measures(c | {best}, adj) > now + 1e-11:
                c, changed = c | {best}, True
        step += 1
    return c


def test_cluster_metrics_and_local_search(spark):
    rng = random.Random(4)
    adj = {i: {} for i in range(14)}
    for a, b in random_graph(7):
        adj[a][b] = adj[b][a] = rng.random()
    df = spark.createDataFrame([(a, b, w) for a, near in adj.items() for b, w in near.items()], "src long, dst long, weight double")
    groups = {k: set(rng.sample(range(14), rng.randint(1, 5))) for k in range(6)} | {9: {3, 99}}
    adj[99] = {}
    m = spark.createDataFrame([(k, p) for k, v in groups.items() for p in v], "cluster_id int, protein long")
    got = {r.cluster_id: r.ff for r in clusters.cluster_metrics(m, df).collect()}
    assert got == {k: pytest.approx(measures(v, adj)) for k, v in groups.items()}
    found: dict = {}
    for r in clusters.local_search(m, df, 3).collect():
        found.setdefault(r.cluster_id, set()).add(r.protein)
    assert found == {k: climb(v, adj, 3) for k, v in groups.items()}


def test_local_search_query_goes_on_to_the_end(spark, monkeypatch):
    adj = {i: {j: 1.0 for j in range(8) if j != i} for i in range(8)} | {8: {0: 0.1}, 9: {8: 0.1}}
    adj[0][8] = adj[8][9] = 0.1
    df = spark.createDataFrame([(a, b, w) for a, near in adj.items() for b, w in near.items()], "src long, dst long, weight double")
    monkeypatch.setattr(catalog, "_clusters", lambda *_: spark.createDataFrame([(1, 1), (1, 2)], "cluster_id long, protein long"))
    monkeypatch.setattr(catalog.fx, "supplier_graph", lambda *_: df)
    got = {r.protein for r in catalog.cluster_local_search(spark, "").collect()}
    assert got == climb({1, 2}, adj, 20) != climb({1, 2}, adj, 3)


def test_evaluation(spark):
    known = {1: "abc", 2: "de", 3: "xyz"}
    detected = {10: "abc", 11: "abd", 12: "q"}
    as_frame = lambda g: spark.createDataFrame([(k, p) for k, v in g.items() for p in v], "cid long, p string")
    d, k = as_frame(detected), as_frame(known)
    pr = evaluation.precision_recall(d, k).head()
    assert (pr.precision, pr.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert evaluation.coverage_rate(d, k).head()[0] == pytest.approx(5 / 8)
    assert evaluation.matching_ratio(d, k).head()[0] == pytest.approx((1 + 1 / 6) / 3)
    assert evaluation.jaccard_index(d, k).head().jc == pytest.approx((1 + 0.5) / 3)
    same = evaluation.total_score(k, k).head()
    assert same.total == pytest.approx(5.0)
    none = d.where("false")
    assert evaluation.total_score(none, k).head().total == 0.0 and evaluation.total_score(none, none).head().total == 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_largest_matching(spark, seed):
    """Against all ways to match; the greedy rule gets less in one of the cases."""
    rng = random.Random(seed)
    known = {i: set(rng.sample("abcdefgh", rng.randint(1, 4))) for i in range(6)}
    detected = {10 + i: set(rng.sample("abcdefgh", rng.randint(1, 4))) for i in range(5)}
    detected |= {20: detected[10], 21: {"z"}}
    score = lambda d, k: len(d & k) ** 2 / (len(d) * len(k))
    sets = sorted({tuple(sorted(d)) for d in detected.values()})
    most = max(sum(score(set(d), known[k]) for d, k in zip(sets, ks, strict=True) if k is not None) for ks in itertools.permutations([*known, *[None] * len(sets)], len(sets)))
    as_frame = lambda g: spark.createDataFrame([(k, p) for k, v in g.items() for p in sorted(v)], "cid long, p string")
    got = evaluation.matching_pairs(as_frame(detected), as_frame(known)).collect()
    assert len({r.kid for r in got}) == len({r.did for r in got}) == len(got) and not {20, 21} & {r.did for r in got}
    assert all(r.score == pytest.approx(score(detected[r.did], known[r.kid])) for r in got)
    assert most >= sum(r.score for r in got) >= most - 6e-3
    both = evaluation.best_matching_ratio(as_frame(detected), as_frame(known)).head()
    assert both.optimal >= both.mmr and both.optimal == pytest.approx(max(both.mmr, sum(r.score for r in got) / 6))
    none = as_frame(detected).where("false")
    assert evaluation.best_matching_ratio(none, as_frame(known)).head().optimal == 0.0


# Optimisers


def sphere(genes):
    return -F.aggregate(genes, F.lit(0.0), lambda a, g: a + g * g)


def test_generations(spark):
    rng = random.Random(0)
    pop = spark.createDataFrame([(i % 2, i // 2, [rng.random() for _ in range(3)]) for i in range(40)], "island int, idx int, genes array<double>")
    first = ga.evaluate(pop, sphere)
    final, history = ga.run(pop, sphere, 6, 3, 1, mutator=ga.gaussian_mutator(0.1))
    assert history.count() == 12 and final.count() == 40
    assert ga.best(final).head().fitness > first.agg(F.avg("fitness")).head()[0]
    again, _ = ga.run(pop.repartition(5), sphere, 6, 3, 1, mutator=ga.gaussian_mutator(0.1))
    assert rows(again) == rows(final)
    moved = ga.migrate(first)
    best = {r.island: r.best for r in ga.summary(first).collect()}
    assert {r.island: r.fitness for r in moved.where("idx = 19").collect()} == {0: best[1], 1: best[0]}
    sizes = rows(ga.split_population(pop.select(F.monotonically_increasing_id().alias("idx")), 3).groupBy("island").count())
    assert sizes == [(0, 14), (1, 13), (2, 13)]


def test_knapsack(spark):
    value = tabu.knapsack([60, 100, 120], [10, 20, 30], 50)
    starts = spark.createDataFrame([(0, [True, True, False]), (1, [True, False, False]), (2, [True, True, True])], "start_id int, repr array<boolean>")
    kind = tabu.composite([tabu.SWAP, tabu.INSERT])
    assert kind.name == "swap+insert" and tabu.neighbors(starts, kind).count() == 3 * (3 + 6)
    for extra in ({}, {"intensification": True, "diversification": True, "patience": 1}):
        found = {r.start_id: r.value for r in tabu.search(starts, kind, value, 4, 2, **extra).collect()}
        assert found == {0: 220.0, 1: 120.0, 2: -1.0}
    assert tabu.best_of(tabu.search(starts, kind, value, 2)).head().value == 220.0
    ended = tabu.search(starts, kind, value, 9, 2, stop=lambda done, best, at: (best >= 220) | (done >= 1)).collect()
    assert {r.start_id: (r.value, r.best_iteration) for r in ended} == {r.start_id: (r.value, r.best_iteration) for r in tabu.search(starts, kind, value, 1, 2).collect()}


def test_places_of_lines(spark, tmp_path):
    """Files count by name and lines by their place, whatever tasks read them in whatever parts."""
    for i, name in enumerate("ba"):
        write(tmp_path / f"{name}.dat", "".join(f"P{i}{j:05}\tORF\tY{j % 3}\n" for j in range(3000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        m = readers.idmapping(spark, str(tmp_path))
        assert m.rdd.getNumPartitions() > 4
        both = idmap.lookup(m, "ORF", name="first").join(idmap.lookup(m, "ORF", keep="last", name="last"), "key")
        assert rows(both) == [(f"Y{j}", f"P1{j:05}", f"P0{2997 + j:05}") for j in range(3)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_every_part_is_searched(spark, tmp_path, monkeypatch):
    parts = [(i, float(100 + i * 37 % 53), i * 7 % 50 + 1) for i in range(1, 31)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    said, search = {}, tabu.search
    monkeypatch.setattr(tabu, "search", lambda *a, **b: said.update(n=a[3:], b=b) or search(*a[:3], 2, **b))
    got = {r.start_id: (r.key, r.value) for r in catalog.tabu_search(spark, str(tmp_path)).collect()}
    assert said == {"n": (), "b": {"given": ["values", "weights"]}}
    want = {}
    for k in range(3):
        items = parts[12 * k : 12 * k + 12]
        one = spark.createDataFrame([(3 * k + s, [i % 3 == s for i in range(len(items))]) for s in range(3)], "start_id long, repr array<boolean>")
        value = tabu.knapsack([x[1] for x in items], [x[2] for x in items], 120)
        found = search(one, tabu.composite([tabu.SWAP, tabu.INSERT]), value, 2).withColumn("key", tabu.key_of(F.col("repr")))
        want |= {r.start_id: (r.key, r.value) for r in found.collect()}
    assert got == want and sorted(got) == list(range(9)) and [len(got[i][0].split(",")) for i in (0, 3, 6)] == [12, 12, 6]


def plain_tabu(x, value, moves, most, tenure, aspired, intensified=False, patience=None):
    """One start, by lists and dicts."""
    best, best_value, best_at, tabu_until, seen = x, value(x), 0, {}, {}
    key = lambda y: ",".join(str(v).lower() for v in y)
    for i in range(1, most + 1):
        free = lambda y: key(y) not in tabu_until  # noqa: B023, E731
        able = [y for y in moves(x) if (free(y) or aspired(value(y), best_value, seen.get(key(y), (0,))[0])) and not (intensified and seen.get(key(y), (0,))[0] >= 3)]
        tabu_until = {k: u for k, u in tabu_until.items() if u > i}
        if able:
            x = min(able, key=lambda y: (-value(y), key(y)))
            tabu_until[key(x)] = i + tenure
            seen[key(x)] = (seen.get(key(x), (0,))[0] + 1, key(x), x)
            if value(x) > best_value:
                best, best_value, best_at = x, value(x), i
        if patience is not None and seen and i - best_at > patience:
            x = min(seen.values())[2]
    return best, best_value, best_at


def plain_swaps(x):
    for i, j in itertools.combinations(range(len(x)), 2):
        y = list(x)
        y[i], y[j] = y[j], y[i]
        yield y


@pytest.mark.parametrize("per_pass", [5, 100])
def test_tabu_search_step_by_step(spark, per_pass):
    rng = random.Random(3)
    values, weights = [rng.randint(1, 9) / 8 for _ in range(7)], [rng.randint(1, 9) for _ in range(7)]
    starts = [[rng.random() < 0.4 for _ in range(7)] for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(starts)), "start_id int, repr array<boolean>")
    worth = lambda x: sum(v for t, v in zip(x, values) if t) if sum(w for t, w in zip(x, weights) if t) <= 14 else -1.0
    better, rare = (lambda v, b, n: v > b), (lambda v, b, n: v > b or n < 2)
    for own, plain in (
        ({"max_iterations": 15, "tenure": 4}, (15, 4, better)),
        ({"max_iterations": 15, "tenure": 12, "aspiration": None}, (15, 12, lambda *_: False)),
        ({"max_iterations": 15, "tenure": 3, "aspiration": tabu.aspired, "intensification": True, "diversification": True, "patience": 2}, (15, 3, rare, True, 2)),
    ):
        got = {r.start_id: (list(r.repr), r.value, r.best_iteration) for r in tabu.search(df, tabu.SWAP, tabu.knapsack(values, weights, 14), per_pass=per_pass, **own).collect()}
        assert got == {i: plain_tabu(x, worth, plain_swaps, *plain) for i, x in enumerate(starts)}


def test_insert_moves(spark):
    x = [1, 2, 3, 4]
    want = []
    for i, j in itertools.product(range(4), repeat=2):
        if i != j:
            y = list(x)
            y.insert(j, y.pop(i))
            want.append(y)
    df = spark.createDataFrame([(0, x)], "start_id int, repr array<int>")
    assert [r.repr for r in tabu.neighbors(df, tabu.INSERT).orderBy("pos").collect()] == want


@pytest.mark.parametrize("kind", [tabu.SWAP, tabu.INSERT, tabu.composite([tabu.SWAP, tabu.INSERT])])
def test_different_neighbours_are_all_neighbours(spark, kind):
    solutions = [list(x) for n in range(1, 7) for x in itertools.product([True, False], repeat=n)] + [[1, 2, 2, 3, 1, 1], [None, 1, None, 2]]
    df = spark.createDataFrame([(i, [None if v is None else int(v) for v in x]) for i, x in enumerate(solutions)], "start_id int, repr array<int>")
    for r in df.select(kind.generate(F.col("repr")).alias("all"), kind.different(F.col("repr")).alias("some")).collect():
        assert {tuple(x) for x in r.all} == {tuple(x) for x in r.some}


# Readers and writers


def test_tables(spark, tmp_path):
    mitab = write(tmp_path / "m.txt", "#ID A\n" + "\t".join(f"c{i}" for i in range(15)) + "\n")
    assert readers.mitab(spark, mitab).head().Confidence == "c14"
    links = write(tmp_path / "l.txt", "protein1 protein2 experimental coexpression database textmining combined_score\n9606.A 9606.B 1 2 3 95 800\n")
    assert rows(readers.string_edges(clean.supported_links(readers.string_links(spark, links)), "9606.")) == [("A", "B")]
    corum = write(tmp_path / "c.txt", "complex_id\tsubunits_uniprot_id\n1\tA; B;;A\n1\tC;D\n2\tE\n")
    assert dict(rows(readers.corum(spark, corum, "CORUM_"))) == {"CORUM_1": ["C", "D"], "CORUM_2": ["E"]}
    humap = write(tmp_path / "h.csv", "HuMAP2_ID,Uniprot_ACCs\nx,A B A\n")
    assert rows(readers.humap(spark, humap)) == [("HuMAP_x", ["A", "B"])]
    ids = write(tmp_path / "i.dat", "P1\tSTRING\t9606.E1\nbad\tline\nP2\tORF\tY\n")
    assert rows(readers.idmapping(spark, ids), "uniprot", "db_id") == [("P1", "9606.E1"), ("P2", "Y")]
    soft = write(tmp_path / "s.soft", "^x\n!dataset_table_begin\nID\tIDENTIFIER\tGSM1\tGSM2\n1\tg\t1.5\t2\n2\th\tnull\t3\n3\tk\t\t1\n!dataset_table_end\n")
    assert rows(readers.expression_profiles(readers.soft_expression(spark, soft)), "IDENTIFIER", "v") == [("g", [1.5, 2.0])]
    slim = write(tmp_path / "g.tab", "n\tS1\ta\tb\tGO:1\tx\n")
    assert rows(readers.go_slim(spark, slim)) == [("S1", "GO:1")]
    go = write(tmp_path / "u.tsv", "Entry\tName\tGene Ontology (GO)\nP1\tn\tcell [GO:12]; x [GO:3]\nP2\tn\t\n")
    assert rows(readers.uniprot_go(spark, go)) == [("P1", "GO:12"), ("P1", "GO:3")]
    comp = write(tmp_path / "k.tsv", "p\tg\tGO:1\tt\t2.5\np\tg\tGO:1\tt\tbad\n")
    assert rows(readers.compartments(spark, comp), "score") == [(2.5,)]
    ppi = write(tmp_path / "p.txt", "# note\nProtein1\tProtein2\n\nA\tB\nC D x\n")
    assert rows(readers.ppi_tolerant(spark, ppi)) == [("A", "B"), ("C", "D")]
    assert rows(readers.ppi_clean(spark.createDataFrame([(" a", "b\t"), ("A", "B"), ("B", "A"), (None, "x")], "protein1 string, protein2 string"))) == [("A", "B"), ("B", "A")]
    cx = write(tmp_path / "x.txt", "complex_id\tproteins\n7\tA;B;C\n8\tA;B\n")
    assert rows(readers.complex_file(spark, cx)) == [("7", "A"), ("7", "B"), ("7", "C")]
    score = write(tmp_path / "f.txt", "a\tb\tHCN_score\nB\tA\t0.5\nA\tB\t0.5\nC\tD\tbad\n")
    assert rows(readers.score_file(spark, score)) == [("A", "B", 0.5)]
    matrix = write(tmp_path / "q.txt", "\tA\tB\nA\t1\t0.25\nB\t0.25\t1\n")
    assert rows(readers.square_matrix(spark, matrix)) == [("A", "B", 0.25)]
    assert [x.rsplit("/", 1)[1] for x in readers.discover(spark, str(tmp_path), "*.soft")] == ["s.soft"]


DIP = """<entrySet xmlns="http://psi.hupo.org/mi/mif"><entry><interactorList>
<interactor id="1"><names><shortLabel>s1</shortLabel></names><xref><secondaryRef db="refseq" id="R1"/><secondaryRef db="uniprot knowledge base" id="U1"/></xref></interactor>
<interactor id="2"><names><shortLabel>s2</shortLabel></names><xref><secondaryRef db="refseq" id="R2"/></xref></interactor>
<interactor id="3"><names><shortLabel>s3</shortLabel></names></interactor></interactorList><interactionList>
{}</interactionList></entry></entrySet>"""


def dip_interaction(refs, value=None):
    parts = "".join(f"<participant id='p'><interactorRef>{r}</interactorRef></participant>" for r in refs)
    note = f"<confidenceList><confidence><value>{value}</value></confidence></confidenceList>" if value else ""
    return f"<interaction id='i'><participantList>{parts}</participantList>{note}</interaction>\n"


def test_dip(spark, tmp_path):
    body = "".join((dip_interaction([1, 2], "0.9"), dip_interaction([2, 3], "0.5"), dip_interaction([3, 1]), dip_interaction([1, 1]), dip_interaction([1, 2, 3]), dip_interaction([1, 9])))
    path = write(tmp_path / "d.mif25", DIP.format(body))
    assert rows(readers.dip_interactors(spark, path)) == [("1", "U1"), ("2", "R2"), ("3", "s3")]
    assert rows(clean.pair_set(clean.confident(readers.dip_interactions(spark, path)))) == [("R2", "U1"), ("U1", "s3")]


PORTAL = """<entrySet xmlns="http://psi.hupo.org/mi/mif300"><entry><interactorList>
<interactor id="1"><interactorType><names><shortLabel>protein</shortLabel></names></interactorType><xref><primaryRef db="uniprotkb" id="{0}1"/></xref></interactor>
<interactor id="2"><interactorType><names><shortLabel>protein</shortLabel></names></interactorType><xref><primaryRef db="uniprotkb" id="{0}2"/></xref></interactor>
<interactor id="3"><interactorType><names><shortLabel>rna</shortLabel></names></interactorType><xref><primaryRef db="rnacentral" id="R"/></xref></interactor></interactorList>
<interactionList><abstractInteraction id="9"><participantList><participant id="a"><interactorRef>1</interactorRef></participant><participant id="b"><interactorRef>2</interactorRef></participant><participant id="c"><interactorRef>3</interactorRef></participant></participantList></abstractInteraction></interactionList></entry></entrySet>"""


def complexes(frame):
    groups: dict = {}
    for r in frame.collect():
        groups.setdefault(r.complex_id, set()).add(r.protein)
    return sorted(map(sorted, groups.values()))


def test_portal(spark, tmp_path):
    """Files of a folder, an archive, and a folder of archives give the same complexes; a damaged file gives none."""
    (tmp_path / "xml").mkdir()
    for k, names in enumerate(("AB", "C")):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for x in names:
                z.writestr(f"yeast/{x}.xml", PORTAL.format(x))
                write(tmp_path / "xml" / f"{x}.xml", PORTAL.format(x))
            z.writestr("yeast/bad.xml", "<entrySet")
            z.writestr("readme.txt", "no")
    write(tmp_path / "xml" / "bad.xml", "<entrySet")
    want = [["A1", "A2"], ["B1", "B2"], ["C1", "C2"]]
    assert complexes(readers.portal_complexes(spark, str(tmp_path / "xml"))) == complexes(readers.portal_archive(spark, str(tmp_path))) == want
    assert complexes(readers.portal_archive(spark, str(tmp_path / "0.zip"))) == want[:2]


def test_archives_are_read_in_parts(spark, tmp_path):
    files = [(f"d/{i}.{'xml' if i % 3 else 'txt'}", f"é{i}\0" * i if i else None) for i in range(50)]
    df = spark.createDataFrame(files, "entry string, content string").repartition(3)
    archives.write_zips(df, str(tmp_path / "z"), archive_bytes=400)
    names = [p for p in (tmp_path / "z").iterdir() if p.suffix == ".zip"]
    assert len(names) > 5 and all(zipfile.ZipFile(p).testzip() is None for p in names)
    for size in (1, 1 << 20):
        got = archives.zip_entries(spark, str(tmp_path / "z"), ".xml", bytes_per_task=size)
        assert (got.rdd.getNumPartitions() > len(names)) == (size == 1)
        assert sorted((r.entry, bytes(r.content).decode()) for r in got.collect()) == sorted((n, c or "") for n, c in files if n.endswith("xml"))
    assert archives.zip_entries(spark, str(tmp_path / "z"), ".none").count() == 0
    (tmp_path / "bad.zip").write_bytes(names[0].read_bytes()[:40])
    with pytest.raises(Exception, match="not a zip file"):
        archives.zip_entries(spark, str(tmp_path / "bad.zip")).collect()


def lines(path):
    return sorted(x for p in path.rglob("part-*") for x in p.read_text().splitlines())


def test_writers(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 0.125), ("b", "c", 1.0)], "protein1 string, protein2 string, weight double").coalesce(1)
    sinks.edge_list(edges, str(tmp_path / "e"))
    assert lines(tmp_path / "e") == ["a\tb", "b\tc"]
    sinks.edge_list(edges, str(tmp_path / "eh"), True)
    assert "Protein1\tProtein2" in lines(tmp_path / "eh")
    sinks.scores(edges, str(tmp_path / "s"), 6)
    assert "a\tb\t0.125000" in lines(tmp_path / "s")
    sinks.weighted_network(edges, str(tmp_path / "w"))
    assert "protein1\tprotein2\tmean_weight" in lines(tmp_path / "w")
    sinks.matrix(edges.withColumnRenamed("weight", "sim"), str(tmp_path / "m"), ["a", "b", "c"])
    assert "b\t0.12500\t0.00000\t1.00000" in lines(tmp_path / "m")
    sinks.complexes(spark.createDataFrame([(1, "y"), (1, "x")], "complex_id int, protein string"), str(tmp_path / "c"), header=False)
    assert lines(tmp_path / "c") == ["1\tx;y"]
    mapped = spark.createDataFrame([("p", "P", "Success"), ("q", None, "Failed")], "Original_Protein_ID string, Mapped_UniProtKB_ID string, Mapping_Status string")
    sinks.mapped_compartments(mapped, str(tmp_path / "mc"))
    assert lines(tmp_path / "mc" / "unmapped") == ["q"] and len(lines(tmp_path / "mc" / "mapped")) >= 3
    assert rows(sinks.report(idmap.mapping_stats(mapped)))[0] == ("mapped", "1")


def test_stream(spark, tmp_path):
    kind = "ts timestamp, protein1 string, protein2 string"
    table = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, to string")
    batch = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS protein1, 'b' AS protein2 UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'b', 'a' UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'a', 'z' UNION ALL SELECT timestamp'2024-01-01 06:00:00', 'a', 'b'")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = evidence_counts(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), table)
    q = counts.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [(r.protein1, r.protein2, r.n) for r in spark.table("counts").collect()] == [("A", "B", 2)]
    finally:
        q.stop()


# Versions, sketches, state and registered functions


def test_versions_as_of(spark):
    rng = random.Random(8)
    day = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    known = [(rng.randrange(4), day(rng.randrange(300)), i, f"v{i % 7}") for i in range(60)] + [(1, day(5), 99, "z"), (1, day(5), 99, "a"), (None, day(1), 1, "x"), (2, None, 1, "y")]
    events = [(i, rng.randrange(6), day(rng.randrange(320))) for i in range(200)] + [(900, None, day(3)), (901, 1, None), (902, 1, day(5))]
    a = spark.createDataFrame(events, "id int, k int, at timestamp").repartition(3)
    b = spark.createDataFrame(known, "k int, at timestamp, n int, name string")
    want = []
    for i, k, t in events:
        able = [(u, n, name) for q, u, n, name in known if q == k is not None and u is not None and t is not None and u <= t]
        want.append((i, *(max(able)[1:] if able else (None, None))))
    for days in (1, 3, 100):
        assert rows(versions.as_of(a, b, "k", "at", ["n", "name"], days), "id", "n", "name") == sorted(want, key=repr)
    assert versions.as_of(a.where("false"), b, "k", "at", ["n"]).count() == 0
    assert rows(versions.as_of(a, b.where("false"), "k", "at", ["n"]), "n") == [(None,)] * len(events)
    with pytest.raises(ValueError, match="names"):
        versions.as_of(a.withColumn("N", F.lit(1)), b, "k", "at", ["n"])


def test_sketches_stay_within_their_error(spark):
    edges = spark.range(60_000).selectExpr("id % 20 AS day", "IF(id < 40000, 'x', 'y') AS net", "concat('a', id % 30000) AS protein1", "IF(id % 50 = 0, NULL, concat('b', id % 7000)) AS protein2")
    days = sketches.node_sketches(edges, "net", "day", lg_k=12)
    assert days.count() == 40
    exact = {r.net: r.n for r in edges.selectExpr("net", "explode(array(protein1, protein2)) AS n").groupBy("net").agg(F.count_distinct("n").alias("n")).collect()}
    for r in sketches.node_counts(sketches.merged(days, "net", lg_k=12)).collect():
        assert abs(r.nodes - exact[r.net]) < 5 * exact[r.net] / 64
    nets = edges.selectExpr("net", "explode(array(protein1, protein2)) AS n").where("n IS NOT NULL").distinct().groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    either, shared = nets.count(), nets.where("k = 2").count()
    got = sketches.shared_nodes(sketches.merged(days, "net", lg_k=12), "net").head()
    assert (got.net, got.other) == ("x", "y")
    assert abs(got.either - either) < 5 * either / 64 and abs(got.shared - shared) < 5 * shared / 64 * (either / shared) ** 0.5


def test_groupings_tell_their_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 3)], "p string, q string, v int")
    got = rows(clean.counted_in_sets(df, ["p", "q"], [["p", "q"], ["p"], []], big=F.col("v") > 1))
    assert got == sorted([("a", None, 0, 1, 0), ("a", "x", 0, 1, 1), (None, "x", 0, 1, 1), ("a", None, 1, 2, 1), (None, None, 1, 1, 1), (None, None, 3, 3, 2)], key=repr)


def test_registered_functions(spark):
    fitness = registered.register_fitness(spark, "total", lambda genes: genes.sum(axis=1))
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0]), (3, []), (4, [5.0, 5.0])], "id int, genes array<double>")
    assert rows(df.select("id", fitness(F.col("genes")).alias("f"))) == rows(spark.sql("SELECT id, total(genes) AS f FROM {df}", df=df)) == [(0, 3.0), (1, None), (2, 3.0), (3, 0.0), (4, 10.0)]
    registered.register_neighbors(spark)
    for x, kind in (([1, 2, 2], "int"), (["a", "b"], "string"), ([], "string")):
        one = spark.createDataFrame([("s", x)], f"name string, repr array<{kind}>")
        got = spark.sql("SELECT * FROM swap_neighbors(TABLE(SELECT * FROM {one}))", one=one)
        assert got.columns == ["name", "pos", "repr"]
        assert [list(r.repr) for r in got.orderBy("pos").collect()] == list(plain_swaps(x))
    with pytest.raises(Exception, match="an id and an array"):
        spark.sql("SELECT * FROM swap_neighbors(TABLE(SELECT 1))").collect()


def test_best_pairs_of_a_stream(spark, tmp_path):
    """Better rows come through, others don't; late ones are left out, and a pair that was silent starts anew."""
    kind = "ts timestamp, protein1 string, protein2 string, score double, row_id long"
    batches = [
        [("01 00:00", "a", "b", 0.5, 2), ("01 00:01", "b", "a", 0.5, 1), ("01 00:02", "c", "d", 0.9, 3), ("01 00:03", None, "d", 0.9, 4)],
        [("01 02:00", "a", "b", 0.4, 5), ("01 02:00", "d", "c", 0.95, 6), ("01 02:01", "c", "d", None, 7)],
        [("01 00:30", "a", "b", 0.99, 8), ("01 02:30", "e", "f", 0.1, 9)],
        [("03 00:00", "x", "y", 0.2, 10)],
        [("03 00:01", "a", "b", 0.3, 11)],
    ]
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen: list = []
    try:
        for i, batch in enumerate(batches):
            made = spark.createDataFrame([(f"2024-01-{t}:00", *r) for t, *r in batch], kind.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
            made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            found = best_pairs(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
            q = found.writeStream.outputMode("update").foreachBatch(lambda df, n, i=i: seen.extend((i, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset(key)
    assert sorted(seen) == [(0, "a", "b", 0.5, 1), (0, "c", "d", 0.9, 3), (1, "c", "d", 0.95, 6), (2, "e", "f", 0.1, 9), (3, "x", "y", 0.2, 10), (4, "a", "b", 0.3, 11)]
