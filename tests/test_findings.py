"""What a review of larger tables and odd rows found; each of these failed before."""

from __future__ import annotations

import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import clusters, evaluation, ga, idmap, similarity, sketches, tabu
from netloom.plans import catalog, fixtures, formats
from netloom.plans.registry import round_signed
from netloom.sources import archives
from netloom.storage import Store


def test_pairs_are_dealt_by_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 300)
    assert fixtures.part_edges(spark, sf).rdd.getNumPartitions() >= 19


@pytest.mark.parametrize("name", ["write_scores", "write_weighted_network", "write_bare_network", "write_edge_list", "write_edge_list_titled"])
def test_networks_are_written_by_the_lines(spark, sf, monkeypatch, tmp_path, name):
    """The tasks that count pairs are those that write, so each leaves a file."""
    monkeypatch.setattr(fixtures, "LINES", 300)
    monkeypatch.setattr(formats, "_folder", lambda spark: str(tmp_path / "out"))
    assert getattr(formats, name)(spark, sf).count() > 0
    assert len(list((tmp_path / "out").glob("part-*"))) >= 19


def test_a_report_counts_by_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 300)
    plan = formats.write_report(spark, sf)._jdf.queryExecution().executedPlan().toString()
    parts = [int(n) for n in re.findall(r"hashpartitioning\(u#\d+L?, v#\d+L?, (\d+)\)", plan)]
    assert parts and min(parts) >= 19


def test_neighbours_are_not_sorted(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 2), (3, 3), (2, 3)], "u long, v long")
    plan = similarity.hcn(edges)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    got = {(r.protein1, r.protein2): r.common_neighbors for r in similarity.hcn(edges, 1).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 2): 4, (3, 3): 2, (2, 3): 2}


def test_sketches_of_shares_are_exact(spark):
    edges = spark.range(60_000).selectExpr("IF(id < 40000, 'x', 'y') AS net", "concat('a', id % 30000) AS protein1", "concat('b', id % 7000) AS protein2")
    shares = sketches.shares_for(edges, lg_k=12)
    assert shares > 1
    one = sketches.node_sketches(edges, "net", lg_k=12, shares=shares)
    assert {r.net: r.nodes for r in sketches.node_counts(one).collect()} == {"x": 37_000, "y": 27_000}
    got = sketches.shared_nodes(one, "net", 12).head()
    assert (got.shared, got.either) == (27_000, 37_000)
    whole = sketches.shared_nodes(sketches.node_sketches(edges, "net", lg_k=17), "net", 17).head()
    assert (whole.shared, whole.either) == (27_000, 37_000)


def test_measure_of_two_rates_of_zero(spark):
    a, b = (spark.createDataFrame([(1, x), (1, x + 1)], "cid long, p long") for x in (0, 10))
    assert evaluation.precision_recall(a, b).head().f_measure == 0
    assert math.isnan(evaluation.precision_recall(a, b, undefined=float("nan")).head().f_measure)
    assert math.isnan(evaluation.total_score(a, b, undefined=float("nan")).head().total)


def test_rounding_keeps_the_sign(spark):
    df = spark.createDataFrame([(-1e-7,), (1e-7,), (-0.1234567,), (None,)], "x double")
    assert [str(r.x) for r in df.select(round_signed(F.col("x"), 6).alias("x")).collect()] == ["-0.0", "0.0", "-0.123457", "None"]


def test_given_columns_come_along(spark):
    df = spark.createDataFrame([(0, [True, False], [1.0, 2.0])], "start_id int, repr array<boolean>, worth array<double>")
    assert [tuple(r) for r in tabu.neighbors(df, tabu.SWAP, "worth").select("start_id", "worth", "repr").collect()] == [(0, [1.0, 2.0], [False, True])]


def test_ended_starts_do_no_work(spark):
    """Neighbours of a start that has ended are not formed."""
    df = spark.createDataFrame([(0, [True, False])], "start_id int, repr array<boolean>")
    never = tabu.Neighborhood("never", lambda x: F.transform(F.array(x), lambda y: F.when(F.size(y) > 0, F.raise_error(F.lit("formed")).cast("array<boolean>")).otherwise(y)))
    found = tabu.search(df, never, lambda x: F.size(x).cast("double"), 3, stop=lambda done, best, at: done >= 0).head()
    assert (found.repr, found.value) == ([True, False], 2.0)


def test_xml_files_are_many(spark, sf, monkeypatch):
    monkeypatch.setattr(formats, "XML_ROWS", 100)
    path = formats._dip(spark, sf)
    assert spark.read.format("binaryFile").load(path.replace("*", "interaction")).count() >= 10


def test_supplier_graph_is_written_once(spark, sf):
    assert fixtures.supplier_graph(spark, sf).netloom_path


def test_correlations_of_blocks(spark):
    """All pairs of a group by blocks are what pairs one by one give: gaps, two lengths, constants, nearly constant ones."""
    def v(i):
        n = 9 - 3 * (i % 3 == 0)
        if i % 7 == 0:
            return [0.1] * n
        if i % 5 == 0:
            return [0.3] * (n - 1) + [float(i)]
        return [None if (i + k) % 4 == 0 else 1e6 + math.sin(i * 31 + k) for k in range(n)]

    df = spark.createDataFrame([(i, i % 2, v(i)) for i in range(40)], "protein long, label int, v array<double>")
    pairs = df.select(F.col("protein").alias("protein1"), "label").join(df.select(F.col("protein").alias("protein2"), "label"), "label").where("protein1 < protein2")
    plain = F.transform("v", lambda x: x)
    a, b = df.select(F.col("protein").alias("protein1"), plain.alias("x")), df.select(F.col("protein").alias("protein2"), plain.alias("y"))
    rows = pairs.join(a, "protein1").join(b, "protein2").select("protein1", "protein2", similarity.scaled_correlation(F.col("x"), F.col("y")).alias("p"))
    constant = lambda i, j: any(len({v(k)[n] for n in range(min(len(v(i)), len(v(j)))) if v(i)[n] is not None and v(j)[n] is not None}) < 2 for k in (i, j))
    want = {(r.protein1, r.protein2): r.p for r in rows.collect() if not constant(r.protein1, r.protein2)}
    for block in (4, 1000):
        got = {(r.protein1, r.protein2): r.PCC for r in similarity.coexpression_within(df, "label", block).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_lookups_are_not_broadcast(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "protein1 string, protein2 string")
    table = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, to string")
    terms = spark.createDataFrame([("a", "t"), ("b", "t")], "protein string, term string")
    profiles = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0])], "protein string, v array<double>")
    for df, n in ((idmap.map_edges(edges, table), 1), (idmap.cascade(edges, "protein1", [(F.col("protein1"), table)]), 2), (similarity.annotation_cosine(edges, terms), 1), (similarity.coexpression(edges, profiles), 1)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == n


def test_tables_of_arrangements_are_the_fold(spark, monkeypatch):
    """Starts of few items go by tables and come to what the fold comes to; long ones and nulls still go by the fold."""
    rng = random.Random(5)
    sizes = [1, 2, 5, 6, 6, 7, 8, 8, 6, 6, 16]
    data = [(i, [rng.random() < 0.4 for _ in range(n)], [rng.randint(0, 9) / 7 for _ in range(n)], [float(rng.randint(1, 9)) for _ in range(n)]) for i, n in enumerate(sizes)]
    data[8][1][2], data[9][2][1] = None, None
    df = spark.createDataFrame(data, "start_id long, repr array<boolean>, values array<double>, weights array<double>")
    value = tabu.knapsack(F.col("values"), F.col("weights"), 12)
    for own in (
        {"neighborhood": tabu.composite([tabu.SWAP, tabu.INSERT]), "tenure": 4},
        {"neighborhood": tabu.INSERT, "tenure": 0, "stop": tabu.enough_iterations},
        {"neighborhood": tabu.SWAP, "tenure": 3, "aspiration": None, "diversification": True, "patience": 2},
        {"neighborhood": tabu.SWAP, "tenure": 5, "aspiration": tabu.aspired, "intensification": True, "diversification": True, "patience": 1},
    ):
        got = {}
        for most in (14, 0):
            monkeypatch.setattr(tabu, "LISTED", most)
            found = tabu.search(df, value=value, max_iterations=9, given=["values", "weights"], **own)
            assert ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString())
            got[most] = sorted(tuple(r) for r in found.collect())
        assert got[14] == got[0] and len(got[14]) == len(sizes)
        assert found.schema == tabu.search(df.limit(0), value=value, given=["values", "weights"], **own).schema


def test_clusters_climb_beside_a_small_graph(spark, monkeypatch):
    """A search beside the graph comes to what tables of candidates come to, in a few tables instead of one for each step."""
    rng = random.Random(11)
    pairs = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(60)) if a < b}
    weights = {p: rng.randint(1, 30) / 30 for p in sorted(pairs)}
    edges = [(f"n{x:02}", f"n{y:02}", w) for (a, b), w in weights.items() for x, y in ((a, b), (b, a))] + [("n03", "n03", 0.7), ("n01", "n05", 0.25), ("n05", "n01", 0.25)]
    adj = spark.createDataFrame(edges, "src string, dst string, weight double")
    members = [(c, f"n{x:02}") for c in range(30) for x in rng.sample(range(14), 1 + c % 6)] + [(3, "alone"), (99, "alone"), (98, "n02"), (98, "n02"), (None, "n01")]
    own = spark.createDataFrame(members, "cluster_id long, protein string")
    written, put = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, df: written.append(1) or put(self, df))
    for removal, most in (("reference", 20), ("best", 2)):
        got = []
        for edges, cells in ((4_000_000, 500_000), (4_000_000, 30), (0, 1)):
            monkeypatch.setattr(clusters, "EDGES", edges)
            monkeypatch.setattr(clusters, "CELLS", cells)
            written.clear()
            got.append(sorted(tuple(r) for r in clusters.local_search(own, adj, most, removal).collect()))
            assert edges == 0 or len(written) == 2
        assert got[0] == got[1] == got[2] and len(got[0]) > 30


def test_archives_are_read_by_any_reader(spark, tmp_path, monkeypatch):
    """Archives of short and long entries are whole for zipfile, and end before they have more entries than the format counts."""
    monkeypatch.setattr(archives, "ENTRIES", 40)
    data = [(f"d/é{i}.xml", None if i == 5 else bytes([i % 256]) * (i * 37 % 900)) for i in range(150)]
    archives.write_zips(spark.createDataFrame(data, "entry string, content binary").coalesce(1), str(tmp_path / "z"))
    found, many = {}, 0
    for path in (tmp_path / "z").glob("*.zip"):
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and len(z.namelist()) <= 40
            found |= {name: z.read(name) for name in z.namelist()}
            many += 1
    assert found == {name: content or b"" for name, content in data} and many == 4
    got = archives.zip_entries(spark, str(tmp_path / "z"), bytes_per_task=500)
    assert {r.entry: bytes(r.content) for r in got.collect()} == found and got.count() == 150


def test_overlaps_are_dealt_by_the_lines(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "protein1 string, protein2 string")
    terms = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "protein string, term string")
    for f in (similarity.annotation_cosine, similarity.localization_edges):
        got = f(edges, terms, parts=7)
        assert got.rdd.getNumPartitions() == 7 and [tuple(r) for r in got.collect()] == [("a", "b", 1.0)]


def test_lists_of_near_numbers_take_two_bytes(spark):
    """Lists go to their neighbours as distances where all are near, else as they are, and come back whole."""
    df = spark.createDataFrame([(100_000, [100_003, 90_000, 132_767]), (5, [6, 40_000]), (7, [])], "a int, x array<int>")
    short = df.select("a", "x", *similarity._short("a", "x"))
    assert short.schema["near"].dataType.simpleString() == "array<smallint>"
    assert {r.a: (r.near is None, r.far is None) for r in short.collect()} == {100_000: (False, True), 5: (True, False), 7: (False, True)}
    assert short.withColumn("back", similarity._long("a", df.schema["x"].dataType)).where("back <=> x").count() == 3


def test_few_parts_look_up_neighbours(spark):
    """Lists of neighbours go to as many parts as there are cores, whatever the number of shuffle partitions is."""
    edges = spark.range(400).selectExpr("id % 20 AS u", "20 + id % 19 AS v").distinct()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        plan = similarity.hcn(edges)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert set(re.findall(r"hashpartitioning\(b#\d+, (\d+)\)", plan)) == {str(spark.sparkContext.defaultParallelism)}


def test_numbers_and_names_share_neighbours(spark):
    """Ends that are their own numbers, ends that must be numbered, and edges whose larger end comes first."""
    rng = random.Random(3)
    pairs = sorted({tuple(sorted((rng.randrange(40), rng.randrange(40)))) for _ in range(300)})
    number = {(r.protein1, r.protein2): tuple(r)[2:] for r in similarity.hcn(spark.createDataFrame(pairs, "u long, v long"), 3).collect()}
    named = similarity.hcn(spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "u string, v string"), 3).collect()
    assert {(int(r.protein1[1:]), int(r.protein2[1:])): tuple(r)[2:] for r in named} == number
    turned = similarity.hcn(spark.createDataFrame([(b, a) for a, b in pairs], "u int, v int"), 3).collect()
    assert {(r.protein2, r.protein1): (*tuple(r)[2:4], r.degree_u, r.degree_v) for r in turned} == number and len(number) == len(pairs)


def test_small_clusters_look_for_each_pair_once(spark, monkeypatch):
    """Pairs of small clusters, each for both directions, come to what large clusters look for; loops and one-way edges too."""
    rng = random.Random(4)
    edges = {(rng.randrange(12), rng.randrange(12)): rng.randint(1, 9) / 8 for _ in range(90)}
    adj = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    own = [(c, x) for c in range(20) for x in rng.sample(range(14), 1 + c % 9)]
    members = spark.createDataFrame(own + own[:5], "cluster_id long, protein long")
    inside = {c: sorted(x for k, x in set(own) if k == c) for c in range(20)}
    want = {c: (sum(w for (a, b), w in edges.items() if a in p and b in p), sum(a in p and b in p for a, b in edges), sum(a in p and b not in p for a, b in edges), len(p)) for c, p in inside.items()}
    for small in (64, 0, 4):
        monkeypatch.setattr(clusters, "SMALL", small)
        got = {r.cluster_id: (r.win, r.ein, r.eout, r.n) for r in clusters.cluster_totals(members, adj).collect()}
        assert got == want


def test_islands_go_through_all_generations(spark, sf, monkeypatch):
    """The registered run has the default of 100 generations and exchanges behind every fifth, in code and SQL."""
    asked = []
    monkeypatch.setattr(ga, "evolve", lambda population, fitness, generations, interval, *rest, **named: asked.append((generations, interval)) or ga.evaluate(population, fitness))
    catalog.ga_islands(spark, sf)
    assert asked == [(100, 5)]
    assert "c119 AS" not in catalog.SQL["ga_islands"] and "e120 AS" in catalog.SQL["ga_islands"] and "'99'" in catalog.SQL["ga_islands"]


@pytest.mark.parametrize("together", [1, 2, 5])
def test_generations_of_one_plan_are_those_written_one_by_one(spark, monkeypatch, together):
    monkeypatch.setattr(ga, "TOGETHER", together)
    df = spark.createDataFrame([(i % 3, i // 3, [math.sin(i), math.cos(i)]) for i in range(24)], "island int, idx int, genes array<double>")
    fitness, mutator = catalog.sphere, ga.gaussian_mutator(0.3)
    want = ga.run(df, fitness, 6, 3, 1, mutator=mutator)[0].select("island", "idx", "genes", "fitness").collect()
    got = ga.evolve(df, fitness, 6, 3, 1, mutator=mutator).select("island", "idx", "genes", "fitness").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 24


def test_leaving_is_scored_for_members_alone(monkeypatch):
    """A step scores all nodes once, for joining, and besides only the members that can leave and the clusters as they are."""
    n = 50
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    keep = (a < b) & ((a * 7 + b * 3) % 4 > 0)
    a, b = a[keep], b[keep]
    w = 1 + (a * b) % 5 / 4
    graph = clusters.Matrix(np.r_[a, b], np.r_[b, a], np.r_[w, w], n)
    member = np.zeros((6, n), bool)
    for i in range(6):
        member[i, i * 3 : i * 3 + 4] = True
    scored, whole = [], clusters._ff
    monkeypatch.setattr(clusters, "_ff", lambda *t: scored.append(np.broadcast(*t).size) or whole(*t))
    clusters._climb(graph, member, np.zeros(6, np.int64), 1, "reference")
    assert scored[:3] == [6, 6 * n, 6 * 4]


def test_profiles_move_as_they_are_in_large_blocks(spark, monkeypatch):
    """Profiles of a group of 2,500 go to one block, as floats if they are, and strips of a block give each pair once."""
    df = spark.range(2_500).selectExpr("id AS protein", "0 AS label", "array(cast(sin(id) AS float), cast(cos(id) AS float), cast(id % 7 AS float)) AS v")
    found = similarity.coexpression_within(df, "label")
    assert "as array<double>" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select(F.min("protein1"), F.count(F.lit(1)), F.count_distinct(F.struct("protein1", "protein2"))).head()[1:] == (2_500 * 2_499 // 2,) * 2
    few = df.limit(60)
    got = []
    for strip, block in ((7, 4_000), (7, 20), (1_000, 4_000)):
        monkeypatch.setattr(similarity, "STRIP", strip)
        got.append({(r.protein1, r.protein2): round(r.PCC, 9) for r in similarity.coexpression_within(few, "label", block).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 60 * 59 // 2
