"""Queries that go the whole way from raw links to a weighted network and the groups that hold in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import construction
from netloom.plans import fixtures as fx
from netloom.plans.fixtures import table, with_
from netloom.plans.registry import query, rounded
from netloom.storage import Store

#: Months of the sales, the places of a profile.
_MONTHS = range(1, 13)


def _sources(spark, d):
    """Parts as proteins: linked by orders, known by name, sold by month, described by kind, placed by supplier."""
    e, p = fx.part_edges(spark, d), table(spark, d, "part")
    k, size, s = F.col("p_partkey"), F.col("p_size"), F.col("u") + F.col("v")
    scores = e.select("u", "v", (600 + s % 400).alias("combined_score"), F.when(s % 7 > 0, F.col("w") * 50).alias("experimental"), (60 + s % 100).alias("coexpression"), F.lit(0).alias("database"), F.lit(None).cast("long").alias("textmining"))
    both = F.explode(F.array(*[F.struct(F.concat(F.lit("4932.YP"), a).alias("protein1"), F.concat(F.lit("4932.YP"), b).alias("protein2"), (F.col("u") * 100_000_000 + F.col("v") * 2 + i).alias("row_id")) for a, b, i in (("u", "v", 0), ("v", "u", 1))]))
    links = scores.withColumn("link", both).select("link.protein1", "link.protein2", "combined_score", "experimental", "coexpression", "database", "textmining", "link.row_id")

    own = F.concat(F.lit("P"), F.when(size < 3, k - 1).otherwise(k))
    line = lambda rows, accession, db, name, more=0: rows.select(accession.alias("uniprot"), F.lit(db).alias("db"), name.alias("db_id"), (k + more).alias("line_no"))
    mapping = line(p.where(~size.isin(3, 4)), own, "STRING", F.concat(F.lit("4932.YP"), k))
    mapping = mapping.union(line(p.where(size > 45), F.concat(F.lit("Q"), k), "STRING", F.concat(F.lit("4932.YP"), k), 1_000_000_000))
    mapping = mapping.union(line(p.where(k % 3 == 0), own, "Gene_OrderedLocusName", F.concat(F.lit("YP"), k))).union(line(p.where(k % 3 == 1), own, "Gene_Name", F.concat(F.lit("g"), k)))

    lines = table(spark, d, "lineitem")
    sold = lines.groupBy("l_partkey").agg(*[F.sum(F.when(F.month("l_shipdate") == m, F.col("l_quantity"))).alias(f"m{m}") for m in _MONTHS])
    gene = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("YP"), "l_partkey")).otherwise(F.concat(F.lit("g"), "l_partkey"))
    expression = sold.select(gene.alias("gene"), F.array(*[F.col(f"m{m}").cast("double") for m in _MONTHS]).alias("v"), F.col("l_partkey").alias("row_id"))

    kind = F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "))
    terms = p.select(F.concat(F.lit("P"), k).alias("protein"), kind.alias("term"))
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("term"))
    places = lines.select("l_partkey", "l_suppkey").distinct().join(nations, "l_suppkey").select(F.concat(F.lit("P"), "l_partkey").alias("protein_id"), "term")
    return construction.Sources(links, mapping, expression, terms, places)


_BUILT = """raw AS (SELECT u, v FROM pe WHERE 600 + (u + v) % 400 >= 700 AND greatest(CASE WHEN (u + v) % 7 > 0 THEN w * 50 END, 60 + (u + v) % 100) > 90),
acc AS (SELECT p_partkey AS k, 'P' || CASE WHEN p_size < 3 THEN p_partkey - 1 ELSE p_partkey END AS a, p_size FROM part),
ed AS (SELECT DISTINCT least(x.a, y.a) AS u, greatest(x.a, y.a) AS v FROM raw JOIN acc x ON x.k = raw.u JOIN acc y ON y.k = raw.v WHERE x.p_size NOT IN (3, 4) AND y.p_size NOT IN (3, 4)),
bo AS (SELECT u AS src, v AS dst FROM ed UNION SELECT v, u FROM ed),
bd AS (SELECT src, count(*) AS n FROM bo GROUP BY 1),
bc AS (SELECT ed.u, ed.v, count(*) AS c FROM ed JOIN bo p ON p.src = ed.u JOIN bo q ON q.src = ed.v AND q.dst = p.dst GROUP BY 1, 2),
hc AS (SELECT ed.u, ed.v, (coalesce(c, 0) * coalesce(c, 0))::DOUBLE / (p.n * q.n * (p.n + q.n - coalesce(c, 0))) AS s FROM ed JOIN bd p ON p.src = ed.u JOIN bd q ON q.src = ed.v LEFT JOIN bc ON bc.u = ed.u AND bc.v = ed.v),
yr AS (SELECT l_partkey AS k, month(l_shipdate) AS y, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1, 2),
ge AS (SELECT a, min(k) AS k FROM acc WHERE k % 3 < 2 AND k IN (SELECT k FROM yr) GROUP BY 1),
pr AS (SELECT a, y, q FROM ge JOIN yr USING (k)),
co AS (SELECT ed.u, ed.v, (corr(x.q, y.q) + 1) / 2 AS s FROM ed JOIN pr x ON x.a = ed.u JOIN pr y ON y.a = ed.v AND y.y = x.y GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_pop(x.q) > 0 AND stddev_pop(y.q) > 0),
ft AS (SELECT DISTINCT 'P' || p_partkey AS a, unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS term FROM part),
lt AS (SELECT DISTINCT 'P' || l_partkey AS a, s_nationkey AS term FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE 'P' || l_partkey IN (SELECT a FROM acc WHERE p_size NOT IN (3, 4) OR k % 3 < 2)),
fn AS (SELECT a, count(*) AS n FROM ft GROUP BY 1), ln AS (SELECT a, count(*) AS n FROM lt GROUP BY 1),
fs AS (SELECT ed.u, ed.v, count(*) / sqrt((any_value(m.n) * any_value(o.n))::DOUBLE) AS s FROM ed JOIN ft x ON x.a = ed.u JOIN ft y ON y.a = ed.v AND y.term = x.term JOIN fn m ON m.a = ed.u JOIN fn o ON o.a = ed.v GROUP BY 1, 2),
sl AS (SELECT ed.u, ed.v, (count(*) * count(*))::DOUBLE / (any_value(m.n) * any_value(o.n)) AS s FROM ed JOIN lt x ON x.a = ed.u JOIN lt y ON y.a = ed.v AND y.term = x.term JOIN ln m ON m.a = ed.u JOIN ln o ON o.a = ed.v GROUP BY 1, 2),
four AS (SELECT ed.u, ed.v, fs.s AS f, sl.s AS l, co.s AS c, hc.s AS h FROM ed LEFT JOIN fs ON fs.u = ed.u AND fs.v = ed.v LEFT JOIN sl ON sl.u = ed.u AND sl.v = ed.v LEFT JOIN co ON co.u = ed.u AND co.v = ed.v LEFT JOIN hc ON hc.u = ed.u AND hc.v = ed.v),
net AS (SELECT u AS protein1, v AS protein2, (f + l + c + h) / ((f <> 0)::INT + (l <> 0)::INT + (c <> 0)::INT + (h <> 0)::INT) AS mean_weight FROM four WHERE f IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL AND h IS NOT NULL AND (f <> 0 OR l <> 0 OR c <> 0 OR h <> 0)),
uni AS (SELECT u AS protein1, v AS protein2, (coalesce(f, 0) + coalesce(l, 0) + coalesce(c, 0) + coalesce(h, 0)) / ((f IS NOT NULL)::INT + (l IS NOT NULL)::INT + (c IS NOT NULL)::INT + (h IS NOT NULL)::INT) AS mean_weight FROM four WHERE f IS NOT NULL OR l IS NOT NULL OR c IS NOT NULL OR h IS NOT NULL)"""


@query(with_("pe", _BUILT) + "SELECT protein1, protein2, round(mean_weight, 6) AS mean_weight FROM net")
def network_weights(spark, d):
    """The weight of each edge that has all four scores."""
    return rounded(construction.build_network(_sources(spark, d)), "mean_weight", digits=6)


def _stats_sql(name: str) -> str:
    return f"SELECT '{name}' AS network, (SELECT count(*) FROM (SELECT protein1 FROM {name} UNION SELECT protein2 FROM {name})) AS proteins, count(*) AS interactions, avg(mean_weight) AS mean_weight FROM {name}"


@query(with_("pe", _BUILT) + f"SELECT network, proteins, interactions, round(mean_weight, 6) AS mean_weight, round(interactions / (proteins * (proteins - 1) / 2), 9) AS density FROM ({_stats_sql('net')} UNION ALL {_stats_sql('uni')})")
def network_summary(spark, d):
    """Nodes, edges, mean weight and density of the networks by both ways to fuse."""
    scored = Store(spark).put(construction.scored_network(_sources(spark, d)))
    built = {name: construction.fused_network(scored, how) for name, how in (("net", "intersection"), ("uni", "union"))}
    return rounded(rounded(construction.network_summaries(built), "mean_weight", digits=6), "density")


@query(with_("pe baskets", _BUILT + """, gr AS (SELECT complex_id, 'P' || protein AS protein FROM baskets), nb AS (SELECT protein1 AS src, protein2 AS dst FROM net UNION SELECT protein2, protein1 FROM net),
whole AS (SELECT complex_id, count(*) AS size, min(protein) AS s, count(*) FILTER (protein IN (SELECT src FROM nb)) AS present FROM gr GROUP BY 1),
ins AS (SELECT g.complex_id, src, dst FROM gr g JOIN whole w ON w.complex_id = g.complex_id AND w.size = w.present JOIN nb ON src = g.protein JOIN gr h ON h.complex_id = g.complex_id AND h.protein = dst),
met AS (SELECT complex_id, s AS p FROM whole UNION SELECT m.complex_id, i.dst FROM met m JOIN ins i ON i.complex_id = m.complex_id AND i.src = m.p),
seen AS (SELECT complex_id, count(*) AS n FROM met GROUP BY 1)""", True) + "SELECT complex_id, size, CASE WHEN size < 3 THEN 'small' WHEN present < size THEN 'missing' WHEN n = size THEN 'kept' ELSE 'disconnected' END AS status FROM whole JOIN seen USING (complex_id)")
def network_complexes(spark, d):
    """Which orders, as complexes of their parts, hold together in the weighted network."""
    network = Store(spark).put(construction.build_network(_sources(spark, d)))
    members = fx.baskets(spark, d).select("complex_id", F.concat(F.lit("P"), "protein").alias("protein"))
    return construction.groups_of_network(members, network)
