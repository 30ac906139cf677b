"""Queries over versions, sketches, grouping sets and functions that are registered for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from netloom.functions.registered import register_fitness, register_neighbors
from netloom.operators import clean, ga, sketches, versions
from netloom.plans import catalog
from netloom.plans import fixtures as fx
from netloom.plans.fixtures import table
from netloom.plans.registry import SQL, query, rounded


@query("""WITH v AS (SELECT user_id, ts, 'U' || event_id AS uniprot, value AS score FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, v.uniprot, v.score FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def versions_as_of(spark, d):
    """Each event with the id and score that its user's last purchase before it, or itself, brought in."""
    e = table(spark, d, "events")
    known = e.where("event_type = 'purchase'").select("user_id", "ts", F.concat(F.lit("U"), F.col("event_id").cast("string")).alias("uniprot"), F.col("value").alias("score"))
    return versions.as_of(e.select("event_id", "user_id", "ts"), known, "user_id", "ts", ["uniprot", "score"]).select("event_id", "user_id", "uniprot", "score")


_LINES = "lines AS (SELECT *, l_partkey <> l_suppkey AS proper, l_quantity >= 25 AS supported, l_discount > 0.05 AS confident, year(l_shipdate) AS year FROM lineitem)"


@query(f"WITH {_LINES} SELECT l_returnflag, l_linestatus, year::INT AS year, grouping_id(l_returnflag, l_linestatus, year)::BIGINT AS level, count(*) AS n, count(*) FILTER (proper) AS proper, count(*) FILTER (proper AND supported) AS supported, count(*) FILTER (proper AND supported AND confident) AS confident FROM lines GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, year), (l_returnflag, l_linestatus), (year), ())")
def clean_stage_sets(spark, d):
    """Rows of each cleaning stage by flag, status and year, with the totals of coarser groups."""
    lines = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    proper, supported, confident = F.col("l_partkey") != F.col("l_suppkey"), F.col("l_quantity") >= 25, F.col("l_discount") > 0.05
    columns = ["l_returnflag", "l_linestatus", "year"]
    return clean.counted_in_sets(lines, columns, [columns, columns[:2], columns[2:], []], proper=proper, supported=proper & supported, confident=proper & supported & confident)


def _networks(spark, d):
    """(network, day, protein1, protein2): the parts and suppliers of lines, a network for each flag and status."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.concat("l_returnflag", "l_linestatus").alias("network"), F.to_date("l_shipdate").alias("day"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("protein1"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("protein2"))


#: Sketches that are exact for a share of the nodes, so that they and SQL say the same however many there are.
_EXACT = 17
_NODES = "nodes AS (SELECT DISTINCT l_returnflag || l_linestatus AS network, unnest(['P' || l_partkey, 'S' || l_suppkey]) AS node FROM lineitem)"


@query(f"WITH {_NODES} SELECT network, count(*) AS nodes FROM nodes GROUP BY 1")
def sketch_nodes(spark, d):
    """The nodes of each network, from sketches of its days."""
    lines = _networks(spark, d)
    days = sketches.node_sketches(lines, "network", "day", lg_k=_EXACT, shares=sketches.shares_for(lines, lg_k=_EXACT))
    return sketches.node_counts(sketches.merged(days, "network", sketches.SHARE, lg_k=_EXACT))


@query(f"WITH {_NODES} SELECT a.network, b.network AS other, count(*) FILTER (x.node IS NOT NULL AND y.node IS NOT NULL) AS shared, count(*) AS either FROM (SELECT DISTINCT network FROM nodes) a JOIN (SELECT DISTINCT network FROM nodes) b ON a.network < b.network JOIN (SELECT DISTINCT node FROM nodes) n ON true LEFT JOIN nodes x ON x.network = a.network AND x.node = n.node LEFT JOIN nodes y ON y.network = b.network AND y.node = n.node WHERE x.node IS NOT NULL OR y.node IS NOT NULL GROUP BY 1, 2")
def sketch_shared(spark, d):
    """The nodes that two networks share, from their sketches."""
    lines = _networks(spark, d)
    return sketches.shared_nodes(sketches.node_sketches(lines, "network", lg_k=_EXACT, shares=sketches.shares_for(lines, lg_k=_EXACT)), "network", _EXACT)


@query(SQL["ga_generation"])
def ga_generation_registered(spark, d):
    """A generation whose fitness is a vectorised Python function."""
    fitness = register_fitness(spark, "sphere", lambda genes: -(genes * genes).sum(axis=1))
    children = ga.next_generation(ga.evaluate(fx.population(spark, d), fitness), fitness, 7, 1, mutator=ga.gaussian_mutator(0.2))
    return rounded(children.select("island", "idx", F.posexplode("genes").alias("pos", "gene")).withColumn("pos", F.col("pos").cast("long")), "gene")


@query(SQL["ga_summary"])
def ga_summary_registered(spark, d):
    """The islands' best and mean by a fitness that SQL calls by its name."""
    register_fitness(spark, "norm", lambda genes: -np.square(genes).sum(axis=1))
    pop = spark.sql("SELECT *, norm(genes) AS fitness FROM {pop}", pop=fx.population(spark, d))
    return rounded(ga.summary(pop), "best", "avg")


@query(SQL["tabu_neighbors_swap"])
def tabu_neighbors_sql(spark, d):
    """Swap neighbours from a table function of SQL."""
    register_neighbors(spark)
    starts = catalog._knapsacks(spark, d).select("start_id", "repr")
    return spark.sql("SELECT start_id, pos, array_join(transform(repr, x -> CAST(x AS STRING)), ',') AS key FROM swap_neighbors(TABLE(SELECT * FROM {starts}) PARTITION BY start_id)", starts=starts)
