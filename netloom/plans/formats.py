"""Queries that write whole tables in the formats of the sources and read them again, each with SQL over the tables.

The files lie in the shared folder and are deleted when the driver's process ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators import clean, graph, idmap
from netloom.plans import fixtures as fx
from netloom.plans.fixtures import table, with_
from netloom.plans.registry import query
from netloom.sources import archives, readers, sinks
from netloom.storage import Store


def _folder(spark: SparkSession) -> str:
    return Store(spark).folder()


def _written(lines: DataFrame) -> str:
    """A folder of text files with the lines of a frame of one column, in its order."""
    folder = _folder(lines.sparkSession)
    lines.write.text(folder)
    return folder


def _joined(separator: str, *fields: Column) -> Column:
    """Fields with the separator between them; null is an empty field."""
    return F.concat_ws(separator, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


# Interactions

_MITAB = "SELECT 'uniprotkb:' || protein1 AS \"ID_A\", protein2 AS \"ID_B\", 'psi-mi:\"MI:0018\"(two hybrid)' AS \"Method\", row_id::VARCHAR AS \"IntIDs\", CASE WHEN row_id % 3 > 0 THEN (score::BIGINT)::VARCHAR END AS \"Confidence\" FROM links"


@query(with_("links") + f"{_MITAB} WHERE row_id % 7 > 0")
def read_mitab(spark, d):
    row = F.col("row_id")
    known = {"ID_A": F.concat(F.lit("uniprotkb:"), "protein1"), "ID_B": F.col("protein2"), "Method": F.lit('psi-mi:"MI:0018"(two hybrid)'), "IntIDs": row, "Confidence": F.when(row % 3 > 0, F.col("score").cast("long"))}
    line = _joined("\t", *[known.get(c, F.lit("-")) for c in readers.MITAB])
    lines = fx.part_links(spark, d).select(F.when(row % 7 == 0, F.concat(F.lit("#"), line)).otherwise(line))
    return readers.mitab(spark, _written(lines)).select(*known)


_STRING = "SELECT '4932.P' || p_partkey AS a, '4932.Q' || p_size AS b, CASE WHEN p_size % 5 > 0 THEN p_size * 2 END AS e, p_size + 30 AS c, p_partkey % 100 AS d, 50 AS t, p_size * 20 AS s FROM part"


def _string(spark, d):
    size = F.col("p_size")
    fields = {"combined_score": size * 20, "protein1": F.concat(F.lit("4932.P"), "p_partkey"), "protein2": F.concat(F.lit("4932.Q"), "p_size"), "textmining": F.lit(50), "experimental": F.when(size % 5 > 0, size * 2), "database": F.col("p_partkey") % 100, "coexpression": size + 30}
    folder = _folder(spark)
    table(spark, d, "part").select(*[c.alias(n) for n, c in fields.items()]).write.csv(folder, sep=" ", header=True)
    return readers.string_links(spark, folder)


@query(f"SELECT a AS protein1, b AS protein2, e::BIGINT AS experimental, c::BIGINT AS coexpression, d::BIGINT AS \"database\", t::BIGINT AS textmining, s::BIGINT AS combined_score FROM ({_STRING})")
def read_string_links(spark, d):
    links = _string(spark, d)
    return links.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in links.dtypes])


@query(f"SELECT DISTINCT least(x, y) AS protein1, greatest(x, y) AS protein2 FROM (SELECT replace(a, '4932.', '') AS x, replace(b, '4932.', '') AS y FROM ({_STRING}) WHERE s >= 700 AND greatest(e, c, d, t) > 90)")
def read_string_edges(spark, d):
    """From a file of links to pairs: the supported ones, without the prefix of the taxon, each once."""
    return clean.pair_set(readers.string_edges(clean.supported_links(_string(spark, d)), "4932."))


_DIP = """WITH who AS (SELECT s_suppkey::VARCHAR AS id, CASE s_suppkey % 4 WHEN 0 THEN 'U' || s_suppkey WHEN 1 THEN 'R' || s_suppkey WHEN 2 THEN s_name END AS protein FROM supplier),
ends AS (SELECT l_orderkey, list_sort(list(l_suppkey)) AS refs FROM lineitem GROUP BY 1 HAVING count(*) = 2),
pairs AS (SELECT a.protein AS protein1, b.protein AS protein2, CASE WHEN l_orderkey % 3 > 0 THEN ((l_orderkey % 10) / 10)::VARCHAR END AS confidence FROM ends JOIN who a ON a.id = refs[1]::VARCHAR JOIN who b ON b.id = refs[2]::VARCHAR WHERE a.protein <> b.protein)
"""


#: Rows of one XML file at most, as a task reads whole files.
XML_ROWS = 100_000


def _dip(spark, d):
    """A path of interactors and interactions as XML files."""
    key = F.col("s_suppkey")
    refs = F.array(*[F.struct(F.lit(db).alias("_db"), F.concat(F.lit(letter), key).alias("_id")) for db, letter in (("refseq", "R"), ("uniprot knowledge base", "U"))])
    named = F.when(key % 4 < 3, F.struct(F.col("s_name").alias("shortLabel")))
    who = table(spark, d, "supplier").select(key.alias("_id"), named.alias("names"), F.struct(F.slice(refs, 1, F.greatest(2 - key % 4, F.lit(0)).cast("int")).alias("secondaryRef")).alias("xref"))
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("refs"))
    parts = F.struct(F.transform("refs", lambda r: F.struct(r.alias("interactorRef"))).alias("participant"))
    note = F.when(F.col("l_orderkey") % 3 > 0, F.struct(F.struct((F.col("l_orderkey") % 10 / 10).alias("value")).alias("confidence")))
    facts = ends.select(F.col("l_orderkey").alias("_id"), parts.alias("participantList"), note.alias("confidenceList"))
    folder = _folder(spark)
    for tag, rows in (("interactor", who), ("interaction", facts)):
        rows.write.format("xml").options(rootTag="entrySet", rowTag=tag, maxRecordsPerFile=XML_ROWS).save(f"{folder}/{tag}")
    return f"{folder}/*"


@query(_DIP + "SELECT id, protein FROM who WHERE protein IS NOT NULL")
def read_dip_interactors(spark, d):
    return readers.dip_interactors(spark, _dip(spark, d))


@query(_DIP + "SELECT * FROM pairs")
def read_dip_interactions(spark, d):
    return readers.dip_interactions(spark, _dip(spark, d))


@query(_DIP + "SELECT DISTINCT least(protein1, protein2) AS protein1, greatest(protein1, protein2) AS protein2 FROM pairs WHERE confidence IS NULL OR confidence::DOUBLE > 0.8")
def read_dip_edges(spark, d):
    """From a file of interactions to confident pairs, each once."""
    return clean.pair_set(clean.confident(readers.dip_interactions(spark, _dip(spark, d))))


@query(with_("links") + "SELECT DISTINCT upper(protein1) AS protein1, upper(trim(protein2)) AS protein2 FROM links WHERE row_id % 9 > 0")
def read_ppi_clean(spark, d):
    lines = fx.part_links(spark, d).select(_joined("\t", F.concat(F.lit(" "), "protein1", F.lit("  ")), F.when(F.col("row_id") % 9 > 0, F.lower("protein2"))))
    return readers.ppi_clean(readers.ppi_raw(spark, _written(lines)))


@query("SELECT 'P' || l_partkey AS protein1, 'S' || l_suppkey AS protein2 FROM lineitem WHERE l_orderkey % 5 < 2")
def read_ppi_tolerant(spark, d):
    kind, pair = F.col("l_orderkey") % 5, (F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey"))
    line = F.when(kind == 0, _joined("\t", *pair, F.lit("more"))).when(kind == 1, F.concat(F.lit("  "), _joined("  ", *pair))).when(kind == 2, F.concat(F.lit("# "), _joined("\t", *pair))).when(kind == 3, _joined("\t", F.lit("Protein1"), pair[1])).otherwise(pair[0])
    return readers.ppi_tolerant(spark, _written(table(spark, d, "lineitem").select(line)))


# Groups

_PORTAL = '<interactor id="%s"><interactorType><names><shortLabel>%s</shortLabel></names></interactorType><xref><primaryRef db="%s" id="N%s"/></xref></interactor>'


@query("SELECT l_orderkey AS k, list_sort(list(DISTINCT 'N' || l_partkey)) AS proteins FROM lineitem WHERE l_partkey % 5 > 0 AND l_partkey % 7 > 0 GROUP BY 1")
def read_portal_complexes(spark, d):
    """Archives with a file for each order, whose participants are its parts, two of each kind that do not count."""
    def lines(template, *fields):
        return F.array_join(F.transform("parts", lambda n: F.format_string(template, *[f(n) for f in fields])), "")

    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    n = lambda x: x.cast("string")
    who = lines(_PORTAL, n, lambda x: F.when(x % 5 > 0, "protein").otherwise("rna"), lambda x: F.when(x % 7 > 0, "uniprotkb").otherwise("refseq"), n)
    content = F.concat(F.lit("<entrySet><entry><interactorList>"), who, F.lit('</interactorList><interactionList><abstractInteraction id="c"><participantList>'), lines('<participant id="p%s"><interactorRef>%s</interactorRef></participant>', n, n), F.lit("</participantList></abstractInteraction></interactionList></entry></entrySet>"))
    names = F.concat(F.lit("yeast/"), F.col("l_orderkey").cast("string"))
    files = parts.select(F.explode(F.array(F.struct(F.concat(names, F.lit(".xml")).alias("entry"), content.alias("content")), F.struct(F.concat(names, F.lit(".txt")).alias("entry"), F.lit("no complex").alias("content")))).alias("x")).select("x.*")
    folder = _folder(spark)
    archives.write_zips(files, folder)
    sets = readers.portal_archive(spark, folder).groupBy("complex_id").agg(F.sort_array(F.collect_set("protein")).alias("proteins"))
    return sets.select(F.regexp_extract("complex_id", "/([0-9]+)[.]xml#0$", 1).cast("long").alias("k"), "proteins")


_LISTED = """listed AS (SELECT l_orderkey AS k, 'CORUM_' || l_orderkey AS complex_id, list_sort(list_distinct(list(CASE WHEN l_orderkey % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END))) AS proteins FROM lineitem GROUP BY 1),
humap AS (SELECT l_orderkey AS k, 'HuMAP_' || l_orderkey AS complex_id, list_sort(list_distinct(list('S' || l_suppkey))) AS proteins FROM lineitem GROUP BY 1)"""


def _corum(spark, d):
    """Each order once with its parts; then the even ones again, with their suppliers."""
    def lines(turn, letter, key):
        items = F.array_join(F.collect_list(F.concat(F.lit(letter), key)), "; ")
        return table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items")).select(F.lit(turn).alias("turn"), F.col("l_orderkey").alias("k"), _joined("\t", F.col("l_orderkey"), F.lit("name"), F.concat("items", F.lit(";;"))).alias("line"))

    folder = _folder(spark)
    rows = lines(0, "P", "l_partkey").union(lines(1, "S", "l_suppkey").where("k % 2 = 0")).orderBy("turn", "k")
    named = rows.select(*[F.get(F.split("line", "\t"), F.lit(i)).alias(c) for i, c in enumerate(("complex_id", "name", "subunits_uniprot_id"))])
    sinks.tsv(named, folder, True)
    return readers.corum(spark, folder, "CORUM_")


def _humap(spark, d):
    folder = _folder(spark)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("HuMAP2_ID")).agg(F.array_join(F.collect_list(F.concat(F.lit("S"), "l_suppkey")), " ").alias("Uniprot_ACCs"))
    rows.select("HuMAP2_ID", F.lit("1").alias("Confidence"), "Uniprot_ACCs").write.csv(folder, header=True)
    return readers.humap(spark, folder)


@query(f"WITH {_LISTED} SELECT complex_id, proteins FROM listed")
def read_corum(spark, d):
    return _corum(spark, d).select("complex_id", F.sort_array("proteins").alias("proteins"))


@query(f"WITH {_LISTED} SELECT complex_id, proteins FROM humap")
def read_humap(spark, d):
    return _humap(spark, d).select("complex_id", F.sort_array("proteins").alias("proteins"))


@query(f"WITH {_LISTED}, both_ AS (SELECT 0 AS source, complex_id, proteins FROM listed UNION ALL SELECT 1, complex_id, proteins FROM humap), ranked AS (SELECT *, row_number() OVER (PARTITION BY proteins ORDER BY source, complex_id) AS r FROM both_) SELECT complex_id, proteins FROM ranked WHERE r = 1")
def read_known_complexes(spark, d):
    """Two sources made one, each set of members once."""
    return readers.known_complexes(_corum(spark, d), _humap(spark, d))


def _complexes(spark, d, separator, header):
    folder = _folder(spark)
    groups = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("complex_id"), F.concat(F.lit("P"), "l_partkey").alias("protein"))
    sinks.complexes(groups, folder, separator, header)
    return readers.complex_file(spark, folder, separator)


_WRITTEN = "WITH g AS (SELECT DISTINCT l_orderkey::VARCHAR AS complex_id, 'P' || l_partkey AS protein FROM lineitem) SELECT complex_id, protein FROM g WHERE complex_id IN (SELECT complex_id FROM g GROUP BY 1 HAVING count(*) >= 3)"


@query(_WRITTEN)
def write_complexes(spark, d):
    return _complexes(spark, d, ";", True)


@query(_WRITTEN)
def write_complexes_spaced(spark, d):
    return _complexes(spark, d, " ", False)


# Identifiers, expression, annotations


@query(with_("idmap") + "SELECT db, db_id, arg_max(uniprot, line_no) AS first, arg_min(uniprot, line_no) AS last FROM idmap WHERE db IN ('ORF', 'Gene_OrderedLocusName', 'STRING') AND line_no % 10 > 0 GROUP BY 1, 2")
def read_idmapping(spark, d):
    """The first and last accession of an identifier, of a file that is written from its last line to its first."""
    rows = fx.idmap(spark, d).orderBy(F.desc("line_no"), "db")
    line = F.when(F.col("line_no") % 10 > 0, _joined("\t", F.col("uniprot"), F.col("db"), F.col("db_id"))).otherwise(_joined("\t", F.col("uniprot"), F.col("db")))
    read = readers.idmapping(spark, _written(rows.select(line))).where(F.col("db").isin("ORF", "Gene_OrderedLocusName", "STRING"))
    return read.groupBy("db", "db_id").agg(F.min_by("uniprot", "line_no").alias("first"), F.max_by("uniprot", "line_no").alias("last"))


@query("SELECT p_brand AS \"IDENTIFIER\", [p_size::DOUBLE, p_partkey % 97 + 0.5::DOUBLE, p_size * 2::DOUBLE] AS v FROM part WHERE p_size % 6 > 0 AND p_partkey % 8 > 0")
def read_expression(spark, d):
    """Profiles of a series file: after the marker and the header, rows of which some have a gap."""
    size, key = F.col("p_size"), F.col("p_partkey")
    line = _joined("\t", key, F.col("p_brand"), F.when(size % 6 > 0, size.cast("string")), F.lit("note"), F.when(key % 8 > 0, (key % 97 + 0.5).cast("string")).otherwise("null"), size * 2)
    first = ["^DATABASE = x", "!dataset_title = y\tz", "!dataset_table_begin", "ID_REF\tIDENTIFIER\tGSM1\tnote\tGSM2\tGSM3"]
    marks = [*[(0, i, x) for i, x in enumerate(first)], (2, 0, "!dataset_table_end")]
    rows = spark.createDataFrame(marks, "part int, at long, line string").union(table(spark, d, "part").select(F.lit(1), key.cast("long"), line))
    read = readers.soft_expression(spark, _written(rows.orderBy("part", "at").select("line")))
    return readers.expression_profiles(read).select("IDENTIFIER", "v")


@query("SELECT DISTINCT 'S' || l_partkey AS sgd, 'GO:' || l_suppkey AS term FROM lineitem")
def read_go_slim(spark, d):
    rows = fx.part_terms(spark, d).select(_joined("\t", F.lit("name"), F.concat(F.lit("S"), "protein"), F.lit("P"), F.lit("text"), F.concat(F.lit("GO:"), "term"), F.lit("ORF")))
    return readers.go_slim(spark, _written(rows))


@query("SELECT DISTINCT 'P' || l_partkey AS protein, 'GO:' || l_suppkey AS term FROM lineitem WHERE l_partkey % 5 > 0")
def read_uniprot_go(spark, d):
    folder = _folder(spark)
    terms = F.array_join(F.collect_list(F.concat(F.lit("a process [GO:"), "l_suppkey", F.lit("]"))), "; ")
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(terms.alias("terms"))
    sinks.tsv(rows.select(F.concat(F.lit("P"), "l_partkey").alias("Entry"), F.lit("x").alias("Entry Name"), F.when(F.col("l_partkey") % 5 > 0, F.col("terms")).alias("Gene Ontology (GO)")), folder, True)
    return readers.uniprot_go(spark, folder)


@query("SELECT 'ENSP' || p_partkey AS protein_id, 'GO:' || p_size AS go_id FROM part WHERE p_partkey % 6 > 0 AND p_size % 7 > 0")
def read_compartments(spark, d):
    """Lines with a score that is none or with too few columns are dropped, also where the score is not asked for."""
    key, size = F.col("p_partkey"), F.col("p_size")
    start = _joined("\t", F.concat(F.lit("ENSP"), key), F.col("p_brand"), F.concat(F.lit("GO:"), size), F.lit("a part"))
    line = F.when(size % 7 == 0, start).otherwise(_joined("\t", start, F.when(key % 6 > 0, (size / 10).cast("string")).otherwise("bad")))
    return readers.compartments(spark, _written(table(spark, d, "part").select(line))).select("protein_id", "go_id")


def _mapped(spark, d):
    """The folder of the mapped parts, their statistics and the identifiers that failed."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    asked = p.select(F.concat(F.when(key % 3 == 0, "ENSP").otherwise("none"), key).alias("protein_id"), F.concat(F.lit("GO:"), "p_size").alias("GO_ID"), F.lit("a part").alias("GO_Term"), _s("p_size").alias("Score"))
    rows = idmap.map_compartments(asked, fx.idmap(spark, d), "human").withColumnRenamed("protein_id", "Original_Protein_ID")
    folder = _folder(spark)
    sinks.mapped_compartments(rows, folder)
    return folder


@query("SELECT 'P' || p_partkey AS protein, 'GO:' || p_size AS term FROM part WHERE p_partkey % 3 = 0")
def read_mapped_compartments(spark, d):
    return readers.mapped_compartments(spark, f"{_mapped(spark, d)}/mapped")


@query("SELECT 'none' || p_partkey AS value FROM part WHERE p_partkey % 3 > 0")
def write_unmapped(spark, d):
    return spark.read.text(f"{_mapped(spark, d)}/unmapped")


@query("SELECT count(*)::VARCHAR AS total, count(*) FILTER (p_partkey % 3 = 0)::VARCHAR AS mapped, count(*) FILTER (p_partkey % 3 > 0)::VARCHAR AS unmapped FROM part")
def write_mapping_stats(spark, d):
    return spark.read.csv(f"{_mapped(spark, d)}/stats", sep="\t", header=True).select("total", "mapped", "unmapped")


# Scores and networks


def _weights(spark, d):
    return fx.edges2(spark, d).select(_s("protein1").alias("protein1"), _s("protein2").alias("protein2"), (F.col("w") / 7).alias("HCN_score"))


@query(with_("pe2") + "SELECT DISTINCT least(protein1::VARCHAR, protein2::VARCHAR) AS protein1, greatest(protein1::VARCHAR, protein2::VARCHAR) AS protein2, round(w / 7, 6) AS weight FROM pe2")
def write_scores(spark, d):
    folder = _folder(spark)
    sinks.scores(_weights(spark, d), folder, 6)
    return readers.score_file(spark, folder)


@query(with_("pe2") + "SELECT protein1::VARCHAR AS protein1, protein2::VARCHAR AS protein2, w / 7 AS mean_weight FROM pe2")
def write_weighted_network(spark, d):
    folder = _folder(spark)
    sinks.weighted_network(_weights(spark, d), folder)
    return spark.read.csv(folder, sep="\t", header=True).withColumn("mean_weight", text.number(F.col("mean_weight")))


@query(with_("pe2") + "SELECT protein1::VARCHAR AS protein1, protein2::VARCHAR AS protein2, w / 7 AS weight FROM pe2")
def write_bare_network(spark, d):
    folder = _folder(spark)
    sinks.weighted_network(_weights(spark, d), folder, False)
    return spark.read.schema("protein1 string, protein2 string, weight double").csv(folder, sep="\t")


@query(with_("pe2") + "SELECT protein1::VARCHAR AS protein1, protein2::VARCHAR AS protein2 FROM pe2")
def write_edge_list(spark, d):
    folder = _folder(spark)
    sinks.edge_list(_weights(spark, d), folder)
    return readers.ppi_raw(spark, folder)


@query(with_("pe2") + "SELECT protein1::VARCHAR AS \"Protein1\", protein2::VARCHAR AS \"Protein2\" FROM pe2")
def write_edge_list_titled(spark, d):
    folder = _folder(spark)
    sinks.edge_list(_weights(spark, d), folder, True)
    return spark.read.csv(folder, sep="\t", header=True)


@query("SELECT a.n_name AS protein1, b.n_name AS protein2, CASE WHEN (a.n_nationkey + b.n_nationkey) % 4 > 0 THEN (a.n_nationkey * b.n_nationkey % 100) / 100 ELSE 0 END::DOUBLE AS weight FROM nation a JOIN nation b ON a.n_name < b.n_name")
def write_matrix(spark, d):
    """The matrix of the nations, of which there are 25; pairs that are absent are 0."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = n.toDF("i", "protein1"), n.toDF("j", "protein2")
    pairs = a.join(b, (F.col("protein1") < F.col("protein2")) & ((F.col("i") + F.col("j")) % 4 > 0)).select("protein1", "protein2", (F.col("i") * F.col("j") % 100 / 100).alias("sim"))
    folder = _folder(spark)
    sinks.matrix(pairs, folder, sorted(r.n_name for r in n.select("n_name").collect()))
    return readers.square_matrix(spark, folder)


def _stats(spark, d):
    return graph.network_stats(_weights(spark, d).withColumn("weight", F.lit(0.5))).select("proteins", "interactions", "mean_weight")


@query(with_("pe2", "n AS (SELECT protein1 AS p FROM pe2 UNION SELECT protein2 FROM pe2)") + "SELECT (SELECT count(*) FROM n)::VARCHAR AS proteins, (SELECT count(*) FROM pe2)::VARCHAR AS interactions, '0.5' AS mean_weight")
def write_statistics(spark, d):
    folder = _folder(spark)
    sinks.statistics(_stats(spark, d), folder)
    return spark.read.csv(folder, sep="\t", header=True)


@query(with_("pe2", "n AS (SELECT protein1 AS p FROM pe2 UNION SELECT protein2 FROM pe2)") + "SELECT 'proteins' AS measure, count(*)::VARCHAR AS value FROM n UNION ALL SELECT 'interactions', count(*)::VARCHAR FROM pe2 UNION ALL SELECT 'mean_weight', '0.5'")
def write_report(spark, d):
    return sinks.report(_stats(spark, d))


@query("SELECT 'DIP_levure.txt' AS file, count(*) AS n FROM nation UNION ALL SELECT 'STRING_levure.txt', count(*) FROM region")
def read_discovered(spark, d):
    """The files of a folder whose name matches, by name, and their lines."""
    folder = _folder(spark)
    for name, source, column in (("STRING_levure.txt", "region", "r_name"), ("DIP_levure.txt", "nation", "n_name"), ("STRING_humain.txt", "region", "r_name")):
        sinks.tsv(table(spark, d, source).select(column), f"{folder}/{name}")
    found = readers.discover(spark, folder, "*levure*")
    lines = spark.read.text(found)
    return lines.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("file")).agg(F.count(F.lit(1)).alias("n"))
