"""Readers of the input formats. Each gives a frame of a fixed schema; an absent value is null.

Paths are read by Spark alone, so any store that Spark reads will do. Files whose order matters give ``line_no``, a
place that grows along a file, and over several files by their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators.fusion import load_scores
from netloom.sources.archives import zip_entries

# The columns of the formats.
MITAB = ("ID_A", "ID_B", "Alt_IDs_A", "Alt_IDs_B", "Aliases_A", "Aliases_B", "Method", "Author", "PubIDs", "TaxID_A", "TaxID_B", "IntType", "SourceDB", "IntIDs", "Confidence")
COMPARTMENTS = ("protein_id", "gene_name", "go_id", "go_term", "score")


def _strings(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _place() -> Column:
    """Where a row stands: its file, the part of the file that the row was read from, and the row's number in that.

    It is for frames just read. Files are read in parts by several tasks, in any order, so no number of a task will do.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))


def _fixed(place: Row) -> Column:
    """A place that was fetched, to compare others with."""
    return F.struct(F.lit(place["file"]).alias("file"), F.lit(place["start"]).cast("long").alias("start"), F.lit(place["n"]).cast("long").alias("n"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of text files."""
    return spark.read.text(path).select("value", _place().alias("line_no"))


def mitab(spark: SparkSession, path: str) -> DataFrame:
    """Interactions in tabular form: 15 text columns; lines that begin with # are left out."""
    return spark.read.schema(_strings(MITAB)).option("sep", "\t").option("comment", "#").csv(path)


def string_links(spark: SparkSession, path: str) -> DataFrame:
    """Links by single spaces with a header; the columns used, scores as integers, whatever the order in the file."""
    frame = spark.read.option("sep", " ").option("header", True).csv(path)
    scores = [F.col(c).cast("int").alias(c) for c in ("experimental", "coexpression", "database", "textmining", "combined_score")]
    return frame.select("protein1", "protein2", *scores)


def string_edges(df: DataFrame, prefix: str) -> DataFrame:
    """(protein1, protein2) without the taxon's prefix, wherever it stands."""
    return df.select(*[text.without(F.col(c), prefix).alias(c) for c in ("protein1", "protein2")])


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("mode", "PERMISSIVE").load(path)


def _ref(refs: str, db: str) -> Column:
    return F.get(F.filter(refs, lambda r: r["_db"] == db), F.lit(0))["_id"]


def dip_interactors(spark: SparkSession, path: str) -> DataFrame:
    """(id, protein): the accession, else the RefSeq identifier, else the short label."""
    rows = _xml(spark, path, "interactor", "_id string, names struct<shortLabel: string>, xref struct<secondaryRef: array<struct<_db: string, _id: string>>>")
    protein = F.coalesce(_ref("xref.secondaryRef", "uniprot knowledge base"), _ref("xref.secondaryRef", "refseq"), F.col("names.shortLabel"))
    return rows.select(F.col("_id").alias("id"), protein.alias("protein")).where("id IS NOT NULL AND protein IS NOT NULL")


def dip_interactions(spark: SparkSession, path: str) -> DataFrame:
    """(protein1, protein2, confidence) of the interactions of two known, different proteins; confidence is its text."""
    schema = "participantList struct<participant: array<struct<interactorRef: string>>>, confidenceList struct<confidence: array<struct<value: string>>>"
    rows = _xml(spark, path, "interaction", schema)
    refs = F.filter(F.transform("participantList.participant", lambda p: p["interactorRef"]), lambda x: x.isNotNull())
    pairs = rows.select(refs.alias("refs"), F.get("confidenceList.confidence", F.lit(0))["value"].alias("confidence")).where(F.size("refs") == 2)
    known = dip_interactors(spark, path)
    first, second = known.select(F.col("id").alias("ref1"), F.col("protein").alias("protein1")), known.select(F.col("id").alias("ref2"), F.col("protein").alias("protein2"))
    ends = pairs.select(F.get("refs", F.lit(0)).alias("ref1"), F.get("refs", F.lit(1)).alias("ref2"), "confidence")
    return ends.join(first, "ref1").join(second, "ref2").where("protein1 <> protein2").select("protein1", "protein2", "confidence")


#: What is read of an entry of a complex's XML.
_COMPLEX = "entry array<struct<interactorList: struct<interactor: array<struct<_id: string, interactorType: struct<names: struct<shortLabel: string>>, xref: struct<primaryRef: struct<_db: string, _id: string>>>>>, interactionList: struct<abstractInteraction: array<struct<participantList: struct<participant: array<struct<interactorRef: string>>>>>>>>"


def complexes_of(files: DataFrame) -> DataFrame:
    """(complex_id, protein) of XML files (file, content): the accessions of the protein participants of each complex.

    Ids are file and place. References hold within a file, so they are resolved where its row is. A file that cannot be
    parsed gives no rows.
    """
    rows = files.select("file", F.from_xml(F.col("content").cast("string"), _COMPLEX, {"mode": "PERMISSIVE"})["entry"].alias("entry"))
    every = lambda name, part: F.flatten(F.filter(F.transform("entry", lambda e: e[name][part]), lambda x: x.isNotNull()))
    good = lambda x: (x["interactorType"]["names"]["shortLabel"] == "protein") & (x["xref"]["primaryRef"]["_db"] == "uniprotkb") & x["xref"]["primaryRef"]["_id"].isNotNull()
    known = F.transform(F.filter(every("interactorList", "interactor"), good), lambda x: F.named_struct(F.lit("ref"), x["_id"], F.lit("protein"), x["xref"]["primaryRef"]["_id"]))
    rows = rows.select("file", known.alias("known"), F.posexplode(every("interactionList", "abstractInteraction")).alias("pos", "complex"))
    refs = F.filter(F.transform("complex.participantList.participant", lambda p: p["interactorRef"]), lambda r: r.isNotNull())
    rows = rows.select(F.concat_ws("#", "file", F.col("pos").cast("string")).alias("complex_id"), "known", refs.alias("refs"))
    proteins = F.array_distinct(F.transform(F.filter("known", lambda k: F.array_contains(F.col("refs"), k["ref"])), lambda k: k["protein"]))
    return rows.select("complex_id", F.explode(proteins).alias("protein"))


def portal_complexes(spark: SparkSession, path: str) -> DataFrame:
    """:func:`complexes_of` the XML files of a folder."""
    return complexes_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def portal_archive(spark: SparkSession, path: str) -> DataFrame:
    """:func:`complexes_of` the XML files in a zip archive, or in those of a folder, as tasks read them there."""
    return complexes_of(zip_entries(spark, path, ".xml").select(F.concat_ws("!", "archive", "entry").alias("file"), "content"))


def _listed(rows: DataFrame, key: Column, items: Column, separator: str) -> DataFrame:
    """(complex_id, proteins); of rows with one id the last counts."""
    named = rows.select(key.alias("complex_id"), text.members(items, separator).alias("proteins"), _place().alias("__row"))
    return named.where("complex_id IS NOT NULL").groupBy("complex_id").agg(F.max_by("proteins", "__row").alias("proteins"))


def corum(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(complex_id, proteins) of a tab-separated file with a header."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return _listed(rows, F.concat(F.lit(prefix), F.col("complex_id")), F.col("subunits_uniprot_id"), ";")


def humap(spark: SparkSession, path: str, prefix: str = "HuMAP_") -> DataFrame:
    """(complex_id, proteins) of a comma-separated file with a header."""
    rows = spark.read.option("header", True).csv(path)
    return _listed(rows, F.concat(F.lit(prefix), F.col("HuMAP2_ID")), F.col("Uniprot_ACCs"), " ")


def known_complexes(*sources: DataFrame) -> DataFrame:
    """(complex_id, proteins) of several sources, proteins sorted; give each source a prefix of its own.

    An id in several sources is what the last of them says. Of equal sets, the first source's smallest id stays.
    """
    sets = [s.select("complex_id", F.sort_array("proteins").alias("proteins"), F.lit(i).alias("source")) for i, s in enumerate(sources)]
    one = reduce(DataFrame.unionByName, sets).groupBy("complex_id").agg(F.max_by("proteins", "source").alias("proteins"), F.min("source").alias("source"))
    first = F.min(F.struct("source", "complex_id"))["complex_id"]
    return one.groupBy("proteins").agg(first.alias("complex_id")).select("complex_id", "proteins")


def idmapping(spark: SparkSession, path: str) -> DataFrame:
    """(uniprot, db, db_id, line_no); lines with fewer than three fields are left out."""
    fields = F.split("value", "\t")
    return _lines(spark, path).where(F.size(fields) >= 3).select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(("uniprot", "db", "db_id"))], "line_no")


def soft_expression(spark: SparkSession, path: str) -> DataFrame:
    """(IDENTIFIER and the GSM columns, as text) of the table in a series file, with line_no."""
    lines = _lines(spark, path)
    begin = lines.where(F.startswith("value", F.lit("!dataset_table_begin"))).agg(F.min("line_no")).head()[0]
    if begin is None:
        raise ValueError(f"{path} has no table")
    body = lines.where((F.col("line_no") > _fixed(begin)) & ~F.startswith("value", F.lit("!")))
    header = body.orderBy("line_no").head()
    if header is None:
        raise ValueError(f"the table of {path} has no header")
    names = header["value"].split("\t")
    fields = F.split("value", "\t")
    keep = [(i, n) for i, n in enumerate(names) if n == "IDENTIFIER" or n.startswith("GSM")]
    rows = body.where(F.col("line_no") > _fixed(header["line_no"]))
    return rows.select(*[F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, n in keep], "line_no")


def expression_profiles(df: DataFrame, row_id: str = "line_no") -> DataFrame:
    """(IDENTIFIER, v, row_id) of rows of numbers without a gap."""
    samples = [c for c in df.columns if c.startswith("GSM")]
    numbers = [text.number(F.col(c)) for c in samples]
    full = df.where(F.col("IDENTIFIER").isNotNull()).select("IDENTIFIER", F.array(*numbers).alias("v"), row_id)
    return full.where(~F.exists("v", lambda x: x.isNull()))


def go_slim(spark: SparkSession, path: str) -> DataFrame:
    """(sgd, term): the second and fifth of the columns."""
    return spark.read.option("sep", "\t").csv(path).select(F.col("_c1").alias("sgd"), F.col("_c4").alias("term"))


def uniprot_go(spark: SparkSession, path: str) -> DataFrame:
    """(protein, term): each GO identifier in the free text of an entry."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col("Entry").alias("protein"), F.explode(text.go_terms(F.col("`Gene Ontology (GO)`"))).alias("term")).distinct()


def compartments(spark: SparkSession, path: str) -> DataFrame:
    """Five columns without a header; malformed lines are dropped, whichever columns are asked for."""
    rows = spark.read.schema(_strings(COMPARTMENTS)).options(sep="\t", mode="DROPMALFORMED", columnPruning=False).csv(path)
    score = text.number(F.col("score"))
    return rows.where(F.col("score").isNull() | score.isNotNull()).withColumn("score", score)


def mapped_compartments(spark: SparkSession, path: str) -> DataFrame:
    """(protein, term) of the rows that were mapped."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.where("Mapping_Status = 'Success'").select(F.col("Mapped_UniProtKB_ID").alias("protein"), F.col("GO_ID").alias("term"))


def ppi_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("protein1 string, protein2 string").option("sep", "\t").csv(path)


def ppi_clean(df: DataFrame) -> DataFrame:
    """Trimmed upper-case ends, both present, exact repeats once; (A, B) and (B, A) are different rows."""
    return df.select(*[F.upper(text.strip(F.col(c))).alias(c) for c in ("protein1", "protein2")]).na.drop("any").dropDuplicates()


def ppi_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """(protein1, protein2) by tabs, or else white space, without empty lines, comments and headers."""
    line = text.strip(F.col("value"))
    good = (line != "") & ~F.startswith(line, F.lit("#")) & ~F.startswith(F.lower(line), F.lit("protein1"))
    parts = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(line, r"\s+"))
    rows = spark.read.text(path).where(good).select(F.transform(parts, text.strip).alias("p")).where(F.size("p") >= 2)
    return rows.select(F.get("p", F.lit(0)).alias("protein1"), F.get("p", F.lit(1)).alias("protein2")).where("protein1 <> '' AND protein2 <> ''")


def complex_file(spark: SparkSession, path: str, separator: str = ";", min_size: int = 3) -> DataFrame:
    """(complex_id, protein) of lines of an id, a tab and a list; a header line is no complex."""
    rows = spark.read.schema("complex_id string, items string").option("sep", "\t").csv(path).where("complex_id <> 'complex_id'")
    sets = rows.select("complex_id", text.members(F.col("items"), r"\s+" if separator == " " else separator).alias("proteins"))
    return sets.where(F.size("proteins") >= min_size).select("complex_id", F.explode("proteins").alias("protein"))


def score_file(spark: SparkSession, path: str) -> DataFrame:
    """(protein1, protein2, weight) of a score file with a header, whatever its third column is called."""
    return load_scores(spark.read.option("sep", "\t").option("header", True).csv(path))


def square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(protein1, protein2, weight) above the diagonal of a matrix labelled by proteins, of which p1 < p2."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    label, *names = rows.columns
    cells = rows.withColumnRenamed(label, "protein1").unpivot("protein1", names, "protein2", "weight")
    return cells.where("protein1 < protein2").select("protein1", "protein2", text.number(F.col("weight")).alias("weight"))


def discover(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The files of a folder that match a glob, in order; an empty list if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])
