"""A query for each operator over its whole table, with its production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontam, divergence, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, runs, sharding, token_count, toxicity, warc
from netloom.session import ship_code
from netloom.storage import Store

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = TOKENIZER) -> bytes:
    """The content of a vocabulary file of the tokenizers that are installed."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


#: The tree of sources: a domain by the number in the source's name, then language, then source.
TREE = {
    "domain": "CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 10 THEN 'web' WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 15 THEN 'forum' WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) >= 15 THEN 'reference' ELSE 'other' END",
    "lang": "lang",
    "source": "source",
}
TREE_WEIGHTS = [{"web": 0.5, "forum": 0.2, "reference": 0.3}, {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}, {"src0": 4.0}]
TREE_DEFAULTS = [0.05, 0.05, 1.0]
#: The budget as a share of all tokens; how often a document may come in op7. The pipeline takes one epoch.
MIX_SHARE, MIX_EPOCHS, PIPELINE_SHARE = 0.8, 2, 0.8


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"), "page_id", line_dedup.host_of(F.col("url")), line_dedup.lines_of_html(F.col("html")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TREE, TREE_WEIGHTS, MIX_SHARE, MIX_EPOCHS, TREE_DEFAULTS)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages in the shared folder, and what is read back from them."""
    pages = table(spark, sf_dir, "pages")
    folder = Store(spark).folder()
    warc.write_archives(pages, folder)
    records = warc.index_of(warc.read_archives(spark, folder, payloads=False))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` in whose texts each tenth id, by its hash, repeats what stands from a word of it on."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumns({"__h": hashed, "__w": F.when(hashed % 10 == 0, words)})
    g, n = F.floor(F.col("__h") / 10), F.size("__w").cast("long")
    start = g % n
    period = 1 + F.expr("(size(__w) - __a) div (3 + __g % 8)")
    repeated = F.transform("__w", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__w", (F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p"))).cast("int"))))
    rows = rows.withColumn("__g", g).withColumn("__a", F.when(n > 0, start)).withColumn("__p", period)
    return rows.withColumn("text", F.when(F.col("__a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_token_counts, op3_ngram_jaccard, op4_line_dedup, op5_quality, op6_toxicity, op7_mixing, op8_exact_dedup, op9_decontamination, op10_sharding, op11_warc, op12_periodic_runs, op13_source_divergence, pipeline)}

_SPACES = r"[\x20\x09-\x0D]+"
_SPACED = f"regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')"

_OP3 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_OP4 = rf"""
WITH pages2 AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^<>]*>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '{_SPACES}', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM pages2 GROUP BY host),
seen AS (SELECT host, line, count(*) AS seen FROM (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM pages2) GROUP BY host, line),
often AS (SELECT s.host, list(line) AS boilerplate FROM seen s JOIN totals t ON s.host = t.host WHERE seen >= 3 AND pages >= 5 AND seen > 0.2 * pages GROUP BY s.host),
kept AS (SELECT page_id, p.host, lines, CASE WHEN boilerplate IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, x)) END AS kept FROM pages2 p LEFT JOIN often o ON p.host = o.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM kept
"""

_OP8 = f"""
WITH rows AS (SELECT doc_id, {_SPACED} AS content FROM documents),
groups AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(r.content) AS text_sha256 FROM rows r JOIN groups g ON r.content = g.content
"""


#: Five hexadecimal digits of a SHA-1 are four characters of its base32.
_OP11 = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
known AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM rows)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> s) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM known
"""

_OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
own AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM own) GROUP BY ALL HAVING count(*) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n FROM grp g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM own GROUP BY ALL) o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM cells),
whole AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tops AS (SELECT s.lang, s.source, s.term AS item, p - q AS value FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM tops) WHERE rank <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""


def _sql_map(weights: dict[str, float], name: str, default: float) -> str:
    return "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END::DOUBLE"


def _mix_sql() -> str:
    """SQL for op7: the budget goes down three levels, and each leaf's documents are added up in order."""
    names = list(TREE)
    parts = [
        f"""WITH placed AS (
  SELECT doc_id, CASE WHEN p = '' THEN 0 ELSE length(p) - length(replace(p, ' ', '')) + 1 END::BIGINT AS tokens, domain, lang, source
  FROM (SELECT doc_id, trim({_SPACED}) AS p, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN k < 10 THEN 'web' WHEN k < 15 THEN 'forum' WHEN k >= 15 THEN 'reference' ELSE 'other' END AS domain
    FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k FROM documents))),
total AS (SELECT floor(sum(tokens) * {MIX_SHARE}) AS t FROM placed)"""
    ]
    for depth in range(1, len(names) + 1):
        own, parent = names[:depth], names[: depth - 1]
        keys, above = ", ".join(own), ", ".join(parent) or "1"
        weight = _sql_map(TREE_WEIGHTS[depth - 1], own[-1], TREE_DEFAULTS[depth - 1])
        budget = f"(SELECT {', '.join(parent)}, gets AS b FROM given{depth - 1})" if parent else f"(SELECT least(t, (SELECT sum(tokens) * {MIX_EPOCHS} FROM placed)) AS b FROM total)"
        join = f"JOIN {budget} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {budget}"
        order = f"PARTITION BY {above} ORDER BY h / w, {own[-1]}"
        parts.append(f"""
node{depth} AS (SELECT * FROM (SELECT {keys}, (sum(tokens) * {MIX_EPOCHS})::DOUBLE AS h, {weight} AS w FROM placed GROUP BY {keys}) {join} WHERE w > 0 AND h > 0),
full{depth} AS (SELECT *, coalesce(sum(h) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + h / w * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS f FROM node{depth}),
given{depth} AS (SELECT {keys}, CASE WHEN f THEN h ELSE (b - coalesce(sum(h) FILTER (f) OVER (PARTITION BY {above}), 0)) * w / sum(w) FILTER (NOT f) OVER (PARTITION BY {above}) END AS gets FROM full{depth})""")
    keys = ", ".join(names)
    return ",".join(parts) + f""",
dealt AS (SELECT p.*, floor(gets + 1e-6)::BIGINT AS leaf_tokens, epoch, md5('mix|' || epoch || '|' || doc_id) AS draw
  FROM placed p JOIN given{len(names)} USING ({keys}) CROSS JOIN (SELECT unnest(range({MIX_EPOCHS}))::INT AS epoch)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY epoch, draw, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM dealt)
SELECT doc_id, {keys}, epoch, tokens, leaf_tokens FROM summed WHERE so_far <= leaf_tokens"""


SQL: dict[str, str] = {"op3_ngram_jaccard": _OP3, "op4_line_dedup": _OP4, "op7_mixing": _mix_sql(), "op8_exact_dedup": _OP8, "op11_warc": _OP11, "op13_source_divergence": _OP13}
