"""Personal data in text: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a DataFrame expression. A text is cut at the matches of a pattern; the running lengths of the pieces
and the matches give the positions, in code points. Patterns that could read a run of characters again from each of
its positions are anchored to where a run begins and use possessive quantifiers, so that time grows with the length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"

# The countries' IBANs have 15 to 34 characters; a card 14 to 19 digits; a phone number 10 to 15.
CONTEXT_CHARS = 32
THRESHOLD = 0.5
# Different digits that a secret in hexadecimal has at least; fewer are filling.
SECRET_DIGITS = 8


@dataclass(frozen=True)
class Kind:
    """A kind of span. prior, confirmed and context add up to the score; base spans stay whatever their score."""

    name: str
    pattern: str
    trigger: str
    base: bool
    prior: float
    confirmed: float
    context: float
    words: str


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, 0.0, 0.1, r"e-?mail|contact|write|mailto"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.5, 0.1, 0.2, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", True, 0.3, 0.4, 0.2, r"card|visa|credit|debit|master|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, 0.1, 0.2, r"phone|tel|call|mobile|cell|fax"),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", "", False, 0.2, 0.5, 0.2, r"iban|account|bank|konto|compte|cuenta"),
    Kind("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])", "", False, 0.2, 0.2, 0.3, r"token|secret|key|passw|credential|auth|bearer"),
    Kind("local_phone", r"[0-9(](?<![0-9A-Za-z+.][0-9(])(?<=[(])?[0-9]{2,3}+\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", "", False, 0.3, 0.0, 0.3, r"phone|tel|call|mobile|cell|fax"),
)
BASE = tuple(k.name for k in KINDS if k.base)

# How many characters the countries' IBANs have.
_LENGTHS = " AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 "


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97: four characters move to the end, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return value.rlike(rf"^{part}(?<=[0-9])(?:\.{part}(?<=[0-9])){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "secret":
        return F.size(F.array_distinct(F.split(value, ""))) >= SECRET_DIGITS
    return F.lit(True)


def _iban(run: Column) -> Column:
    """The IBAN that a run of words begins with, null without one.

    It ends where a word ends, with the length of its country. The whole run may have another length, and a code that
    is no country's any length: the longest.
    """
    words = F.split(run, " ")

    def upto(k: Column) -> Column:
        value = F.array_join(F.slice(words, F.lit(1), k), " ")
        n = F.length(F.replace(value, F.lit(" "), F.lit("")))
        country = F.concat(F.lit(" "), F.left(run, F.lit(2)))
        fits = F.contains(F.lit(_LENGTHS), F.concat(country, n.cast("string"), F.lit(" ")))
        able = fits | (k == F.size(words)) | ~F.contains(F.lit(_LENGTHS), country)
        return F.when(able & n.between(15, 34) & value.rlike("^[A-Z0-9 ]+$") & mod97(value), F.struct(fits.alias("fits"), n.alias("n"), value.alias("value")))

    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(words)), upto))["value"]


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double,value:string>>"


def _found(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind, leftmost and not overlapping; a match that fails is passed over.

    The pattern of an IBAN matches its first four characters only and looks ahead at the run that may belong to it, so
    another one inside the run is still met. The context of a match is the text before it, with other matches in it.
    """
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.zip_with(hits, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)), lambda head, run: _iban(F.concat(head, run))) if kind.name == "iban" else hits
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.arrays_zip(hits.alias("hit"), values.alias("value")),
        lambda piece, x: F.struct(F.char_length(piece).alias("gap"), F.right(piece, F.lit(CONTEXT_CHARS)).alias("near"), x["hit"].alias("hit"), F.char_length(x["hit"]).alias("moves"), x["value"].alias("value")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        before = F.right(F.concat(acc["tail"], x["near"]), F.lit(CONTEXT_CHARS))
        moved = ((start + x["moves"]).alias("at"), F.right(F.concat(before, x["hit"]), F.lit(CONTEXT_CHARS)).alias("tail"))
        score = F.lit(kind.prior + kind.confirmed) + F.when(F.lower(before).rlike(kind.words), F.lit(kind.context)).otherwise(F.lit(0.0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), x["value"].alias("value"))
        keeps = (start >= acc["free"]) & _valid(kind.name, x["value"]) & (F.lit(kind.base) | (score >= THRESHOLD))
        kept = F.struct(*moved, end.alias("free"), F.array_append(acc["out"], span).alias("out"))
        return F.when(x["moves"].isNull(), acc).when(x["value"].isNotNull() & keeps, kept).otherwise(F.struct(*moved, acc["free"].alias("free"), acc["out"].alias("out")))

    none = F.array().cast(_SPAN)
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit(0).alias("free"), none.alias("out")), step)["out"]
    return F.when(F.contains(text, F.lit(kind.trigger)), spans).otherwise(none) if kind.trigger else spans


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with a column of spans: kind, start, end (code points, end exclusive), score and value, by start.

    Base kinds keep every confirmed match. The other kinds need a score of 0.5 and no overlap with a base span. A null
    or empty text has no spans. A column that already has the name ``out`` is replaced; no other column is touched.
    """
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.concat(*[_found(words, k, i) for i, k in enumerate(KINDS) if k.base])
    more = F.concat(*[_found(words, k, i) for i, k in enumerate(KINDS) if not k.base])
    found = df.withColumn(out, F.struct(base.alias("base"), more.alias("more")))
    base, more = F.col(f"`{out}`")["base"], F.col(f"`{out}`")["more"]
    apart = F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn(out, F.array_sort(F.concat(base, apart)))


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Each span of :func:`find_pii` in the text gives way to its kind in brackets; of overlapping spans, the first counts."""
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substr(words, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    done = F.aggregate(F.col(f"`{pii}`"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.aggregate(F.col(f"`{pii}`"), F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    return df.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), F.concat(done["out"], F.substr(words, rest + 1))))


def digest(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def pii_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, how many spans each base kind has, a digest of the base spans, and all spans.

    A null or empty text has none: counts of 0, the digest of an empty string, and empty ``spans``.
    """
    found = find_pii(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))
