"""Archives, periodic runs and the audit of sources, each against a plain version, an exact round trip or its SQL."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from netloom.llm import divergence, queries, runs, warc
from netloom.storage import Store

# Archives

PAGES = "page_id long, url string, html string"
HTML = "<html><head><title>{0}</title></head><body class='main'><p>text of page {0} with &amp; and é😀</p></body></html>"
ROWS = [
    (3, "http://a.example/x", HTML.format(1)),
    (1, "http://a.example/y?q=a b\r\nX: y", HTML.format(1)),
    (1, "http://a.example/y", HTML.format(1)),
    (None, "http://a.example/z", HTML.format(1)),
    (2, None, HTML.format(2)),
    (4, "http://b.example/é", None),
    (5, "http://b.example/", ""),
    (6, "http://b.example/", "\0\r\n\r\nWARC/1.1\r\n" * 5),
    (None, None, "only null ids have this"),
    (None, None, "only null ids have this"),
    (7, "http://c.example/", "x" * 300_000),
    *[(100 + i, f"http://d.example/{i}", HTML.format(i) * 4) for i in range(60)],
]


def written(spark, rows, tmp_path, name="w", schema=PAGES, **options):
    path = str(tmp_path / name)
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), path, **options)
    return path


def test_archives_are_read_back(spark, tmp_path):
    path = written(spark, ROWS, tmp_path)
    got = warc.read_archives(spark, path).where("record_type <> 'warcinfo'").collect()
    first = {}
    for i, _, html in ROWS:
        payload = (html or "").encode()
        first[payload] = i if payload not in first or first[payload] is None else first[payload] if i is None else min(i, first[payload])
    want = []
    for i, _, html in ROWS:
        payload = (html or "").encode()
        revisit = i != first[payload]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i and str(i), "revisit" if revisit else "response", len(payload), digest, str(first[payload]) if revisit else None, None if revisit else payload))
    assert sorted([(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=repr) == sorted(want, key=repr)
    by_page = {(r.page_id, r.record_type): r for r in got}
    assert by_page["1", "response"].uri in ("http://a.example/y?q=a%20b%0D%0AX:%20y", "http://a.example/y") and by_page["4", "response"].uri == "http://b.example/%C3%A9"
    assert by_page["2", "response"].uri == by_page["2", "response"].record_id


def test_an_archive_is_its_dictionary_and_one_frame_for_each_record(spark, tmp_path):
    path = written(spark, ROWS, tmp_path)
    files = sorted(f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.zst"))
    assert files and not [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-") and f not in files]
    index = warc.read_archives(spark, path, payloads=False).collect()
    assert "payload" not in index[0].asDict()
    for f in files:
        data = f.read_bytes()
        assert data[:4] == warc.SKIP_DICTIONARY
        held = zstandard.ZstdDecompressor().decompress(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        own = [r for r in index if r.archive.endswith(f.name)]
        assert own and sum(r.record_type == "warcinfo" for r in own) == 1
        for r in own:
            # Each record by its offset, by the library, without the others.
            record = reader.decompress(data[r.offset : r.offset + r.length])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            head, _, rest = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block = rest[:-4]
            assert int(fields["Content-Length"]) == len(block)
            if r.record_type != "warcinfo":
                assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            if r.record_type == "revisit":
                assert fields["WARC-Profile"].endswith("identical-payload-digest")
                assert fields["WARC-Refers-To"].strip("<>") in {x.record_id for x in index if x.page_id == r.refers_to}


def test_a_dictionary_makes_archives_of_short_pages_smaller(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://d.example/{i}", HTML.format(i)) for i in range(400)]
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).iterdir())
    written(spark, rows, tmp_path, "with")
    monkeypatch.setattr(warc, "train_dictionary", lambda *a: None)
    path = written(spark, rows, tmp_path, "without")
    assert size("with") < 0.8 * size("without")
    assert warc.read_archives(spark, path).count() == 403


def test_archives_have_a_bounded_size(spark, tmp_path):
    path = written(spark, ROWS, tmp_path, archive_bytes=2_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").iterdir() if f.name.endswith(".zst")]
    assert len(sizes) > 3
    assert warc.index_of(warc.read_archives(spark, path)).count() == len(ROWS)


def test_payloads_below_the_bound_are_all_responses(spark, tmp_path):
    path = written(spark, ROWS, tmp_path, min_bytes=50)
    kinds = {(r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert {("4", "response"), ("5", "response"), ("3", "revisit")} <= kinds


def test_many_repeated_payloads(spark, monkeypatch):
    """Beyond the bound, frequent payloads are told apart from the others, and the rows are the same."""
    rows = [(i, f"p{i % 7 if i % 2 else i // 4}") for i in range(400)] + [(None, "p1"), (0, "p0")]
    df = spark.createDataFrame(rows, "id long, payload string").withColumn("payload", F.col("payload").cast("binary"))
    keep = {}
    for i, p in rows:
        keep[p] = min(keep.get(p, 10**9), 10**9 if i is None else i)
    want = sorted([(i, p, i != keep[p], keep[p] if i != keep[p] else None) for i, p in rows], key=repr)
    for size in (1 << 20, 0):
        monkeypatch.setattr(warc, "COPIES_BYTES", size)
        monkeypatch.setattr(warc, "COPIES_SHARE", 20)
        got = warc.with_first_copies(df, "id", "payload", 0, Store(spark)).collect()
        assert sorted([(r.id, r.payload.decode(), r.revisit, r.refers_to) for r in got], key=repr) == want


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_any_type_and_other_columns(spark, tmp_path, kind):
    rows = [(i, u, h, "x", 1) for i, u, h in ROWS]
    df = spark.createDataFrame(rows, PAGES + ", key string, copied int").withColumn("page_id", F.col("page_id").cast(kind))
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.index_of(warc.read_archives(spark, str(tmp_path / "w"), payloads=False))
    assert got.where("page_id = '1'").first().record_type == "response" and got.count() == len(ROWS)
    odd = spark.createDataFrame([("a b\r\n: é", "u", "h"), ("", None, "k")], "page_id string, url string, html string")
    warc.write_archives(odd, str(tmp_path / "odd"))
    assert {r.page_id for r in warc.index_of(warc.read_archives(spark, str(tmp_path / "odd"))).collect()} == {"a b\r\n: é", ""}


def test_no_pages(spark, tmp_path):
    path = written(spark, [], tmp_path)
    assert warc.read_archives(spark, path).collect() == []


def test_frames_and_records_that_are_damaged():
    packer = warc.Packer(None, "2020-01-01T00:00:00Z", 3)
    payload = b"a page"
    packer.add(warc.Page("1", "u", hashlib.sha1(payload).hexdigest(), len(payload), payload, False, None))
    data = packer.end()
    assert [r[2][:8] for r in warc.frames_of(data + warc.SKIP_NOTHING)] == [b"WARC/1.1"] * 2
    for cut in (1, 5, len(data) // 2):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.frames_of(data[:-cut]))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.frames_of(b"no archive at all"))
    record = list(warc.frames_of(data))[1][2]
    with pytest.raises(ValueError, match="another digest"):
        warc.parse_record(record.replace(b"a page", b"A page"))


@pytest.mark.parametrize("level", [1, 19])
def test_ends_of_frames_are_the_librarys(level):
    rng = random.Random(3)
    for size in (0, 1, 255, 256, 70_000, 400_000):
        for text in (bytes(size), rng.randbytes(size)):
            for known in (True, False):
                frame = zstandard.ZstdCompressor(level=level, write_content_size=known, write_checksum=size % 2 == 0).compress(text)
                assert warc.frame_end(memoryview(frame + b"more"), 0) == len(frame)


# Periodic runs


def plain_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(least, times * q):
                    found.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(1, 3), (4, 3), (24, 3), (10, 5)])
def test_runs_are_those_of_all_periods(monkeypatch, least, times):
    rng = random.Random(least)
    for t in range(400):
        monkeypatch.setattr(runs, "PLACES", rng.choice([1, 7, 1 << 20]))
        n, k = rng.randint(0, 140), rng.choice([1, 2, 3, 10, 50])
        words = [b"%d" % rng.randint(0, k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 10 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a + p, min(n, a + p * rng.randint(2, 9))):
                words[i] = words[i - p]
        found = runs.runs_of(words, least, times)
        assert [tuple(map(int, r)) for r in found] == plain_runs(words, least, times), t
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert runs.kept_words(words, found) == [w for i, w in enumerate(words) if i not in gone]


def test_names_tell_blocks_apart():
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b"]) for _ in range(200)]
    for k, level in enumerate(runs.name_levels(words)):
        blocks = [tuple(words[i : i + (1 << k)]) for i in range(len(words) - (1 << k) + 1)]
        times = Counter(blocks)
        assert len(level) == len(blocks)
        assert all((level[i] >= 0) == (times[b] > 1) for i, b in enumerate(blocks))
        names = {(int(level[i]), b) for i, b in enumerate(blocks) if level[i] >= 0}
        assert len(names) == len({n for n, _ in names}) == len({b for _, b in names})


def test_a_period_fits_three_times():
    with pytest.raises(ValueError, match="three"):
        runs.runs_of([b"a"] * 30, 24, 2)


def test_runs_of_odd_texts(spark):
    values = [None, "", " \n\t ", "a " * 23, "a " * 24, "\x1c ".join(["b"] * 24), "w" * 100_000, "ab cd " * 40_000, "é 😀 " * 20, "\0 " * 30]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, "x") for i, t in enumerate(values)] + [(4, "a " * 24, 1, "x")], "doc_id long, text string, runs int, collapsed string")
    rows = runs.find_runs(df.repartition(3)).collect()
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in rows}
    assert len(rows) == len(values) + 1
    assert got[0] == got[1] == got[2] == ([], "")
    assert got[None] == ([], " ".join("a" * 23)) and got[4] == ([(0, 24, 1)], "a")
    assert got[5] == ([], "\x1c ".join(["b"] * 24)) or got[5][0] == [(0, 23, 1)]
    assert got[6] == ([], "w" * 100_000) and got[7] == ([(0, 80_000, 2)], "ab cd")
    assert got[8] == ([(0, 40, 2)], "é 😀") and got[9] == ([(0, 30, 1)], "\0")
    assert sorted(map(tuple, runs.run_rows(runs.find_runs(df.where("doc_id = 7"))).collect())) == [(7, 0, 80_000, 2)]
    assert runs.find_runs(df.where("false")).collect() == []
    assert runs.digests(runs.find_runs(df.where("doc_id = 0"))).drop("runs_sha256", "collapsed_sha256").collect() == [(0, 0, None, None, None, None)]


def test_periodic_runs_of_documents(spark, sf):
    got = {r.doc_id: list(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        some += len(found)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[doc_id] == [doc_id, len(found), *(best or [None] * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))]
    assert some


# Sources


def plain_audit(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in counts:
        kept = sorted((t for t, k in docs[lang].items() if k >= min_docs), key=str.encode)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        own = share(groups[source])
        pairs = [(sum(abs(own[t] - x) for t, x in share(c).items()), s) for s, c in groups.items() if s != source]
        q = share(whole)
        terms = [(own[t] - q[t], t) for t in kept if groups[source][t] > 0 and own[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def random_docs(n, sources):
    rng = random.Random(n)
    vocabulary = ["The", "the", "THE", "été", "É", "x1y", "a-b", "日本", "😀", "_", "İ", "ß"] + [f"w{'abcdefgh'[i % 8]}{'xyz'[i // 8 % 3]}" for i in range(24)]
    return [(" ".join(rng.choice(vocabulary[: 4 + rng.randrange(32)]) for _ in range(rng.randint(0, 30))) if rng.random() > 0.05 else None, rng.choice(["en", "fr", None, ""]), rng.choice([None, "", *[f"s{i}" for i in range(sources)]])) for _ in range(n)]


@pytest.mark.parametrize(("tile", "terms", "held"), [(256, 1024, 300_000), (2, 5, 20), (1, 1, 1)])
def test_audit_is_exact(spark, monkeypatch, tile, terms, held):
    monkeypatch.setattr(divergence, "TILE_GROUPS", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = random_docs(300, 5) + [("only here", "de", "one"), (None, "es", "two"), ("", "es", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    for min_docs, top in ((30, 50), (3, 4)):
        assert sorted(map(tuple, divergence.audit_sources(df, min_docs=min_docs, top=top).collect())) == plain_audit(rows, min_docs, top)


def test_shares_of_large_counts_are_exact():
    rng = random.Random(2)
    for _ in range(2_000):
        total = rng.randint(5, 9 * 10**15)
        n = rng.randint(0, total - 5)
        assert int(divergence.shares(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * (n + 5) // total


def test_sums_of_pairs_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 100, (7, 11)), rng.integers(0, 100, (5, 11))
    for step in (1, 11, 40, 1 << 20):
        monkeypatch.setattr(divergence, "STEP", step)
        assert (divergence._pair_sums(a, b) == [[np.abs(x - y).sum() for y in b] for x in a]).all()


def test_audit_of_odd_tables(spark):
    df = spark.createDataFrame([], "text string, lang string, source string, gid int, tile string, term string")
    assert divergence.audit_sources(df).collect() == []
    rows = [("a " * 50_000 + "x" * 100_000, "en", "s0")] * 3 + [(None, None, None)]
    more = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], df.schema)
    assert sorted(map(tuple, divergence.audit_sources(more, min_docs=1).collect())) == plain_audit(rows, 1, 50)


@pytest.mark.parametrize("name", ["op11_warc", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)
