"""Each operator against a plain version, on tricky texts and on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netloom.llm import decontam, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, queries, sharding, token_count, toxicity
from netloom.operators.components import component_labels
from netloom.storage import Store


def texts(spark, values):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "doc_id long, text string")


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def tricky_texts():
    rng = random.Random(5)
    parts = ["a@b.c", "x_y%z@d-e.f.g", "@", ".", "..", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4628898577833016", "4628 8985 7783 3016", "4628-8985-7783-3016-", " ", "  ", "-", "+1 (319) 555-5132", "+", "+4", "12345678901234567890", "\n", "é", "😀", "_", "word", "a@b.c_d@e.f", "+1 )( ", "00000000000000", "GB82 WEST 1234 5698 7654 32", "phone 319-555-5132"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 14))) for _ in range(400)]


def test_base_spans_are_those_of_the_patterns(spark):
    values = [*tricky_texts(), None, "", "1" * 60_000, "a." * 30_000 + "@" + "b." * 30_000, "x" * 100_000, "1 " * 40_000, "+" + "1-" * 30_000 + " ", "😀" * 5_000 + "a@b.c"]
    rows = {r.doc_id: r for r in pii.pii_report(texts(spark, values)).collect()}
    for i, t in enumerate(values):
        want = base_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t or "")[:80]
        n = Counter(x[3] for x in want)
        assert [rows[i][f"n_{k}"] for k in BASE] == [n[k] for k in BASE]
        assert set(filter(None, said.split(","))) <= set(rows[i].spans.split(","))


def test_spans_by_checksum_and_context(spark):
    values = ["pay to GB82 WEST 1234 5698 7654 32 now", "pay to GB82 WEST 1234 5698 7654 33 now", "call my phone: 319-555-5132.", "number 319-555-5132.", "IBAN DE89370400440532013000"]
    rows = [r.spans for r in pii.pii_report(texts(spark, values)).orderBy("doc_id").collect()]
    assert rows == ["iban:7:34", "", "local_phone:15:27", "", "iban:5:27"]


def test_ibans_before_other_words(spark):
    iban = "DE89370400440532013000"
    values = [f"IBAN {iban} Please pay", f"IBAN {iban} BIC COBADEFFXXX", f"IBAN {iban} 2026-01-01", f"IBAN {iban} {iban}", "IBAN DE89 3704 0044 0532 0130 00 TOTAL 12", f"CODE AB12 CDEF GHIJ {iban}", "IBAN DE89370400440532013001 BIC COBADEFFXXX", f"{iban} Ü", f"x{iban}", "AA12 " * 20_000]
    rows = [r.spans for r in pii.pii_report(texts(spark, values)).orderBy("doc_id").collect()]
    assert rows == ["iban:5:27", "iban:5:27", "iban:5:27", "iban:5:27,iban:28:50", "iban:5:32", "iban:20:42", "", "iban:0:22", "", ""]


def test_secrets(spark):
    digits = "0123456789abcdef" * 3
    values = [f'token = "{digits[:40]}"', f"commit {digits[:40]}", f"key {'ab' * 20}", f"secret: {digits[:31]}", f"api_key={digits.upper()[:32]}z"]
    rows = [r.spans for r in pii.pii_report(texts(spark, values)).orderBy("doc_id").collect()]
    assert rows == ["secret:9:49", "", "", "", ""]


def test_context_reaches_over_other_matches(spark):
    values = ["phone 555-123-4567 or 555-987-6543", "phone 555-123-4567 or 555-987-6543 or 555-222-3333", "number 555-123-4567 or 555-987-6543"]
    rows = [r.spans for r in pii.pii_report(texts(spark, values)).orderBy("doc_id").collect()]
    assert rows == ["local_phone:6:18,local_phone:22:34"] + ["local_phone:6:18,local_phone:22:34"] + [""]


def test_redaction(spark):
    df = pii.redact(pii.find_pii(texts(spark, ["write a@b.c or c@d.e!", "none", None, "a@b.c"])))
    assert [r.text for r in df.orderBy("doc_id").collect()] == ["write [EMAIL] or [EMAIL]!", "none", None, "[EMAIL]"]


def test_personal_data_in_documents(spark, sf):
    want = {i: (len(s := base_spans(t)), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()) for i, t in documents(spark, sf)}
    got = {r.doc_id: (r.n_email + r.n_ip + r.n_card + r.n_phone, r.base_sha256) for r in queries.op1_pii(spark, sf).collect()}
    assert got == want and any(n for n, _ in want.values())


# Token counts


def test_tokens_are_the_librarys(spark, sf):
    import public_tokenizers
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    rng = random.Random(3)
    parts = ["the", "Haus", "▁", " ", "  ", "\n", "\t", "<s>", "</s>", "<unk>", "<0x0A>", "😀", "ß", "語", ".", "...", "123", "　", "\x00", "a", "un", "▁the", " "]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(800)] + ["", None, " ", "  ", "a ", " a", "▁", "x" * 20_000, " " * 3_000]
    values += [t for _, t in documents(spark, sf)]
    rows = {r.doc_id: r for r in token_count.count_tokens(texts(spark, values), queries.tokenizer_file()).collect()}
    for i, t in enumerate(values):
        n = len(encoder.encode(t or ""))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 4096), repr((t or "")[:60])


def test_words_known_are_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_WORDS", 100)
    counter = token_count.WordCounter(queries.tokenizer_file())
    assert counter.apart and counter.single["the"] == 1
    words = [f"w{i} v{i}" for i in range(500)]
    assert counter.counts(words) == [len(x) for x in counter.encoder.encode(words)]
    assert len(counter.known) < len(counter.single) + 500


# N-gram Jaccard join


def word_sets(rows, n):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def components(rows, n, percent):
    """(doc_id, size, smallest id reached), by comparing all pairs that share an n-gram."""
    sets, root = word_sets(rows, n), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    for a, b in {(a, b) for v in having.values() for a in v for b in v if a < b}:
        k = len(sets[a] & sets[b])
        if 100 * k >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def similar_texts():
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    out = ["", None, " \n ", "one", "One", "one two", "ONE  two", "one two three", "É é", "one two three four", "a b a b a b a b", "a b a b"]
    for k in range(12):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.choice([6, 20, 60, 150]))]
        out += family(rng, base + (common if k % 2 else []), 12, rng.choice([1, 3, 8]))
    out += family(rng, common, 60, 2)
    rng.shuffle(out)
    return out + out[:20]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 100)])
@pytest.mark.parametrize("eager", [False, True])
def test_components_are_exact(spark, monkeypatch, n, percent, eager):
    if eager:
        for name, value in (("PAIRS_PER_CELL", -1), ("BLOCK", 4), ("ROUNDS", 2), ("TOLD", 2), ("CHUNK", 3000)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = list(enumerate(similar_texts()))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, percent).collect()
    assert sorted(map(tuple, got)) == components(rows, n, percent)


def test_components_of_documents(spark, sf):
    got = queries.op3_ngram_jaccard(spark, sf).collect()
    assert sorted(map(tuple, got)) == components(documents(spark, sf), 4, 85)


def test_one_of_each_group_stays(spark):
    df = texts(spark, ["a b c d e f", "x", "A b c d e f", None, None, "x y"]).withColumn("class", F.lit(1))
    kept = jaccard_join.keep_one(df)
    assert kept.columns == ["doc_id", "text", "class"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 5]


def test_labels_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(1, 30)] + [(7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(chain, "a long, b long"), Store(spark)).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in [500, *range(1, 30)]}}


# Line dedup


def test_boilerplate_lines(spark):
    rows = [(i, "http://User@Site.example:80/x", f"<p>home</p> <b>page {i}</b>\n<i>home</i>  tail\t{i % 2} ") for i in range(10)] + [(90, "https://one.example/", "home<br>alone"), (91, None, None), (92, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(df, "page_id", line_dedup.host_of(F.col("url")), line_dedup.lines_of_html(F.col("html"))).collect()}
    assert got[3].host == "site.example" and got[3].text == "page 3" and (got[3].n_lines, got[3].n_dropped) == (4, 3)
    assert got[90].text == "home\nalone" and got[90].n_dropped == 0
    assert (got[91].host, got[91].n_lines, got[91].text) == ("", 0, "") and len(got) == len(rows)


# Quality


def test_votes_are_weighed():
    rng = random.Random(2)
    counts: Counter = Counter()
    truth = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        s = "".join(("g" if rng.random() < 0.97 else "b") if good else ("b" if rng.random() < p else "g") for p in (0.9, 0.8, 0.7, 0.05))
        counts[s] += 1
        truth.setdefault(s, Counter())[good] += 1
    chance, right = quality.expectation_maximisation(counts)
    wrong = sum(truth[s][not (chance[s] > 0.5)] for s in counts)
    assert wrong < 200 and right[0, 1] > 0.8 > 0.3 > right[3, 1]
    assert quality.expectation_maximisation({})[0] == {}


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_quality(spark, sf).join(queries.table(spark, sf, "labels").withColumnRenamed("quality", "label"), "doc_id").collect()
    good, bad = [[r for r in rows if r.label == k] for k in (1, 0)]
    assert np.mean([r.kept for r in good]) >= 0.98
    assert np.mean([[a.quality > b.quality for b in bad] for a in good]) > 0.95


# Toxicity


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if i % 9 == 0:
            t[3], t[9] = rng.choice(["vile", "nasty", "grim"]), rng.choice(["zorka", "zorky", "zorke"])
        rows.append((i, " ".join(t)))
        if i % 2 == 0:
            marks.append((i, int(i % 9 == 0)))
    rows += [(1000, None), (1001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    held = [i for i, r in got.items() if r.held_out and i < 900]
    assert np.mean([got[i].predicted == int(i % 9 == 0) for i in held]) > 0.97
    assert got[1000].score == got[1001].score < 0.5
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in marks], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_no_confirmed_texts(spark):
    docs = texts(spark, ["a b", "c"])
    assert [r.predicted for r in toxicity.score_toxicity(docs, spark.createDataFrame([(0, None)], "doc_id long, toxic int")).collect()] == [0, 0]


def test_risk_does_not_fall_below_zero():
    w, b = toxicity.fit_nnpu([np.array([0]), np.array([0, 1])] * 20, [np.array([0]), np.array([2])], np.array([10.0, 90.0]), 3, 0.1)
    assert w[0] + b > 0 > w[2] + b and np.isfinite(w).all()


# Mixing


def fill(weights, holds, budget):
    """Gives each its share again and again, until nothing is left or all are full."""
    got = dict.fromkeys(weights, 0.0)
    while budget > 1e-9:
        open_ = [k for k in weights if weights[k] > 0 and got[k] < holds[k] - 1e-9]
        if not open_:
            break
        total, before = sum(weights[k] for k in open_), budget
        for k in open_:
            give = min(before * weights[k] / total, holds[k] - got[k])
            got[k] += give
            budget -= give
    return got


def test_budgets_fill_siblings_first(spark):
    leaves = [("a", "x", 100, 4), ("a", "y", 20, 2), ("b", "x", 30, 1), ("b", "z", 500, 9), ("c", "x", 400, 3), ("d", "x", 1000, 3)]
    df = spark.createDataFrame(leaves, "level_0 string, level_1 string, tokens long, n long")
    top, low = {"a": 0.5, "b": 0.2, "c": 0.3, "d": 0.0}, {"x": 0.4, "y": 0.6}
    for budget in (50, 300, 900, 1050, 5000):
        got = {(r.level_0, r.level_1): r.gets for r in mixing.leaf_budgets(df, ["level_0", "level_1"], [top, low], [0, 0.5], budget, 1).collect()}
        above = fill(top, {"a": 120, "b": 530, "c": 400, "d": 1000}, budget)
        for node, b in above.items():
            own = {k: t for n, k, t, _ in leaves if n == node}
            for k, v in fill({k: low.get(k, 0.5) for k in own}, own, b).items():
                assert got.get((node, k), 0) == pytest.approx(v, abs=1e-5), (budget, node, k)


def test_prefix_of_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 7)
    rng = random.Random(8)
    rows = [(i, rng.choice(["s", "t", None]), " ".join(["w"] * rng.randint(0, 30))) for i in range(200)] + [(5, "s", "again and again"), (None, "t", "no id"), (6, "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, {"source": "source"}, [{"s": 3.0, "": 0.0}], 0.9, 3, [1.0]).collect()
    tokens = {k: sum(len((t or "").split()) for _, s, t in rows if (s or "") == k) for k in ("s", "t", "")}
    budgets = fill({"s": 3.0, "t": 1.0, "": 0.0}, {k: 3 * v for k, v in tokens.items()}, int(sum(tokens.values()) * 0.9))
    want = []
    for leaf in ("s", "t"):
        so_far = 0
        order = sorted((e, hashlib.md5(f"mix|{e}|{'null' if d is None else d}".encode()).hexdigest(), len((t or "").split()), d) for e in range(3) for d, s, t in rows if (s or "") == leaf)
        for e, _, n, d in order:
            so_far += n
            if so_far <= int(budgets[leaf] + 1e-6):
                want.append((d, leaf, e, n))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.source, r.epoch, r.tokens) for r in got), key=key) == sorted(want, key=key) and want


@pytest.mark.parametrize("leaves", [50_000, 0])
def test_chosen_rows(spark, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(mixing, "LEAVES", leaves)
    rng = random.Random(9)
    rows = [(i, rng.choice(["s", "t", None]), " ".join(["w"] * rng.randint(0, 30)), "x") for i in range(200)]
    rows += [(5, "s", "again and again", "x"), (5, "t", "elsewhere", "x"), (None, "t", "no id", "x"), (None, "s", None, "x"), (6, "t", None, "x")] + rows[20:40]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string")
    tree = ({"source": "source"}, [{"s": 3.0, "": 0.0}], 0.6)
    ids = {(r.doc_id, r.source) for r in mixing.mix(df, *tree, 1, [1.0]).collect()}
    got = mixing.chosen_rows(df, *tree, defaults=[1.0])
    assert got.columns == df.columns
    want = [r for r in rows if (r[0], r[1] or "") in ids]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and 0 < len(want) < len(rows)


@pytest.mark.parametrize("parts", [4_000, 5, 0])
def test_values_of_frequent_keys(spark, monkeypatch, parts):
    monkeypatch.setattr(jaccard_join, "PARTS", parts)
    rng = random.Random(3)
    rows = [(i, rng.choice([7, 7, 7, *range(20)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, k long").repartition(4)
    values = df.where("k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    got = jaccard_join._with_value(df, values, "k").select("doc_id", "k", "least").collect()
    want = [(d, k, None if k == 3 else min(x for x, y in rows if y == k)) for d, k in rows]
    assert sorted(map(tuple, got)) == sorted(want)


# Exact dedup


def test_copies(spark):
    rng = random.Random(6)
    values = ["hot  text" if rng.random() < 0.4 else rng.choice([f"t{rng.randrange(60)}", f" t{rng.randrange(9)}\t", None, "", "hot\n text"]) for _ in range(600)]
    rows = [(rng.randrange(500) if i % 50 else None, t) for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.dedup_exact(df, partitions=4).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = Counter()
    for t, ids in groups.items():
        least = min((d for d in ids if d is not None), default=None)
        for k, d in enumerate(ids):
            want[(d, least, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.frequent(df, exact_dedup.normalised(F.col("text")), 4)


def test_copies_with_one_id(spark):
    rows = [(None, "the same text")] * 5_000 + [(7, "the same text")] * 3 + [(i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert max(exact_dedup.frequent(df, F.col("text"), 4)) >= 16
    got = exact_dedup.dedup_exact(df, partitions=4).collect()
    copies = [r for r in got if r.group_size > 1]
    assert len(got) == len(rows) and len(copies) == 5_003 and {(r.keep_id, r.group_size) for r in copies} == {(7, 5_003)}
    assert [r.doc_id for r in copies if r.kept] == [7] and sum(r.kept for r in got) == 101


# Decontamination


def edits(item, text):
    """The fewest edits between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(9)
    letters = "abcde  "
    items = [(i, decontam.plain("".join(rng.choice(letters) for _ in range(n)))) for i, n in enumerate([120, 90, 60, 30, 12, 8, 5])]
    values = []
    for k in range(250):
        _, item = items[k % len(items)]
        s = list(item)
        for _ in range(rng.randint(0, decontam.budget(len(item)) + 3)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], [rng.choice(letters)], [s[at], rng.choice(letters)]])
        around = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 200]))) for _ in "ab"]
        values.append(decontam.plain(around[0] + "".join(s) + around[1]))
    matcher = decontam.Matcher(items)
    got = defaultdict(lambda: 10**6)
    for d, i, start, end, e in matcher.find(values):
        assert edits(items[i][1], values[d][start:end]) == e <= decontam.budget(len(items[i][1]))
        got[d, i] = min(got[d, i], e)
    for d, t in enumerate(values):
        for i, item in items:
            best = edits(item, t)
            assert got[d, i] == best if best <= decontam.budget(len(item)) else (d, i) not in got, (d, i, best)


def test_alignment_within_bands():
    rng = random.Random(1)
    for _ in range(200):
        item, window = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in "ab"]
        got = decontam.align(decontam._codes(item), decontam._codes(window), -len(item), len(window), len(item))
        assert got is not None and got[0] == edits(item, window) == edits(item, window[got[1] : got[2]])


def test_passages_in_documents(spark, sf, monkeypatch):
    benchmark = [(r.item_id, decontam.plain(r.text)) for r in queries.table(spark, sf, "benchmark").collect()]
    rows = documents(spark, sf)
    whole = {(d, i) for d, t in rows for i, p in benchmark if p in decontam.plain(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()}
    assert whole and whole <= got
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1500)  # several blocks of passages
    assert {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()} == got
    clean = decontam.clean_of(queries.table(spark, sf, "documents"), queries.table(spark, sf, "benchmark"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}


@pytest.mark.parametrize("q", [1, 2, 3, 5, 7, 8, 12])
def test_qgrams_are_equal_where_the_strings_are(q):
    rng = random.Random(q)
    text = "".join(rng.choice("ab\U0001f600") for _ in range(300))
    got = decontam._qgrams(decontam._codes(text), q)
    grams = [text[i : i + q] for i in range(len(text) - q + 1)]
    assert len(got) == len(grams) and len(set(zip(grams, got.tolist(), strict=True))) == len(set(grams)) == len(set(got.tolist()))
    assert not len(decontam._qgrams(decontam._codes(text[: q - 1]), q))


def test_hits_do_not_depend_on_the_blocks(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["the", "quick", "fox", "of", "a"]) for _ in range(2000))
    matcher = decontam.Matcher([(1, text[100:160]), (2, text[900:1000]), (3, "the " * 30)])
    want = matcher.find([text, "the " * 500, text[::-1]])
    assert {i for d, i, *_ in want if d == 0} >= {0, 1} and {i for d, i, *_ in want if d == 1} == {2}
    monkeypatch.setattr(decontam, "HASHED", 37)
    assert matcher.find([text, "the " * 500, text[::-1]]) == want


@pytest.mark.parametrize("kind", ["int", "string", "short"])
def test_passage_ids_of_any_type(spark, kind):
    passage = "a passage that stands in one of the documents and nowhere else"
    docs = spark.createDataFrame([(1, "before " + passage + " after"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    out = decontam.contaminated(docs, bench)
    assert out.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert [(r.doc_id, str(r.item_id), r.edits) for r in out.collect()] == [(1, "7", 0)]


# Sharding


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shard(key, n):
    import math

    def u(s):
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return ((h >> 11) + 0.5) * 2.0**-53

    return max(range(n), key=lambda s: (-1 / math.log(u(s)), -s))


def test_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 3)
    rows = documents(spark, sf)
    got = queries.op10_sharding(spark, sf).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        data = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (shard(str(r.doc_id), 24), shard(str(r.doc_id), 25)) and r.grown_shard in (r.shard, 24)
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_rows_that_are_the_same_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 10)
    said, put = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, df: said.append(df.columns) or put(self, df))
    rows = [(None, "one text")] * 2_000 + [(None, f"text {i % 9}") for i in range(90)] + [(i, "one text") for i in range(300)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=3).collect()
    assert len(got) == len(rows) and said
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d, zlib.crc32(t.encode())) for d, t in rows)


def test_weighted_shards(spark, tmp_path):
    ids = spark.range(20_000).select(sharding.shard_of(F.col("id").cast("string"), [1.0, 3.0, 0.0]).alias("s"))
    n = {r.s: r["count"] for r in ids.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), [0.0])
    df = texts(spark, ["a", None, "c"])
    sharding.write_shards(df, str(tmp_path / "out"), weights=[1.0, 1.0])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_giant_text_changes_nothing_for_the_others(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(40)), *(["zorka", "vile"] if i % 4 == 0 else [])]) + ".") for i in range(200)]
    plain = {r.doc_id: r.kept for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    first = spark.range(200).select(F.col("id").alias("doc_id")).where(~toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") % 4 == 0)).orderBy(F.xxhash64("doc_id", F.lit("sample"))).head().doc_id
    rows[first] = (first, rows[first][1] + " " + "padding " * 1_000_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, marks).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(200)}
    good = {r.doc_id: r.kept for r in quality.score_quality(docs).collect()}
    assert sum(good.values()) > 150 and all(good[i] == plain[i] for i in good if i != first)


def risk_of(positive, unlabelled, weight, prior, w, b):
    """Both parts of the risk, a row at a time."""
    loss = lambda row, y: float(np.log1p(np.exp(-y * (sum(w[i] for i in row) + b))))
    toxic = prior * sum(loss(x, 1) for x in positive) / len(positive)
    clean = sum(n * loss(x, -1) for x, n in zip(unlabelled, weight, strict=True)) / sum(weight) - prior * sum(loss(x, -1) for x in positive) / len(positive)
    return toxic, clean


@pytest.mark.parametrize("prior", [0.05, 0.9])
def test_the_gradient_is_that_of_the_risk(prior):
    rng = np.random.default_rng(3)
    rows = lambda n, often: [np.flatnonzero(rng.random(6) < often).astype(np.int32) for _ in range(n)]
    positive, unlabelled, weight = rows(9, prior), rows(15, 0.3), rng.integers(1, 9, 15).astype(float)
    w, b = rng.random(6) * 2, -0.5
    risk = toxicity.Risk(positive, unlabelled, weight, 6, prior)
    toxic, clean, _, _ = risk.parts(w, b)
    assert np.allclose([toxic, clean], risk_of(positive, unlabelled, weight, prior, w, b))
    assert (clean < 0) == (prior == 0.9)

    def goal(x):
        t, c = risk_of(positive, unlabelled, weight, prior, x[:-1], x[-1])
        return -c if clean < 0 else t + c

    x = np.append(w, b)
    slope = [(goal(x + e) - goal(x - e)) / 2e-5 for e in np.eye(7) * 1e-5]
    assert np.allclose(risk.step(w, b), slope, atol=1e-6)


def test_the_steps_of_toxicity_cover_all_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(toxicity, "SETS_KEPT", 5)
    monkeypatch.setattr(toxicity, "HEADS_KEPT", 50)
    rows = [(i, t or "") for i, t in documents(spark, sf)] + [(10**6 + i, "The, copied text!") for i in range(30)]
    marks = lru_cache(None)(lambda t: {n for w in t.lower().split() for n in toxicity.features_of(w)})
    counts = Counter(n for _, t in rows for n in marks(t))
    names = sorted(n for n, k in counts.items() if k >= 10)[:300] + ["^cop", "=the", "=copied"]
    names = sorted(set(names))
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("text_key"), "text").repartition(3)
    monkeypatch.setattr(toxicity, "PARTS", 10)
    hot = toxicity._frequent(df)
    assert list(hot.values()) == [toxicity.ROW // 30]
    usage, n = toxicity._usage(df, names, hot)
    weigh = lambda t: hot[min(hot)] / toxicity.ROW if t == "The, copied text!" else 1
    assert np.allclose(usage, [sum(weigh(t) for _, t in rows if x in marks(t)) for x in names]) and np.isclose(n, sum(weigh(t) for _, t in rows))
    want = Counter()
    for _, t in rows:
        want[tuple(i for i, x in enumerate(names) if x in marks(t))] += hot[min(hot)] if weigh(t) < 1 else toxicity.ROW
    sets = toxicity._sets(df, names, hot)
    assert {tuple(r.places): r.weight for r in sets.collect()} == want
    own = [np.array([names.index("=the")], np.int32)] * 3
    w, b = toxicity.fit_nnpu(own, [np.array(k, np.int32) for k in sorted(want)], np.array([want[k] for k in sorted(want)], float), len(names), 0.1)
    whole = toxicity._trained(sets, own, len(names), 0.1)
    assert np.allclose(whole[0], w) and np.isclose(whole[1], b)
    monkeypatch.setattr(toxicity, "CELLS", 500)
    parted = toxicity._trained(sets, own, len(names), 0.1)
    assert np.isfinite(parted[0]).all() and abs(parted[1] - b) < 1.5
    model = toxicity.Model(names, w, b)
    got = {r.text: r.s for r in df.select("text", toxicity.score_of(F.col("text"), model).alias("s")).collect()}
    for _, t in rows:
        assert np.isclose(got[t], 1 / (1 + np.exp(-(b + sum(w[i] for i, x in enumerate(names) if x in marks(t))))))


def test_expectation_maximisation_row_by_row():
    """The same sums over single rows, with probabilities instead of their logarithms."""
    rng = random.Random(6)
    rows = ["".join(rng.choice("gggb-" if i % 3 else "bbg-") for _ in range(4)) for i in range(300)]
    chance, right = quality.expectation_maximisation(Counter(rows), 30)
    acc, prior = [[0.99, 0.2] for _ in range(4)], 0.7
    for _ in range(30):
        post = []
        for r in rows:
            a, b = prior, 1 - prior
            for k, v in enumerate(r):
                a *= {"g": acc[k][0], "b": 1 - acc[k][0], "-": 1}[v]
                b *= {"b": acc[k][1], "g": 1 - acc[k][1], "-": 1}[v]
            post.append(a / (a + b))
        prior = min(0.98, max(0.02, sum(post) / len(rows)))
        for k in range(4):
            good = sum(p for p, r in zip(post, rows, strict=True) if r[k] != "-")
            bad = sum(1 - p for p, r in zip(post, rows, strict=True) if r[k] != "-")
            acc[k] = [(sum(p for p, r in zip(post, rows, strict=True) if r[k] == "g") + 9.9) / (good + 10), (sum(1 - p for p, r in zip(post, rows, strict=True) if r[k] == "b") + 2) / (bad + 10)]
            acc[k] = [min(0.995, max(0.8, acc[k][0])), min(0.995, max(0.02, acc[k][1]))]
    assert np.allclose(right, acc) and all(abs(chance[r] - p) < 1e-9 for r, p in zip(rows, post, strict=True))


def test_quality_row_by_row(spark, sf, monkeypatch):
    kept = {}
    real = quality.train_scorer
    monkeypatch.setattr(quality, "train_scorer", lambda *given: kept.setdefault("model", real(*given)))
    got = {r.doc_id: r.quality for r in quality.score_quality(queries.table(spark, sf, "documents")).collect()}
    w, by_word, b = kept["model"]
    for i, t in documents(spark, sf):
        words = (t or "").split()
        p = quality.properties(t)
        own = [sum(bool(x < v) for x in quality._RATIO_STEPS) if v <= 1 else min(63, 20 + int(np.log2(v + 1))) for v in p.values()]
        kind = Counter("d" if x.isdigit() else "a" if x.isalpha() else "x" if x[:-1].isalpha() else "m" for x in words)
        steps = own + [1 + int(10 * kind[k] / len(words)) if kind[k] else 0 for k in quality.SHAPES]
        codes = [k * 64 + s for k, s in enumerate(steps) if k < 11 or s] + [(1 << 20) + (j * 64 + steps[j]) * 1024 + k * 64 + steps[k] for j in range(11) for k in range(j + 1, 11)]
        different = {zlib.crc32(x.encode()) % quality.WORDS for x in words}
        total = b + sum(w[((c + 1) * 0x9E3779B97F4A7C15 % 2**64) >> 48] for c in codes) + sum(by_word[x] for x in different) / max(1, len(different)) ** 0.5
        assert np.isclose(got[i], 1 / (1 + np.exp(-total)))


def test_quality_scorer_learns_words():
    """Texts alike in all properties are told apart by a word; nothing is learned from no rows."""
    rows = quality.hashed(np.ones((40, quality.PROPERTIES + len(quality.SHAPES)), np.int64))
    buckets = [quality.word_buckets(["the", "good" if i % 2 else "spam", f"w{i}"]) for i in range(40)]
    w, by_word, b = quality.train_scorer(rows, np.array([i % 2 for i in range(40)], float), buckets)
    total = w[rows].sum(1) + quality.word_sums(by_word, buckets) + b
    assert all(total[1::2] > 0) and all(total[::2] < 0)
    assert np.array_equal(quality.word_sums(by_word, [b""]), [0.0]) and quality.word_buckets([]) == b""
    # A lone surrogate, as a broken reader may hand on, is a word like any other.
    assert len(quality.word_buckets(["\ud800", "x", "x"])) == 4
    none = quality.train_scorer(rows[:0], np.zeros(0), [])
    assert not none[0].any() and not none[1].any() and none[2] == 0


def test_nothing_to_learn_is_said(spark):
    with pytest.warns(UserWarning, match="no labelled row is toxic"):
        toxicity.fit(texts(spark, ["a b"]), spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
