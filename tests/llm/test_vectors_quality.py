"""Product codes, sort-means and host rules against brute force, on tables with nulls, ties,
repeats, huge values, wrong lengths and clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwell.llm import centroids, codes, quality, vectors
from arcwell.llm import queries as own
from arcwell.llm.shared import ship

VECTORS = "vec_id long, embedding array<float>, label string, code string, error string, cluster string, was string, n string"


def vector_rows():
    rng = random.Random(11)
    rows = []
    for i in range(420):
        v = [rng.gauss(0, 0.2) if i % 3 else rng.choice((-0.25, 0.25)) for _ in range(64)]  # a third on a grid: ties
        rows.append([i * 3, v, (None, "a", "b")[i % 3] if i % 2 else "hot"])
    for i in range(0, 120, 3):
        rows.append([2000 + i, rows[0][1], "hot"])  # copies
    rows += [[7, None, "a"], [8, [], "a"], [9, [0.1] * 63 + [None], "a"], [10, [0.1] * 63 + [float("nan")], "a"], [11, [0.1] * 63 + [float("inf")], None]]
    rows += [[None, [0.3] * 64, "a"], [12, [0.1] * 32, "a"], rows[5], rows[5], [3001, [3e30] * 64, "b"], [3002, [-3e30] * 64, "b"]]
    return [(*r, "c", "e", "k", "w", "n") for r in rows]


ROWS = vector_rows()


def fit_rows(scale, most=vectors.MOST):
    """(id, label, integers) of the usable vectors of 64 components."""
    out = []
    for i, v, label, *_ in ROWS:
        if v is None or len(v) != 64 or any(e is None or not math.isfinite(e) for e in v):
            continue
        out.append((i, label, [max(-most, min(most, math.floor(float(np.float32(e)) * scale))) for e in v]))
    return out


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, VECTORS).repartition(5)


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_means(points, books, rounds):
    """Lloyd's rounds by all distances on Python integers, one part."""
    near = lambda v: min((away(v, e), i) for i, e in enumerate(books))
    for _ in range(rounds):
        groups = {}
        for v in points:
            groups.setdefault(near(v)[1], []).append(v)
        books = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books)]
    return books, [near(v) for v in points]


def test_product_codes_equal_brute_force(table):
    points = fit_rows(1024)
    start = [p[2] for p in sorted((p for p in points if p[0] is not None), key=lambda p: (p[0], p[2]))[:16]]
    books = codes.fit(table, 4, 16, 2, 1024)
    expected, per_part = [], []
    for p in range(4):
        cut = slice(16 * p, 16 * p + 16)
        entries, found = plain_means([v[cut] for _, _, v in points], [e[cut] for e in start], 2)
        expected.append(entries)
        per_part.append(found)
    assert books.entries.tolist() == expected
    errors, digits = [sum(f[i][0] for f in per_part) for i in range(len(points))], ["".join(f"{f[i][1]:02x}" for f in per_part) for i in range(len(points))]
    by_label = Counter()
    for (_, label, _), e in zip(points, errors, strict=True):
        by_label[label] += e
    got = codes.label_errors(codes.encode(table, books)).collect()
    assert Counter(map(tuple, got)) == Counter((i, label, d, e, by_label[label]) for (i, label, _), d, e in zip(points, digits, errors, strict=True))


def test_codes_decode_to_their_entries(table):
    books = codes.fit(table, 4, 16, 1, 1024)
    coded = codes.encode(table.where("vec_id < 60"), books)
    back = {r["vec_id"]: r["embedding"] for r in codes.decode(coded, books).collect()}
    for r in coded.collect():
        parts = [books.entries[p][int(r["code"][2 * p : 2 * p + 2], 16)] / 1024 for p in range(4)]
        assert back[r["vec_id"]] == np.concatenate(parts).tolist()


def test_kd_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(3)
    entries = np.concatenate((rng.integers(-50, 50, (200, 3)), rng.integers(-50, 50, (28, 3)).repeat(2, 0)))  # equal entries
    x = rng.integers(-60, 60, (3000, 3))
    x[:300] = entries[rng.integers(0, len(entries), 300)]
    found = codes.Search(x, entries, codes.kd_tree(entries))
    plain = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (found.at == plain.argmin(1)).all() and (found.best == plain.min(1)).all()
    assert found.products < 0.5 * plain.size
    wide = codes.Search(x * 10**6, entries * 10**6, codes.kd_tree(entries * 10**6))  # beyond float64
    assert (wide.at == plain.argmin(1)).all() and wide.best.dtype == np.int64


@pytest.mark.parametrize("rounds", [0, 3, 5])  # five rounds pass a REPLAY
def test_sort_means_equal_brute_force(table, rounds):
    points = fit_rows(64)
    named = sorted((hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[2]) for p in points if p[0] is not None)[:8]
    expected, found = plain_means([v for _, _, v in points], [v for _, v in named], rounds)
    assigned, last = centroids.sort_means(table, 8, rounds)
    assert last.tolist() == expected
    got = centroids.digest(assigned, last).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter((p[0], c, d) for p, (d, c) in zip(points, found, strict=True))
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    for r in got:
        assert r["cluster_inertia"] == min(inertia[r["cluster"]], 2**63 - 1) and r["inertia"] == min(sum(inertia.values()), 2**63 - 1)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, expected[r["cluster"]])).encode()).hexdigest()


def test_sort_means_stops_early_and_keeps_ties():
    rng = np.random.default_rng(4)
    centers = rng.integers(-1000, 1000, (40, 6))
    centers[7] = centers[31]
    x = centers[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 6))
    x[:100] = (centers[3] + centers[4]) // 2
    plain = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    warm = centroids.Assignment(x, plain.argmin(1), centroids.Order(centers))
    assert (warm.at == plain.argmin(1)).all() and warm.products < 0.15 * plain.size
    cold = centroids.Assignment(x, np.full(4000, 31), centroids.Order(centers))
    assert (cold.at == plain.argmin(1)).all() and (cold.best == plain.min(1)).all()


def test_nothing_usable(spark, table):
    for some in (table.where("false"), table.where("vec_id IN (7, 8, 10, 11)"), table.where("vec_id IS NULL")):
        assert codes.fit(some) is None
        assigned, last = centroids.sort_means(some)
        assert centroids.digest(assigned, last).count() == 0
    few, last = centroids.sort_means(table.where("vec_id < 9"), 16, 3)
    assert few.count() == 3 and len(last) == 3
    books = codes.fit(table.where("vec_id < 9"))
    assert books.entries.shape == (4, 3, 16)
    assert {r["error"] for r in codes.encode(table.where("vec_id < 9"), books).collect()} == {0}


def plain_measures(text):
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\f")]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    twice = Counter(triples)
    cover = {i + k for i, t in enumerate(triples) if twice[t] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(cover)


TEXTS = ["", " \n\t ", "one", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n x\nx", "é€😀 ünï z q \x1c r", "#* $%& |<> ok", "w " * 5000, "line\r\nline\r\nline", "a\x0bb\x0cc a b c"]


def test_measures_equal_brute_force():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab #\n\té") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t in texts:
        assert quality.measure_text(t.encode()) == plain_measures(t), t


def quality_rows():
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(t, "odd") for t in TEXTS] + [(None, "odd"), (None, None), (say(80), None), (say(10), None)]
    rows += [(say(90), f"good{i % 3}") for i in range(60)] + [(say(20), "good0")]
    rows += [(say(60) + " ###" * 20, "spam") for _ in range(30)] + [(say(70), "spam") for _ in range(3)]  # clean texts of a bad host
    rows += [(say(12), "lone"), (say(80), "lone2")]
    rows += [rows[-1]]
    return [(i, t, s, "7", "8", "9", "k") for i, (t, s) in enumerate(rows)]


def test_host_rules(spark):
    ship(spark)
    rows = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words string, _bad string, rejected string").repartition(4)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    assert set(quality.judge(docs).columns) == {"doc_id", "text", "source", "_bad", "rejected", *quality.ADDED}
    fails = {}
    for i, t, *_ in rows:
        n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words = plain_measures(t or "")
        fails[i] = [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 2 * n_dup_lines > n_lines, word_chars < 2 * n_words or word_chars > 12 * n_words]
        assert [got[i][m] for m in quality.MEASURES] == list(plain_measures(t or "")) and got[i]["text"] == t
    by_host = {}
    for i, _, s, *_ in rows:
        if s is not None:
            by_host.setdefault(s, []).append(fails[i])
    bad, n = set(), sum(map(len, by_host.values()))
    for j in range(5):
        k = {s: sum(f[j] for f in fs) for s, fs in by_host.items()}
        mean = sum(k.values()) / n
        between = sum(k[s] ** 2 / len(fs) for s, fs in by_host.items()) / n - mean**2 - mean * (1 - mean) * len(by_host) / n
        weight = min(max(mean * (1 - mean) / between - 1 if between > 0 else 1000.0, 2.0), 1000.0)
        bad |= {s for s, fs in by_host.items() if (k[s] + mean * weight) / (len(fs) + weight) > 0.5}
    assert "spam" in bad and not bad & {"good0", "good1", "good2", "lone2"}
    for i, _, s, *_ in rows:
        assert got[i]["base_failed"] == (fails[i][0] or fails[i][1])
        assert got[i]["kept"] == (not any(fails[i]) and s not in bad), i
    small = {r["doc_id"]: r for r in quality.digest(docs).collect()}
    assert all(small[i]["kept"] == got[i]["kept"] and small[i]["n_dup_lines"] == got[i]["n_dup_lines"] for i in small) and len(small) == len(rows)
    assert quality.digest(docs.where("false")).count() == 0 and quality.judge(docs.where("source IS NULL")).count() == 3


def test_priors():
    same = quality.Prior.of(100, 10_000, 1_000, 100 * 10 * 10 / 100)  # all hosts at a tenth
    assert same.mean == 0.1 and same.weight == quality.WEIGHT[1]
    split = quality.Prior.of(10, 1_000, 500, 5 * 100 * 100 / 100)  # half all bad, half all good
    assert split.weight == quality.WEIGHT[0]
    assert quality.Prior.of(0, 0, 0, 0.0).mean == 0


def test_clean_documents_stay(spark):
    """Labelled quality is no input; what it calls good is kept but for the base."""
    sf = "/root/testdata/sf0.01"
    judged = own.op13_host_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    kept = {r["quality"]: r["share"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] >= 0.99 and kept[0] <= 0.1
