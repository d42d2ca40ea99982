"""Language ID against the whole posterior worked out in plain Python."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from arcwell.llm import langid
from arcwell.llm.shared import ship

WORDS = {"en": "the of and harbour ship water wind north captain sail", "fr": "le la les bateau vent mer nord équipage voile port", "de": "der die das schiff wasser wind norden mannschaft segel hafen"}


def corpus():
    """(doc_id, text, declared, host, suffix, label): null and wrong declarations, hosts of one
    language and of two, texts of one letter, of none, and a language without texts."""
    rng = random.Random(12)
    rows = []
    for i in range(240):
        lang = ("en", "fr", "de", "en")[i % 4]
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.choice((1, 3, 40))))
        declared = None if i % 7 == 0 else rng.choice(list(WORDS)) if i % 11 == 0 else lang
        host = None if i % 13 == 0 else f"h{i % 5}" if i % 2 else f"only-{lang}"
        rows.append((i, text, declared, host, (None, "com", "fr", "de", "mx")[i % 5], declared if i % 3 else lang))
    rows += [(900, "x", None, "h1", "com", None), (901, "12 34", "en", "h1", "com", "en"), (902, None, "en", "h1", "com", "en"), (903, "vent", "zz", "h2", None, "zz"), (904, "", None, None, None, None)]
    return rows + [rows[3]]


def slots(text):
    raw = text.encode()
    return langid.trigrams(np.frombuffer(raw, np.uint8)).tolist() if len(raw) > 2 else []


def plain(rows):
    """(language, its posterior) of each row, by sums over dictionaries."""
    langs = sorted({x for _, _, declared, _, suffix, label in rows for x in (declared, langid.COUNTRIES.get(suffix), label) if x})
    size, k = 1 << langid.BITS, len(langs)
    counts = {}
    for text, label in {(t, (i, lab)) for i, t, _, _, _, lab in rows if t and lab}:
        if len(text.encode()) > 2:
            counts.setdefault(label[1], Counter()).update(slots(text))
    totals = {x: sum(c.values()) for x, c in counts.items()}
    mean = lambda s: 0.1 / size + 0.9 * sum(c[s] / totals[x] for x, c in counts.items()) / len(counts)

    def chance(lang, s):
        return (counts[lang][s] + langid.SMOOTHING * mean(s)) / (totals[lang] + langid.SMOOTHING) if lang in counts else mean(s)

    evidence = []
    for _, text, declared, _, suffix, _ in rows:
        own = slots(text or "")
        weight = min(len(own), langid.EVIDENCE) / len(own) if own else 0.0
        logs = {x: weight * sum(math.log(chance(x, s)) for s in own) for x in langs}
        for said, right in ((declared, langid.DECLARED), (langid.COUNTRIES.get(suffix), langid.SUFFIX)):
            if said:
                for x in langs:
                    logs[x] += math.log(right if x == said else (1 - right) / max(1, k - 1))
        evidence.append(logs)
    lettered = [any(c.isascii() and c.isalpha() or ord(c) > 127 for c in t or "") for _, t, *_ in rows]
    guesses = [min(langs, key=lambda x: (-round(logs[x], 6), x)) for logs in evidence]
    overall, by_suffix, by_host = Counter(dict.fromkeys(langs, 1)), {}, {}
    for (_, _, _, host, suffix, _), guess, fit in zip(rows, guesses, lettered, strict=True):
        if fit:
            overall[guess] += 1
            if host:
                by_suffix.setdefault(suffix, Counter())[guess] += 1
                by_host.setdefault((host, suffix), Counter())[guess] += 1
    smooth = lambda c, x, towards: (c[x] + langid.STRENGTH * towards) / (sum(c.values()) + langid.STRENGTH)
    out = []
    for (_, _, _, host, suffix, _), logs, fit in zip(rows, evidence, lettered, strict=True):
        general = {x: overall[x] / sum(overall.values()) for x in langs}
        if (host, suffix) in by_host:
            general = {x: smooth(by_host[host, suffix], x, smooth(by_suffix[suffix], x, general[x])) for x in langs}
        whole = {x: logs[x] + math.log(general[x]) for x in langs}
        best = max(whole.values())
        share = {x: math.exp(v - best) for x, v in whole.items()}
        lang = max(langs, key=lambda x: share[x])
        out.append((lang, 1 / sum(share.values())) if fit else (None, 0.0))
    return out


def test_posteriors_equal_brute_force(spark):
    ship(spark)
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string, label string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(d, F.col("declared"), F.col("host"), F.col("suffix"), training=F.col("label")).collect()}
    assert len(got) == len(rows) - 1
    near = 0
    for row, (lang, sure) in zip(rows, plain(rows), strict=True):
        r = got[row[0]]
        assert r["confidence"] == pytest_approx(sure), row
        near += sure < 0.6
        if lang is None or sure > 0.51:
            assert r["lang"] == lang, row
        assert r["rejected"] == (lang is None or r["confidence"] < 0.5)
    assert near and {r["lang"] for r in got.values()} >= {"en", "fr", "de", None}


def pytest_approx(x):
    import pytest

    return pytest.approx(x, abs=2e-3)
