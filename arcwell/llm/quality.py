"""Quality rules and verdicts of hosts.

A text's measures are counted exactly in one pass over it. Each document fails or passes
RULES; failures are counted by host, and each host's rates are shrunk to the corpus by a
beta prior that the hosts themselves give (moments of their rates, weighted by documents,
less what chance alone spreads them). A host is rejected if a shrunk rate passes
``limit``, and its verdict is joined back to its documents.

Only numbers are shuffled: one row a host and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, small
from .textscan import chunks

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: What a document fails, in SQL over its measures. The first two are the base.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE = ("short", "repeats")
#: Bounds of the prior's weight in documents: hosts that differ no more than chance give
#: it the most, hosts that are each all good or all bad the least.
WEIGHT = (2.0, 1000.0)


def measure_text(raw: bytes) -> tuple[int, ...]:
    """MEASURES of one text. ``bytes.split`` parts at exactly the bytes 20 and 09 to 0D, none
    of which occurs inside a UTF-8 sequence."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(b"".join(words).decode()), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that occur twice or more. Windows are named by
    ranks of ever longer ones, so that equal names mean equal words."""
    n = len(words)
    if n <= width:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    names = ids
    for k in range(1, width):
        names = names[:-1] * len(index) + ids[k:]
        _, names, times = np.unique(names, return_inverse=True, return_counts=True)
    twice = times[names] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def measure(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of ``docs`` (all, as one struct ``doc``, if none is named) and the
    measures of each row's whole text; a null text is an empty one."""
    told = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("text")) if kept else docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").alias("source"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            counted = np.array([measure_text(t or b"") for t in texts], np.int64).reshape(-1, len(MEASURES))
            others = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*others, *map(pa.array, counted.T)], [*batch.schema.names[:-1], *MEASURES])

    names = told.columns[:-1]
    kinds = ", ".join(f"`{n}` {told.schema[n].dataType.simpleString()}" for n in names)
    return told.mapInArrow(run, f"{kinds}, {', '.join(f'{m} long' for m in MEASURES)}")


def fails(rule: str) -> Column:
    return F.expr(RULES[rule])


@dataclass
class Prior:
    """A beta distribution of hosts' failure rates: mean and weight in documents."""

    mean: float
    weight: float

    @classmethod
    def of(cls, hosts: int, n: int, k: int, spread: float) -> Prior:
        """From the number of hosts, documents and failures, and the sum over hosts of
        failures squared by documents. Of the weighted variance of the rates, what chance
        gives (about mean * (1 - mean) * hosts / n) is taken off."""
        mean = k / n if n else 0.0
        chance = mean * (1 - mean)
        between = spread / n - mean * mean - chance * hosts / n if n else 0.0
        weight = WEIGHT[1] if between * WEIGHT[1] <= chance else chance / between - 1
        return cls(mean, min(max(weight, WEIGHT[0]), WEIGHT[1]))


def hosts(measured: DataFrame) -> tuple[DataFrame, dict[str, Prior]]:
    """(a row a host that isn't null with its documents and failures; the priors, of which a
    row of sums comes to the driver). Documents of a null host count in no prior."""
    failed = [F.sum(fails(r).cast("long")).alias(r) for r in RULES]
    counted = checkpoint(measured.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n_docs"), *failed))
    sums = counted.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r) * F.col(r).cast("double") / F.col("n_docs")).alias(f"{r}_spread") for r in RULES]).first()
    return counted, {r: Prior.of(sums["hosts"], sums["n"] or 0, sums[r] or 0, sums[f"{r}_spread"] or 0.0) for r in RULES}


def verdicts(counted: DataFrame, priors: dict[str, Prior], limit: float = 0.5) -> DataFrame:
    """``counted`` with each rule's shrunk rate, and ``rejected`` where one is over ``limit``."""
    rates = {r: (F.col(r) + F.lit(p.mean * p.weight)) / (F.col("n_docs") + F.lit(p.weight)) for r, p in priors.items()}
    out = counted.select("*", *[rate.alias(f"{r}_rate") for r, rate in rates.items()])
    return out.withColumn("rejected", F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > limit)


def judged(measured: DataFrame, judged_hosts: DataFrame) -> DataFrame:
    """``measured`` with base_failed, host_rejected and kept. Only rejected hosts are joined,
    broadcast while they are few; a document of a null host has none."""
    bad = small(judged_hosts.where("rejected").select(F.col("source").alias("_host"), F.lit(True).alias("_bad")))
    met = measured.join(bad, F.col("source") == F.col("_host"), "left").withColumn("host_rejected", F.coalesce("_bad", F.lit(False))).drop("_host", "_bad")
    own = F.array(*[fails(r) for r in RULES if r not in BASE])
    met = met.withColumn("base_failed", F.greatest(*[fails(r) for r in BASE]))
    return met.withColumn("kept", ~F.col("base_failed") & ~F.exists(own, lambda x: x) & ~F.col("host_rejected"))


ADDED = (*MEASURES, "base_failed", "host_rejected", "kept")


def judge(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """All columns of ``docs`` (same-named ones replaced), the measures, base_failed,
    host_rejected and kept.

    A document is kept if it fails no rule itself and its host isn't rejected. A null or
    empty text has no words and fails the base. A null source is no host: its documents are
    judged by their own rules alone. Repeated rows count and are judged each; an empty
    table gives no rows. The texts are read twice, once for the hosts and once for the rows.
    """
    counted, priors = hosts(measure(docs, "source"))
    met = judged(measure(docs), checkpoint(verdicts(counted, priors, limit)))
    return met.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ADDED], *ADDED)


def digest(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """doc_id and what ``judge`` adds, without the texts: measures are counted once."""
    measured = checkpoint(measure(docs, "doc_id", "source"))
    counted, priors = hosts(measured)
    return judged(measured, checkpoint(verdicts(counted, priors, limit))).select("doc_id", *[c for c in ADDED if c != "n_lines"])


ORACLE_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
m AS (
  SELECT r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, [%(rules)s] AS fs FROM m),
h AS (SELECT source, count(*) AS n, %(sums)s FROM f WHERE source IS NOT NULL GROUP BY source),
k AS (SELECT source, n, unnest(range(1, %(count)d + 1)) AS j, unnest([%(named)s]) AS k FROM h),
s AS (SELECT j, count(*) AS hosts, sum(n) AS n, sum(k) / sum(n)::DOUBLE AS mean, sum(k * k::DOUBLE / n) / sum(n) AS spread FROM k GROUP BY j),
b AS (SELECT *, mean * (1 - mean) AS chance, spread - mean * mean - mean * (1 - mean) * hosts / n AS between_hosts FROM s),
pr AS (SELECT j, mean, least(greatest(CASE WHEN between_hosts * %(most)s <= chance THEN %(most)s ELSE chance / between_hosts - 1 END, %(least)s), %(most)s) AS weight FROM b),
bad AS (SELECT DISTINCT source FROM k JOIN pr USING (j) WHERE (k + mean * weight) / (k.n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fs[1] OR fs[2]) AS base_failed,
       bad.source IS NOT NULL AS host_rejected,
       NOT list_bool_or(fs) AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
""" % {
    "rules": ", ".join(f"({r})" for r in RULES.values()),
    "sums": ", ".join(f"sum(fs[{i + 1}]::INT)::BIGINT AS k{i + 1}" for i in range(len(RULES))),
    "named": ", ".join(f"k{i + 1}" for i in range(len(RULES))),
    "count": len(RULES),
    "least": WEIGHT[0],
    "most": WEIGHT[1],
}
