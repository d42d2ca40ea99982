"""Language identification by Bayesian evidence fusion.

Text likelihoods (hashed byte trigrams) are combined with the language that the
document declares, the address suffix, and a prior of its host, smoothed towards the
suffix's and that towards the corpus's. The priors are grouped counts over all
documents of the language that text and declaration alone suggest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, small
from .textscan import chunks
from .urls import parts

BITS = 16
#: Trigrams that a text counts for at most: neighbours aren't independent evidence.
EVIDENCE = 40.0
#: Chance that a declaration or a country's suffix names the text's language.
DECLARED, SUFFIX = 0.9, 0.8
#: Strength of the priors, in documents.
STRENGTH = 10.0
#: Rows that the text model is fitted on, about: as many of each language, but no fewer
#: than TRAIN_LEAST where it has them; of a longer text, TRAIN_BYTES bytes from a place
#: drawn by its hash.
TRAIN_ROWS, TRAIN_LEAST, TRAIN_BYTES = 8_000, 32, 8_192
#: Trigrams that all languages' mean counts for in each language's model.
SMOOTHING = 4_096.0
#: Languages so many nats behind the best are left out of a document's list. A prior
#: moves two languages apart by less than 60 (for 10**9 documents), and what is another
#: 50 behind is beyond the precision of float64.
NEAR = 110.0
#: Languages of country suffixes (fixed values).
COUNTRIES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(raw: np.ndarray) -> np.ndarray:
    x = _LOWER[raw]
    return ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def fit(rows: Iterable[tuple[str, bytes]], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of trigram slots (models x slots) and each language's model.

    Each language's counts are smoothed towards the mean of all languages, which is the
    model of the languages without a text, if there are any: the last one.
    """
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        if len(text) > 2:
            own = counts.setdefault(lang, np.zeros(1 << BITS, np.uint32))
            own += np.bincount(trigrams(np.frombuffer(text, np.uint8)), minlength=1 << BITS).astype(np.uint32)
    fitted = sorted(counts)
    mean = np.full(1 << BITS, 1.0 / (1 << BITS))
    if fitted:
        mean = 0.1 * mean + 0.9 * sum(counts[x] / counts[x].sum() for x in fitted) / len(fitted)
    logs = np.empty((len(fitted) + (len(fitted) < max(1, len(langs))), 1 << BITS), np.float32)
    for i, x in enumerate(fitted):
        logs[i] = np.log((counts[x] + SMOOTHING * mean) / (counts[x].sum() + SMOOTHING))
    logs[len(fitted) :] = np.log(mean)
    at = {x: i for i, x in enumerate(fitted)}
    return logs, np.array([at.get(x, len(fitted)) for x in langs], np.int64)


def identify(docs: DataFrame, declared: Column, host: Column, suffix: Column | None = None, training: Column | None = None, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, confidence, declared, rejected.

    The languages are all those that any row is labelled with (``training``, else
    ``declared``), declares or has a suffix of. The text model is fitted on a bounded
    sample of each one's labelled rows, drawn by hash; a language without any has the
    mean of the others as its text likelihood. The driver and each worker hold about
    0.4 MB a language. A text without a letter (null and empty ones too) has lang null,
    confidence 0 and is rejected; so is one whose best language is less likely than
    ``least``. A null declaration, host or suffix is no evidence. Ties go to the first
    language by code point. Repeated rows are judged alike; extra columns are ignored;
    without any language all are rejected; an empty table gives no rows.
    """
    spark = docs.sparkSession
    suffix = F.lit(None).cast("string") if suffix is None else suffix
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", declared.alias("declared"), host.alias("host"), suffix.alias("suffix"), (declared if training is None else training).alias("_label"))
    country = F.element_at(F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair]), F.coalesce("suffix", F.lit("")))
    # Equal rows have equal hashes, so rows are counted and drawn by different hashes.
    drawn = F.when(F.octet_length("text") > 2, F.xxhash64("doc_id", "text"))
    named = F.array(F.struct(F.col("_label").alias("x"), drawn.alias("h")), *[F.struct(c.alias("x"), F.lit(None).cast("long").alias("h")) for c in (F.col("declared"), country)])
    found = base.select(F.explode(named).alias("n")).select("n.x", "n.h").where("x IS NOT NULL").groupBy("x").agg(F.approx_count_distinct("h").alias("n")).collect()
    langs = sorted(r["x"] for r in found)
    k = max(1, len(langs))
    share = max(TRAIN_LEAST, TRAIN_ROWS // k)
    cuts = [(r["x"], int(min(2**63 - 1, -(2**63) + 2**64 * share // r["n"]))) for r in found if r["n"]]
    labelled = base.join(F.broadcast(spark.createDataFrame(cuts, "_label string, cut long")), "_label").withColumn("h", drawn).where("h <= cut")
    raw = F.col("text").cast("binary")
    piece = F.substring(raw, F.pmod("h", F.greatest(F.octet_length("text") - TRAIN_BYTES + 1, F.lit(1))).cast("int") + 1, F.lit(TRAIN_BYTES))
    sample = labelled.groupBy("_label", "h").agg(F.first(piece).alias("piece"))
    logs, model = fit(((r["_label"], bytes(r["piece"])) for r in sample.select("_label", "piece").collect()), langs)
    told = spark.sparkContext.broadcast((logs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, model = told.value
        place = {x: i for i, x in enumerate(langs)}
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                raw = b"\0\0".join([b"", *(t or b"" for t in texts), b"", b""])
                buf = np.frombuffer(raw, np.uint8)
                at = np.cumsum([2, *(len(t or b"") + 2 for t in texts)])[:-1]
                sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
                slots = trigrams(buf)
                letters = np.add.reduceat(_LETTER[_LOWER[buf]], at)
                n = np.maximum(sizes - 2, 1)
                weight = np.minimum(n, EVIDENCE) / n * (sizes > 2)
                inside = np.ones(len(slots), np.int8)  # not those across the ends of texts
                for i in (-2, -1, 0, 1):
                    inside[np.minimum(at + sizes + i, len(slots) - 1)] = 0
                inside[: at[0]] = 0
                by_model = np.stack([np.add.reduceat(own[slots] * inside, at) * weight for own in logs], 1).astype(np.float64)
                score = by_model[:, model] if langs else by_model
                for column, right in ((1, DECLARED), (4, SUFFIX)):
                    claims = [place.get(x, -1) for x in batch.column(column).to_pylist()]
                    for row, claimed in enumerate(claims):
                        if claimed >= 0:
                            score[row] += np.log((1 - right) / max(1, k - 1))
                            score[row, claimed] += np.log(right) - np.log((1 - right) / max(1, k - 1))
                row, lang = np.nonzero(score >= score.max(1)[:, None] - NEAR)
                ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
                near, near_log = pa.ListArray.from_arrays(ends, pa.array(lang, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(score[row, lang]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(letters > 0), pa.array(score.argmax(1), pa.int32()), near, near_log], ["doc_id", "declared", "host", "suffix", "lettered", "guess", "near", "log"])

    shown = base.select("doc_id", "declared", "host", "suffix", country.alias("country"), "text")
    seen = checkpoint(shown.mapInArrow(run, "doc_id long, declared string, host string, suffix string, lettered boolean, guess int, near array<int>, log array<double>"))
    counts = checkpoint(seen.where("lettered").groupBy("host", "suffix", "guess").agg(F.count("*").cast("double").alias("n")))
    overall = np.ones(k)
    for r in counts.groupBy("guess").agg(F.sum("n").alias("n")).collect():
        overall[r["guess"]] += r["n"]
    overall = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])
    hosted = counts.where("host IS NOT NULL")

    def tally(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("n"), F.sum("n").alias("total"))

    by_host = tally(hosted, "host", "suffix").toDF("_host", "_suffix", "host_n", "host_total")
    by_suffix = tally(hosted.groupBy("suffix", "guess").agg(F.sum("n").alias("n")), "suffix").toDF("_s", "suffix_n", "suffix_total")
    priors = small(checkpoint(by_host.join(by_suffix, F.col("_suffix").eqNullSafe(F.col("_s"))).drop("_s")))

    def smooth(i: Column, n: str, total: str, towards: Column) -> Column:
        return (F.coalesce(F.element_at(n, i), F.lit(0.0)) + STRENGTH * towards) / (F.col(total) + STRENGTH)

    def prior(i: Column) -> Column:
        general = F.get(overall, i)
        return F.log(F.coalesce(smooth(i, "host_n", "host_total", smooth(i, "suffix_n", "suffix_total", general)), general))

    met = seen.join(priors, (F.col("host") == F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")), "left")
    met = met.select("doc_id", "declared", "lettered", "near", F.zip_with("near", "log", lambda i, x: x + prior(i)).alias("log"))
    top = F.array_max("log")
    sure = 1 / F.aggregate("log", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    best = F.get("near", F.array_position("log", top).cast("int") - 1)
    lang = F.when(F.col("lettered") & F.lit(bool(langs)), F.get(F.array(*map(F.lit, langs or [""])), best))
    out = met.select("doc_id", lang.alias("lang"), F.when(lang.isNotNull(), sure).otherwise(0.0).alias("confidence"), "declared")
    return out.withColumn("rejected", F.col("lang").isNull() | (F.col("confidence") < least))


def read_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, declared, host, suffix) of (page_id, url, html): the language that the
    markup declares (the root's lang or xml:lang, else a content-language; its first
    subtag, lower-case), the address's host and last label, and the markup's text without
    scripts, styles, comments and tags. Null or absent parts are null."""
    html = F.coalesce("html", F.lit(""))

    def found(pattern: str) -> Column:
        return F.nullif(F.lower(F.regexp_extract(html, pattern, 1)), F.lit(""))

    told = F.coalesce(found("(?is)<html\\b[^>]*?[\\s:]lang\\s*=\\s*[\"']?([a-z]{2,3})\\b"), found("(?is)<meta\\b[^>]*content-language[^>]*?content\\s*=\\s*[\"']?([a-z]{2,3})\\b"))
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.nullif(parts(F.col("url"))[0], F.lit(""))
    suffix = F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), told.alias("declared"), host.alias("host"), suffix.alias("suffix"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, lang, confidence,
    declared, rejected, by the page's text, its markup's language, its address's suffix
    and its host. A null or empty html has no text and is rejected; a null url has no host
    and no suffix; repeated rows are judged alike; extra columns are ignored; an empty
    table gives no rows."""
    told = identify(read_pages(pages), F.col("declared"), F.col("host"), F.col("suffix"))
    return told.withColumnRenamed("doc_id", "page_id")
