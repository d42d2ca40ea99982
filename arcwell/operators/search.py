"""Text search (inverted index, prefix BM25), vector search and rank fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, half_up, split_terms
from ..plans.session import checkpoint

K1, B = 1.2, 0.75
# Words that aren't indexed (fixed values).
STOP = (
    "the and for are was this that with from have has had not but you all can her his one will more use get set let var new null true false else then void type enum class "
    "interface extends implements import export return public private protected static final const que nao com por para uma dos das nos nas seu sua num ser ter tem foi como mais mas "
    "sem quando muito bem entre depois antes onde tambem isso isto aqui"
).split()
SQL_WORDS = (
    "select insert update delete where join inner outer left right group order having create table index primary foreign key values commit rollback begin declare procedure function "
    "trigger cursor fetch open close"
).split()


def term_array(text: Column) -> Column:
    """A text's distinct indexed terms in first-seen order."""
    return F.array_except(F.array_distinct(split_terms(F.coalesce(text, F.lit("")))), F.array(*map(F.lit, [*STOP, *SQL_WORDS])))


def terms(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(file, term): a document's distinct terms, at most ``most`` in first-seen order."""
    t = term_array(F.col("text"))
    return docs.select("file", F.explode(F.slice(t, 1, most) if most else t).alias("term"))


def index_terms(files: DataFrame, most: int | None = 400) -> DataFrame:
    """(file, snippet, terms) of source files: terms of the path, then of comments, of names
    and of strings, each once; the snippet is the first three lines with a word, 120
    characters of each. ``most`` bounds the terms of a file (none: no bound)."""
    text = F.coalesce("text", F.lit(""))
    notes = F.array_join(F.regexp_extract_all(text, F.lit("(?s)/\\*.*?\\*/|//[^\\n]*|(?m)^\\s*#[^\\n]*|--[^\\n]*"), 0), " ")
    bare = F.regexp_replace(text, "(?s)/\\*.*?\\*/|//[^\\n]*|--[^\\n]*", " ")
    strings = F.array_join(F.regexp_extract_all(bare, F.lit("\"[^\"\\n]*\"|'[^'\\n]*'|`[^`\\n]*`"), 0), " ")
    names = F.regexp_replace(bare, "\"[^\"\\n]*\"|'[^'\\n]*'|`[^`\\n]*`", " ")
    found = term_array(F.concat_ws(" ", F.col("file"), notes, names, strings))
    said = F.filter(F.split(text, "\n"), lambda x: x.rlike("\\w"))
    snippet = F.array_join(F.transform(F.slice(said, 1, 3), lambda x: F.substring(F.trim(x), 1, 120)), "\n")
    return files.select("file", snippet.alias("snippet"), (F.slice(found, 1, most) if most else found).alias("terms"))


def query_terms(text: str) -> list[str]:
    """Tokens of a query: runs of three letters or more, whole and split at camel case, in
    lower case, each once."""
    out: list[str] = []
    for run in re.findall(r"[A-Za-z]{3,}", text):
        parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", run)).split()
        out += [p.lower() for p in [*parts, run] if len(p) >= 3]
    return list(dict.fromkeys(out))


def bm25(docs: DataFrame, prefixes: list[str], n: int = 20) -> DataFrame:
    """(file, score) of documents (file, terms: distinct ones): an OR of prefixes. tf is the
    number of a document's terms that a prefix fits, df the documents it fits; an idf that
    isn't positive is a millionth. Scores have one place.

    Each text is read once: a row of counts a document is kept, what its corpus has in all
    is one row.
    """
    prefixes = sorted(set(prefixes))

    def fitting(prefix: str) -> Column:
        return F.size(F.filter("terms", lambda t: t.startswith(prefix)))

    tf = [fitting(p).alias(f"tf{i}") for i, p in enumerate(prefixes)]
    # The condition comes after the checkpoint: before it, it would be pushed below the terms and read the texts again.
    rows = checkpoint(docs.select("file", F.size("terms").alias("dl"), *tf)).where("dl > 0")
    whole = rows.agg(F.count("*").alias("docs"), F.avg("dl").alias("avg_dl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(prefixes))])
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        idf = F.ln((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    hit = rows.where(F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{i}") for i in range(len(prefixes))]) > 0)
    return hit.crossJoin(F.broadcast(whole)).select("file", half_up(score, 1).alias("score")).orderBy(F.desc("score"), "file").limit(n)


def inverted_score(postings: DataFrame, words: list[str], n: int = 20) -> DataFrame:
    """2 for each exact term, 1 for each that a word begins."""
    score = sum((F.when(F.col("term") == w, 2).when(F.col("term").startswith(w), 1).otherwise(0) for w in words), F.lit(0))
    return postings.select("file", score.alias("s")).where("s > 0").groupBy("file").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "file").limit(n)


def vector_top(vectors: DataFrame, query: list[float], n: int = 20, places: int = 3) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("file", half_up(cosine(F.col("vec"), q), places).alias("score")).orderBy(F.desc("score"), "file").limit(n)


def fuse(text: DataFrame, vector: DataFrame, n: int = 10, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank), with the origin of each file."""
    order = Window.orderBy(F.desc("score"), "file")
    a = text.select("file", F.row_number().over(order).alias("ra"))
    b = vector.select("file", F.row_number().over(order).alias("rb"))
    s = F.coalesce(1.0 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("rb")), F.lit(0.0))
    origin = F.when(F.col("ra").isNull(), "vec").when(F.col("rb").isNull(), "fts").otherwise("both")
    return a.join(b, "file", "full_outer").select("file", origin.alias("origin"), half_up(s, 4).alias("score")).orderBy(F.desc("score"), "file").limit(n)


def fused_search(docs: DataFrame, vectors: DataFrame, text: str, query: list[float] | None, n: int = 10, each: int = 20) -> DataFrame:
    """Text and vector search, ``each`` hits of both, fused; text alone without a query vector
    or without any vector. Columns: file, origin, score."""
    words = query_terms(text)
    found = bm25(docs, words, each) if words else docs.select("file", F.lit(0.0).alias("score")).where(F.lit(False))
    near = vector_top(vectors, query, each) if query else found.where(F.lit(False))
    return fuse(found, near, n)
