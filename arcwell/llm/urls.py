"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

Everything is DataFrame functions. Trees are grown from counts of equal feature bins
over all labelled URLs (those that a rule decides), one grouped aggregation a level;
the driver sees at most (nodes x features x bins) sums, and a grown tree is a nested
CASE expression. Both labels weigh the same in total. Statistics of a suffix or ending
are out of fold for the URLs that they are made of, so that the trees can't read a
label back from its own count. A value that no (other) labelled URL has is missing: a
split on it says the mean of its sides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, small

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
TREES, DEPTH, BINS, RATE, RIDGE, PRIOR, FOLDS, MISSING = 10, 3, 16, 0.4, 1.0, 20.0, 5, -1
NUMBERS = ("f_length", "f_host", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix", "f_ending")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.when(n > 0, F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def features(urls: DataFrame) -> DataFrame:
    """Adds host, path and the lexical features to rows with a ``url``."""
    host, path = parts(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    d = urls.withColumn("host", host).withColumn("path", path)
    n = F.greatest(F.length(url), F.lit(1))
    return d.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host": F.length("host").cast("double"),
            "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n,
            "f_entropy": entropy(url),
            "f_params": F.regexp_count(F.regexp_extract(url, "\\?([^#]*)", 1), F.lit("[^&]+")).cast("double"),
            "f_labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
            "f_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "ending": F.lower(F.regexp_extract("path", "[^/]\\.([A-Za-z0-9]{1,8})$", 1)),
        }
    )


def decide(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("said"))
    for rule, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, slash, begin = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + begin)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(said).alias("said"))).otherwise(out)
    return out


@dataclass
class Node:
    feature: int = -1
    bin: int = -1
    value: float = 0.0
    share: float = 0.5
    left: Node | None = None
    right: Node | None = None

    def expression(self, bins: Column) -> Column:
        """Its value for an array of bins; a missing one (MISSING) has the mean of both
        sides, each weighing what its labelled URLs do."""
        if self.left is None:
            return F.lit(self.value)
        one, two, bin_ = self.left.expression(bins), self.right.expression(bins), F.get(bins, F.lit(self.feature))
        return F.when(bin_ == MISSING, F.lit(self.share) * one + F.lit(1 - self.share) * two).when(bin_ <= self.bin, one).otherwise(two)


def binned(cuts: list[list[float]]) -> Column:
    """The bin of each feature: how many of its cuts lie below it; MISSING for a null."""
    return F.array(*[F.when(F.col(f).isNull(), MISSING).otherwise(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cut), F.lit(0))) for f, cut in zip(NUMBERS, cuts, strict=True)])


def grow(train: DataFrame) -> Node:
    """One tree on (bins, n, bad, margin): gradients of the logistic loss at ``margin``. A
    level is one job; its sums also give the values of the nodes below it."""
    root = Node()
    p = 1 / (1 + F.exp(-F.col("margin")))
    base = train.select("bins", (F.col("n") * p - F.col("bad")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
    level = [root]
    for _ in range(DEPTH):
        number = {id(x): i for i, x in enumerate(level)}

        def at(node: Node) -> Column:
            if node.left is None:
                return F.lit(number.get(id(node), -1))
            bin_ = F.get(F.col("bins"), F.lit(node.feature))
            return F.when(bin_ == MISSING, -1).when(bin_ <= node.bin, at(node.left)).otherwise(at(node.right))

        sums = base.select(at(root).alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin")).where("node >= 0")
        got: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        for r in sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            got.setdefault((r["node"], r["feature"]), {})[r["bin"]] = (r["g"], r["h"])
        following = []
        for i, node in enumerate(level):
            split(node, [got.get((i, f), {}) for f in range(len(NUMBERS))])
            following += [n for n in (node.left, node.right) if n]
        level = following
        if not level:
            break
    return root


def split(node: Node, cells: list[dict[int, tuple[float, float]]]) -> None:
    """The node's value, and its best split with the values of both sides, from the sums
    of gradients and curvatures by bin of each feature. Ties go to the first feature and
    the lowest bin."""
    g, h = math.fsum(x for x, _ in cells[0].values()), math.fsum(x for _, x in cells[0].values())
    node.value = leaf(g, h)
    best = (1e-6, -1, -1, 0.0, 0.0, 0.0, 0.0)
    for f, own in enumerate(cells):
        bins = sorted(b for b in own if b != MISSING)
        whole_g, whole_h = (math.fsum(own[b][i] for b in bins) for i in (0, 1))
        gl = hl = 0.0
        for b in bins[:-1]:
            gl, hl = gl + own[b][0], hl + own[b][1]
            gr, hr = whole_g - gl, whole_h - hl
            gain = round(gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - whole_g * whole_g / (whole_h + RIDGE), 9)
            if hl >= 1 and hr >= 1 and gain > best[0]:
                best = (gain, f, b, gl, hl, gr, hr)
    if best[1] >= 0:
        node.feature, node.bin, node.share = best[1], best[2], round(best[4] / (best[4] + best[6]), 9)
        node.left, node.right = Node(value=leaf(*best[3:5])), Node(value=leaf(*best[5:]))


def leaf(g: float, h: float) -> float:
    return round(-RATE * g / (h + RIDGE), 9)


def rated(told: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the share of blocked URLs of each row's ``column``, both labels weighing the
    same: of the other folds alone for a labelled row. Null for a value without any."""
    weight = F.col("weight")
    sums = told.where("said IS NOT NULL").groupBy(column, "fold").agg(F.sum(weight).alias("n"), F.sum(F.when(F.col("said") == "block", weight).otherwise(0.0)).alias("bad"))
    sums = checkpoint(sums)
    whole = sums.groupBy(column).agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    own = sums.select(column, "fold", F.col("n").alias("own_n"), F.col("bad").alias("own_bad"))
    met = told.join(small(checkpoint(whole)), column, "left").join(small(own), [column, "fold"], "left")
    labelled = F.col("said").isNotNull()
    n, bad = (F.coalesce(F.col("all_" + x), F.lit(0.0)) - F.when(labelled, F.coalesce("own_" + x, F.lit(0.0))).otherwise(0.0) for x in ("n", "bad"))
    # Rounded: sums of weights in another order differ in their last digits.
    return met.withColumn(name, F.when(n > 1e-9, F.round((bad + PRIOR / 2) / (n + PRIOR), 9))).drop("all_n", "all_bad", "own_n", "own_bad")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains where the path starts with the rule's;
    the longest wins. Other URLs get the trees' verdict: block at a score of 0.5 or
    more. A null URL, or one without ``://``, has an empty host and path and so no
    rule. Without a labelled URL every score is 0 (allow). Repeated rows are judged
    alike; extra columns are ignored; an empty table gives no rows.
    """
    told = features(pages.select("page_id", "url")).withColumn("ruled", decide(F.col("host"), F.col("path"), rules)).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    told = checkpoint(told.select("page_id", "host", "path", "suffix", "ending", "fold", "ruled.rule", "ruled.said", *[f for f in NUMBERS if f not in ("f_suffix", "f_ending")]))
    total = told.where("said IS NOT NULL").groupBy("said").agg(F.count("*").alias("n")).collect()
    if not total:
        return told.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("score"))
    weights = {r["said"]: sum(x["n"] for x in total) / (2 * r["n"]) for r in total}
    weight = F.when(F.col("said") == "block", weights.get("block", 1.0)).when(F.col("said") == "allow", weights.get("allow", 1.0))
    told = told.withColumn("weight", weight)
    for column, name in (("suffix", "f_suffix"), ("ending", "f_ending")):
        told = rated(told, column, name)
    known = told.where("said IS NOT NULL")
    steps = [i / BINS for i in range(1, BINS)]
    found = known.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in NUMBERS]).first()
    cuts = [sorted(set(found[f] or [])) for f in NUMBERS]
    told = told.withColumn("bins", binned(cuts))
    bad = F.sum(F.when(F.col("said") == "block", F.col("weight")).otherwise(0.0))
    train = told.where("said IS NOT NULL").groupBy("bins").agg(F.sum("weight").alias("n"), bad.alias("bad")).withColumn("margin", F.lit(0.0))
    margin = F.lit(0.0)
    for _ in range(TREES):
        train = checkpoint(train)  # with the margin so far: a level evaluates one tree
        tree = grow(train).expression(F.col("bins"))
        margin, train = margin + tree, train.withColumn("margin", F.col("margin") + tree)
    out = told.withColumn("score", 1 / (1 + F.exp(-margin)))
    said = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "score")
