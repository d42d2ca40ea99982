"""Positions and predecessors over several ranges against sorting."""

import random

from pyspark.sql import functions as F

from arcwell.operators import ordered


def test_ranges_equal_sorting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, k int, v string").repartition(7)
    places = {r["id"]: r["position"] for r in ordered.with_position(d, [F.desc("k"), F.col("id").asc()]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert places == {r[0]: i + 1 for i, r in enumerate(want)}
    before = {r["id"]: r["was"] for r in ordered.with_previous(d, ["k", "id"], "v", "was").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert before == {r[0]: (want[i - 1][2] if i else None) for i, r in enumerate(want)}
    none = d.where("false")
    assert ordered.with_position(none, [F.col("id").asc()]).count() == 0 and ordered.with_previous(none, ["id"], "v", "was").count() == 0
