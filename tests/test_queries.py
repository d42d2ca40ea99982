"""Every query with an oracle equals it on the smallest tables."""

import duckdb
import pytest

from arcwell import queries
from arcwell.operators import codegraph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, table):
    return sorted((tuple(None if x is None or x != x else str(x)[:10] if "date" in type(x).__name__ and str(x).endswith("00:00:00") else str(x) for x in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, con, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    told = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows(columns, got.select(*columns).collect()) == rows(columns, told)


def test_profile_without_trade_has_its_types(spark, tmp_path):
    for t, key in (("lineitem", "l_orderkey bigint, l_suppkey bigint"), ("orders", "o_orderkey bigint, o_custkey bigint"), ("supplier", "s_suppkey bigint, s_nationkey int"), ("customer", "c_custkey bigint, c_nationkey int")):
        spark.createDataFrame([], key).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(1, "B"), (0, "A")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = queries.queries()["file_profile"](spark, str(tmp_path)).first()
    assert (got["callees"], got["callers"], got["symbols"]) == (None, None, "A,B")


def test_profile_lists_every_caller_and_type(spark, con, tmp_path):
    """Nation 0 buys from 24 others; there are 8 regions."""
    tables = {
        "lineitem": ("l_orderkey bigint, l_suppkey bigint", [(i % 2, i) for i in range(25)]), "orders": ("o_orderkey bigint, o_custkey bigint", [(0, 0), (1, 1)]),
        "supplier": ("s_suppkey bigint, s_nationkey int", [(i, i) for i in range(25)]), "customer": ("c_custkey bigint, c_nationkey int", [(0, 0), (1, 0)]),
        "region": ("r_regionkey int, r_name string", [(i, None if i == 8 else f"R{i}") for i in range(9)]),
    }
    for t, (columns, held) in tables.items():
        spark.createDataFrame(held, columns).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE OR REPLACE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    try:
        told = con.sql(f"SELECT callees, callers, symbols FROM ({queries.oracle_sql()['file_profile']})").fetchall()
    finally:
        for t in tables:
            con.sql(f"DROP VIEW temp.{t}")
    got = tuple(queries.queries()["file_profile"](spark, str(tmp_path)).select("callees", "callers", "symbols").first())
    assert [got] == told == [(None, ",".join(sorted(f"n{i}" for i in range(1, 25))), ",".join(f"R{i}" for i in range(8)))]


def test_profile_of_a_hub_is_whole(spark):
    """30 callees, each by two edges and one unsure besides, 40 callers, the file itself on both sides, 12 types."""
    edges = [("h", f"u{i}", c) for i in range(30) for c in ("resolved", "resolved")] + [("h", "maybe", "heuristic"), ("h", "h", "resolved"), ("x", "y", "resolved")]
    edges += [(f"c{i}", "h", "heuristic") for i in range(40)]
    d = codegraph.file_profile("h", spark.createDataFrame(edges, "from_file string, to_file string, confidence string"), spark.createDataFrame([("h", f"T{i}") for i in range(12)] + [("x", "Other")], "file string, name string"))
    want = [("callees", f"u{i}") for i in range(30)] + [("callees", "h"), ("callers", "h")] + [("callers", f"c{i}") for i in range(40)] + [("symbols", f"T{i}") for i in range(12)]
    assert sorted(map(tuple, d.select("part", "name").collect())) == sorted(want)


def test_risk_rules_equal_sql_beside_accents_and_odd_spaces(spark, con, tmp_path):
    texts = ["método", "todoé", "éé TODO", "paſſword = 'abcd'", "console.log(Kpf, toKen)", "catch (e) ", "catch (e)\u000b", "catch (e) {\u000b}", "allowedOrigins\r*", "credit card console.log(1)", "console.log(credit card)", "éMD5", "//   MD5", "eval(\u000bx)", "  // eval(x)", "\u000b// eval(x)", "api_Key logger.info(1)", "paſs dısable_ssl", "verify = Falſe", "DISABLE_ſSL"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    try:
        told = con.sql(f"SELECT rule, level, title, file, line_no FROM ({queries.oracle_sql()['risk_rules_docs']})").fetchall()
    finally:
        con.sql("DROP VIEW temp.documents")
    got = queries.queries()["risk_rules_docs"](spark, str(tmp_path)).select("rule", "level", "title", "file", "line_no").collect()
    assert rows([], got) == rows([], told)
