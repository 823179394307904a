"""Pair files are read back whole: rows within a unit and across units."""

import datetime

import __spark_entry__ as entry


def test_positional_reader_counts_both_views(spark, tmp_path):
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    # Three internal people on one article: 1 and 4 share units 1 and 101, 2 has units 2 and 102.
    table([(1, "S1", 1), (2, "S2", 2), (4, "S4", 1)], "s_suppkey long, s_name string, s_nationkey int", "supplier")
    table([(7, 1), (7, 2), (7, 4)], "l_orderkey long, l_suppkey long", "lineitem")
    table([(7, datetime.date(1998, 1, 1), "1-URGENT")], "o_orderkey long, o_orderdate date, o_orderpriority string", "orders")
    got = {row.unit: row for row in entry.queries()["read_csv_positional"](spark, str(tmp_path)).collect()}
    assert {unit: (row.n_rows, row.n_articles, row.first_partner) for unit, row in got.items()} == {"1": (8, 8, "S1"), "2": (4, 4, "S1")}
