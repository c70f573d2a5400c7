"""Patterns end where the text does, not before a line end that comes last."""

import json

from pyspark.sql import functions as F

from sahifa.functions import columns, spans, udfs

ENDS = ("\n", "\r", "\r\n", chr(0x85), chr(0x2028), chr(0x2029))


def test_snap_window_after_a_line_end(spark):
    udfs.register_all(spark)
    rows = [(f"ein. loweiwei{end}Licensed under the Apache", 13 + len(end), 23 + len(end)) for end in ENDS]
    found = spark.createDataFrame(rows, "t string, s int, e int").select(columns.snap_window(F.col("t"), F.col("s"), F.col("e")).alias("w"), F.expr("ar_snap_snippet_window_json(t, s, e)").alias("by_sql")).collect()
    want = [spans.snap_window(*row) for row in rows]
    assert want[0] == (14, 28)
    assert [tuple(r.w) for r in found] == want
    assert [tuple(json.loads(r.by_sql).values()) for r in found] == want


def test_terms_and_spans_with_a_line_end_last(spark):
    udfs.register_all(spark)
    rows = spark.createDataFrame([(f"theater{end}", f"كتابات{end}", f"1:2:3{end};4:5:6") for end in ENDS], "term string, word string, csv string")
    found = rows.select(columns.glob_match(F.col("term"), "t?e*er").alias("hit"), "word", columns.stem(F.col("word")).alias("stem"), F.expr("ar_stem(word)").alias("by_sql"), F.expr("ar_select_non_overlapping_spans_csv(csv)").alias("csv")).collect()
    assert all(not r.hit and r.stem == r.word == r.by_sql and r.csv == "4:5" for r in found)
