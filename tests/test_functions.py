"""Scalar helpers against Python: UUIDs, JSON merge, text normalisation and formats."""

import json
import uuid

from pyspark.sql import functions as F

from parlance.functions import ids, jsonx, text


def test_uuid5_and_canonical(spark):
    vals = ["doc-1", "Thảo", "", "user_42", "6BA7B810-9DAD-11D1-80B4-00C04FD430C8",
            "{6ba7b810-9dad-11d1-80b4-00c04fd430c8}", "urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8", "nope"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for r in df.select("s", ids.uuid5_dns("s").alias("u5"), ids.canonical_uuid("s").alias("c")).collect():
        assert r.u5 == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.s))
        try:
            want = str(uuid.UUID(r.s))
        except ValueError:
            want = None
        assert r.c == want, r.s


def test_shallow_merge_is_dict_update(spark):
    pairs = [('{"a": 1, "b": {"x": [1, 2]}, "c": "s"}', '{"b": 2, "d": null}'),
             (None, '{"a": 1}'), ('{"a": 1}', None), ('{"a": {"n": 1}}', '{"a": {"m": 2}}')]
    df = spark.createDataFrame(pairs, "l string, r string")
    for r in df.select("l", "r", jsonx.shallow_merge(F.col("l"), F.col("r")).alias("m")).collect():
        want = json.loads(r.l or "{}")
        want.update(json.loads(r.r or "{}"))
        assert json.loads(r.m) == want


def test_normalize_and_formats(spark):
    df = spark.createDataFrame([("  Áo_Thun \t\n",), (None,)], "s string")
    got = [r.n for r in df.select(text.normalize_name("s").alias("n")).collect()]
    assert got == ["áo thun", ""]
    r = spark.range(1).select(text.thousands(F.lit(1234567.5)).alias("a"), text.percent2(F.lit(0.1234)).alias("b"),
                              text.preview(F.lit("x" * 150), 100).alias("c"),
                              text.list_text(F.array().cast("array<string>")).alias("d"),
                              text.numbered_lines(F.array(F.lit("a"), F.lit("b"))).alias("e")).collect()[0]
    assert r.a == format(1234567.5, ",.0f") and r.b == format(0.1234, ".2%")
    assert r.c == "x" * 100 + "..." and r.d == "None" and r.e == "1. a\n2. b"


def test_formats_round_as_python_does(spark):
    values = [0.00125, 0.00135, 0.125, 0.5, 1.0, 12.3456, -0.00125, -0.5, 0.0, 0.015625, 0.046875, 1234.56789, 1e-9, 2.5, 3.5,
              1234567.5, 1234568.5, -2.5, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", text.percent2("x").alias("p"), text.thousands("x").alias("t")).collect():
        assert r.p == format(r.x, ".2%") and r.t == format(r.x, ",.0f"), r


def test_previews(spark):
    sizes = [0, 1, 99, 100, 101, 199, 200, 201, 1999, 2000, 2001]
    df = spark.createDataFrame([(n, "é" * n) for n in sizes] + [(0, None)], "n int, s string")
    for r in df.select("n", *[text.preview("s", k).alias(f"p{k}") for k in (100, 200, 2000)]).collect():
        whole = "é" * r.n
        assert r.p100 == whole[:100] + ("..." if r.n > 100 else "")
        assert r.p200 == whole[:200] + ("..." if r.n > 200 else "")
        assert r.p2000 == whole[:2000]


def test_lists_and_lines(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, []), (2, None), (3, ["", "x, y"])], "i int, l array<string>")
    got = {r.i: tuple(r)[1:] for r in df.select("i", text.list_text("l"), text.numbered_lines("l"), text.bulleted_lines("l")).collect()}
    assert got == {0: ("a, b", "1. a\n2. b", "- a\n- b"), 1: ("None", "(no trace)", ""), 2: ("None", "(no trace)", ""),
                   3: (", x, y", "1. \n2. x, y", "- \n- x, y")}
