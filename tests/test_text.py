"""Text rules, scoring and query expansion on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from phrasewell.functions import scoring as S
from phrasewell.functions import text as X
from phrasewell.operators import lcep
from phrasewell.operators.search import candidates, compounds, expand, stems


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_identifiers(spark):
    texts = ["", "fünf Öfen", "?.,~`", "KilnDriver sets targetHeat", "is it hot", "_ash ___ x_1", "7kilns 2go", "ash kiln " * 250]
    got = column(spark, texts, "string", X.identifiers)
    assert got[:7] == [[], ["fen"], [], ["KilnDriver", "sets", "targetHeat"], ["hot"], ["_ash", "___", "x_1"], ["kilns"]]
    assert len(got[7]) == 500
    assert [X.identifier_list(t) for t in texts] == got


def test_lines(spark):
    assert column(spark, ["", "a", "a\n", "a\n\n", "a\r\nb\r\n", "\n", "a\rb"], "string", X.lines) == [[], ["a"], ["a"], ["a", ""], ["a", "b"], [""], ["a\rb"]]


@pytest.mark.parametrize("line,zone", [
    ("while (kiln.hot) {", 0), ("heat += step;", 0), ("#ifdef KILN", 0), ("#!/bin/sh", 0), ("", 1), ("// fired twice", 1), ("# cooling plan", 1),
    ("* slip", 1), ("<!-- ash -->", 1), ("> said", 1), ("/* glaze */", 1), (" \t ", 1), ("7 + 8", 1), ("#!", 0), ("an old pot", 1), ("warm days pass slowly", 0), ("x=kiln(7);y[2]", 0),
])
def test_line_zone(spark, line, zone):
    assert column(spark, [line], "string", X.line_zone) == [zone]


def test_definitions(spark):
    lines = ["def fire(kiln):", "impl Kiln {", "let heap<Clay>", "fire(kiln)", "kiln.fire()", "ash + kiln - 2", "enum Glaze: Int {", "pot->next"]
    got = column(spark, lines, "string", X.definitions)
    assert "fire" in got[0] and "Kiln" in got[1] and "heap" in got[2] and "pot" in got[7] and "Glaze" in got[6]
    assert "kiln" not in got[3] and "fire" not in got[4] and got[5] == []


def test_pack_flags(spark):
    rows = [(d, z, c) for d in (-1, 0, 1, 2) for z in (0, 1) for c in (1, 30, 31, 500)]
    df = spark.createDataFrame(rows, "d int, z int, c long").withColumn("f", X.pack_flags(F.col("d"), F.col("z"), F.col("c"))).select("d", "z", "c", "f", X.unpack_flags(F.col("f")).alias("u"))
    for r in df.collect():
        assert (r.u.is_def, r.u.zone, r.u["count"]) == (r.d, r.z, min(r.c, 31)) and 0 <= r.f < 256


def test_extension_and_module(spark):
    assert column(spark, ["a/b.ts", "Makefile", "x.longextension", "LICENSE.md"], "string", X.extension) == ["ts", None, None, "md"]
    assert column(spark, ["a/b/c.ts", "c.ts"], "string", X.module) == ["a/b", ""]


def test_body_cut(spark):
    got = column(spark, ["x" * 10, "x" * 60_000], "string", X.cut_body)
    assert got[0] == "x" * 10 and got[1].startswith("x" * 51_200 + "\n")


def test_idf(spark):
    rows = [(100.0, 100.0, 0.004963), (100.0, 1.0, 4.209655), (100.0, 0.0, 5.308268), (0.0, 1.0, -0.405465)]
    df = spark.createDataFrame(rows, "n double, d double, e double")
    for r in df.select(S.bm25_idf(F.col("n"), F.col("d")).alias("g"), "e").collect():
        assert r.g == pytest.approx(r.e, abs=1e-6)


def test_score(spark):
    rows = [(2.0, 0.0, 50.0, 100.0, 0.0), (2.0, 1.0, 50.0, 100.0, 2.113331), (2.0, 100.0, 50.0, 100.0, 3.784916), (2.0, 1.0, 10.0, 100.0, 2.815728), (2.0, 1.0, 1000.0, 100.0, 0.305194)]
    df = spark.createDataFrame(rows, "i double, t double, l double, a double, e double")
    got = df.select(S.bm25_score(F.col("i"), F.col("t"), F.col("l"), F.col("a")).alias("g"), "e").collect()
    for r in got[:4]:
        assert r.g == pytest.approx(r.e, abs=1e-5)
    zero = spark.createDataFrame([(2.0, 1.0, 50.0, 0.0)], "i double, t double, l double, a double").select(S.bm25_score(F.col("i"), F.col("t"), F.col("l"), F.col("a"))).first()[0]
    assert math.isfinite(zero)


def test_path_role(spark):
    paths = ["src/a.ts", "x/src/a.ts", "tests/a.ts", "spec/a.rb", "a/vendor/b.go", "deps/a.go", "scripts/a.sh", "README.md", "lib/a.ts"]
    assert column(spark, paths, "string", S.path_role) == [2.0, 2.0, 0.6, 0.6, 0.3, 0.3, 0.6, 0.25, 1.0]


def test_filename_coverage(spark):
    assert column(spark, ["src/kiln_heat.ts", "a.ts"], "string", lambda p: S.filename_coverage(p, ["kiln", "glaze", "kiln-heat"])) == pytest.approx([1 + 2 / 3, 1.0])


def test_proximity(spark):
    assert column(spark, [[], [5], [5, 5], [5, 30], [1, 11]], "array<int>", S.proximity) == pytest.approx([1, 1, 1.55, 1, 1.05])


def test_proximity_bonus(spark):
    sets = [[], [[5]], [[5], [5]], [[5], [30]], [[1, 100], [99, 500]]]
    assert column(spark, sets, "array<array<int>>", S.proximity_bonus) == pytest.approx([0, 0, 0.55, 0, 0.5])
    assert column(spark, [[[5], [5]]], "array<array<int>>", lambda s: S.proximity_bonus(s, 0))[0] > 0


@pytest.mark.parametrize("df,h,kind", [(5, 0.5, 2), (5, 1.5, 1), (50, 3.0, 0), (50, 1.5, 1), (5, None, -1), (50, None, 0), (20, 0.5, 1), (19, 0.5, 2), (15, 0.99, 2), (15, 1.01, 1)])
def test_classify(spark, df, h, kind):
    row = spark.createDataFrame([(df, h)], "d int, h double").select(S.classify_definition(F.col("d"), F.col("h"))).first()
    assert row[0] == kind


def test_entropy(spark):
    samples = [("few", "a")] * 2 + [("one", "a")] * 10 + [("eight", str(i)) for i in range(8)] + [("mix", "a")] * 8 + [("mix", "b")] * 2
    df = spark.createDataFrame(samples, "phrase_lc string, word string")
    got = {r.phrase_lc: r.entropy for r in lcep.entropy(df).collect()}
    assert "few" not in got and got["one"] == pytest.approx(0, abs=1e-12) and got["eight"] == pytest.approx(3.0) and 0 < got["mix"] < 1


def test_expansion():
    assert stems("running") == ["runn"] and stems("items") == ["item"] and stems("created") == ["creat"] and stems("option") == ["op"]
    assert compounds("big_kiln_door") == ["big", "kiln", "door", "big_kiln", "kiln_door"] and compounds("plain") == []
    assert expand(["ClayPot"], lambda t: True) == ["ClayPot"]
    assert expand(["ClayPot"], lambda t: False) == ["ClayPot", "claypot"]
    assert expand(["a_bcd_efg"], lambda t: True) == ["a_bcd_efg"]
    assert candidates([]) == []
