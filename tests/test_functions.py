import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import text as tx
from sparkwarden.functions.arrays import count_at_most, running
from sparkwarden.functions.paths import extension, glob_to_regex, ignore_pattern_regex, language_of
from sparkwarden.functions.semver import semver_key, semver_satisfies, with_requirements
from sparkwarden.functions.severity import cvss_severity, parse_severity, rank_of, severity_level, severity_rank


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'array<int>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 1000])
def test_running_totals(spark, n):
    got = one(spark, running(F.col("v"), F.lit(0), lambda a, b: a + b), v=list(range(n)))
    assert got == [sum(range(i)) for i in range(n + 1)]


def test_sorted_lookup(spark):
    values = sorted([3, 3, 7, 20, 21, 90])
    for x in (0, 3, 8, 21, 89, 90, 100):
        assert one(spark, count_at_most(F.col("v"), F.lit(x)), v=values) == sum(v <= x for v in values)
    assert one(spark, count_at_most(F.col("v"), F.lit(4)), v=[]) == 0


@pytest.mark.parametrize("text", ["", "a" * 8, "0123456789abcdef" * 2, "žluťoučký kůň 🐎", "ab\x00\n\t"])
def test_entropy(spark, text):
    data = text.encode()
    want = -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0
    assert one(spark, tx.shannon_entropy(F.col("s")), s=text) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "a\r\nb\r\n", "\n", "a\rb", "a\r"])
def test_lines(spark, text):
    want = re.split(r"\r?\n", text)
    want = want[:-1] if want[-1] == "" else want
    assert one(spark, tx.lines(F.col("s")), s=text) == want
    assert one(spark, tx.line_count(F.col("s")), s=text) == len(want)


def test_spans_against_python(spark):
    text = "".join(f"x{i} = 'é{i}'\n" * (i % 3) + "token" * (i % 2) + " \x01 " for i in range(400))
    pattern = r"'[^']*'|token"
    got = one(spark, tx.regex_spans(F.col("s"), pattern), s=text)
    want = list(re.finditer(pattern, text))
    assert [(g.start, g.end, g.text) for g in got] == [(m.start(), m.end(), m.group()) for m in want]
    for g, m in zip(got, want):
        before, until = text[: m.start()], text[: m.end()]
        assert (g.start_line, g.start_col) == (before.count("\n") + 1, len(before) - before.rfind("\n"))
        assert (g.end_line, g.end_col) == (until.count("\n") + 1, len(until) - until.rfind("\n"))


def test_small_text_functions(spark):
    assert one(spark, tx.preview(F.col("s")), s="é" * 25) == "é" * 25
    assert one(spark, tx.preview(F.col("s")), s="é" * 51) == "é" * 50 + "…"
    assert one(spark, tx.count_literal(F.col("s"), F.lit("aa")), s="aaaaa") == 2
    assert one(spark, tx.count_literal(F.col("s"), F.lit("")), s="aaa") == 0
    assert one(spark, tx.occurs_twice(F.col("s"), F.lit("aa")), s="aaa") is False
    assert one(spark, tx.occurs_twice(F.col("s"), F.lit("aa")), s="aaaa") is True
    assert one(spark, tx.ascii_lower(F.col("s")), s="ÉA") == "Éa"
    assert one(spark, tx.ascii_ws_ratio(F.col("s")), s="a b\n") == 0.5
    assert one(spark, tx.ascii_ws_ratio(F.col("s")), s="") == 0.0
    ranges = F.expr("array(struct(10 AS start, 20 AS end), struct(30 AS start, 35 AS end))")
    assert [one(spark, tx.in_ranges(F.col("n"), ranges), n=n) for n in (10, 19, 34, 20, 25)] == [True, True, True, False, False]
    for x, want in ((0.05, 0.0), (0.2, 0.5), (0.9, 1.0)):
        assert one(spark, tx.ramp(F.lit(x), 0.1, 0.3), n=1) == pytest.approx(want)


def test_severities(spark):
    names = ["info", "low", "medium", "high", "critical"]
    assert [one(spark, severity_rank(F.col("s")), s=n) for n in names] == [0, 1, 2, 3, 4]
    assert one(spark, parse_severity(F.col("s")), s="HiGh") == "high"
    assert one(spark, parse_severity(F.col("s")), s="None") == "info"
    assert one(spark, parse_severity(F.col("s")), s="what") is None
    assert [rank_of(x) for x in ("CRITICAL", "none", "what", None)] == [4, 0, 3, 3]
    assert [one(spark, cvss_severity(F.lit(x).cast("double")), n=1) for x in (9.0, 7.0, 4.0, 3.9, None)] == ["critical", "high", "medium", "low", "high"]
    assert [one(spark, severity_level(F.col("s")), s=n) for n in names] == ["note", "note", "warning", "error", "error"]


@pytest.mark.parametrize(
    "path,ext,language",
    [("a/b.rs", "rs", "rust"), (".bashrc", "", "unknown"), ("x/.a.py", "py", "python"), ("a.b.TSX", "TSX", "typescript"),
     ("noext", "", "unknown"), ("a.d/file", "", "unknown"), ("m.mjs", "mjs", "javascript"), ("g.go", "go", "go"), ("t.pyi", "pyi", "python")],
)
def test_paths(spark, path, ext, language):
    assert one(spark, extension(F.col("s")), s=path) == ext
    assert one(spark, language_of(F.col("s")), s=path) == language


@pytest.mark.parametrize(
    "glob,path,hit",
    [("*.rs", "a/b.rs", True), ("src/*", "src/a/b", True), ("**/t.py", "t.py", True), ("**/t.py", "a/b/t.py", True), ("a/**", "a/b/c", True),
     ("a?c", "abc", True), ("[!a]b", "ab", False), ("[!a]b", "cb", True), ("[]]x", "]x", True), ("a.b", "axb", False), ("a(b)", "a(b)", True)],
)
def test_globs(glob, path, hit):
    assert bool(re.match(glob_to_regex(glob).replace("(?s:.", "(?s:."), path)) is hit


def test_invalid_globs():
    assert glob_to_regex("a[") is None and glob_to_regex("a**b") is None and glob_to_regex("***") is None


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("*.py", "a/b.py", True), ("/a.py", "b/a.py", False), ("/a.py", "a.py", True), ("doc/*.txt", "doc/a.txt", True), ("doc/*.txt", "x/doc/a.txt", False),
     ("doc/*.txt", "doc/s/a.txt", False), ("**/x", "a/b/x", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**", "a/b/c", True), ("a/**", "a", False),
     ("b?r", "bar", True), ("[!a]x", "bx", True), ("target/", "x/target", True), ("a+b", "a+b", True), ("\\#x", "#x", True)],
)
def test_ignore_patterns(spark, pattern, path, hit):
    rows = spark.createDataFrame([(pattern, path)], "p string, s string")
    assert rows.select(F.rlike("s", ignore_pattern_regex(F.col("p"))).alias("x")).collect()[0].x is hit


def test_version_order(spark):
    ordered = ["0.0.1", "0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r.v for r in df.orderBy(semver_key(F.col("v"))).collect()] == ordered
    assert one(spark, semver_key(F.col("s")), s="not a version") is None


@pytest.mark.parametrize(
    "version,requirement,met",
    [("1.2.3", ">=1.2.3", True), ("1.2.2", ">=1.2.3", False), ("1.10.0", ">1.9.9", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True),
     ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.0.0-alpha", "<1.0.0", True),
     ("1.0.0-alpha", ">=1.0.0", False), ("1.5.0", ">=1.2.0, <2", True), ("2.0.0", ">=1.2.0, <2", False), ("1.9.0", "1.2.0", True), ("1.2.9", "1.2.*", True),
     ("1.3.0", "1.2.*", False), ("3.1.4", "*", True), ("1.3.0", ">1.2", True), ("1.2.9", ">1.2", False), ("1.2.9", "<=1.2", True), ("x", "*", None)],
)
def test_requirements(spark, version, requirement, met):
    rows = spark.createDataFrame([(version, requirement)], "v string, r string")
    assert rows.select(semver_satisfies(F.col("v"), F.col("r")).alias("x")).collect()[0].x is met


def test_requirements_of_a_table(spark):
    wanted = {"a": ">=1.2.0, <2", "b": "^0.2.3", "c": "no requirement"}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["1.2.0", "0.2.9", "2.0.0-rc.1", "x", None, "1.2.0"])], "i int, v string")
    out = with_requirements(rows, "v", wanted)
    assert out.columns == ["i", "v", "a", "b", "c"]
    each = rows.select("i", "v", *[semver_satisfies(F.col("v"), F.lit(r)).alias(n) for n, r in wanted.items()])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, each.collect()))
    # A version is read once, and requirements below their own side of the join.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(v#") == 1 and plan.count("Range (") == 1
    assert each._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(v#") > 1
