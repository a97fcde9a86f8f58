"""Semantic versions as sortable keys, and requirement tests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.arrays import let

_VERSION = r"^\s*v?(\d+)(?:\.(\d+|[*xX]))?(?:\.(\d+|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
_COMPARATOR = r"^\s*(>=|<=|>|<|=|\^|~)?\s*(.*?)\s*$"


def _parts(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a whole-text match as an array; one element if there is no match."""
    joined = "|".join(f"${n + 1}" for n in range(groups))
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(joined)), r"\|", -1)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def _key(p: Column) -> Column:
    identifiers = F.transform(
        F.filter(F.split(p[3], r"\."), lambda x: x != ""),
        lambda x: let(
            F.rlike(x, F.lit(r"^\d+$")),
            lambda numeric: F.struct(
                F.when(numeric, F.lit(0)).otherwise(F.lit(1)).alias("word"),
                F.when(numeric, _number(x)).otherwise(F.lit(0).cast("long")).alias("number"),
                F.when(numeric, F.lit("")).otherwise(x).alias("text"),
            ),
        ),
    )
    return F.struct(
        F.array(_number(p[0]), _number(p[1]), _number(p[2])).alias("core"),
        (p[3] == "").alias("release"),
        identifiers.alias("pre"),
    )


def semver_key(version: Column) -> Column:
    """``struct<core, release, pre>`` that sorts by version order; null if the text is not a version.

    A pre-release sorts before its release. Its identifiers compare one by one: numbers by value and
    before words, and a shorter list before a longer one.
    """
    return let(_parts(version, _VERSION, 4), lambda p: F.when(F.size(p) == 4, _key(p)))


_KEY = "struct<core:array<bigint>,release:boolean,pre:array<struct<word:int,number:bigint,text:string>>>"


def _release(*core: Column) -> Column:
    # The lowest key of that core version: also its pre-releases are at or above it.
    return F.struct(F.array(*core).alias("core"), F.lit(False).alias("release"),
                    F.expr("cast(array() as array<struct<word:int,number:bigint,text:string>>)").alias("pre"))


def _range(op: Column, p: Column, key: Column) -> Column:
    """Bounds of one comparator on a (possibly partial) version."""
    major, minor, patch = key["core"][0], key["core"][1], key["core"][2]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(_KEY)
    no_minor, no_patch = ~F.rlike(p[1], F.lit(r"^\d+$")), ~F.rlike(p[2], F.lit(r"^\d+$"))
    wild = F.rlike(F.concat(p[1], p[2]), F.lit("[*xX]"))
    caret = (op == "^") | ((op == "") & ~wild)
    exact = ~no_minor & ~no_patch
    # First version above everything the text stands for: which core number goes up.
    up_major = no_minor | (caret & (major > 0))
    up_minor = no_patch | (op == "~") | (caret & (minor > 0))
    above = _release(
        F.when(up_major, major + 1).otherwise(major),
        F.when(up_major, zero).when(up_minor, minor + 1).otherwise(minor),
        F.when(up_major | up_minor, zero).otherwise(patch + 1),
    )
    at_text = exact & op.isin("=", "<=")
    return F.struct(
        F.when(op.isin("<", "<="), none).when((op == ">") & ~exact, above).otherwise(key).alias("lo"),
        ((op == ">") & exact).alias("lo_open"),
        F.when(op.isin(">", ">="), none).when((op == "<") | at_text, key).otherwise(above).alias("hi"),
        (~at_text).alias("hi_open"),
    )


def _comparator(text: Column) -> Column:
    """One comparator as ``struct<lo, lo_open, hi, hi_open>``, open ends as null; null if it cannot be read."""
    none = F.lit(None).cast(_KEY)
    unbounded = F.struct(
        none.alias("lo"), F.lit(False).alias("lo_open"), none.alias("hi"), F.lit(False).alias("hi_open")
    )

    def read(c: Column) -> Column:
        bounded = let(
            _parts(c[1], _VERSION, 4),
            lambda p: F.when(F.size(p) == 4, let(_key(p), lambda key: _range(c[0], p, key))),
        )
        return F.when(c[1].isin("", "*", "x", "X"), unbounded).otherwise(bounded)

    return let(_parts(text, _COMPARATOR, 2), read)


def requirement_ranges(requirement: Column) -> Column:
    """A requirement such as ``>=1.2.0, <2`` as the array of its version ranges, all of which must hold."""
    return F.transform(F.split(requirement, ","), _comparator)


def key_in_ranges(key: Column, ranges: Column) -> Column:
    """True if the version key lies in every range."""
    return F.forall(
        ranges,
        lambda r: F.coalesce(
            F.coalesce(F.when(r["lo_open"], key > r["lo"]).otherwise(key >= r["lo"]), r["lo"].isNull())
            & F.coalesce(F.when(r["hi_open"], key < r["hi"]).otherwise(key <= r["hi"]), r["hi"].isNull()),
            F.lit(False),
        ),
    )


def semver_satisfies(version: Column, requirement: Column) -> Column:
    """True if the version meets the requirement; null if the version is not a semantic version."""
    return let(
        semver_key(version),
        lambda key: F.when(key.isNotNull(), key_in_ranges(key, requirement_ranges(requirement))),
    )


def with_requirements(rows: DataFrame, version: str, requirements: Mapping[str, str]) -> DataFrame:
    """``rows`` with a column for each of the named requirements: what ``semver_satisfies`` says of the column ``version``.

    Each version is read once for all requirements, and each requirement once for all rows: their ranges are one row that
    meets the others. A column of ``rows`` with the name of a requirement is replaced.
    """
    rows = rows.drop(*requirements)
    ranges = [requirement_ranges(F.lit(text)).alias(f"_range_{i}") for i, text in enumerate(requirements.values())]
    keyed = rows.withColumn("_key", semver_key(F.col(version))).crossJoin(rows.sparkSession.range(1).select(*ranges))
    tests = [
        F.when(F.col("_key").isNotNull(), key_in_ranges(F.col("_key"), F.col(f"_range_{i}"))).alias(name)
        for i, name in enumerate(requirements)
    ]
    return keyed.select(*rows.columns, *tests)
