"""Packages against advisories: version ranges, exact versions, freshness and lookup batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwarden.functions.semver import key_in_ranges, requirement_ranges, semver_key
from sparkwarden.functions.severity import cvss_severity, severity_rank
from sparkwarden.schemas import FIX
from sparkwarden.session import spread, stored

VERIFIER = "cve"
DESCRIPTION = "Known vulnerabilities in locked dependencies"
LANGUAGES = ["rust", "typescript", "javascript", "python", "go"]

# What is said of a package goes by these columns.
KEYS = ["ecosystem", "name", "version"]
# Findings stand at this line of the lockfile.
FINDING_LINE = 1
# Lookup services are asked about this many packages at once.
BATCH_SIZE = 500
# Answers older than this are asked for again.
TTL_HOURS = 24


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 1) -> DataFrame:
    """Inner join in which a key held by a large share of ``left`` is worked on by ``salts`` tasks.

    Without salts Spark joins as it likes, and adaptive execution splits skewed partitions. With them ``right`` is
    repeated per salt, so use it where that side is much smaller. The salt comes from the
    row itself: a recomputed task gives the same rows. If ``right`` is small enough for Spark's own
    size-checked broadcast, nothing is shuffled at all.
    """
    if salts <= 1:
        return left.join(right, keys)
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c not in keys]), F.lit(salts)).cast("int")
    wide = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(wide, [*keys, "_salt"]).drop("_salt")


def vulnerable_versions(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Distinct locked versions that an advisory applies to.

    A version is vulnerable if it meets no patched and no unaffected requirement. Versions are made
    distinct first: the same few versions recur in very many repositories, and version tests are the
    costly part. Versions that are not semantic versions are never vulnerable.
    """
    versions = (
        packages.select("ecosystem", "name", "version")
        .distinct()
        .withColumn("key", semver_key(F.col("version")))
        .where(F.col("key").isNotNull())
    )
    # A small table comes in one or two tasks, which would read all requirements, test all versions and make all findings.
    advisories = advisories.repartition(spread(advisories.sparkSession), "ecosystem", "package", "advisory_id")
    ranges = advisories.withColumn(
        "safe",
        F.transform(
            F.concat(
                F.coalesce("patched", F.expr("cast(array() as array<string>)")),
                F.coalesce("unaffected", F.expr("cast(array() as array<string>)")),
            ),
            requirement_ranges,
        ),
    ).withColumnRenamed("package", "name")
    joined = versions.join(ranges, ["ecosystem", "name"])
    return joined.where(~F.exists("safe", lambda r: key_in_ranges(F.col("key"), r))).drop("key", "safe")


def fix_hint(patched: Column) -> Column:
    listed = F.array_join(F.coalesce(patched, F.expr("cast(array() as array<string>)")), ", ")
    return F.when(listed == "", F.lit("(no patched version available)")).otherwise(
        F.concat(F.lit("(fixed in: "), listed, F.lit(")"))
    )


def findings_of(
    packages: DataFrame, said: DataFrame, salts: int = 1, also: Mapping[str, Column] | None = None, counted: bool = False
) -> DataFrame:
    """Findings of packages, which take over their ``provenance_score``, given what is said of each ``ecosystem, name, version``.

    A finding's text follows from the version and what is said of it: it is made before the join with the packages, which
    only copies it, as each version recurs in very many repositories. So are the columns of ``also``, made of
    ``verifier_id, rule_id, severity, message, metadata``. ``counted``: see ``findings.in_counts``. Texts of one version and
    severity are counted before they meet the packages, so that the join does not grow with their number.
    """
    said = said.withColumn("verifier_id", F.lit(VERIFIER))
    if counted:
        said = said.groupBy(*KEYS, "verifier_id", "severity").agg(F.count(F.lit(1)).alias("number"))
    else:
        said = said.withColumns(dict(also or {}))
    said = said.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in said.columns if c not in KEYS])
    hits = spread_join(packages, said, KEYS, salts)
    if counted:
        place = F.struct(F.col("lockfile_path").alias("path"))
        return hits.select("repo", *[F.col(f"_{c}").alias(c) for c in ("verifier_id", "severity")], place.alias("location"), F.col("_number").alias("number"))
    one = F.lit(FINDING_LINE)
    score = F.col("provenance_score") if "provenance_score" in hits.columns else F.lit(None)
    return hits.select(
        "repo",
        *[F.col(f"_{c}").alias(c) for c in ("verifier_id", "rule_id", "severity", "message")],
        F.struct(
            F.col("lockfile_path").alias("path"), one.alias("start_line"), one.alias("start_col"),
            one.alias("end_line"), one.alias("end_col"), F.col("_snippet").alias("snippet"),
        ).alias("location"),
        F.lit(None).cast(FIX).alias("fix"),
        score.cast("double").alias("provenance_score"),
        F.col("_metadata").alias("metadata"),
        *[F.col(f"_{c}").alias(c) for c in also or {}],
        *[c for c in ("first",) if c in hits.columns],
    )


def _in_order(*more: str) -> Column:
    """Order of what is said of one package, as ``findings.order_key`` has it: most severe first."""
    return F.struct((-severity_rank(F.col("severity"))).alias("by_severity"), *more)


def _said(said: DataFrame, *columns: str) -> DataFrame:
    """``said`` with these columns of its own; the others are null."""
    kinds = {"rule_id": "string", "severity": "string", "message": "string", "snippet": "string", "metadata": "map<string,string>"}
    return said.select(*KEYS, *[(F.col(c) if c in columns else F.lit(None).cast(kind).alias(c)) for c, kind in kinds.items()])


def first_findings(packages: DataFrame, said: DataFrame) -> DataFrame:
    """The first finding of each package in its repository's report, as far as the report's order reads it."""
    least = said.groupBy(*KEYS).agg(F.min(_in_order("rule_id", "severity")).alias("_first"))
    return findings_of(packages, _said(least.select(*KEYS, "_first.rule_id", "_first.severity"), "rule_id", "severity"))


def described_findings(packages: DataFrame, said: DataFrame) -> DataFrame:
    """The first finding of each package and rule, for ``findings.rule_descriptors``, with ``alone``.

    Most rules are about one package, and most lockfiles hold one version of it: then no other finding of the repository has
    the rule, and the findings need not be brought together by it. Both is known before packages meet what is said of them.
    """
    first = said.groupBy(*KEYS, "rule_id").agg(F.min(_in_order("message", "severity")).alias("_first"))
    about, by_rule = F.struct("ecosystem", "name"), Window.partitionBy("rule_id")
    one_package = F.min(about).over(by_rule) == F.max(about).over(by_rule)
    first = stored(first.select(*KEYS, "rule_id", "_first.severity", "_first.message", one_package.alias("_one_package")))
    held = packages.select("repo", "lockfile_path", *KEYS, *[c for c in ("provenance_score",) if c in packages.columns]).distinct()
    versions = F.count(F.lit(1)).over(Window.partitionBy("repo", "ecosystem", "name"))
    held = stored(held.withColumn("_one_version", versions == 1))

    def made(packages: DataFrame, said: DataFrame, alone: bool) -> DataFrame:
        rows = findings_of(packages.drop("_one_version"), _said(said, "rule_id", "severity", "message"))
        return rows.withColumn("alone", F.lit(alone))

    single, one = held.where("_one_version"), first.where("_one_package")
    return (
        made(single, one, True)
        .unionByName(made(single, first.where("NOT _one_package"), False))
        .unionByName(made(held.where("NOT _one_version"), first, False))
    )


def advisory_texts(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """What version-range advisories say of the locked versions: one row for each version and advisory that applies to it."""
    name, version = F.col("name"), F.col("version")
    patched = F.array_join(F.coalesce("patched", F.expr("cast(array() as array<string>)")), ", ")
    metadata = F.create_map(
        F.lit("advisory_id"), F.col("advisory_id"), F.lit("package"), name, F.lit("version"), version,
        F.lit("patched_versions"), patched, F.lit("url"), F.col("url"),
    )
    return vulnerable_versions(packages, advisories).select(
        *KEYS,
        F.concat(F.lit("cve."), F.lower("ecosystem"), F.lit("."), F.col("advisory_id")).alias("rule_id"),
        cvss_severity(F.col("cvss")).alias("severity"),
        F.concat(name, F.lit(" "), version, F.lit(": "), F.col("title"), F.lit(" "), fix_hint(F.col("patched"))).alias("message"),
        F.concat(name, F.lit(' = "'), version, F.lit('"')).alias("snippet"),
        metadata.alias("metadata"),
    )


def advisory_findings(
    packages: DataFrame, advisories: DataFrame, salts: int = 1, also: Mapping[str, Column] | None = None, counted: bool = False
) -> DataFrame:
    """Findings from version-range advisories; see ``findings_of``."""
    return findings_of(packages, advisory_texts(packages, advisories), salts, also, counted)


def latest_answers(answers: DataFrame, as_of: Column | None = None, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """``ecosystem, name, version, vuln_id`` of the last answer for each package, each vulnerability once.

    Rows of one package with one ``fetched_at`` are one answer, undated ones count if no dated one is there; a null ``vuln_id`` says that there is nothing. With
    ``as_of``, answers that are later than that or no longer fresh don't count.
    """
    keys = ["ecosystem", "name", "version"]
    if as_of is not None:
        answers = fresh(answers, as_of, ttl_hours).where(F.col("fetched_at") <= as_of)
    last = answers.groupBy(*keys, "fetched_at").agg(F.collect_set("vuln_id").alias("ids"))
    earliest = F.expr("timestamp'0001-01-01 00:00:00'").cast(answers.schema["fetched_at"].dataType)
    last = last.groupBy(*keys).agg(F.max_by("ids", F.coalesce("fetched_at", earliest)).alias("ids"))
    return last.select(*keys, F.explode("ids").alias("vuln_id"))


def exact_texts(answers: DataFrame, as_of: Column | None = None, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """What the last answer says of each exact version: one row for each vulnerability; severity is always high."""
    name, version = F.col("name"), F.col("version")
    metadata = F.create_map(
        F.lit("advisory_id"), F.col("vuln_id"), F.lit("package"), name, F.lit("version"), version,
        F.lit("ecosystem"), F.col("ecosystem"), F.lit("source"), F.lit("osv.dev"),
    )
    return latest_answers(answers, as_of, ttl_hours).select(
        *KEYS,
        F.concat(F.lit("cve."), F.lower("ecosystem"), F.lit("."), F.col("vuln_id")).alias("rule_id"),
        F.lit("high").alias("severity"),
        F.concat(name, F.lit(" "), version, F.lit(": see "), F.col("vuln_id")).alias("message"),
        F.concat(name, F.lit(" "), version).alias("snippet"),
        metadata.alias("metadata"),
    )


def exact_findings(
    packages: DataFrame, answers: DataFrame, salts: int = 1, as_of: Column | None = None, ttl_hours: int = TTL_HOURS,
    also: Mapping[str, Column] | None = None, counted: bool = False,
) -> DataFrame:
    """Findings from the last answer for each exact version; see ``findings_of``."""
    return findings_of(packages, exact_texts(answers, as_of, ttl_hours), salts, also, counted)


def fresh(rows: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Rows fetched within the time to live; exactly at the limit still counts as fresh."""
    return rows.where(F.col("fetched_at") >= as_of - F.expr(f"interval {int(ttl_hours)} hours"))


def to_refresh(packages: DataFrame, answers: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Distinct packages without a fresh answer; an answer that names no vulnerability is one too."""
    keys = ["ecosystem", "name", "version"]
    return packages.select(*keys).distinct().join(fresh(answers, as_of, ttl_hours).select(*keys), keys, "left_anti")


def lookup_batches(packages: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Numbered batches of at most ``size`` distinct packages per ecosystem, in order of a content hash.

    The running number is exact without one task per ecosystem: rows are counted and numbered within
    4096 even hash buckets, and the bucket totals give each bucket its first number.
    """
    keyed = (
        packages.select("ecosystem", "name", "version")
        .distinct()
        .withColumn("h", F.md5(F.concat_ws("@", "name", "version").cast("binary")))
        .withColumn("bucket", F.substring("h", 1, 3))
    )
    before = Window.partitionBy("ecosystem").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        keyed.groupBy("ecosystem", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("ecosystem", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    )
    place = F.row_number().over(Window.partitionBy("ecosystem", "bucket").orderBy("h"))
    return (
        keyed.withColumn("place", place)
        .join(first, ["ecosystem", "bucket"])
        .select(
            "ecosystem",
            F.floor((F.col("skipped") + F.col("place") - 1) / size).cast("long").alias("batch"),
            "name",
            "version",
        )
    )


def batch_requests(batches: DataFrame) -> DataFrame:
    """One row per batch with its queries as JSON text; a batch is bounded by its size."""
    query = F.struct(F.struct("name", "ecosystem").alias("package"), F.col("version").alias("version"))
    return batches.groupBy("ecosystem", "batch").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(query)).alias("queries"))).alias("body"),
        F.count(F.lit(1)).alias("n"),
    )
