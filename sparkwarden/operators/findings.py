"""The findings table: merging, scores, order, counts and gates."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NullType, StructType

from sparkwarden.functions.severity import SEVERITIES, rank_of, severity_level, severity_rank
from sparkwarden.schemas import FINDINGS

# A file counts as likely machine-written from this score on.
AI_LIKELY = 0.5

Verifier = Callable[[], DataFrame]


@dataclass(frozen=True)
class UserVerifier:
    """A verifier from outside: ``find`` gets the candidates (repo, path, language, content) and gives findings.

    Of the findings schema ``repo, rule_id, severity`` and either ``location`` or ``path`` are needed; what else is missing is null. A
    rule id is the verifier's own id or begins with it and a dot.
    """

    verifier_id: str
    description: str
    find: Callable[[DataFrame], DataFrame]
    #: None: all languages.
    languages: Sequence[str] | None = None


WEEK = 7 * 24 * 3600

def choose_verifiers(
    available: Mapping[str, bool], explicit: Sequence[str] | None = None, skip: Sequence[str] = ()
) -> list[str]:
    """Verifier ids to run. A skipped one never runs; an explicit list replaces the default toggles."""
    return [
        name
        for name, enabled in available.items()
        if name not in skip and (name in explicit if explicit is not None else enabled)
    ]


def for_languages(files: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Files a verifier gets to see."""
    return files.where(F.col("language").isin(list(languages)))


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of verifier outputs."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_verifiers(verifiers: Mapping[str, Verifier], chosen: Sequence[str]) -> list[DataFrame]:
    """Outputs of the chosen verifiers. One that cannot be set up gives a warning and no rows."""
    out = []
    for name in chosen:
        try:
            out.append(verifiers[name]())
        except (PySparkException, ValueError) as error:
            warnings.warn(f"verifier {name} failed: {error}", stacklevel=2)
    return out


def checked_findings(rows: DataFrame, verifier_id: str) -> DataFrame:
    """Rows of a user's verifier in the findings schema; ValueError says what does not fit.

    Rows with an unknown severity or a rule id of another verifier fail the job when they are read.
    """
    wanted = {f.name: f.dataType for f in StructType.fromDDL(FINDINGS).fields}
    place = ("path", "start_line", "start_col", "end_line", "end_col", "snippet")
    have = {f.name: f.dataType for f in rows.schema.fields}
    missing = [c for c in ("repo", "rule_id", "severity") if c not in have] + ([] if {"location", "path"} & set(have) else ["location"])
    unknown = [c for c in have if c not in wanted and c not in place]
    if missing or unknown:
        raise ValueError(f"verifier {verifier_id}: columns missing {missing}, unknown {unknown}")
    if "location" not in have:
        kinds = {f.name: f.dataType for f in wanted["location"].fields}
        parts = [(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in place]
        rows = rows.withColumn("location", F.struct(*parts)).drop(*place)
        have = {f.name: f.dataType for f in rows.schema.fields}
    wrong = [c for c, t in have.items() if t.simpleString() != wanted[c].simpleString() and not isinstance(t, NullType) and c in ("location", "fix", "metadata", "repo", "rule_id", "severity")]
    if wrong:
        raise ValueError(f"verifier {verifier_id}: wrong types {wrong}")
    own = (F.col("rule_id") == verifier_id) | F.startswith("rule_id", F.lit(f"{verifier_id}."))
    fits = F.coalesce(own & F.col("severity").isin(SEVERITIES), F.lit(False))
    text = F.concat(F.lit(f"verifier {verifier_id}: not its own rule, or no severity: "), F.to_json(F.struct("rule_id", "severity")))
    rows = rows.withColumn("rule_id", F.when(fits, F.col("rule_id")).otherwise(F.raise_error(text).cast("string")))
    rows = rows.withColumn("verifier_id", F.lit(verifier_id))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def unreadable_files(files: DataFrame, verifier_id: str = "secrets") -> DataFrame:
    """Files a verifier had to skip, as an error table."""
    return files.where(F.col("content").isNull()).select(
        "repo", "path", F.lit(verifier_id).alias("verifier_id"), unread_reason(files).alias("reason")
    )


def unread_reason(files: DataFrame) -> Column:
    """Why a file has no content: what its reader says, or else that it is no text."""
    said = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    return F.coalesce(said, F.lit("not valid UTF-8"))


def attach_provenance(findings: DataFrame, scored: DataFrame, path: Column | None = None) -> DataFrame:
    """Fill missing scores from the file's score. ``path`` is the file's path where rows have no location."""
    scores = scored.select("repo", F.col("path").alias("_path"), F.col("score").alias("_score"))
    keyed = findings.withColumn("_path", F.col("location.path") if path is None else path)
    return (
        keyed.join(scores, ["repo", "_path"], "left")
        .withColumn("provenance_score", F.coalesce("provenance_score", "_score"))
        .select(*findings.columns)
    )


def order_key(ai_priority: bool = False) -> list[Column]:
    """Sort key in ascending form: score first if wanted, then severity, path and place."""
    first = [(-F.coalesce("provenance_score", F.lit(0.0))).alias("by_score")] if ai_priority else []
    return first + [
        (-severity_rank(F.col("severity"))).alias("by_severity"),
        F.col("location.path").alias("by_path"),
        F.col("location.start_line").alias("by_line"),
        F.col("location.start_col").alias("by_col"),
        F.col("rule_id").alias("by_rule"),
    ]


def place_key(ai_priority: bool = False) -> list[Column]:
    """``order_key`` with a score in any case: the place of a finding in the report of its repository."""
    return ([] if ai_priority else [F.lit(0.0).alias("by_score")]) + order_key(ai_priority)


def first_places(findings: DataFrame, ai_priority: bool = False) -> DataFrame:
    """``repo, first``: the ``place_key`` of the first finding in each repository's report."""
    return findings.groupBy("repo").agg(F.min(F.struct(*place_key(ai_priority))).alias("first"))


def sort_findings(findings: DataFrame, ai_priority: bool = False) -> DataFrame:
    """Repositories together, most severe findings first. The key goes on below the repository, so one with
    very many findings is still spread over several sort ranges."""
    return findings.orderBy("repo", *order_key(ai_priority))


def in_counts(findings: DataFrame) -> DataFrame:
    """What counts read of findings: ``repo, verifier_id, severity, location.path, number``.

    A row stands for ``number`` findings. The counts and the gate below take such rows as well as findings.
    """
    place = F.struct(F.col("location.path").alias("path")).alias("location")
    return findings.select("repo", "verifier_id", "severity", place, F.lit(1).cast("long").alias("number"))


def _number(findings: DataFrame, wanted: Column | None = None) -> Column:
    """How many findings, or of those wanted, the rows of a group stand for."""
    if "number" not in findings.columns:
        return F.count(F.lit(1)) if wanted is None else F.count_if(wanted)
    number = F.col("number") if wanted is None else F.when(wanted, F.col("number"))
    return F.coalesce(F.sum(number), F.lit(0).cast("long"))


def counts_by_severity(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Five counts per repository, zeros included. ``repos`` adds repositories without findings."""
    counts = findings.groupBy("repo").agg(
        *[_number(findings, F.col("severity") == name).alias(name) for name in SEVERITIES]
    )
    if repos is not None:
        counts = repos.select("repo").distinct().join(counts, "repo", "left")
    return counts.na.fill(0, SEVERITIES)


def gate(findings: DataFrame, fail_on: str | None = "high", repos: DataFrame | None = None) -> DataFrame:
    """``repo, worst, passed``: fails with any finding at or above the threshold."""
    worst = findings.groupBy("repo").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    if repos is not None:
        worst = repos.select("repo").distinct().join(worst, "repo", "left")
    return worst.select("repo", "worst", F.coalesce(F.col("worst") < rank_of(fail_on), F.lit(True)).alias("passed"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings at or above a severity."""
    return findings.where(severity_rank(F.col("severity")) >= rank_of(severity, "info"))


def ai_likely(score: Column) -> Column:
    return F.coalesce(F.round(score, 6) >= AI_LIKELY, F.lit(False))


def with_levels(findings: DataFrame) -> DataFrame:
    """Add the SARIF level and the likely-machine-written flag."""
    return findings.withColumns(
        {"level": severity_level(F.col("severity")), "ai_likely": ai_likely(F.col("provenance_score"))}
    )


def rule_descriptors(findings: DataFrame, verifiers: Mapping[str, str], ai_priority: bool = False) -> DataFrame:
    """Rules of each repository's report: ``repo, rule_id, short_text, full_text, place``.

    Verifiers come first; every other rule id is described by the message of its first finding in the report's order.
    Findings with a true ``alone`` are the only ones of their repository and rule: they need no grouping, nor a shuffle.
    """
    first = F.struct(F.struct(*place_key(ai_priority)).alias("place"), F.col("message").alias("message"))
    told = findings.where(~F.col("rule_id").isin(list(verifiers)))
    several = told if "alone" not in told.columns else told.where(~F.col("alone"))
    seen = several.groupBy("repo", "rule_id").agg(F.min(first).alias("first"))
    if "alone" in told.columns:
        seen = told.where(F.col("alone")).select("repo", "rule_id", first.alias("first")).unionByName(seen)
    return seen.select(
        "repo", "rule_id", F.col("rule_id").alias("short_text"), F.col("first.message").alias("full_text"), F.col("first.place").alias("place")
    )


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Scanned files per repository."""
    return candidates.groupBy("repo").agg(F.count(F.lit(1)).alias("candidates_scanned"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by repository, verifier and severity with subtotals. Findings are counted once; subtotals add up those counts."""
    counts = findings.groupBy("repo", "verifier_id", "severity").agg(_number(findings).alias("_n"))
    return counts.rollup("repo", "verifier_id", "severity").agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("n"))


def on_changed_lines(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings that start on a changed line, given ``hunks(repo, path, start_line, end_line)``, end exclusive."""
    f, h = findings.alias("f"), hunks.alias("h")
    inside = (
        (F.col("f.repo") == F.col("h.repo"))
        & (F.col("f.location.path") == F.col("h.path"))
        & (F.col("f.location.start_line") >= F.col("h.start_line"))
        & (F.col("f.location.start_line") < F.col("h.end_line"))
    )
    return f.join(h, inside, "left_semi")


def weekly_counts(findings: DataFrame, last: DataFrame) -> DataFrame:
    """Findings per repository and week of the last commit of their file: ``week, repo, n``.

    Findings are first counted per file, so the join and the final count see one row per file. Files without history
    have a null week.
    """
    per_file = findings.groupBy("repo", F.col("location.path").alias("path")).agg(_number(findings).alias("n"))
    dated = per_file.join(last.select("repo", "path", "author_ts"), ["repo", "path"], "left")
    # A window would drop the rows without time.
    week = F.timestamp_seconds(F.floor(F.unix_timestamp("author_ts") / WEEK) * WEEK)
    return dated.groupBy(week.alias("week"), "repo").agg(F.sum("n").alias("n")).select("week", "repo", "n")
