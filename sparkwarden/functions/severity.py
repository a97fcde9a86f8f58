"""Severity names, ranks and levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities from most to least severe; the rank is the distance from the end.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
_RANKS = {name: len(SEVERITIES) - 1 - place for place, name in enumerate(SEVERITIES)}


def _choose(value: Column, mapping: dict, default: Column | None = None) -> Column:
    out = None
    for key, result in mapping.items():
        out = (F if out is None else out).when(value == key, F.lit(result))
    return out if default is None else out.otherwise(default)


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 0 for info; null for anything else."""
    return _choose(severity, _RANKS)


def parse_severity(text: Column) -> Column:
    """Canonical name, case-insensitive; ``none`` reads as info; null if unknown."""
    low = F.lower(text)
    return F.when(low.isin(SEVERITIES), low).when(low == "none", F.lit("info"))


def rank_of(text: str | None, default: str = "high") -> int:
    """Rank of a threshold argument; unknown text counts as ``default``."""
    name = (text or default).lower()
    name = "info" if name == "none" else name
    return _RANKS.get(name, _RANKS[default])


def cvss_severity(score: Column) -> Column:
    """Severity of a CVSS base score; a missing score counts as high."""
    return (
        F.when(score.isNull(), F.lit("high"))
        .when(score >= 9.0, F.lit("critical"))
        .when(score >= 7.0, F.lit("high"))
        .when(score >= 4.0, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def severity_level(severity: Column) -> Column:
    """SARIF level."""
    return (
        F.when(severity.isin("critical", "high"), F.lit("error"))
        .when(severity == "medium", F.lit("warning"))
        .otherwise(F.lit("note"))
    )
