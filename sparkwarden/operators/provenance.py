"""Provenance score: eight weighted signals that a file is machine-written.

Five signals come from the text and three from the last commit that touched the file. Text signals are
row-wise; only their few numbers are joined with the commit side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwarden.functions.arrays import let
from sparkwarden.functions.text import (
    line_count,
    matched_bytes,
    occurs_twice,
    pieces,
    ramp,
    readable,
    settled,
    spans_of,
    strip,
)

# Signal weights, in report order. They sum to 1.
WEIGHTS = {
    "commit_msg": 0.40,
    "commit_size": 0.10,
    "time_of_day": 0.05,
    "docstring_ratio": 0.10,
    "null_density": 0.10,
    "marketing_comments": 0.05,
    "unused_imports": 0.10,
    "function_variance": 0.10,
}
TEXT_SIGNALS = ["docstring_ratio", "null_density", "marketing_comments", "unused_imports", "function_variance"]
COMMIT_SIGNALS = ["commit_msg", "commit_size", "time_of_day"]

# Commit message markers.
COMMIT_MARKERS = [
    "generated with .*claude",
    "co-authored-by: *claude",
    "co-authored-by: *cursor",
    "co-authored-by: *.*copilot",
    r"cursor\.com",
    "github[- ]?copilot",
    "🤖 +generated",
    r"anthropic\.com",
]

# Null-check and control-flow words, praise phrases.
NULL_CHECK = (
    r"(?:\.is_none\(\)|\.is_some\(\)|== *None|== *null|=== *null|!== *null|is *None|is *not *None|\.is_null\(\)|\?\?)"
)
CONTROL_FLOW = r"\b(?:if|else|match|when)\b"
PRAISE = [
    "robust", "comprehensive", "production-ready", "production ready", "scalable", "enterprise-grade",
    "enterprise grade", "best practice", "seamless", "elegant", "modular", "extensible", "highly performant",
]

# Import and function patterns by language.
_RUST_IMPORT = r"(?m)^use\s+(?:[\w:]+::)?(\w+)(?:\s+as\s+(\w+))?\s*;"
_SCRIPT_IMPORT = r"""import\s+(?:\{([^}]+)\}|(\w+))\s+from\s+["']"""
_PYTHON_IMPORT = r"(?m)^(?:from\s+\S+\s+)?import\s+(.+?)(?:\s+as\s+(\w+))?$"
FUNCTION_PATTERNS = {
    "rust": r"(?m)^\s*(?:pub\s+(?:\(\w+\)\s+)?)?(?:async\s+)?fn\s+\w+",
    "typescript": r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+\w+",
    "javascript": r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+\w+",
    "python": r"(?m)^\s*(?:async\s+)?def\s+\w+",
}

_RUST_DOC = r"(?md)^[^\S\n]*//[/!][^\n]*?(?=\r\n|\n|\z)"
_SCRIPT_DOC = r"/\*(?:\*/|\*(?s:.*?)(?:\*/|\z))"
_PYTHON_DOCS = [r'"""(?s:.*?)"""', r"'''(?s:.*?)'''"]

SCRIPTS = ["typescript", "javascript"]


def _flags(pattern: str, unicode: bool) -> str:
    return ("(?dU)" if unicode else "(?d)") + pattern


# --- text signals -----------------------------------------------------------------------------------

# Regex passes cost a hundred times a plain substring search. Each signal therefore looks first for text
# that every match must contain, and for the regexes that start with a word boundary a look-ahead on the
# first letter spares most boundary tests.

def _has_any(text: Column, *needles: str) -> Column:
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return found


def docstring_ratio(text: Column, language: Column) -> Column:
    """Share of bytes in doc comments, ramp 0.10 to 0.30."""
    doc = (
        F.when((language == "rust") & _has_any(text, "///", "//!"), matched_bytes(text, _RUST_DOC))
        .when(language.isin(SCRIPTS) & _has_any(text, "/**"), matched_bytes(text, _SCRIPT_DOC))
        .when(
            (language == "python") & _has_any(text, '"""', "'''"),
            matched_bytes(text, _PYTHON_DOCS[0]) + matched_bytes(text, _PYTHON_DOCS[1]),
        )
        .otherwise(F.lit(0))
    )
    share = F.coalesce(F.try_divide(doc, F.octet_length(text)), F.lit(0.0))
    return ramp(share, 0.10, 0.30)


def null_density(text: Column, unicode: bool = True) -> Column:
    """Null checks per control-flow word, ramp 0.10 to 0.30."""
    checks = F.regexp_count(text, F.lit("(?=[.=!i?])" + NULL_CHECK))
    flows = F.greatest(F.regexp_count(text, F.lit(_flags("(?=[iemw])" + CONTROL_FLOW, unicode))), F.lit(1))
    ratio = F.when(_has_any(text, ".is_", "None", "null", "??"), checks / flows).when(text.isNotNull(), F.lit(0.0))
    return ramp(ratio, 0.10, 0.30)


def marketing_comments(text: Column) -> Column:
    """Praise phrases anywhere in the file; three or more give 1."""
    # Without the Unicode flag the case folding covers A-Z only, as it must.
    hits = F.regexp_count(text, F.lit("(?i)(?=[rcpsebmh])(?:" + "|".join(PRAISE) + ")"))
    lower = F.lower(text)
    seen = F.when(_has_any(lower, *PRAISE), hits).when(text.isNotNull(), F.lit(0))
    return F.least(seen / F.lit(3.0), F.lit(1.0))


def imported_names(text: Column, language: Column, unicode: bool = True) -> Column:
    """Imported identifiers in order, duplicates kept."""

    def names_in_list(group: Column) -> Column:
        parts = F.transform(F.split(group, ","), lambda p: strip(F.substring_index(strip(p), " as ", 1)))
        return F.filter(parts, lambda p: p != "")

    def each(pattern: str, read) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_flags(pattern, unicode)), 0), read)

    def group(match: Column, pattern: str, number: int) -> Column:
        return F.regexp_extract(match, _flags(pattern, unicode), number)

    rust = each(
        _RUST_IMPORT,
        lambda m: F.coalesce(F.nullif(group(m, _RUST_IMPORT, 2), F.lit("")), group(m, _RUST_IMPORT, 1)),
    )
    script = F.flatten(
        each(
            _SCRIPT_IMPORT,
            lambda m: F.when(group(m, _SCRIPT_IMPORT, 2) != "", F.array(group(m, _SCRIPT_IMPORT, 2))).otherwise(
                names_in_list(group(m, _SCRIPT_IMPORT, 1))
            ),
        )
    )
    python = F.flatten(each(_PYTHON_IMPORT, lambda m: names_in_list(group(m, _PYTHON_IMPORT, 1))))
    imports_at_all = _has_any(text, "import")
    return (
        F.when((language == "rust") & _has_any(text, "use"), rust)
        .when(language.isin(SCRIPTS) & imports_at_all, script)
        .when((language == "python") & imports_at_all, python)
        .otherwise(F.expr("cast(array() as array<string>)"))
    )


def unused_imports(text: Column, language: Column, unicode: bool = True) -> Column:
    """Share of imported names that occur only once in the file, ramp 0.10 to 0.40."""

    def share(names: Column) -> Column:
        unused = F.size(F.filter(names, lambda name: ~occurs_twice(text, name)))
        return F.coalesce(F.try_divide(unused, F.size(names)), F.lit(0.0))

    return ramp(let(imported_names(text, language, unicode), share), 0.10, 0.40)


def function_starts(text: Column, language: Column, unicode: bool = True) -> Column:
    """0-based line of each function start. Blank lines before a function belong to its match."""
    # One span computation over the language's own pieces keeps the expression small.
    parts = None
    for pattern in dict.fromkeys(FUNCTION_PATTERNS.values()):
        names = [name for name, own in FUNCTION_PATTERNS.items() if own == pattern]
        split = pieces(readable(text), _flags(pattern, unicode))
        parts = (F if parts is None else parts).when(language.isin(names), split)
    starts = F.transform(spans_of(parts), lambda s: s["start_line"] - 1)
    named = _has_any(text, "fn", "function", "def")
    return F.coalesce(F.when(named, starts), F.expr("cast(array() as array<int>)"))


def function_lengths(text: Column, language: Column, unicode: bool = True) -> Column:
    """Lines from each function start to the next one, or to the end of the file."""
    return let(
        function_starts(text, language, unicode),
        lambda starts: F.transform(
            starts, lambda s, i: (F.coalesce(F.get(starts, i + 1), line_count(text)) - s).cast("int")
        ),
    )


def function_variance(text: Column, language: Column, unicode: bool = True) -> Column:
    """Evenness of function lengths: coefficient of variation, falling ramp 0.4 to 0.2."""

    def even(lengths: Column) -> Column:
        n = F.size(lengths)
        total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
        mean = F.try_divide(total, n)
        squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        cv = F.try_divide(F.sqrt(F.try_divide(squares, n)), mean)
        return F.when((n < 3) | (mean < 3), F.lit(0.0)).otherwise(ramp(cv, 0.4, 0.2))

    return let(function_lengths(text, language, unicode), even)


def inline_override(text: Column, prefix: str = "audit") -> Column:
    """1.0 for a ``<prefix>:ai`` marker anywhere, else 0.0 for ``<prefix>:human``, else null."""
    return F.when(F.contains(text, F.lit(f"{prefix}:ai")), F.lit(1.0)).when(
        F.contains(text, F.lit(f"{prefix}:human")), F.lit(0.0)
    )


def text_signals(
    files: DataFrame, prefix: str = "audit", unicode: bool = True, keep: tuple[str, ...] = ("repo", "path", "language")
) -> DataFrame:
    """Text signals and the override of every file; all null where the text is null. No shuffle."""
    text, language = F.col("content"), F.col("language")
    signals = {
        "docstring_ratio": docstring_ratio(text, language),
        "null_density": null_density(text, unicode),
        "marketing_comments": marketing_comments(text),
        "unused_imports": unused_imports(text, language, unicode),
        "function_variance": function_variance(text, language, unicode),
    }
    # The ramps are built on greatest and least, which pass over nulls: missing text is tested for here.
    return files.select(
        *keep,
        *[F.when(text.isNotNull(), value).alias(name) for name, value in signals.items()],
        inline_override(text, prefix).alias("override"),
    )


# --- commit signals ---------------------------------------------------------------------------------

def commit_msg(message: Column, markers: list[str] | None = None) -> Column:
    """1 if any marker occurs in the message."""
    pattern = "(?idu)" + "|".join(f"(?:{m})" for m in (markers or COMMIT_MARKERS))
    return F.when(F.rlike(message, F.lit(pattern)), F.lit(1.0)).otherwise(F.lit(0.0))


def commit_size(additions: Column) -> Column:
    """0 below 200 added lines, 1 from 500, linear between."""
    return F.when(additions < 200, F.lit(0.0)).otherwise(ramp(additions, 200, 500))


def time_of_day(hour: Column) -> Column:
    """1 outside 8 to 22 o'clock author time, 0 inside or unknown."""
    return F.when(~hour.between(8, 22), F.lit(1.0)).otherwise(F.lit(0.0))


#: Commits of an author that make up the usual pattern, how many are needed for one, and the share below which an hour is unusual.
PAST_COMMITS, LEAST_COMMITS, USUAL_SHARE = 100, 10, 0.05


def hour_anomalies(commits: DataFrame, past: int = PAST_COMMITS, least: int = LEAST_COMMITS, usual: float = USUAL_SHARE) -> DataFrame:
    """``repo, sha, usual_share, unusual``: the share of the author's last commits in the repository in this commit's hour.

    The pattern is the ``past`` commits before this one, in order of time and hash. With fewer than ``least`` nothing is
    unusual. Unknown hours are no part of a pattern and have a null share.
    """
    order = Window.partitionBy("repo", "author").orderBy("author_ts", "sha").rowsBetween(-past, -1)
    rows = commits.select("repo", "sha", "author_hour", F.collect_list("author_hour").over(order).alias("hours"))
    same = F.size(F.filter("hours", lambda h: h == F.col("author_hour")))
    share = F.when((F.size("hours") > 0) & F.col("author_hour").isNotNull(), same / F.size("hours"))
    unusual = F.coalesce((F.size("hours") >= least) & (share < usual), F.lit(False))
    return rows.select("repo", "sha", share.alias("usual_share"), unusual.alias("unusual"))


def last_commits(commits: DataFrame, commit_files: DataFrame, *carry: str) -> DataFrame:
    """The latest commit of each path with the lines it added there: ``repo, path, sha, additions, <carry>``.

    Counts are added up per commit first, so a path that nearly every commit touches shrinks before each
    shuffle. ``carry`` names the commit columns to bring along; leave long ones out and join them later.
    """
    touched = commit_files.groupBy("repo", "path", "sha").agg(
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions")
    )
    dated = touched.join(commits.select("repo", "sha", "author_ts", *carry), ["repo", "sha"])
    latest = dated.groupBy("repo", "path").agg(
        F.max(F.struct("author_ts", "sha", "additions", *carry)).alias("last")
    )
    return latest.select("repo", "path", *[F.col(f"last.{c}").alias(c) for c in ("sha", "author_ts", "additions", *carry)])


def commit_signals(commits: DataFrame, commit_files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """The three commit signals per file. The message is reduced to one number before any join."""
    slim = commits.select(
        "repo", "sha", "author_ts", "author_hour", commit_msg(F.col("message"), markers).alias("commit_msg")
    )
    last = last_commits(slim, commit_files, "author_hour", "commit_msg")
    return last.select(
        "repo",
        "path",
        "commit_msg",
        commit_size(F.col("additions")).alias("commit_size"),
        time_of_day(F.col("author_hour")).alias("time_of_day"),
    )


# --- score ------------------------------------------------------------------------------------------

def weighted_score(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the clamped signals, at most 1."""
    total = F.lit(0.0)
    for name, weight in (weights or WEIGHTS).items():
        total = total + F.lit(weight) * F.greatest(F.least(signals[name], F.lit(1.0)), F.lit(0.0))
    return settled(F.least(total, F.lit(1.0)))


def with_score(rows: DataFrame, commit_side: DataFrame | None) -> DataFrame:
    """Add ``score`` to rows that carry the text signals. Files without a commit get 0 for its signals."""
    if commit_side is None:
        for name in COMMIT_SIGNALS:
            rows = rows.withColumn(name, F.lit(0.0))
    else:
        rows = rows.join(commit_side, ["repo", "path"], "left").withColumns(
            {name: F.coalesce(name, F.lit(0.0)) for name in COMMIT_SIGNALS}
        )
    score = weighted_score({name: F.col(name) for name in WEIGHTS})
    return rows.withColumn("score", F.coalesce("override", F.when(F.col("null_density").isNotNull(), score)))


def provenance(
    files: DataFrame,
    commits: DataFrame | None = None,
    commit_files: DataFrame | None = None,
    prefix: str = "audit",
    unicode: bool = True,
) -> DataFrame:
    """``repo, path, score, override`` plus the eight signals for every file."""
    side = None if commits is None else commit_signals(commits, commit_files)
    scored = with_score(text_signals(files, prefix, unicode), side)
    return scored.select(
        "repo", "path", "score", F.col("override").isNotNull().alias("override"),
        *[settled(F.col(name)).alias(name) for name in WEIGHTS],
    )


def signals_long(scored: DataFrame) -> DataFrame:
    """One row per file and signal: ``repo, path, name, weight, value, contribution``."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"), F.col(name).alias("value"))
            for name, weight in WEIGHTS.items()
        ]
    )
    return scored.select("repo", "path", F.inline(rows)).withColumn(
        "contribution",
        settled(F.col("weight") * F.greatest(F.least("value", F.lit(1.0)), F.lit(0.0))),
    )


def likely_generated(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Files whose score reaches the threshold; files without a score drop out."""
    return scored.where(F.round("score", 6) >= threshold)


def imports(files: DataFrame, unicode: bool = True) -> DataFrame:
    """Imported names as a table."""
    return files.select(
        "repo", "path", "language", F.explode_outer(imported_names(F.col("content"), F.col("language"), unicode)).alias("name")
    ).where(F.col("name").isNotNull())


def functions(files: DataFrame, unicode: bool = True) -> DataFrame:
    """Function starts (0-based line) and lengths as a table."""
    text, language = F.col("content"), F.col("language")
    starts = function_starts(text, language, unicode)
    rows = let(
        starts,
        lambda at: F.transform(
            at,
            lambda s, i: F.struct(
                s.alias("start_line"), (F.coalesce(F.get(at, i + 1), line_count(text)) - s).cast("int").alias("n_lines")
            ),
        ),
    )
    return files.select("repo", "path", "language", F.explode_outer(rows).alias("fn")).where(
        F.col("fn").isNotNull()
    ).select("repo", "path", "language", "fn.start_line", "fn.n_lines")
