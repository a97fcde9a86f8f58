"""Which files take part in a scan: languages, exclude globs, ignore files and change sets.

Filters that look at one row work on the files table itself. Filters that need a join work on
``repo, path`` rows only, so file text never goes through a shuffle: apply them to scan results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.arrays import let
from sparkwarden.functions.paths import basename, dirname, glob_to_regex, ignore_pattern_regex, ignore_pattern_valid
from sparkwarden.functions.text import lines

# Added, copied, modified, renamed; deleted paths are left out.
CHANGED = ["A", "C", "M", "R"]


def by_language(files: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Files of the listed languages; without a list all known languages."""
    if languages is None:
        return files.where(F.col("language") != "unknown")
    return files.where(F.col("language").isin(list(languages)))


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """True if any glob matches the whole path. An invalid glob is searched as plain text."""
    out = F.lit(False)
    for glob in globs:
        regex = glob_to_regex(glob)
        out = out | (F.contains(path, F.lit(glob)) if regex is None else F.rlike(path, F.lit(regex)))
    return out


def not_excluded(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    return files.where(~excluded(F.col("path"), globs)) if globs else files


# --- ignore files -----------------------------------------------------------------------------------

def ignore_file_kinds(prefix: str = "audit", respect_git: bool = True) -> dict[str, int]:
    """Ignore file names with their weight: rules of a heavier kind win wherever they stand."""
    kinds = {".ignore": 1, f".{prefix}ignore": 2}
    return {".gitignore": 0, **kinds} if respect_git else kinds


def ignore_rules(files: DataFrame, prefix: str = "audit", respect_git: bool = True) -> DataFrame:
    """Rules of all ignore files: ``repo, dir, kind, ordinal, pattern, regex, negated, dir_only``."""
    named = basename(F.col("path")).isin(list(ignore_file_kinds(prefix, respect_git)))
    rows = files.where(named & F.col("content").isNotNull())
    return rules_of_lines(rows.select("repo", "path", lines(F.col("content")).alias("lines")), prefix, respect_git)


def rules_of_lines(rows: DataFrame, prefix: str = "audit", respect_git: bool = True, invalid: bool = False) -> DataFrame:
    """The same from rows of ``repo, path, lines``; with ``invalid`` the lines that are no valid rule instead."""
    kinds = ignore_file_kinds(prefix, respect_git)
    name = basename(F.col("path"))
    kind = None
    for file_name, weight in kinds.items():
        kind = (F if kind is None else kind).when(name == file_name, F.lit(weight))
    rows = rows.where(name.isin(list(kinds))).select(
        "repo", dirname(F.col("path")).alias("dir"), kind.alias("kind"), F.posexplode("lines").alias("ordinal", "line")
    )
    rows = rows.withColumn("line", F.regexp_replace("line", F.lit(r"(?<!\\)[ \t]+$"), F.lit("")))
    rows = rows.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    negated = F.startswith("line", F.lit("!"))
    pattern = F.when(negated, F.substring(F.col("line"), F.lit(2), F.length("line"))).otherwise(F.col("line"))
    rows = rows.withColumn("pattern", pattern)
    valid = ignore_pattern_valid(F.col("pattern"))
    return rows.where(valid if not invalid else ~valid).select(
        "repo", "dir", "kind", "ordinal", "pattern", negated.alias("negated"),
        F.endswith("pattern", F.lit("/")).alias("dir_only"),
        ignore_pattern_regex(F.col("pattern")).alias("regex"),
    )


def invalid_ignore_rules(rows: DataFrame, prefix: str = "audit", respect_git: bool = True) -> DataFrame:
    """Lines of ignore files (rows of ``repo, path, lines``) that are no valid rule, as an error table."""
    names = F.create_map(*[F.lit(x) for name, kind in ignore_file_kinds(prefix, respect_git).items() for x in (kind, name)])
    bad = rules_of_lines(rows, prefix, respect_git, invalid=True)
    path = F.concat(F.when(F.col("dir") != "", F.concat("dir", F.lit("/"))).otherwise(F.lit("")), F.element_at(names, F.col("kind")))
    return bad.select(
        "repo", path.alias("path"), F.lit("discovery").alias("verifier_id"),
        F.format_string("invalid ignore rule in line %d: %s", F.col("ordinal") + 1, F.col("pattern")).alias("reason"),
    )


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``repo, path`` rows that the ignore rules leave out.

    For a path and each folder above it, the last matching rule decides; kind comes before depth, and
    depth before the order within one file. A path is left out if any of these decisions says so:
    nothing can be taken back below an ignored folder.

    Each path meets only the ignore files of the folders above it, in an equi join on repository and
    folder. The rules of one ignore file form one list, never those of a whole repository.
    """
    lists = rules.groupBy("repo", "dir", "kind").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "regex", "negated", "dir_only"))).alias("rules")
    )
    parts = paths.select("repo", "path", F.split("path", "/").alias("parts"))
    folders = parts.select(
        "repo", "path", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth")
    ).withColumn("dir", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))

    def last_match(n: Column) -> Column:
        # The first n parts of the path, seen from the folder of the ignore file.
        below = F.array_join(F.slice("parts", F.col("depth") + 1, n - F.col("depth")), "/")
        is_dir = n < F.size("parts")
        hits = let(
            below, lambda text: F.filter("rules", lambda r: (~r["dir_only"] | is_dir) & F.rlike(text, r["regex"]))
        )
        return let(hits, lambda h: F.struct(n.alias("n"), F.get(h, F.size(h) - 1)["negated"].alias("negated")))

    steps = F.transform(F.sequence(F.col("depth") + 1, F.size("parts")), last_match)
    decided = (
        folders.join(lists, ["repo", "dir"])
        .select("repo", "path", "kind", "depth", F.explode_outer(steps).alias("step"))
        .where(F.col("step.negated").isNotNull())
    )
    return (
        decided.groupBy("repo", "path", "step.n")
        .agg(F.max(F.struct("kind", "depth", F.col("step.negated").alias("negated"))).alias("last"))
        .where("not last.negated")
        .select("repo", "path")
        .distinct()
    )


def not_ignored(rows: DataFrame, paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose path is not ignored."""
    return rows.join(ignored_paths(paths, rules), ["repo", "path"], "left_anti")


# --- change sets ------------------------------------------------------------------------------------

def changed_paths(changes: DataFrame) -> DataFrame:
    """Distinct paths that were added, copied, modified or renamed."""
    return changes.where(F.col("status").isin(CHANGED)).select("repo", "path").distinct()


def changes_since(commits: DataFrame, commit_files: DataFrame, refs: DataFrame) -> DataFrame:
    """Net change per path in commits later than the reference commit ``refs(repo, ref)`` of its repository.

    The status is that of the last such commit.
    """
    since = (
        refs.join(commits.select("repo", F.col("sha").alias("ref"), F.col("author_ts").alias("ref_ts")), ["repo", "ref"])
        .select("repo", "ref_ts")
    )
    later = commits.select("repo", "sha", "author_ts").join(since, "repo").where("author_ts > ref_ts")
    return (
        commit_files.select("repo", "sha", "path", "status")
        .join(later.select("repo", "sha", "author_ts"), ["repo", "sha"])
        .groupBy("repo", "path")
        .agg(F.max(F.struct("author_ts", "sha", "status")).alias("last"))
        .select("repo", "path", "last.status")
    )


def unknown_refs(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """References that name no commit of their repository."""
    return refs.join(commits.select("repo", F.col("sha").alias("ref")), ["repo", "ref"], "left_anti")


def change_set(paths: DataFrame, commits: DataFrame, commit_files: DataFrame, refs: DataFrame) -> DataFrame:
    """Paths to scan in diff mode. A repository whose reference is unknown falls back to all its paths."""
    existing = paths.select("repo", "path")
    changed = existing.join(changed_paths(changes_since(commits, commit_files, refs)), ["repo", "path"], "left_semi")
    whole = existing.join(unknown_refs(commits, refs).select("repo").distinct(), "repo", "left_semi")
    return changed.unionByName(whole.select("repo", "path"))


def staged_paths(paths: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Paths with a staged change that is not a deletion."""
    return paths.select("repo", "path").join(changed_paths(commit_files.where("staged")), ["repo", "path"], "left_semi")


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, modified and deleted paths between two files tables. Only hashes are joined."""

    def hashed(files: DataFrame, name: str) -> DataFrame:
        return files.select("repo", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias(name))

    both = hashed(old, "old_hash").join(hashed(new, "new_hash"), ["repo", "path"], "full_outer")
    status = (
        F.when(F.col("old_hash").isNull(), F.lit("A"))
        .when(F.col("new_hash").isNull(), F.lit("D"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("M"))
    )
    return both.select("repo", "path", status.alias("status")).where(F.col("status").isNotNull())
