"""The whole audit: files, history and advisories in, findings out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import cache, partial

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.paths import basename
from sparkwarden.functions.text import lines

from sparkwarden.functions.code import FAMILIES
from sparkwarden.operators import deadcode, discovery, imports, lockfiles, provenance, secrets, vulnerabilities
from sparkwarden.operators.findings import (
    UserVerifier,
    attach_provenance,
    candidate_counts,
    checked_findings,
    choose_verifiers,
    in_counts,
    on_changed_lines,
    run_verifiers,
    unread_reason,
    union_findings,
)
from sparkwarden.operators.secrets import SecretOptions, explode_items
from sparkwarden.schemas import FINDINGS
from sparkwarden.session import stored

VERIFIERS = {secrets.VERIFIER: secrets.DESCRIPTION, vulnerabilities.VERIFIER: vulnerabilities.DESCRIPTION}

#: Verifiers of the library that run when they are asked for, as user verifiers.
DEAD_CODE = UserVerifier(
    deadcode.VERIFIER, deadcode.DESCRIPTION, lambda files: deadcode.dead_functions(files).drop("verifier_id").withColumnRenamed("name", "message"),
    list(FAMILIES),
)


def unresolved_import_verifier(packages: DataFrame) -> UserVerifier:
    """Unresolved imports as a verifier, given the packages of the lockfiles."""

    def find(files: DataFrame) -> DataFrame:
        return imports.unresolved_imports(files, packages).drop("verifier_id").withColumnRenamed("module", "message")

    return UserVerifier(imports.VERIFIER, imports.DESCRIPTION, find)


def verifiers_of(options: AuditOptions) -> dict[str, str]:
    """Descriptions by verifier id for reports, the user's own included."""
    return VERIFIERS | {v.verifier_id: v.description for v in options.user_verifiers}


@dataclass(frozen=True)
class AuditOptions:
    languages: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    respect_gitignore: bool = True
    use_ignore_files: bool = True
    detect: bool = True
    ai_only: bool = False
    threshold: float = 0.5
    verifiers: Sequence[str] | None = None
    skip: Sequence[str] = ()
    secrets: SecretOptions = field(default_factory=SecretOptions)
    prefix: str = "audit"
    #: Only files with a staged change that is no deletion.
    staged: bool = False
    #: Further verifiers; they run after the others, by default and wherever their id is chosen.
    user_verifiers: Sequence[UserVerifier] = ()
    #: Answers of vulnerability lookups count if they are fresh at this time; without it the last one counts.
    as_of: datetime | None = None

    def chosen(self, tables: Tables) -> list[str]:
        """Ids of the verifiers that run. Without vulnerability tables there is nothing to look up."""
        has_advisories = tables.advisories is not None or tables.osv_vulns is not None
        available = {secrets.VERIFIER: True, vulnerabilities.VERIFIER: has_advisories}
        own = [v.verifier_id for v in self.user_verifiers]
        if len({*available, *own}) < len(available) + len(own):
            raise ValueError(f"verifier ids must differ: {[*available, *own]}")
        available |= dict.fromkeys(own, True)
        return choose_verifiers(available, self.verifiers, self.skip)


@dataclass(frozen=True)
class Tables:
    """Input tables. Only ``files`` is needed; what is missing switches its part off.

    ``ignore_files(repo, path, content)`` may hold the ignore files apart from the others, so that reading their rules
    reads no other text; without it they are taken from ``files``. ``file_errors``, such as ``tree_errors``, go to the errors.
    With ``hunks(repo, path, start_line, end_line)``, end exclusive, only findings that start on one of these lines are made.
    """

    files: DataFrame
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    advisories: DataFrame | None = None
    osv_vulns: DataFrame | None = None
    refs: DataFrame | None = None
    ignore_files: DataFrame | None = None
    file_errors: DataFrame | None = None
    hunks: DataFrame | None = None


@dataclass(frozen=True)
class Audited:
    """What an audit gives: findings, ``runs(repo, candidates_scanned)`` and ``errors(repo, path, verifier_id, reason)``."""

    findings: DataFrame
    runs: DataFrame
    errors: DataFrame
    #: ``findings_as(form, also, firsts)``: the findings in another form, from what the audit has written. Columns of ``firsts`` (``repo, first``) are
    #: added to the few rows that findings come from, so that none of the findings is moved for it.
    findings_as: Callable[..., DataFrame]


def _by_change(tables: Tables, options: AuditOptions) -> bool:
    return tables.refs is not None or options.staged


def _is_candidate(tables: Tables, options: AuditOptions) -> Column:
    """The row-wise part of file selection. In diff and staged mode neither language nor globs are tested."""
    if _by_change(tables, options):
        return F.lit(True)
    known = (
        F.col("language") != "unknown" if options.languages is None else F.col("language").isin(list(options.languages))
    )
    return known & ~discovery.excluded(F.col("path"), options.exclude)


def _ignore_lines(tables: Tables, options: AuditOptions) -> DataFrame:
    """``repo, path, lines`` of the ignore files."""
    names = list(discovery.ignore_file_kinds(options.prefix, options.respect_gitignore))
    source = tables.files if tables.ignore_files is None else tables.ignore_files
    rows = source.where(basename(F.col("path")).isin(names) & F.col("content").isNotNull())
    return rows.select("repo", "path", lines(F.col("content")).alias("lines"))


def selected(tables: Tables, options: AuditOptions, ignore_lines: DataFrame | None) -> DataFrame:
    """``files`` with ``candidate``, decided before any text is searched, and without files that have no part.

    The change set, or else the paths that ignore rules leave out, come from ``repo, path`` rows. They are written down, so
    that Spark knows their size when it chooses how to join them to the text: by broadcast if they are small, by a shuffle
    if not, with the same rows either way.
    """
    is_lock = F.col("path").isin(list(lockfiles.LOCKFILES))
    paths = tables.files.select("repo", "path", "language")
    if tables.refs is not None:
        marked = discovery.change_set(paths, tables.commits, tables.commit_files, tables.refs)
    elif options.staged:
        marked = discovery.staged_paths(paths, tables.commit_files)
    elif ignore_lines is not None:
        rules = discovery.rules_of_lines(ignore_lines, options.prefix, options.respect_gitignore)
        marked = discovery.ignored_paths(paths.where(_is_candidate(tables, options)).select("repo", "path"), rules)
    else:
        files = tables.files.withColumn("candidate", _is_candidate(tables, options))
        return files.where(F.col("candidate") | is_lock)
    marked = stored(marked.select("repo", "path").distinct())
    if _by_change(tables, options):
        # Few files: the text of the others takes no part in a join, and lockfiles are found by a filter of the scan.
        changed = tables.files.join(marked, ["repo", "path"], "left_semi").withColumn("candidate", F.lit(True))
        locks = tables.files.where(is_lock).join(marked, ["repo", "path"], "left_anti").withColumn("candidate", F.lit(False))
        return changed.unionByName(locks)
    files = tables.files.join(marked.withColumn("_marked", F.lit(True)), ["repo", "path"], "left")
    files = files.withColumn("candidate", F.col("_marked").isNull() & _is_candidate(tables, options)).drop("_marked")
    return files.where(F.col("candidate") | is_lock)


def extract(files: DataFrame, options: AuditOptions, with_secrets: bool) -> DataFrame:
    """Everything the audit needs from the text of selected files, in one row-wise pass.

    One small row per file: ``repo, path, language, candidate, unreadable, signals, secrets, packages``. The text goes no
    further, so nothing later depends on its size.
    """
    text, path, language = F.col("content"), F.col("path"), F.col("language")
    is_lock = path.isin(list(lockfiles.LOCKFILES))
    files = files.withColumn("unreadable", F.when(text.isNull(), unread_reason(files)))
    base = ["repo", "path", "language", "candidate", "unreadable"]
    packages = F.when(is_lock, lockfiles.packages_in(path, text)).alias("packages")
    if options.detect:
        names = [*provenance.TEXT_SIGNALS, "override"]
        rows = provenance.text_signals(files, options.prefix, options.secrets.unicode, (*base, "content"))
        files = rows.select(*base, "content", F.struct(*names).alias("signals"))
    else:
        files = files.withColumn("signals", F.lit(None).cast("string"))
    keep = [*base, "signals", "packages"]
    files = files.select(*base, "signals", packages, "content")
    if not with_secrets:
        return files.select(*keep)
    scanned = F.when(F.col("candidate") & language.isin(secrets.LANGUAGES), text).alias("content")
    return secrets.scan_secrets(files.select(*keep, scanned), options.secrets, keep)


def scored(tables: Tables, rows: DataFrame, options: AuditOptions) -> DataFrame:
    """Candidates with ``provenance_score``; null throughout if detection is off."""
    if not options.detect:
        return rows.withColumn("provenance_score", F.lit(None).cast("double"))
    side = None if tables.commits is None else provenance.commit_signals(tables.commits, tables.commit_files)
    with_score = provenance.with_score(rows.select("*", "signals.*"), side)
    if options.ai_only:
        with_score = provenance.likely_generated(with_score, options.threshold)
    return with_score.withColumn("provenance_score", F.col("score")).select(*rows.columns, "provenance_score")


#: Forms of the findings: whole; counted (rows of ``in_counts``); the first ones in each repository's report, for ``first_places``; the
#: first ones of each rule there, for ``rule_descriptors``.
WHOLE, COUNTED, FIRST, DESCRIBED = "whole", "counted", "first", "described"


def dependency_findings(
    tables: Tables, packages: DataFrame, as_of: datetime | None = None, also: Mapping[str, Column] | None = None, form: str = WHOLE
) -> DataFrame:
    """Findings in locked dependencies, per repository and ecosystem."""
    at = None if as_of is None else F.lit(as_of).cast("timestamp")
    if form in (FIRST, DESCRIBED):
        texts = []
        if tables.advisories is not None:
            texts.append(vulnerabilities.advisory_texts(packages, tables.advisories))
        if tables.osv_vulns is not None:
            texts.append(vulnerabilities.exact_texts(tables.osv_vulns, at))
        make = vulnerabilities.first_findings if form == FIRST else vulnerabilities.described_findings
        return make(packages, union_findings(texts))
    parts, counted = [], form == COUNTED
    if tables.advisories is not None:
        parts.append(vulnerabilities.advisory_findings(packages, tables.advisories, also=also, counted=counted))
    if tables.osv_vulns is not None:
        parts.append(vulnerabilities.exact_findings(packages, tables.osv_vulns, as_of=at, also=also, counted=counted))
    return union_findings(parts)


def audited(
    tables: Tables, options: AuditOptions | None = None, also: Mapping[str, Column] | None = None, form: str = WHOLE, several: bool = False
) -> Audited:
    """The whole audit. Write the findings to a table before reporting on them.

    ``also`` names further columns of the findings, made of ``verifier_id, rule_id, severity, message, metadata``: what they
    say of a version is made once for all its findings. In the form ``COUNTED`` the findings are rows of ``in_counts``, for counts alone: then
    dependency findings, which are packages times what is said of each, are counted without being made. ``several``: the findings
    are read more than once, or in several forms, so that scores are written.

    Calling this selects the files, searches the text of those, and writes what it found to the shared folder: text is
    searched exactly once, however many parts use what was found in it. Only in AI-only mode it is searched twice, the
    second time for secrets in the files that are left.
    """
    options = options or AuditOptions()
    chosen = options.chosen(tables)
    use_ignore = options.use_ignore_files and not _by_change(tables, options)
    ignore_lines = stored(_ignore_lines(tables, options)) if use_ignore else None
    files = selected(tables, options, ignore_lines)
    scan_now = secrets.VERIFIER in chosen and not options.ai_only
    extracted = stored(extract(files, options, scan_now))
    candidates = extracted.where("candidate")

    lock_scores = options.detect and (_by_change(tables, options) or "unknown" in (options.languages or ()))
    shared = several or len([v for v in chosen if v != vulnerabilities.VERIFIER or lock_scores]) > 1

    @cache
    def scored_candidates() -> DataFrame:
        """Scores of all candidates; several verifiers read one written copy, so that the history is joined once."""
        rows = scored(tables, candidates, options).drop("signals")
        return stored(rows) if shared else rows

    def on_wanted_lines(rows: DataFrame) -> DataFrame:
        return rows if tables.hunks is None else on_changed_lines(rows, tables.hunks)

    def shaped(rows: DataFrame, form: str, also: Mapping[str, Column] | None) -> DataFrame:
        if form == DESCRIBED:
            return rows.withColumn("alone", F.lit(False))
        return in_counts(rows) if form == COUNTED else rows.withColumns(dict(also or {}))

    def from_secrets(form: str, also: Mapping[str, Column] | None, firsts: DataFrame | None) -> DataFrame:
        rows, keep = scored_candidates(), ["repo", "path", "provenance_score"]
        if options.ai_only:
            # Scores come first: only the text of what is left is searched.
            rows = searched_later()
        if firsts is not None:
            rows, keep = rows.join(firsts, "repo", "left"), [*keep, "first"]
        return shaped(on_wanted_lines(explode_items(rows, "secrets", keep)), form, also)

    @cache
    def searched_later() -> DataFrame:
        left = stored(scored_candidates().select("repo", "path", "provenance_score"))
        scanned = files.where(F.col("candidate") & F.col("language").isin(secrets.LANGUAGES))
        rows = scanned.select("repo", "path", "language", "content").join(left, ["repo", "path"])
        return stored(secrets.scan_secrets(rows, options.secrets, ["repo", "path", "provenance_score"]))

    @cache
    def locked() -> DataFrame:
        locks = extracted.where(F.col("packages").isNotNull())
        packages = lockfiles.first_lockfiles(lockfiles.lockfile_rows(locks))
        if lock_scores:
            # Lockfiles are candidates only here, so only here can their findings get a score. It is the same for all findings
            # of a file: the few packages get it and hand it on, and no finding is moved for it.
            rows = scored_candidates().where(F.col("packages").isNotNull())
            packages = packages.withColumn("provenance_score", F.lit(None).cast("double"))
            packages = attach_provenance(packages, rows.withColumnRenamed("provenance_score", "score"), F.col("lockfile_path"))
        # All findings of a lockfile start on one line: its packages are tested, before they meet the advisories.
        at = F.struct(F.col("lockfile_path").alias("path"), F.lit(vulnerabilities.FINDING_LINE).alias("start_line"))
        packages = on_wanted_lines(packages.withColumn("location", at)).drop("location")
        # Versions and both joins read one written copy.
        return stored(packages)

    def from_dependencies(form: str, also: Mapping[str, Column] | None, firsts: DataFrame | None) -> DataFrame:
        packages = locked() if firsts is None else locked().join(firsts, "repo", "left")
        return dependency_findings(tables, packages, options.as_of, also, form)

    def from_user(verifier: UserVerifier, form: str, also: Mapping[str, Column] | None, firsts: DataFrame | None) -> DataFrame:
        left = scored_candidates().select("repo", "path", F.col("provenance_score").alias("score"))
        left = left if shared else stored(left)
        seen = files.where("candidate").select("repo", "path", "language", "content")
        if verifier.languages is not None:
            seen = seen.where(F.col("language").isin(list(verifier.languages)))
        if options.ai_only:
            seen = seen.join(left, ["repo", "path"], "left_semi")
        rows = attach_provenance(on_wanted_lines(checked_findings(verifier.find(seen), verifier.verifier_id)), left)
        return shaped(rows if firsts is None else rows.join(firsts, "repo", "left").select(*rows.columns, "first"), form, also)

    runners = {secrets.VERIFIER: from_secrets, vulnerabilities.VERIFIER: from_dependencies}
    runners |= {v.verifier_id: partial(from_user, v) for v in options.user_verifiers}

    def findings_as(form: str = WHOLE, also: Mapping[str, Column] | None = None, firsts: DataFrame | None = None) -> DataFrame:
        parts = run_verifiers({name: partial(run, form, also, firsts) for name, run in runners.items()}, chosen)
        if parts:
            return union_findings(parts)
        none = tables.files.sparkSession.createDataFrame([], FINDINGS)
        return shaped(none if firsts is None else none.join(firsts, "repo", "left").select(*none.columns, "first"), form, also)

    unread = candidates.where("unreadable IS NOT NULL").select(
        "repo", "path", F.lit(secrets.VERIFIER).alias("verifier_id"), F.col("unreadable").alias("reason")
    )
    locks = extracted.where(F.col("packages").isNotNull() & (F.size("packages") == 0)).select(
        "repo", "path", F.lit(vulnerabilities.VERIFIER).alias("verifier_id"), F.lit("no packages in lockfile").alias("reason")
    )
    errors = unread.unionByName(locks)
    if tables.file_errors is not None:
        errors = errors.unionByName(tables.file_errors)
    if ignore_lines is not None:
        errors = errors.unionByName(
            discovery.invalid_ignore_rules(ignore_lines, options.prefix, options.respect_gitignore)
        )
    return Audited(findings_as(form, also), candidate_counts(candidates), errors, findings_as)


def audit(tables: Tables, options: AuditOptions | None = None, also: Mapping[str, Column] | None = None) -> DataFrame:
    """The findings of ``audited``."""
    return audited(tables, options, also).findings


def run_table(tables: Tables, options: AuditOptions | None = None) -> DataFrame:
    """Scanned files per repository without an audit. Reads the text of ignore files alone."""
    options = options or AuditOptions()
    use_ignore = options.use_ignore_files and not _by_change(tables, options)
    ignore_lines = stored(_ignore_lines(tables, options)) if use_ignore else None
    return candidate_counts(selected(tables, options, ignore_lines).where("candidate").select("repo", "path"))
