"""Findings that are counted or worded before packages meet what is said of them, and the same results as one by one."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.severity import SEVERITIES
from sparkwarden.operators import findings as fnd
from sparkwarden.operators import reports, vulnerabilities
from sparkwarden.plans.audit import COUNTED, DESCRIBED, FIRST, VERIFIERS, Tables, audited, run_table
from sparkwarden.plans.registry import flat, metadata_text

AWS = "AKIA" + "IOSFODNN7EXAMPLE"
ADVISORY = "advisory_id string, ecosystem string, package string, title string, cvss double, url string, patched array<string>, unaffected array<string>"
ANSWER = "ecosystem string, name string, version string, vuln_id string, fetched_at int"


def lock(*packages):
    return "".join(f'[[package]]\nname = "{n}"\nversion = "{v}"\n\n' for n, v in packages)


@pytest.fixture
def tables(spark, files_of):
    # Two versions of one package in a lockfile, a package twice, advisories with one id, and one of two packages.
    files = files_of(("Cargo.lock", lock(("a", "1.0.0"), ("a", "1.5.0"), ("b", "1.0.0"), ("b", "1.0.0"))), ("k.rs", f'let k = "{AWS}";\n'))
    files = files.unionByName(files_of(("Cargo.lock", lock(("a", "1.0.0"))), ("x.rs", "fn a() {}\n"), repo="one"))
    files = files.unionByName(files_of(("x.rs", "fn a() {}\n"), repo="clean"))
    rows = [(f"A-{i}", "Rust", "a", f"flaw {i % 7}", [9.5, 8.0, 5.0, 1.0, None][i % 5], "u", ["^2.0.0"], []) for i in range(40)]
    rows += [("A-1", "Rust", "a", "later flaw", 9.9, None, [], []), ("A-2", "Rust", "b", "of b", 9.9, None, [">=2"], None), ("A-2", "Rust", "b", "of b", 9.9, None, [">=2"], None)]
    answers = [("Rust", "a", "1.0.0", "A-3", 0), ("Rust", "b", "1.0.0", "B-1", 0), ("Rust", "a", "1.5.0", None, 0)]
    touched = spark.createDataFrame([(r, "s", p) for r in ("r", "one") for p in ("Cargo.lock", "k.rs")], "repo string, sha string, path string")
    touched = touched.selectExpr("*", "'M' status", "1 additions", "0 deletions", "true staged")
    commits = spark.createDataFrame([("r", "s"), ("one", "s")], "repo string, sha string").selectExpr("repo", "sha", "'d' author", "timestamp'2024-01-01 10:00:00' author_ts", "10 author_hour", "'x' message")
    return Tables(files, commits, touched, spark.createDataFrame(rows, ADVISORY), spark.createDataFrame(answers, ANSWER))


def collected(df):
    return sorted(map(str, df.collect()))


def test_counts_without_making_each_finding(tables):
    found, counted, runs = audited(tables).findings, audited(tables, form=COUNTED).findings, run_table(tables)
    last = tables.commits.crossJoin(tables.commit_files.select("path").distinct()).select("repo", "path", "author_ts").where("path <> 'k.rs' OR repo <> 'r'")
    for count in (
        lambda f: fnd.counts_by_severity(f, runs), fnd.counts_by_severity, lambda f: fnd.gate(f, "critical", runs), fnd.severity_rollup,
        lambda f: fnd.weekly_counts(f, last),
    ):
        assert collected(count(counted)) == collected(count(found)) and count(counted).schema.simpleString() == count(found).schema.simpleString()
    # Each of the five packages has a row for a severity and source, however many advisories it has.
    assert found.count() > 120 and counted.count() <= 5 * 5 + 1
    assert counted.agg(F.sum("number")).first()[0] == found.count()


def test_metadata_is_put_into_words_with_its_version(tables):
    found, worded = flat(audited(tables).findings), flat(audited(tables, also=metadata_text()).findings)
    assert collected(worded) == collected(found) and worded.schema.simpleString() == found.schema.simpleString()
    lockfiles = flat(audited(Tables(tables.files, advisories=tables.advisories, osv_vulns=tables.osv_vulns), also=metadata_text()).findings.where("verifier_id = 'cve'"))
    lines = lockfiles._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [lines[i - 1] for i, line in enumerate(lines) if "Join Inner" in line and "repo" in lines[i - 1]]
    # Nothing reads the map above the joins with the packages.
    assert len(above) == 2 and not any("map_entries" in line for line in above) and any("map_entries" in line for line in lines)


@pytest.mark.parametrize("ai_priority", [False, True])
def test_rules_are_described_without_bringing_findings_together(tables, ai_priority):
    found, some = audited(tables).findings, audited(tables, form=DESCRIBED).findings
    assert collected(fnd.rule_descriptors(some, VERIFIERS, ai_priority)) == collected(fnd.rule_descriptors(found, VERIFIERS, ai_priority))
    # In the repository with one version of its package, only the rule that two packages have is grouped.
    assert {(r.repo, r.alone) for r in some.where("repo = 'one' AND rule_id <> 'cve.rust.A-2'").select("repo", "alone").collect()} == {("one", True)}
    assert {r.alone for r in some.where("rule_id IN ('cve.rust.A-2', 'secrets.aws-access-token')").collect()} == {False}


@pytest.mark.parametrize("ai_priority", [False, True])
def test_reports_list_findings_where_they_are(tables, ai_priority):
    done = audited(tables, several=True)
    found = done.findings_as(firsts=fnd.first_places(done.findings_as(FIRST), ai_priority))
    # The first of equal findings has no comma, its copies have one.
    lines = reports.json_lines(found, done.runs, VERIFIERS, ai_priority=ai_priority)
    assert collected(lines) == collected(reports.json_lines(done.findings, done.runs, VERIFIERS, ai_priority=ai_priority))
    for repo in ("r", "one", "clean"):
        rows = lines.where(F.col("repo") == repo).orderBy("place").collect()
        listed = json.loads("".join(r.line for r in rows))["findings"]
        assert len(listed) == done.findings.where(F.col("repo") == repo).count()
        keys = [(-(f.get("provenance_score") or 0) * ai_priority, -SEVERITIES[::-1].index(f["severity"]), f["location"]["path"], f["location"]["start_line"]) for f in listed]
        assert keys == sorted(keys)
    whole = reports.sarif_lines(done.findings, done.runs, VERIFIERS, ai_priority)
    assert collected(reports.sarif_lines(found, done.runs, VERIFIERS, ai_priority, described=done.findings_as(DESCRIBED))) == collected(whole)
    text = reports.text_lines(done.findings, done.runs, 5, ai_priority, counted=done.findings_as(COUNTED))
    assert collected(text) == collected(reports.text_lines(done.findings, done.runs, 5, ai_priority))


def test_reports_do_not_move_findings(tables):
    """No line but the few at the first place is shuffled or sorted after packages have met what is said of them."""
    done = audited(tables, several=True)
    found = done.findings_as(firsts=done.findings.sparkSession.createDataFrame([], fnd.first_places(done.findings).schema))
    lines = reports.json_lines(found, done.runs, VERIFIERS).where("place.section = 1")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [repo" not in plan.split("Join")[0] and plan.count("row_number") >= 1
    text = reports.text_lines(done.findings, done.runs).where("place.section = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in text.split("Join")[0]


def test_a_small_table_of_advisories_is_spread(spark, tables, tmp_path):
    tables.advisories.coalesce(1).write.parquet(str(tmp_path / "advisories"))
    packages = spark.createDataFrame([(f"r{i}", "Cargo.lock", "Rust", "a", "1.0.0") for i in range(9)], "repo string, lockfile_path string, ecosystem string, name string, version string")
    found = vulnerabilities.advisory_findings(packages, spark.read.parquet(str(tmp_path / "advisories")))
    assert found.count() == 9 * 41
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Requirements are read (their arrays transformed) above the exchange, and nothing brings its partitions together again.
    assert "REPARTITION_BY_NUM" in plan and plan.index("AS safe") < plan.index("REPARTITION_BY_NUM")
