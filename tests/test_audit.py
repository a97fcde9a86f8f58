import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import findings as fnd
from sparkwarden.operators import reports
from sparkwarden.plans.audit import VERIFIERS, AuditOptions, Tables, _ignore_lines, audit, audited, extract, run_table, selected

AWS = "AKIA" + "IOSFODNN7EXAMPLE"


@pytest.fixture
def tables(spark, files_of):
    files = files_of(
        ("ai.rs", f'// audit:ai\nlet k = "{AWS}";\n'), ("human.py", f'# audit:human\nk = "{AWS}"\n'), ("plain.go", f'k := "{AWS}"\n'),
        ("skip/a.rs", f'let k = "{AWS}";\n'), (".gitignore", "skip/\n"), ("go.sum", "example.org/a v1.0.0 h1:x=\n"), ("notes.md", AWS),
    ).unionByName(files_of(("ok.rs", "fn a() {}\n"), repo="clean"))
    osv = spark.createDataFrame([("Go", "example.org/a", "v1.0.0", "V-1", 0)], "ecosystem string, name string, version string, vuln_id string, fetched_at int")
    return Tables(files, osv_vulns=osv)


def keys(df):
    return sorted((r.location.path, r.rule_id, r.provenance_score) for r in df.collect())


def test_whole_audit(tables):
    assert keys(audit(tables)) == [
        ("ai.rs", "secrets.aws-access-token", 1.0), ("go.sum", "cve.go.V-1", None), ("human.py", "secrets.aws-access-token", 0.0),
    ]


def test_options(tables):
    def run(**options):
        return [k[0] for k in keys(audit(tables, AuditOptions(**options)))]

    assert run(ai_only=True, skip=["cve"]) == ["ai.rs"]
    assert run(use_ignore_files=False, verifiers=["secrets"]) == ["ai.rs", "human.py", "skip/a.rs"]
    assert run(languages=["python"], skip=["cve"]) == ["human.py"]
    assert run(exclude=["ai*"], skip=["cve"]) == ["human.py"]
    assert run(verifiers=["secrets", "cve"], skip=["secrets", "cve"]) == []
    assert [k[2] for k in keys(audit(tables, AuditOptions(detect=False, skip=["cve"])))] == [None, None]


def test_verifier_choice_and_isolation(tables):
    assert fnd.choose_verifiers({"a": True, "b": False}) == ["a"]
    assert fnd.choose_verifiers({"a": True, "b": False}, ["b"], ["a"]) == ["b"]

    def broken():
        return tables.files.select("no_such_column")

    with pytest.warns(UserWarning, match="broken"):
        assert fnd.run_verifiers({"broken": broken, "fine": lambda: tables.files}, ["broken", "fine"]) == [tables.files]
    bad = tables.files.withColumn("content", F.lit(None).cast("string"))
    assert fnd.unreadable_files(bad).count() == tables.files.count()


def test_order_counts_and_gate(tables):
    found = audit(tables)
    runs = run_table(tables)
    assert {r.repo: r.candidates_scanned for r in runs.collect()} == {"r": 3, "clean": 1}
    assert [r.severity for r in fnd.sort_findings(found).collect()] == ["critical", "critical", "high"]
    assert [r.location.path for r in fnd.sort_findings(found, ai_priority=True).collect()] == ["ai.rs", "human.py", "go.sum"]
    counts = {r.repo: (r.critical, r.high, r.medium, r.low, r.info) for r in fnd.counts_by_severity(found, runs).collect()}
    assert counts == {"r": (2, 1, 0, 0, 0), "clean": (0, 0, 0, 0, 0)}
    assert {r.repo: r.passed for r in fnd.gate(found, "high", runs).collect()} == {"r": False, "clean": True}
    assert {r.repo: r.passed for r in fnd.gate(found.where("severity = 'high'"), "critical", runs).collect()} == {"r": True, "clean": True}
    assert fnd.at_least(found, "critical").count() == 2


def documents(path):
    out = {}
    for folder in Path(path).iterdir():
        if folder.name.startswith("repo="):
            parts = sorted(folder.glob("part-*"))
            out[folder.name[5:]] = "".join(p.read_text() for p in parts)
    return out


def test_json_and_sarif_documents(tables, tmp_path):
    found, runs = audit(tables), run_table(tables)
    doubled = found.unionAll(found)  # equal findings must not break the list
    reports.write_lines(reports.json_lines(doubled, runs, VERIFIERS, duration_ms=7), str(tmp_path / "json"), folders=True)
    docs = {k: json.loads(v) for k, v in documents(tmp_path / "json").items()}
    assert docs["clean"]["findings"] == [] and docs["r"]["run"]["candidates_scanned"] == 3 and docs["r"]["run"]["duration_ms"] == 7
    assert [f["severity"] for f in docs["r"]["findings"]] == ["critical"] * 4 + ["high"] * 2
    assert "fix" not in docs["r"]["findings"][0] and docs["r"]["findings"][0]["location"]["start_line"] == 2

    reports.write_lines(reports.sarif_lines(doubled, runs, VERIFIERS), str(tmp_path / "sarif"), folders=True)
    docs = {k: json.loads(v) for k, v in documents(tmp_path / "sarif").items()}
    run = docs["r"]["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["secrets", "cve", "secrets.aws-access-token", "cve.go.V-1"]
    assert [r["level"] for r in run["results"]] == ["error"] * 6
    first = run["results"][0]
    assert first["properties"]["audit"] == {"verifier_id": "secrets", "provenance_score": 1.0, "ai_likely": True}
    assert first["locations"][0]["physicalLocation"]["region"]["startLine"] == 2
    assert docs["clean"]["runs"][0]["results"] == []


def test_text_report(tables, tmp_path):
    found, runs = audit(tables), run_table(tables)
    reports.write_lines(reports.text_lines(found, runs, duration_ms=1234), str(tmp_path / "text"), folders=True)
    docs = documents(tmp_path / "text")
    assert docs["clean"].splitlines()[0].endswith("scanned 1 file(s) in 1.23s") and docs["clean"].rstrip().endswith("0 findings")
    assert docs["r"].rstrip().endswith("2 critical · 1 high · 0 medium · 0 low · 0 info")
    assert "CRITICAL  ai.rs:2      secrets.aws-access-token" in docs["r"]


def test_table_sinks(tables, tmp_path):
    found = audit(tables)
    reports.write_findings(found, str(tmp_path / "t"), folders=True)
    reports.write_findings(found, str(tmp_path / "one"))
    lines = reports.text_lines(found, fnd.candidate_counts(found))
    reports.write_lines(lines, str(tmp_path / "lines"))
    spark = found.sparkSession
    assert spark.read.parquet(str(tmp_path / "t")).where("repo = 'r'").count() == 3
    assert keys(spark.read.parquet(str(tmp_path / "one"))) == keys(found)
    assert spark.read.parquet(str(tmp_path / "lines")).columns == ["repo", "place", "line"]
    reports.write_json(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert os.path.isdir(tmp_path / "t" / "repo=r")


def test_partitioning_does_not_matter(tables):
    one = Tables(tables.files.repartition(1), osv_vulns=tables.osv_vulns)
    many = Tables(tables.files.repartition(16), osv_vulns=tables.osv_vulns)
    assert keys(audit(one)) == keys(audit(many))


def test_text_is_read_once(spark, tables, tmp_path):
    # After the extract no plan reads file text again: neither findings, nor counts, nor errors.
    tables.files.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    done = audited(Tables(files, osv_vulns=tables.osv_vulns))
    for df in (done.findings, done.runs, done.errors):
        assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_are_selected_before_their_text_is_searched(spark, tables, tmp_path):
    tables.files.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    options = AuditOptions()
    chosen = selected(Tables(files), options, _ignore_lines(Tables(files), options))
    assert sorted(r.path for r in chosen.where("candidate").collect()) == ["ai.rs", "human.py", "ok.rs", "plain.go"]
    plan = extract(chosen, options, True)._jdf.queryExecution().optimizedPlan().toString()
    # The join with the selection stands below the first search of the text.
    assert plan.index("regexp") < plan.index("Join") < plan.rindex("Relation")


def test_staged_errors_and_as_of(spark, tables, files_of):
    touched = spark.createDataFrame([("r", "s1", "human.py", "M", True), ("r", "s1", "ai.rs", "D", True)], "repo string, sha string, path string, status string, staged boolean")
    staged = Tables(tables.files, commit_files=touched, osv_vulns=tables.osv_vulns)
    assert [k[0] for k in keys(audit(staged, AuditOptions(staged=True, skip=["cve"])))] == ["human.py"]
    bad = tables.files.where("path <> '.gitignore'").unionByName(files_of((".gitignore", "[a\nskip/\n"), ("bad.rs", None), ("yarn.lock", "")))
    done = audited(Tables(bad))
    assert sorted((r.path, r.verifier_id) for r in done.errors.collect()) == [(".gitignore", "discovery"), ("bad.rs", "secrets"), ("yarn.lock", "cve")]
    assert "skip/a.rs" not in [k[0] for k in keys(done.findings)]


def test_user_verifiers(spark, files_of):
    from sparkwarden.operators import lockfiles
    from sparkwarden.plans.audit import DEAD_CODE, audited, unresolved_import_verifier, verifiers_of

    files = files_of(("a.py", "import ghost\ndef _f():\n    pass\n"), ("b.txt", "todo"), ("c.py", "# todo\n"))
    todo = fnd.UserVerifier(
        "todo", "Things to do",
        lambda f: f.where(F.contains("content", F.lit("todo"))).select("repo", "path", F.lit("todo.any").alias("rule_id"), F.lit("low").alias("severity")),
    )
    options = AuditOptions(user_verifiers=[todo, DEAD_CODE, unresolved_import_verifier(lockfiles.all_packages(files))])
    found = audited(Tables(files), options).findings
    assert found.schema.simpleString() == audit(Tables(files)).schema.simpleString()
    assert sorted((r.verifier_id, r.rule_id, r.location.path, r.location.start_line, r.provenance_score is None) for r in found.collect()) == [
        ("deadcode", "deadcode.unused-function", "a.py", 2, False), ("hallucination", "hallucination.unresolved-import", "a.py", None, False),
        ("todo", "todo.any", "c.py", None, False),
    ]
    assert set(verifiers_of(options)) == {"secrets", "cve", "todo", "deadcode", "hallucination"}
    only = AuditOptions(user_verifiers=[todo, DEAD_CODE], verifiers=["todo"], detect=False)
    assert [(r.rule_id, r.provenance_score) for r in audit(Tables(files), only).collect()] == [("todo.any", None)]
    with pytest.raises(ValueError, match="differ"):
        audit(Tables(files), AuditOptions(user_verifiers=[todo, todo]))
    bad = {"columns missing": lambda f: f.select("repo"), "unknown": lambda f: f.selectExpr("repo", "path", "'x' rule_id", "'low' severity", "1 AS odd"),
           "wrong types": lambda f: f.selectExpr("repo", "path", "1 AS rule_id", "'low' severity")}
    for text, find in bad.items():
        with pytest.raises(ValueError, match=text):
            fnd.checked_findings(find(files), "x")
        with pytest.warns(UserWarning, match="verifier x"):
            assert audit(Tables(files), AuditOptions(user_verifiers=[fnd.UserVerifier("x", "d", find)], skip=["secrets"], detect=False)).count() == 0
    for rule, severity in (("other.rule", "low"), ("x.rule", "urgent"), (None, "low")):
        rows = fnd.checked_findings(files.select("repo", "path", F.lit(rule).cast("string").alias("rule_id"), F.lit(severity).alias("severity")), "x")
        with pytest.raises(Exception, match="not its own rule"):
            rows.collect()


def test_dependency_findings_get_scores_with_their_packages(spark, files_of):
    """Scores meet the packages, not the findings: nothing above the advisory join is shuffled any more."""
    files = files_of(("Cargo.lock", '[[package]]\nname = "a"\nversion = "1.0.0"\n'), ("audit.rs", "// audit:ai\n"))
    locks = files_of(("Cargo.lock", '# audit:ai\n[[package]]\nname = "a"\nversion = "1.0.0"\n'), repo="ai")
    advisories = spark.createDataFrame(
        [(f"A-{i}", "Rust", "a", "flaw", None, None, ["^2.0.0"], []) for i in range(3)],
        "advisory_id string, ecosystem string, package string, title string, cvss double, url string, patched array<string>, unaffected array<string>",
    )
    commits = spark.createDataFrame([("r", "s"), ("ai", "s")], "repo string, sha string")
    commits = commits.selectExpr("repo", "sha", "'d' author", "timestamp'2024-01-01 10:00:00' author_ts", "10 author_hour", "'x' message")
    touched = commits.selectExpr("repo", "sha", "'Cargo.lock' path", "'M' status", "1 additions", "0 deletions", "true staged")
    found = audit(Tables(files.unionByName(locks), commits, touched, advisories), AuditOptions(staged=True, verifiers=["cve"]))
    rows = sorted((r.repo, r.rule_id, r.provenance_score) for r in found.collect())
    assert rows == [(repo, f"cve.rust.A-{i}", score) for repo, score in (("ai", 1.0), ("r", 0.0)) for i in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_findings_on_hunks_are_tested_before_advisories(spark, files_of):
    """The same findings as with the test afterwards, but only packages and secrets meet the hunks."""
    lock = '[[package]]\nname = "a"\nversion = "1.0.0"\n'
    files = files_of(("Cargo.lock", lock), ("a.rs", f'let k = "{AWS}";\nlet l = "{AWS}";\n')).unionByName(files_of(("Cargo.lock", lock), repo="other"))
    osv = spark.createDataFrame([("Rust", "a", "1.0.0", f"V-{i}", 0) for i in range(3)], "ecosystem string, name string, version string, vuln_id string, fetched_at int")
    hunks = spark.createDataFrame(
        [("r", "Cargo.lock", 0, 2), ("r", "Cargo.lock", 1, 5), ("r", "a.rs", 2, 3), ("other", "Cargo.lock", 2, 9)], "repo string, path string, start_line int, end_line int"
    )
    before = keys(fnd.on_changed_lines(audit(Tables(files, osv_vulns=osv)), hunks))
    found = audit(Tables(files, osv_vulns=osv, hunks=hunks))
    assert keys(found) == before and [k[1] for k in before] == ["cve.rust.V-0", "cve.rust.V-1", "cve.rust.V-2", "secrets.aws-access-token"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
