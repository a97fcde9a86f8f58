import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import lockfiles as locks
from sparkwarden.operators import vulnerabilities as vul

CASES = {
    "package-lock.json": (
        '{"lockfileVersion":3,"packages":{"":{},"node_modules/treeline":{"version":"3.4.9"},"node_modules/a/node_modules/@s/p":{"version":"1.0.0"},'
        '"apps/web":{"version":"0.1.0"},"node_modules/none":{},"node_modules/":{"version":"1"}}}',
        {("treeline", "3.4.9"), ("@s/p", "1.0.0"), ("apps/web", "0.1.0")},
    ),
    "pnpm-lock.yaml": (
        "lockfileVersion: '6.0'\n\n/early@1.0.0:\n\npackages:\n\n  /treeline@3.4.9:\n    resolution: {}\n  /@s/p@1.0.0(peer@2.0.0):\n    dev: true\n"
        "  bare@1.0.0:\n  /noversion:\n  /@only:\n\nother:\n  /late@1.0.0:\n",
        {("treeline", "3.4.9"), ("@s/p", "1.0.0")},
    ),
    "yarn.lock": (
        '# yarn lockfile v1\n\ntreeline@^3.4.1, treeline@^3.0.0:\n  version "3.4.9"\n  resolved "x"\n\n"@s/p@^1.0.0":\n  version "1.0.0"\n  version "9.9.9"\n'
        '"odd":\n  version "7.0.0"\nberry@npm:1:\n  version: 2.0.0\n',
        {("treeline", "3.4.9"), ("@s/p", "1.0.0")},
    ),
    "poetry.lock": (
        '[[package]]\nname = "quillpad"\nversion = "5.1.2"\n\n[package.extras]\nversion = "no"\n\n[[package]]\nversion = \'0.8.3\'\nname = "mossgate"\n',
        {("quillpad", "5.1.2"), ("mossgate", "0.8.3")},
    ),
    "requirements.txt": (
        "quillpad==5.1.2\r\n mossgate==0.8.3 ; sys_platform == 'linux'\n# a==1\n-r other==1\nfernway>=2.1,<3\nx== 1.0\ny===1.0\nz[e]==2,<3\n\n",
        {("quillpad", "5.1.2"), ("mossgate", "0.8.3"), ("y", "=1.0"), ("z[e]", "2")},
    ),
    "go.sum": (
        "example.org/a v1.2.3 h1:x=\nexample.org/a v1.2.3/go.mod h1:y=\nexample.org/b\tv0.1.0   h1:z=\nshort\n",
        {("example.org/a", "v1.2.3"), ("example.org/b", "v0.1.0")},
    ),
    "Cargo.lock": ('version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.0-rc.1"\ndependencies = [\n "x",\n]\n', {("serde", "1.0.0-rc.1")}),
}


@pytest.mark.parametrize("name", CASES)
def test_parsers(files_of, name):
    text, want = CASES[name]
    rows = locks.all_packages(files_of((name, text))).collect()
    assert len(rows) == len(want) and {(r.name, r.version) for r in rows} == want


@pytest.mark.parametrize("name,text", [("package-lock.json", '{"packages": {"node_modules/a": {"version": "1"}'), ("package-lock.json", "[1]"), ("package-lock.json", '{"packages": {"node_modules/a": {"version": "1.0.0"}, "node_modules/b": {"version": 2}}}'), ("package-lock.json", '{"dependencies": {}}'), ("poetry.lock", '[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "b"\n'), ("yarn.lock", ""), ("go.sum", "\n"), ("pnpm-lock.yaml", "x: 1\n")])
def test_broken_lockfiles_give_nothing(files_of, name, text):
    assert locks.all_packages(files_of((name, text))).count() == 0


def test_first_useful_root_lockfile_wins(files_of):
    files = files_of(
        ("package-lock.json", "{"), ("yarn.lock", CASES["yarn.lock"][0]), ("sub/package-lock.json", CASES["package-lock.json"][0]),
        ("requirements.txt", CASES["requirements.txt"][0]), ("poetry.lock", CASES["poetry.lock"][0]),
    )
    chosen = {(r.ecosystem, r.lockfile_path) for r in locks.chosen_packages(files).collect()}
    assert chosen == {("npm", "yarn.lock"), ("PyPI", "poetry.lock")}


def packages(spark, *rows):
    return spark.createDataFrame([("r", "Cargo.lock", *row) for row in rows], "repo string, lockfile_path string, ecosystem string, name string, version string")


@pytest.mark.parametrize("salts", [1, 8])
def test_advisories(spark, salts):
    pk = packages(spark, ("Rust", "a", "1.0.0"), ("Rust", "a", "1.5.0"), ("Rust", "a", "2.0.0"), ("Rust", "b", "0.1.0"), ("Rust", "b", "odd"), ("npm", "a", "1.0.0"))
    adv = spark.createDataFrame(
        [("ADV-1", "Rust", "a", "Bad", 9.1, None, [">=2.0.0"], ["<1.2.0"]), ("ADV-2", "Rust", "b", "Worse", None, "u", [], None)],
        "advisory_id string, ecosystem string, package string, title string, cvss double, url string, patched array<string>, unaffected array<string>",
    )
    rows = vul.advisory_findings(pk, adv, salts).orderBy("rule_id").collect()
    assert [(r.rule_id, r.severity, r.message, r.location.snippet) for r in rows] == [
        ("cve.rust.ADV-1", "critical", "a 1.5.0: Bad (fixed in: >=2.0.0)", 'a = "1.5.0"'),
        ("cve.rust.ADV-2", "high", "b 0.1.0: Worse (no patched version available)", 'b = "0.1.0"'),
    ]
    assert rows[0].metadata == {"advisory_id": "ADV-1", "package": "a", "version": "1.5.0", "patched_versions": ">=2.0.0", "url": None}


def test_exact_versions_freshness_and_refresh(spark):
    at = dt.datetime(2024, 1, 2, 12)
    pk = packages(spark, ("npm", "a", "1"), ("npm", "a", "2"), ("Go", "m", "v1"), ("Go", "m", "v1"))
    vulns = spark.createDataFrame(
        [("npm", "a", "1", "V-1", at - dt.timedelta(hours=24)), ("npm", "a", "1", "V-2", at), ("Go", "m", "v1", "V-3", at - dt.timedelta(hours=24, seconds=1))],
        "ecosystem string, name string, version string, vuln_id string, fetched_at timestamp",
    )
    rows = vul.exact_findings(pk, vulns).collect()
    assert sorted(r.rule_id for r in rows) == ["cve.go.V-3", "cve.go.V-3", "cve.npm.V-2"]  # the later answer alone
    assert {r.severity for r in rows} == {"high"} and rows[0].location.path == "Cargo.lock"
    as_of = F.lit(at).cast("timestamp")
    assert sorted(r.vuln_id for r in vul.fresh(vulns, as_of).collect()) == ["V-1", "V-2"]
    assert sorted((r.name, r.version) for r in vul.to_refresh(pk, vulns, as_of).collect()) == [("a", "2"), ("m", "v1")]


def test_batches_are_full_and_even(spark):
    pk = spark.range(1234).select(F.lit("r").alias("repo"), F.lit("p").alias("lockfile_path"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "id").alias("name"), F.lit("1").alias("version"))
    batches = vul.lookup_batches(pk.union(pk))
    sizes = {r.batch: r["count"] for r in batches.groupBy("batch").count().collect()}
    assert sizes == {0: 500, 1: 500, 2: 234}
    assert vul.batch_requests(batches).where("n = 234 and body like '{\"queries\":[{\"package\":{\"name\":%'").count() == 1


def test_hot_package_join_is_whole(spark):
    pk = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("repo"), F.lit("go.sum").alias("lockfile_path"), F.lit("Go").alias("ecosystem"), F.lit("hot").alias("name"), F.lit("v1").alias("version"))
    vulns = spark.createDataFrame([("Go", "hot", "v1", f"V-{i}", 0) for i in range(3)], "ecosystem string, name string, version string, vuln_id string, fetched_at int")
    assert vul.exact_findings(pk, vulns, salts=16).count() == 15000


def test_last_answer_counts(spark):
    rows = [
        ("npm", "alpha", "1.0.0", "V-1", "2024-01-01 00:00:00"),
        ("npm", "alpha", "1.0.0", "V-1", "2024-01-02 00:00:00"),
        ("npm", "alpha", "1.0.0", "V-2", "2024-01-02 00:00:00"),
        ("npm", "beta", "2.0.0", "V-3", "2024-01-01 00:00:00"),
        ("npm", "beta", "2.0.0", None, "2024-01-02 00:00:00"),
        ("npm", "gamma", "3.0.0", "V-4", "2023-12-01 00:00:00"),
    ]
    answers = spark.createDataFrame(rows, "ecosystem string, name string, version string, vuln_id string, fetched_at string")
    answers = answers.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    as_of = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert {tuple(r) for r in vul.latest_answers(answers).select("name", "vuln_id").collect()} == {("alpha", "V-1"), ("alpha", "V-2"), ("gamma", "V-4")}
    assert {r.name for r in vul.latest_answers(answers, as_of).collect()} == {"alpha"}
    packages = spark.createDataFrame([("r", "p", "npm", n, v) for n, v in (("alpha", "1.0.0"), ("beta", "2.0.0"), ("gamma", "3.0.0"))], "repo string, lockfile_path string, ecosystem string, name string, version string")
    assert vul.exact_findings(packages, answers, as_of=as_of).count() == 2
    assert [r.name for r in vul.to_refresh(packages, answers, as_of).collect()] == ["gamma"]


def test_undated_answers_count_without_dated_ones(spark):
    rows = [("PyPI", "a", "1", "V1", None), ("PyPI", "a", "1", "V2", None), ("PyPI", "b", "1", "V3", None), ("PyPI", "b", "1", None, "2024-01-01")]
    answers = spark.createDataFrame(rows, "ecosystem string, name string, version string, vuln_id string, fetched_at string")
    answers = answers.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert sorted(r.vuln_id for r in vul.latest_answers(answers).collect()) == ["V1", "V2"]


def test_findings_are_worded_before_they_meet_the_packages(spark):
    from sparkwarden.operators import vulnerabilities as v

    packages = spark.createDataFrame(
        [("r1", "Cargo.lock", "Rust", "a", "1.0.0"), ("r2", "Cargo.lock", "Rust", "a", "1.0.0"), ("r2", "Cargo.lock", "Rust", "a", "1.0.0"), (None, "Cargo.lock", "Rust", "a", "2.0.0")],
        "repo string, lockfile_path string, ecosystem string, name string, version string",
    )
    advisories = spark.createDataFrame(
        [("A1", "Rust", "a", "bad", 9.8, "u", [">=2.0.0"], None)],
        "advisory_id string, ecosystem string, package string, title string, cvss double, url string, patched array<string>, unaffected array<string>",
    )
    found = v.advisory_findings(packages, advisories)
    assert sorted((r.repo, r.rule_id, r.severity, r.message, r.location.snippet, r.metadata["patched_versions"]) for r in found.collect()) == [
        (repo, "cve.rust.A1", "critical", "a 1.0.0: bad (fixed in: >=2.0.0)", 'a = "1.0.0"', ">=2.0.0") for repo in ("r1", "r2", "r2")
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join ") < plan.index("(fixed in: ")


def test_rollup_adds_up_counts(spark):
    from sparkwarden.operators.findings import severity_rollup

    rows = spark.createDataFrame([("r", "v", "low")] * 3 + [("r", "w", "high"), (None, "v", "low")], "repo string, verifier_id string, severity string")
    got = severity_rollup(rows)
    want = rows.rollup("repo", "verifier_id", "severity").count().withColumnRenamed("count", "n")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand") :]
