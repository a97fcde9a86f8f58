from dataclasses import replace

from sparkwarden.operators import secrets as sec
from sparkwarden.sources.rules import STARTER_RULES, SecretRule, load_rules, rules_frame, skipped_frame

# Documented example key of the vendor; no live credential.
AWS = "AKIA" + "IOSFODNN7EXAMPLE"
WILD = "Xk2Yz9qP4mT7nR8sL1cW3vF5jB6gH0aD"


def found(files, options=None):
    rows = sec.secret_findings(files, options).select("location.path", "rule_id", "severity", "location.start_line", "location.start_col").collect()
    return sorted((r.path, r.rule_id.removeprefix("secrets."), r.severity, r.start_line, r.start_col) for r in rows)


def test_rules_and_literals(files_of):
    files = files_of(
        ("clean.rs", 'pub fn greet(n: &str) -> String {\n    format!("Hi, {n}!")\n}\n'),
        ("key.rs", f'// demo\npub fn go() {{\n    let id = "{AWS}";\n}}\n'),
        ("pat.ts", '// demo\nexport const v: string = "ghp_Zq83kLw0PvTn5XsRy7AdJm2HcGbUe6FoIiQtNx";\n'),
        ("pem.py", f'# demo\nV = """-----BEGIN RSA PRIVATE KEY-----\n{WILD * 2}\n-----END RSA PRIVATE KEY-----"""\n'),
        ("wild.rs", f'// demo\n//\npub fn v() -> &\'static str {{\n    "{WILD}"\n}}\n'),
    )
    assert found(files) == [
        ("key.rs", "aws-access-token", "critical", 3, 15),
        ("pat.ts", "generic-high-entropy", "medium", 2, 26),
        ("pat.ts", "github-pat", "critical", 2, 27),
        ("pem.py", "generic-high-entropy", "medium", 2, 5),
        ("pem.py", "private-key", "critical", 2, 8),
        ("wild.rs", "generic-high-entropy", "medium", 4, 5),
    ]


def test_comment_and_allow_markers(files_of):
    files = files_of(
        ("comment.rs", f"// Example: {AWS}\nfn main() {{}}\n"),
        ("all.rs", f'let e = "{AWS}"; // audit:allow secrets\n'),
        ("own.rs", f'let e = "{AWS}"; // audit:allow secrets.jwt, secrets.aws\n'),
        ("other.rs", f'let e = "{AWS}"; // audit:allow secrets.jwt\n'),
        ("next.rs", f'// audit:allow secrets\nlet e = "{AWS}";\n'),
        ("string.py", f'u = "http://x/{AWS}"  # note\n'),
    )
    assert {f[0] for f in found(files)} == {"other.rs", "next.rs", "string.py"}
    assert found(files, sec.SecretOptions(prefix="other")) != found(files)
    assert found(files, sec.SecretOptions(allowlist=["aws"])) == []


def test_unknown_language_has_no_context(files_of):
    files = files_of(("notes.txt", f"# {AWS}\n'{WILD}'\n"))
    assert [f[1] for f in found(files)] == ["aws-access-token"]


SAMPLES = {
    "private-key": "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----",
    "aws-access-token": AWS,
    "gcp-service-account": '"type": "service_account"',
    "azure-storage": "AccountKey=" + ("Ab1+" * 22)[:86] + "==",
    "github-pat": "ghp_" + (WILD * 2)[:36],
    "github-fine-grained-pat": "github_pat_" + (WILD * 3)[:82],
    "github-oauth": "gho_" + (WILD * 2)[:36],
    "github-app-token": "ghs_" + (WILD * 2)[:36],
    "stripe-access-token": "sk_" + "test_" + WILD,
    "vault-service-token": "hvs." + (WILD * 3)[:95],
    "vault-batch-token": "hvb." + (WILD * 5)[:140],
    "sendgrid": "SG." + WILD[:22] + "." + (WILD * 2)[:43],
    "pypi-upload-token": "pypi-AgEIcHlwaS5vcmc" + (WILD * 2)[:60],
    "shopify-shared-secret": "shpss_" + "0123456789abcdef" * 2,
    "new-relic": "NRAK-" + (WILD * 2).upper()[:27],
    "doppler": "dp.pt." + (WILD * 2)[:43],
    "readme": "rdme_" + (WILD * 3).lower()[:70],
    "duffel": "duffel_test_" + (WILD * 2)[:43],
    "slack-bot-token": "xoxb-" + "1234567890" + "-" + "0987654321" + "-abcdEFGH",
    "gitlab-pat": "glpat-" + WILD[:20],
    "npm-access-token": "npm_" + (WILD * 2)[:36],
    "gcp-api-key": "AIza" + (WILD * 2)[:35],
    "jwt": "eyJ" + WILD[:12] + ".eyJ" + WILD[3:16] + "." + WILD[:20],
    "generic-api-key": f'PaſſWD_x: "{WILD}"'.replace("ſſ", "ss"),
}


def test_each_rule_has_a_match(files_of):
    assert set(SAMPLES) == {r.rule_id for r in STARTER_RULES}
    files = files_of(*[(f"{name}.txt", f"value\n {text} \n") for name, text in SAMPLES.items()])
    hits = {(f[0].removesuffix(".txt"), f[1]) for f in found(files)}
    assert {(name, name) for name in SAMPLES} <= hits


def test_keyword_folding_covers_the_long_s(files_of):
    files = files_of(("a.txt", f'paſſword = "{WILD}"'))
    assert [f[1] for f in found(files)] == ["generic-api-key"]


def test_many_matches_in_one_file(files_of):
    ids = [AWS[:-4] + f"{i:04d}" for i in range(3000)]
    text = "".join(f'// c{i} "\nlet a{i} = "{v}"; let s{i} = "x";\n' for i, v in enumerate(ids))
    files = files_of(("many.rs", text))
    got = [f for f in found(files) if f[1] == "aws-access-token"]
    assert got == [("many.rs", "aws-access-token", "critical", 2 * i + 2, len(f'let a{i} = "') + 1) for i in range(3000)]


def test_partitioning_does_not_matter(files_of):
    files = files_of(*[(f"f{i}.py", f'k{i} = "{AWS}"\nt = "{WILD}"  # audit:allow secrets.jwt\n') for i in range(40)])
    assert found(files.repartition(1)) == found(files.repartition(16))


def test_long_literals_do_not_overflow(files_of):
    files = files_of(("a.ts", "const a = `" + "x" * 400_000 + "`;\n/*" + "y" * 300_000 + "*/\n"), ("b.py", '"' + "\\n" * 200_000 + '"\n'))
    assert found(files) == []


def test_rule_file(spark, files_of):
    text = """
[[rules]]
id = "corp-token"
description = "Corp token"
regex = '''(?P<t>corp_[[:alnum:]]{8})(?:\\s|$)'''
entropy = 1.5
keywords = ["CORP_"]
[[rules]]
id = "only-path"
path = '''x'''
[[rules]]
id = "broken"
regex = '''a('''
"""
    rules, skipped = load_rules(spark, text)
    assert [r.rule_id for r in rules] == ["corp-token"]
    assert [s[0] for s in skipped] == ["only-path", "broken"] and skipped[0][1] == "path-only"
    assert skipped_frame(spark, skipped).count() == 2
    assert load_rules(spark, "not = [toml")[0] == []
    options = sec.SecretOptions(rules=rules, literals=False)
    files = files_of(("a.py", "x = 1\ncorp_12345678\n"), ("b.py", "corp_1111aaaa"), ("c.py", "corp_12345678x corp_11111111"))
    assert found(files, options) == [
        ("a.py", "corp-token", "high", 2, 1), ("b.py", "corp-token", "high", 1, 1), ("c.py", "corp-token", "high", 1, 16),
    ]


def test_keywords_of_loaded_rules_do_not_filter(spark, files_of):
    rules, _ = load_rules(spark, """[[rules]]
id = "run"
regex = '''x{12}'''
entropy = 0
keywords = ["zzz"]
""")
    assert rules[0].entropy == 0.0 and rules_frame(spark, rules).first().entropy == 0.0
    options = sec.SecretOptions(rules=rules, literals=False)
    assert len(found(files_of(("a.py", "v = xxxxxxxxxxxx")), options)) == 1
    assert found(files_of(("a.py", "v = xxxxxxxxxxxx")), sec.SecretOptions(rules=[replace(rules[0], prefilter=True)], literals=False)) == []
    assert load_rules(spark, "[[rules]]\nregex = '''a'''\n")[0] == []


def test_many_loaded_rules(spark, files_of):
    text = "".join(f"[[rules]]\nid = \"r-{i}\"\nregex = '''tok{i}_[0-9a-f]{{8}}'''\n" for i in range(120))
    rules, skipped = load_rules(spark, text)
    assert len(rules) == 120 and not skipped
    assert len(found(files_of(("a.py", "tok7_0123abcd tok119_deadbeef")), sec.SecretOptions(rules=rules, literals=False))) == 2


def test_rules_sharing_an_id_are_deduplicated(files_of):
    rules = [SecretRule("x", "first", "ab+"), SecretRule("x", "second", "abb")]
    files = files_of(("a.py", "abbb\n"))
    assert len(found(files, sec.SecretOptions(rules=rules, literals=False))) == 1


def test_unreadable_files_give_nothing(spark):
    files = spark.createDataFrame([("r", "a.rs", "rust", None)], "repo string, path string, language string, content string")
    assert found(files) == []
    assert sec.scan_secrets(files).collect()[0].secrets == []


def test_doubled_findings_come_from_one_scan(spark, tmp_path):
    from sparkwarden.plans.all_queries import QUERIES

    spark.range(12, 600).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["deduplicated_findings"](spark, str(tmp_path))
    assert "content#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == QUERIES["secret_findings"](spark, str(tmp_path)).distinct().count() > 0
