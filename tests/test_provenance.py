import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import provenance as prov


def signal(files_of, name, content, path="a.rs"):
    return prov.text_signals(files_of((path, content))).collect()[0][name]


def test_weights_sum_to_one():
    assert sum(prov.WEIGHTS.values()) == pytest.approx(1.0)


@pytest.mark.parametrize(
    "message,want",
    [("feat: x\n\nCo-Authored-By: Claude <bot@example.org>", 1.0), ("🤖 Generated with some tool", 1.0), ("generated with the help of Claude", 1.0),
     ("via CURSOR.com", 1.0), ("GitHub-Copilot did it", 1.0), ("fix: typo in readme", 0.0), ("", 0.0), ("generated with\nclaude", 0.0)],
)
def test_commit_msg(spark, message, want):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(prov.commit_msg(F.col("m")).alias("x")).collect()[0].x == want


def test_commit_size_and_hour(spark):
    df = spark.createDataFrame([(50, 14), (199, 8), (200, 22), (350, 7), (500, 23), (1000, None)], "a int, h int")
    rows = df.select(prov.commit_size(F.col("a")).alias("s"), prov.time_of_day(F.col("h")).alias("t")).collect()
    assert [r.s for r in rows] == [0.0, 0.0, 0.0, 0.5, 1.0, 1.0]
    assert [r.t for r in rows] == [0.0, 0.0, 0.0, 1.0, 1.0, 0.0]


def test_docstring_ratio(files_of):
    assert signal(files_of, "docstring_ratio", "fn add(a: i32) -> i32 {\n    a\n}\n") == 0.0
    heavy = "".join(f"/// line {i} of a long note\n" for i in range(13)) + "fn add(a: i32) {}\n"
    assert signal(files_of, "docstring_ratio", heavy) == 1.0
    # 4 bytes of 20 are 20 %: half way up the ramp
    assert signal(files_of, "docstring_ratio", "/**/" + "x" * 16, "a.js") == pytest.approx(0.5)
    assert signal(files_of, "docstring_ratio", "x" * 16 + "/** ", "a.js") == pytest.approx(0.5)
    assert signal(files_of, "docstring_ratio", "'''abc'''" + '"""' + "x" * 24, "a.py") == pytest.approx((9 / 36 - 0.1) / 0.2)
    assert signal(files_of, "docstring_ratio", "/// go\n", "a.go") == 0.0
    assert signal(files_of, "docstring_ratio", "") == 0.0


def test_null_density(files_of):
    assert signal(files_of, "null_density", "fn main() { if 1 == 1 { go(); } }") == 0.0
    assert signal(files_of, "null_density", "if a.is_none() {}\nif b == None {}\nif c.is_some() {}\nif d.is_none() {}\n") == 1.0
    assert signal(files_of, "null_density", "if a != null {}\nx?.y\n") == 0.0
    assert signal(files_of, "null_density", "a ?? b\n" + "if x {}\n" * 5) == pytest.approx(0.5)


def test_marketing_comments(files_of):
    assert signal(files_of, "marketing_comments", "fn f() {}") == 0.0
    assert signal(files_of, "marketing_comments", "// ROBUST and Scalable, seamlessly") == 1.0
    assert signal(files_of, "marketing_comments", "// best practices") == pytest.approx(1 / 3)


def test_imports(files_of):
    files = files_of(
        ("a.rs", "use std::sync::Arc;\nuse a::b as c ;\nuse x::{y, z};\npub use q::w;\n  use i::j;\n"),
        ("a.ts", 'import { A, B as C , } from "x";\nimport D from \'y\';\nimport * as E from "z";\n'),
        ("a.py", "import os\nfrom a.b import c as d, e\nimport x.y as z\nfrom m import (p,\n  q)\n"),
        ("a.go", 'import "fmt"\n'),
    )
    rows = prov.imports(files).collect()
    names = {p: [r.name for r in rows if r.path == p] for p in ("a.rs", "a.ts", "a.py", "a.go")}
    assert names == {"a.rs": ["Arc", "c"], "a.ts": ["A", "B", "D"], "a.py": ["os", "c", "e", "x.y", "(p"], "a.go": []}


def test_unused_imports(files_of):
    assert signal(files_of, "unused_imports", "fn main() {}") == 0.0
    used = "use std::collections::HashMap;\nfn main() { let _: HashMap<i32, i32> = HashMap::new(); }"
    assert signal(files_of, "unused_imports", used) == 0.0
    assert signal(files_of, "unused_imports", "use a::Ab;\nuse a::Cd;\nuse b::Ef;\nuse c::Gh;\nfn main() { Ab::x(); }\n") == 1.0


def test_function_variance(files_of):
    body = "    let x = 1;\n    let y = 2;\n    x + y;\n}\n"
    assert signal(files_of, "function_variance", "fn one() {}") == 0.0
    assert signal(files_of, "function_variance", "".join(f"fn {n}() {{\n{body}" for n in "abc")) == 1.0
    assert signal(files_of, "function_variance", "fn a() {}\nfn b() {}\nfn c() {}\n") == 0.0
    table = prov.functions(files_of(("a.rs", f"use x;\n\nfn a() {{\n{body}pub(crate) fn no() {{}}\nasync fn b() {{}}\n")))
    # the blank line before the first function belongs to it
    assert [(r.start_line, r.n_lines) for r in table.orderBy("start_line").collect()] == [(1, 7), (8, 1)]


def test_score_and_override(spark, files_of):
    files = files_of(("a.rs", "fn a() {}\n"), ("ai.rs", "// audit:ai audit:human\n"), ("human.py", "# audit:human\n"), ("late.rs", "fn b() {}\n"))
    commits = spark.createDataFrame(
        [("r", "s1", "d", "2024-01-01 10:00:00", 10, "Generated with Claude"), ("r", "s2", "d", "2024-02-01 03:00:00", 3, "fix")],
        "repo string, sha string, author string, author_ts string, author_hour int, message string",
    ).withColumn("author_ts", F.col("author_ts").cast("timestamp"))
    touched = spark.createDataFrame(
        [("r", "s1", "a.rs", "A", 350), ("r", "s1", "late.rs", "A", 900), ("r", "s2", "late.rs", "M", 100), ("r", "s2", "late.rs", "M", 250)],
        "repo string, sha string, path string, status string, additions int",
    )
    scores = {r.path: r.score for r in prov.provenance(files, commits, touched).collect()}
    assert scores == {"a.rs": 0.45, "ai.rs": 1.0, "human.py": 0.0, "late.rs": 0.1}
    assert [r.path for r in prov.likely_generated(prov.provenance(files, commits, touched)).collect()] == ["ai.rs"]
    last = {r.path: (r.sha, r.additions) for r in prov.last_commits(commits, touched).collect()}
    assert last == {"a.rs": ("s1", 350), "late.rs": ("s2", 350)}
    long = prov.signals_long(prov.provenance(files, commits, touched)).where("path = 'late.rs'").collect()
    assert sum(r.contribution for r in long) == pytest.approx(0.1)


def test_no_text_means_no_score(spark):
    files = spark.createDataFrame([("r", "a.rs", "rust", None)], "repo string, path string, language string, content string")
    assert prov.provenance(files).collect()[0].score is None


def test_unresolved_imports(spark, files_of):
    from sparkwarden.operators import imports, lockfiles

    files = files_of(
        ("a.py", "import os, x\nfrom quill_pad.core import y\nimport ghost\nfrom .near import z\nimport util\n"),
        ("src/b.ts", "import a from './a';\nimport { b } from \"@s/p/sub\";\nconst c = require('vanished');\nimport 'fs';\n"),
        ("src/c.rs", "use std::fmt;\nuse crate::a;\nuse fable::b;\nuse serde_x::C;\n"),
        ("util.go", ""), ("requirements.txt", "Quill-Pad==1.0\n"), ("Cargo.lock", '[[package]]\nname = "serde-x"\nversion = "1.0.0"\n'),
        ("package-lock.json", '{"packages":{"node_modules/@s/p":{"version":"1.0.0"}}}'), ("near.py", ""),
    )
    got = imports.unresolved_imports(files, lockfiles.all_packages(files)).collect()
    assert sorted((r.path, r.module) for r in got) == [
        ("a.py", "ghost"), ("a.py", "util"), ("a.py", "x"), ("src/b.ts", "vanished"), ("src/c.rs", "fable"),
    ]


def test_unresolved_imports_of_every_form(spark, files_of):
    from sparkwarden.operators import imports, lockfiles

    files = files_of(
        ("a.py", "import os, ghost.sub as g, \\\n    spook\nimport sys; import wisp\ntry: import shade\nexcept ImportError: pass\nimport util\nimport mine, pkg\n"),
        ("b.py", "from os import path, name\nfrom . import near\nfrom far.off import (x,\n  y)\n# say: import nothing\nx = 'a; import nothing'\n"),
        ("c.js", "const a = import('lazy');\nimport(/* webpackChunkName: \"n\" */ `late`);\nimport x from\"tight\";\nimport(`${x}`);\nimport('./near');\n"),
        ("d.rs", "use one;\nextern crate two;\npub(crate) use {three::{a, b::{c}}, four as f, std::fmt::{self, Debug}};\nuse ::five::x;\n"
                 "// no::comment\nconst S: &str = \"no::string \\\" no::more\"; const Q: char = '\"';\nmod inner { pub fn x() {} }\n"
                 "fn a() { six::run(); inner::x(); f::g(); fmt::format(); u8::MAX; x.iter().collect::<Vec<_>>(); Vec::new(); ::seven::y(); own::z(); b::h(); }\n"
                 "#[eight::main]\nfn b() { std::mem::take(); }\n"),
        ("src/own/lib.rs", ""), ("util.go", ""), ("wisp/x.go", ""), ("mine.py", ""), ("pkg/m.py", ""),
    )
    got = {}
    for r in imports.unresolved_imports(files, lockfiles.all_packages(files)).collect():
        got.setdefault(r.path, []).append(r.module)
    assert {p: sorted(m) for p, m in got.items()} == {
        "a.py": ["ghost", "shade", "spook", "util", "wisp"], "b.py": ["far"], "c.js": ["late", "lazy", "tight"],
        "d.rs": ["eight", "five", "four", "one", "seven", "six", "three", "two"],
    }


def test_modules_are_looked_for_below_roots(spark, files_of):
    from sparkwarden.operators import imports, lockfiles

    files = files_of(
        ("a.py", "import util\nimport pkg.core, pkg.gone.deep\nfrom app_mod import x\nfrom tool import y\nimport Mixed_Case\n"),
        ("x/y/util.py", ""), ("src/pkg/core.py", "from . import z\nfrom .far import z\nfrom ..other import z\nfrom ... import q\nfrom ..missing.deep import w\n"),
        ("src/pkg/far.py", "import core\nimport util\n"), ("src/other/__init__.py", ""), ("svc/pyproject.toml", ""), ("svc/src/app_mod.py", ""),
        ("deep/tool.py", ""), ("mixed-case/m.py", ""), ("x/y/z.py", "import util\n"),
        ("m.js", "import a from 'widgets/b';\nimport c from 'own-pkg';\nimport d from 'nowhere/b';\n"), ("src/widgets/b.ts", ""),
        ("package.json", '{"name": "own-pkg"}'), ("Cargo.toml", '[package]\nname = "own-crate"\n'), ("main.rs", "use own_crate::a;\nuse not_own::b;\n"),
    )
    got = {}
    for r in imports.unresolved_imports(files, lockfiles.all_packages(files)).collect():
        got.setdefault(r.path, []).append(r.module)
    assert {p: sorted(m) for p, m in got.items()} == {
        "a.py": ["pkg.gone", "tool", "util"], "src/pkg/core.py": ["..missing"], "src/pkg/far.py": ["util"], "m.js": ["nowhere"], "main.rs": ["not_own"],
    }


def test_imports_of_very_long_texts(spark):
    import time

    from sparkwarden.operators import imports

    names = ", ".join(f"m{i}" for i in range(100_000))
    texts = [
        ("python", f"import {names}\n", 100_000), ("python", "y = " + "a" * 1_000_000 + "; import ghost\n", 1),
        ("python", "import " * 150_000, None), ("python", "from a" + ".a" * 400_000, None), ("python", "x = '" + "a" * 500_000 + "\nimport late\n", 1),
        ("rust", "use " + "a" * 1_000_000 + "-;", None), ("rust", "use " * 250_000, None), ("rust", "use a::" + "{b::" * 10_000 + "}" * 10_000 + ";", 1),
        ("rust", 'r#"' * 300_000, None), ("rust", "use {" + names.replace(", ", "::x, ") + "::x};", 100_000),
        ("javascript", "import " * 150_000, None), ("javascript", "import(" + "/* a */ " * 100_000 + "'late')", 1), ("javascript", "import `" * 120_000, None),
    ]
    rows = spark.createDataFrame([(i, x, t) for i, (x, t, _) in enumerate(texts)], "i int, language string, content string")
    rows = rows.repartition(len(texts), "i").cache()
    rows.count()
    for i, (language, text, want) in enumerate(texts):
        one = rows.where(F.col("i") == i).select(F.size(imports.imported_modules(F.col("content"), F.col("language"))))
        start = time.time()
        got = one.collect()[0][0]
        assert time.time() - start < 10, (i, language, text[:20])
        assert want is None or got == want, (i, got)
