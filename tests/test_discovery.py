import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import discovery as disc
from sparkwarden.sources import commits as log
from sparkwarden.sources.files import as_files, read_tree


def paths(df):
    return sorted(r.path for r in df.collect())


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "main.rs": b"fn main() {}", "lib.py": b"print('hi')", "app.ts": b"export const x = 1;", "notes.md": b"# hi", "sub/util.rs": b"pub fn ok() {}",
        ".hidden/h.go": b"package h", "blob.rs": b"a" * 50 + b"\x00" + b"a" * 49, "late.rs": b"a" * 8192 + b"\x00", "bad.rs": b"\xff\xfe", "empty.rs": b"", "pkg/__init__.py": b"", ".gitignore": b"x\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.rs").symlink_to(tmp_path / "main.rs")
    return tmp_path


def test_tree_scan(spark, tree):
    files = read_tree(spark, str(tree), repo="r")
    known = disc.by_language(files)
    assert paths(known) == [".hidden/h.go", "app.ts", "bad.rs", "empty.rs", "late.rs", "lib.py", "main.rs", "pkg/__init__.py", "sub/util.rs"]
    assert [r.content for r in files.where("path = '.gitignore'").collect()] == ["x\n"]
    assert paths(disc.by_language(files, ["rust"]).where("content like '%fn%'")) == ["main.rs", "sub/util.rs"]
    assert [r.content for r in files.where("path = 'bad.rs'").collect()] == [None]
    assert {r.repo for r in read_tree(spark, str(tree)).where("path = 'util.rs'").collect()} == {"sub"}


@pytest.mark.parametrize("error", [PermissionError, FileNotFoundError, OSError])
def test_folders_that_cannot_be_listed(spark, tree, error):
    import pandas as pd
    from pyarrow import fs

    from sparkwarden.plans.audit import AuditOptions, Tables, audited
    from sparkwarden.sources import files as source

    class Broken:
        def get_file_info(self, selector):
            if selector.base_dir.endswith("/sub"):
                raise error("no")
            return fs.LocalFileSystem().get_file_info(selector)

    given = [pd.DataFrame({"folder": [f"{tree}/sub", f"{tree}/pkg"]})]
    run = source._list_folders(f"file://{tree}", opened=lambda uri: (Broken(), str(tree)))
    if error is OSError:
        with pytest.raises(OSError):
            list(run(given))
        return
    rows = pd.concat(run(given))
    reason = "folder not permitted" if error is PermissionError else "folder not found"
    assert rows[["rel", "kind"]].values.tolist() == [["sub", reason], ["pkg/__init__.py", "file"]]
    errors = source.tree_errors(spark.createDataFrame(rows), repo="r").collect()
    assert [tuple(r) for r in errors] == [("r", "sub", "files", reason)]
    table = source.tree_errors(spark.createDataFrame(rows), repo="r")
    done = audited(Tables(read_tree(spark, str(tree), repo="r"), file_errors=table), AuditOptions(detect=False))
    assert ("r", "sub", "files", reason) in [tuple(r) for r in done.errors.collect()]


@pytest.mark.parametrize("error", [PermissionError, FileNotFoundError, OSError])
def test_files_that_cannot_be_read(spark, tree, error):
    import pandas as pd
    from pyarrow import fs

    class Broken:
        def open_input_file(self, path):
            if path.endswith("__init__.py"):
                raise error(path)
            return fs.LocalFileSystem().open_input_file(path)

    (tree / "fine.py").write_text("x = 1\n")
    given = [pd.DataFrame({"full": [f"{tree}/pkg/__init__.py", f"{tree}/fine.py"], "rel": ["pkg/__init__.py", "fine.py"]})]
    from sparkwarden.plans.audit import AuditOptions, Tables, audited
    from sparkwarden.sources import files as source

    run = source._read_files(f"file://{tree}", opened=lambda uri: (Broken(), str(tree)))
    if error is OSError:
        with pytest.raises(OSError):
            list(run(given))
        return
    reason = "file not permitted" if error is PermissionError else "file not found"
    rows = pd.concat(run(given))
    assert rows.values.tolist() == [["pkg/__init__.py", None, reason], ["fine.py", b"x = 1\n", None]]
    read = spark.createDataFrame(rows, "rel string, content binary, problem string").selectExpr("'r' AS repo", "rel AS path", "content", "problem")
    bad = spark.createDataFrame([("r", "bad.py", b"\xff", None)], "repo string, path string, content binary, problem string")
    files = source.as_files(read.unionByName(bad))
    done = audited(Tables(files), AuditOptions(detect=False))
    assert sorted(tuple(r) for r in done.errors.collect()) == [
        ("r", "bad.py", "secrets", "not valid UTF-8"), ("r", "pkg/__init__.py", "secrets", reason),
    ]


def test_missing_root(spark):
    with pytest.raises(FileNotFoundError):
        read_tree(spark, "/nonexistent/root/xyz", repo="r")


def test_exclude(files_of):
    files = files_of(("a/b.rs", ""), ("a/c.py", ""), ("x[.rs", ""))
    assert paths(disc.not_excluded(files, ["*.py", "x["])) == ["a/b.rs"]
    assert len(paths(disc.not_excluded(files, []))) == 3


def test_ignore_files(files_of):
    files = files_of(
        (".gitignore", "# c\n*.log\n!keep.log\nbuild/\n/top.py\nsub/*.ts\n"), ("sub/.gitignore", "!x.log\n*.go\n"), ("deep/.ignore", "*.go\n"), (".auditignore", "*.rs\n!own.rs\n"),
        ("a.log", ""), ("keep.log", ""), ("sub/x.log", ""), ("build/keep.log", ""), ("sub/build/y.py", ""), ("top.py", ""), ("sub/top.py", ""), ("sub/a.ts", ""),
        ("sub/s/a.ts", ""), ("sub/m.go", ""), ("m.go", ""), ("deep/er/m.go", ""), ("z.rs", ""), ("own.rs", ""), ("build", ""),
    )
    rules = disc.ignore_rules(files)
    assert paths(disc.ignored_paths(files, rules)) == [
        "a.log", "build/keep.log", "deep/er/m.go", "sub/a.ts", "sub/build/y.py", "sub/m.go", "top.py", "z.rs",
    ]
    assert paths(disc.ignored_paths(files, disc.ignore_rules(files, respect_git=False))) == ["deep/er/m.go", "z.rs"]
    assert "z.rs" not in paths(disc.not_ignored(files, files, rules))
    assert paths(disc.ignored_paths(files, disc.ignore_rules(files, prefix="other", respect_git=False))) == ["deep/er/m.go"]


def test_change_sets(spark, files_of):
    files = files_of(("a.rs", ""), ("b.rs", ""), ("c.rs", ""), ("gone.rs", "")).unionByName(files_of(("q.rs", ""), repo="s"))
    commits = spark.createDataFrame([("r", "1", "2024-01-01"), ("r", "2", "2024-01-02"), ("r", "3", "2024-01-03"), ("s", "9", "2024-01-01")], "repo string, sha string, t string").select("repo", "sha", F.col("t").cast("timestamp").alias("author_ts"))
    touched = spark.createDataFrame(
        [("r", "1", "a.rs", "A", False), ("r", "1", "b.rs", "A", False), ("r", "2", "a.rs", "M", True), ("r", "2", "c.rs", "A", False), ("r", "2", "gone.rs", "A", False), ("r", "3", "gone.rs", "D", True)],
        "repo string, sha string, path string, status string, staged boolean",
    )
    refs = spark.createDataFrame([("r", "1"), ("s", "unknown")], "repo string, ref string")
    assert paths(disc.change_set(files, commits, touched, refs)) == ["a.rs", "c.rs", "q.rs"]
    assert [r.repo for r in disc.unknown_refs(commits, refs).collect()] == ["s"]
    assert paths(disc.staged_paths(files, touched)) == ["a.rs"]


def test_snapshots(files_of):
    old, new = files_of(("a", "1"), ("b", "1"), ("c", "1")), files_of(("a", "1"), ("b", "2"), ("d", "1"))
    assert sorted((r.path, r.status) for r in disc.compare_snapshots(old, new).collect()) == [("b", "M"), ("c", "D"), ("d", "A")]


def test_exported_history(spark, tmp_path):
    r, f = log.RECORD, log.FIELD
    text = (
        f"{r}s1{f}Ann{f}2024-03-01T23:30:00+09:00{f}feat: one\n\nbody\n{f}\n:000000 100644 0 a A\ta.rs\n:000000 100644 0 b A\tb.png\n10\t0\ta.rs\n-\t-\tb.png\n"
        f"{r}s2{f}Bob{f}2024-03-02T01:00:00+00:00{f}fix{f}\n:100644 100644 a c M100\ta.rs\n3\t2\ta.rs\n"
    )
    (tmp_path / "log.txt").write_text(text)
    raw = log.read_log(spark, str(tmp_path / "log.txt"), "r")
    rows = {c.sha: c for c in log.commits_of(raw).collect()}
    assert rows["s1"].author_hour == 23 and rows["s1"].message == "feat: one\n\nbody" and rows["s2"].author == "Bob"
    assert rows["s1"].author_ts < rows["s2"].author_ts
    touched = {(c.sha, c.path): (c.status, c.additions, c.deletions) for c in log.commit_files_of(raw).collect()}
    assert touched == {("s1", "a.rs"): ("A", 10, 0), ("s1", "b.png"): ("A", None, None), ("s2", "a.rs"): ("M", 3, 2)}


def test_histories_by_file_and_odd_records(spark, tmp_path):
    r, f = log.RECORD, log.FIELD
    quoted = '"caf\\303\\251 \\"x\\".rs"'
    big = "12345678901"
    for repo in ("one", "two.x"):
        text = f"{r}s{f}A{f}2024-03-01T10:00:00+00:00{f}m{f}\n:000000 100644 0 a A\t{quoted}\n{big}\t1\t{quoted}\n"
        (tmp_path / f"{repo}.log").write_text(text)
    rows = log.commit_files_of(log.read_log(spark, str(tmp_path))).collect()
    assert sorted((c.repo, c.path, c.status, c.additions) for c in rows) == [
        (repo, 'café "x".rs', "A", int(big)) for repo in ("one", "two.x")
    ]


def test_binary_and_utf8(spark):
    rows = spark.createDataFrame([("r", "a.rs", bytearray(b"ok")), ("r", "b.rs", bytearray(b"\x00")), ("r", "c.rs", None)], "repo string, path string, content binary")
    assert paths(as_files(rows)) == ["a.rs", "c.rs"]


def test_hostile_ignore_lines(spark, files_of):
    lines = ["[a", "x\\", "[z-a]*", "\\d.rs", "[a&&b].py", "[[].go", "q[!a-c]+.ts", "\\#no.js", "a{1}(b)$.rs", "deep/**/**/k.rs"]
    names = ["1.rs", "d.rs", "a.py", "&.py", "[.go", "qd+.ts", "qa+.ts", "#no.js", "a{1}(b)$.rs", "a1b.rs", "deep/a/b/k.rs", "zz.rs"]
    files = files_of((".gitignore", "\n".join(lines)), *[(n, "x") for n in names])
    rules = disc.ignore_rules(files)
    assert {r.pattern for r in rules.collect()} == set(lines) - {"[a", "x\\", "[z-a]*"}
    got = {r.path for r in disc.ignored_paths(files, rules).collect()}
    assert got == {"d.rs", "a.py", "&.py", "[.go", "qd+.ts", "#no.js", "a{1}(b)$.rs", "deep/a/b/k.rs"}
    from sparkwarden.functions.text import lines as split_lines

    rows = files.where("path = '.gitignore'").select("repo", "path", split_lines(F.col("content")).alias("lines"))
    errors = disc.invalid_ignore_rules(rows).orderBy("reason").collect()
    assert [(e.path, e.reason.split(" line ")[1].split(":")[0]) for e in errors] == [(".gitignore", "1"), (".gitignore", "2"), (".gitignore", "3")]


def test_backwards_glob_matches_nothing(spark, files_of):
    files = files_of(("z.rs", "x"), ("m1.rs", "x"))
    assert disc.not_excluded(files, ["[z-a]*"]).count() == 2
    assert disc.not_excluded(files, ["[a-z]*"]).count() == 0


def test_histories_of_many_repositories_in_one_file(spark, tmp_path):
    from sparkwarden.sources import commits as log

    record = lambda repo, sha: f"\x1e{repo}\x1f{sha}\x1fann\x1f2024-03-01T09:30:00+02:00\x1ffix\n\n\x1f\n1\t2\ta.py\n"
    (tmp_path / "all.log").write_text(record("one", "s1") + record("two", "s2") + record("", "s3"))
    read = log.read_log(spark, str(tmp_path), named=True)
    assert sorted((r.repo or "-", r.sha, r.author, r.author_hour, r.message) for r in log.commits_of(read).collect()) == [
        ("-", "s3", "ann", 9, "fix"), ("one", "s1", "ann", 9, "fix"), ("two", "s2", "ann", 9, "fix"),
    ]
    assert sorted((r.repo or "-", r.path, r.additions) for r in log.commit_files_of(read).collect()) == [("-", "a.py", 1), ("one", "a.py", 1), ("two", "a.py", 1)]


def test_exported_histories_have_no_folder_per_repository(spark, monkeypatch, tmp_path):
    from sparkwarden.plans import queries_discovery as q

    monkeypatch.setattr(q, "shared_dir", lambda _: str(tmp_path))
    for name in ("exported_commits", "exported_commit_files"):
        rows = q.query.__globals__["QUERIES"][name](spark, "/root/testdata/sf0.001")
        assert rows.count() and rows.where("repo IS NULL").count() == 0
    assert not [p for p in tmp_path.rglob("*") if p.is_dir() and p.name.startswith("repo=")]
