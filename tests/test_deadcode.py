"""Unused functions: what counts as a function, as a mention and as a root, chains, cycles, odd files and very long ones."""

import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import deadcode

PYTHON = '''import x

def main():
    _one()

def _one():
    """doc
at column 0 _dead
    """
    def _inner():
        return 1
    def _unused_inner():
        return 2
    return _inner()

@app.route('/')
def _view():
    pass

def _dead():
    # _one()
    _dead2()

def _dead2():
    _dead3(1,
)

def _dead3():
    _r1()

def _r1(): _r2()
def _r2(): _r1()

class A:
    def _m(self):
        pass
    def __init__(self):
        pass

table = {"x": _late}
def _late(): pass
'''
RUST = """use x;
pub fn a() { b(); }
fn b() {
    let s = "c()";
}
fn c() {}
fn d(
    a: u32,
) -> u32 {
    e()
}
fn e() {}
impl Display for X {
    fn fmt(&self) { f(); }
}
fn f() {}
#[test]
#[inline]
fn t() { g(); }
fn g() {}
#[inline]
fn h() {}
pub(crate) fn i() {}
fn main() {}
impl X {
    fn own(&self) {}
    pub fn p(&self) { self.own() }
    fn lost(&self) {}
}
// c2()
/* c2 */
fn c2() {}
"""
SCRIPT = "export function a() { return b() }\nfunction b() {}\nfunction c() { d() }\nasync function d() {}\nfunction* e() {}\nconst z = `\n${f()}\n`;\nfunction f() {}\n"
GO = "package a\nfunc main() { b() }\nfunc b() {}\nfunc c() {}\nfunc (x *T) d() {}\nfunc Pub() { e() }\nfunc e() {}\n"


def dead(files):
    out = {}
    for r in deadcode.dead_functions(files).collect():
        out.setdefault(r.path, []).append((r.start_line, r.name))
    return {path: [name for _, name in sorted(found)] for path, found in out.items()}


def test_functions_that_nothing_uses(spark, files_of):
    got = dead(files_of(("a.py", PYTHON), ("b.rs", RUST), ("c.ts", SCRIPT), ("d.go", GO), ("e.py", None), ("f.py", ""), ("g.txt", "def _x(): pass")))
    assert got == {
        "a.py": ["_unused_inner", "_dead", "_dead2", "_dead3", "_r1", "_r2", "_m"],
        "b.rs": ["d", "e", "h", "i", "lost", "c2"], "c.ts": ["c", "d", "e"], "d.go": ["c", "d"],
    }


def test_names_are_used_within_repository_and_family(spark, files_of):
    one = files_of(("a.py", "def _f():\n    _g()\n"), ("b.py", "_f()\n"), ("c.py", "def _g(): pass\ndef _h(): pass\n"), ("d.js", "_h();\nfunction _g() {}\n"))
    two = files_of(("a.py", "def _f(): pass\n"), repo="s")
    assert dead(one) == {"c.py": ["_h"], "d.js": ["_g"]} and dead(two) == {"a.py": ["_f"]}
    assert dead(one.unionByName(one)) == {"c.py": ["_h", "_h"], "d.js": ["_g", "_g"]}
    assert dead(one.where("false")) == {}


def test_long_chains_end(spark, files_of):
    chain = "def start():\n    _f0()\n" + "".join(f"def _f{i}():\n    _f{i + 1}()\n" for i in range(6)) + "def _f6(): pass\ndef _lost(): _f0()\n"
    assert dead(files_of(("a.py", chain))) == {"a.py": ["_lost"]}


def test_lines_and_line_ends(spark, files_of):
    got = deadcode.dead_functions(files_of(("a.py", 'x = """\n\n"""\r\n\r\ndef _f():\r\n    pass\r\n'))).collect()
    assert [(r.start_line, r.rule_id, r.severity) for r in got] == [(5, "deadcode.unused-function", "low")]


@pytest.mark.parametrize("family", [("python", "a.py"), ("rust", "a.rs"), ("javascript", "a.js")])
def test_very_long_texts_take_linear_time(spark, family):
    n = 300_000
    texts = [
        "def a():\n" + "    x = 1\n" * (n // 10), "".join(f"def _f{i}():\n    _f{i + 1}()\n" for i in range(n // 25)), "x" * n, " " * n, "\n" * n,
        "@a\n" * (n // 3), "#[a]\n" * (n // 5) + "fn x() {}", "/*" * (n // 2), 'r##"' * (n // 4), "func (" * (n // 6), "impl for " * (n // 9),
        "impl a for b {\n" * (n // 15), "pub(" * (n // 4), "export " * (n // 7), "'" * n, '"""' * (n // 3), "def f(\n" * (n // 7),
    ]
    rows = spark.createDataFrame([("r", f"{i}", family[0], t) for i, t in enumerate(texts)], "repo string, path string, language string, content string")
    start = time.time()
    assert deadcode.function_uses(rows).agg(F.count(F.lit(1))).collect()[0][0] == len(texts)
    assert time.time() - start < 40
