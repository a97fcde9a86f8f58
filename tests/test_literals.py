"""Required literals of regexes, the single pass that finds them, and rules searched with and without them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.literals import any_of, fold, literals_in, required_literals
from sparkwarden.operators import secrets as sec
from sparkwarden.sources.rules import SecretRule


@pytest.mark.parametrize(
    ("regex", "want"),
    [
        ("ghp_[0-9a-z]{36}", ["ghp_"]), ("(?i)(?:key|token|auth)[a-z]{0,20}=x", ["auth", "key", "token"]), ("[A-Z]{4}", None), ("a|bcd", None),
        (r"\b[sr]k_(?:test|live)_[0-9]{3}", ["rk_live_", "rk_test_", "sk_live_", "sk_test_"]), ("(?:abcd)?x", None), ("(?:abcd)+x", ["abcd"]),
        ("-----BEGIN[ A-Z]{0,100}PRIVATE KEY", ["private key"]), ("[a[bc]]xyz", None), ("[[:alnum:]]abc", ["abc"]), (r"\p{L}abc", None),
        ("(?P<x>hello)[0-9]wor", ["hello"]), ("(ab|cd)(ef|gh)", ["abef", "abgh", "cdef", "cdgh"]), ("éabc", ["abc"]), ("(?i)straße", ["stra"]),
        ("[]a]bcd", ["]bcd", "abcd"]), ("abc*", None), ("[a-z&&[^b]]abc", None), ("(", None), ("", None), ("ab(?:c|)d", ["abcd", "abd"]), ("(?:abc|def|xy)z", ["abcz", "defz", "xyz"]),
    ],
)
def test_required_literals(regex, want):
    assert required_literals(regex) == (frozenset(want) if want else None)


def test_every_match_holds_a_required_literal():
    draw = random.Random(3)

    def made(depth):
        kind = draw.randrange(8 if depth else 3)
        if kind < 3:
            return draw.choice(["a", "b", "ab", "abc", "cab", "[ab]", "[a-c]", "b+", r"\b", "."])
        if kind == 3:
            return f"(?:{made(depth - 1)}|{made(depth - 1)})"
        if kind == 4:
            return f"(?:{made(depth - 1)}){draw.choice(['?', '*', '+', '{1,2}', '{2}', '{0}', '+?'])}"
        if kind == 5:
            return f"({made(depth - 1)})"
        if kind == 6:
            return f"(?={made(depth - 1)})"
        return made(depth - 1) + made(depth - 1) + made(depth - 1)

    seen = 0
    for _ in range(1500):
        regex = made(4)
        words = required_literals(regex)
        if words:
            seen += 1
            for _ in range(20):
                text = "".join(draw.choice("abc ") for _ in range(draw.randrange(1, 14)))
                assert not re.search(regex, text) or any(w in text for w in words), (regex, text, words)
    assert seen > 100


def test_literals_of_one_pass(spark):
    words = ["key", "eyj", "ke", "keys", "a.b", "sik", "ey", "[x"]
    texts = ["keyjab", "KEYS", "xa.b a-b", "ſıK", "İ sİk", "k e", "", None, "[x]key[x", "aa.bb" * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = literals_in(fold(F.col("t")), words)
    tests = [F.coalesce(any_of(found, frozenset([w]), words), F.lit(False)).alias(f"w{n}") for n, w in enumerate(words)]
    plain = [(t or "").replace("ſ", "s").replace("ı", "i").replace("İ", "i").replace("K", "k").lower() for t in texts]
    for r in rows.select("i", *tests).collect():
        assert [r[f"w{n}"] for n in range(len(words))] == [w in plain[r.i] for w in words], texts[r.i]


def test_same_matches_with_and_without_literals(spark, files_of):
    draw = random.Random(8)
    rules = [SecretRule(f"r{i}", "d", draw.choice([rf"(?i)tok{i % 9}_[a-f]{{3}}", rf"a{i % 5}bc|d{i % 7}ef", rf"[a-z]{i % 10}x?", rf"(?:key|eyj){i % 8}", rf"\bsik{i % 6}"])) for i in range(60)]
    words = ["tok3_abc", "TOK4_FFF", "a1bc", "d3ef", "keyj5", "eyj5", "q7x", "ſik2", "sıK3", "none", "sik2"]
    files = files_of(*[(f"f{i}.py", " ".join(draw.choice(words) for _ in range(draw.randrange(0, 9)))) for i in range(40)], ("n.py", None))
    both = [sec.rule_matches(files, sec.SecretOptions(rules=rules, find_literals=on)).orderBy("path", "rule_id", "start").collect() for on in (True, False)]
    assert both[0] == both[1] and len(both[0]) > 100
