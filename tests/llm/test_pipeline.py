"""The pipeline and the registered queries on the smallest tables, each stage on its predecessor's output."""

import os
import re
import sys

import pytest

pytest.importorskip("sparkwarden.llm.queries")
pipeline = pytest.importorskip("corpus_pipeline")

from sparkwarden.llm import common, packing, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, kept, SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        before, after = ({r.doc_id: r for r in d.collect()} for d in (kept, out))
        assert after.keys() <= before.keys() and len(after) >= 0.5 * len(before), name
        if name == "language":
            assert all(i in after for i, r in before.items() if len(r.text) > 40)
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.scored(kept, toxicity.fit(kept, labels)).collect()}
            assert after.keys() == {i for i, p in scores.items() if not p}
        if name == "near_duplicates":
            sets = {i: shingles(r.text) for i, r in before.items()}
            for i, a in sets.items():
                near = [j for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)]
                assert i not in after or not any(j in after for j in near)
                assert i in after or near
        if name == "repeats":
            windows = {}
            for i, r in before.items():
                data = r.text.encode()
                for s in range(len(data) - 199):
                    windows.setdefault(data[s : s + 200], set()).add((i, s))
            for i, r in before.items():
                data, drop = r.text.encode(), set()
                for s in range(len(data) - 199):
                    if len(windows[data[s : s + 200]]) > 1:
                        drop.update(range(s, s + 200))
                left = bytes(b for k, b in enumerate(data) if k not in drop)
                assert i in after or not left.strip() or len(left) < 4
                if i in after:
                    assert abs(len(after[i].text.encode()) - len(left)) <= 6 and after[i].n_chars == len(after[i].text)
        kept = out
    last = pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in kept.collect()}
    assert last.agg({"sequence_id": "max"}).first()[0] < last.agg({"length": "sum"}).first()[0] / packing.CAPACITY + 2


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "The same words as in the other row.", "en", "a", 3)]
    rows += [(3, "The same words as in the other row.", "en", "a", 3), (None, "Some text without an id.", "en", None, 1)]
    rows += [(None, "Some text without an id.", "en", None, 1), (4, "The same words as in the other row.", "en", "b", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in pipeline.STAGES:
            docs = common.stored(stage(spark, docs, SF))
        assert docs.count() == (2 if given else 0)


def test_near_distinct_decides_on_rows(spark):
    near = " ".join(f"word{i}" for i in range(60))
    own = " ".join(f"other{i}" for i in range(60))
    both = " ".join(f"third{i}" for i in range(60))
    loose = " ".join(f"fourth{i}" for i in range(60))
    rows = [(1, near), (7, near + " more"), (7, own), (8, both), (8, both + "  more"), (None, loose), (None, loose + " more"), (None, near + " else")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text.split()[0]) for r in pipeline.near_distinct(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == [(1, "word0"), (7, "other0"), (8, "third0"), (None, "fourth0")]


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0 and pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_and_their_sql(spark, name):
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import compare

    rows, problems, *_ = compare.compare(spark, compare.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert rows > 0 and not problems
