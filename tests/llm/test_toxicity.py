from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import toxicity as T


@pytest.mark.parametrize("text", ["bastard", "BASTARD", "b@st@rd", "ba​stard", "baaastaard", "bаstard", "b a s t a r d", "b.a.s.t.a.r.d", "bästard", "b4stard"])
def test_spellings_of_one_word(text):
    assert [T.term(p) for p in T.pieces(text)] == ["bastard"]


def test_masked_words_and_vocabulary():
    terms = T.Terms({"stupid": 0, "idiot": 1, "#": 2})
    assert terms.of("s***id i***t 123 x!") == [0, 1, 2, -1, -2]


def test_windows_cover_everything():
    ids = np.array([1, 2, -2, -2, *range(30), -2, 5])
    first, last = T.windows(ids)
    covered = {i for s, e in zip(first, last) for i in range(s, e)}
    assert covered == {i for i, x in enumerate(ids) if x != -2}
    assert all(e - s <= T.WIDTH + 2 for s, e in zip(first, last))
    assert len(T.windows(np.array([], np.int64))[0]) == len(T.windows(np.array([-2, -2]))[0]) == 0


def brute(bags, clean, bad, idf, base, ids):
    def vector(b):
        v = np.bincount(b, minlength=len(idf)) * idf
        return v / np.sqrt((v**2).sum())

    q = vector(ids)
    pos = neg = 0.0
    for b, c, a in zip(bags, clean, bad):
        s = float(q @ vector(b))
        if s >= T.NEAR:
            pos, neg = pos + s**T.POWER * a, neg + s**T.POWER * c
    return (pos + T.SMOOTH * base) / (pos + neg + T.SMOOTH) if pos + neg else 0.0


def test_index_is_exact():
    rng = np.random.default_rng(0)
    idf = rng.uniform(0.3, 4.6, 60)
    bags = sorted({tuple(sorted(rng.integers(0, 60, rng.integers(2, 9)).tolist())) for _ in range(600)})
    clean, bad = rng.integers(1, 3, len(bags)).tolist(), rng.integers(0, 2, len(bags)).tolist()
    e = T.Examples(bags, clean, bad, list(range(len(bags))), idf, 0.13)
    queries = [rng.integers(0, 60, rng.integers(2, 9)) for _ in range(200)]
    got, best = e.votes(queries)
    for q, v, b in zip(queries, got, best):
        assert v == pytest.approx(brute(bags, clean, bad, idf, 0.13, q), abs=1e-4)
        assert b < 0 or e.abusive[b] > 0
    assert e.votes([])[0].tolist() == []
    offending = np.flatnonzero(e.abusive > 0)
    e.choose(offending)
    ids = rng.integers(-2, 60, 4000)
    first, last = T.windows(ids)
    passed = set(e.gate(ids, first, last).tolist())
    vectors = np.array([np.bincount(e.bags[o], minlength=60) * idf for o in offending])
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    for k, (s, t) in enumerate(zip(first, last)):
        part = ids[s:t][ids[s:t] >= 0]
        q = np.bincount(part, minlength=60) * idf
        near = float((vectors @ q).max() / max(np.sqrt((q**2).sum()), 1e-9)) if len(part) else 0.0
        if near >= T.NEAR + 1e-4:
            assert k in passed
        if len(set(part.tolist())) == len(part) and near < T.NEAR - 1e-4:
            assert k not in passed


DOC, LABEL = "doc_id long, text string, source string, score string", "doc_id long, quality int, toxic int"


def test_scores(spark):
    clean = ["The lantern of the harbour was left to the archivist.", "We moved the chapel scene to the next chapter.", "thinking about the save slots tonight"]
    bad = ["you worthless stupid moron go away", "shut up you filthy moron and leave"]
    rows = [(i, f"{clean[i % 3]} {clean[(i + 1) % 3]}", "a", None) for i in range(40)]
    rows += [(100 + i, f"{clean[i % 3]} {bad[i % 2]}!", "a", None) for i in range(10)]
    asked = [(200, "note. YOU W0RTHLESS stuuupid mоron, go away! bye", "b", None), (201, clean[0], "b", None), (202, None, "b", None), (203, "", None, None), (204, " \n", "b", None), (205, "x " * 200_000 + ". shut up you filthy moron and leave", "b", None)]
    docs = spark.createDataFrame(rows + asked, DOC)
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in rows] + [(None, 1, 1), (0, 1, None), (999, 1, 1), (100, 2, 0)], LABEL)
    got = {r.doc_id: r for r in T.score(docs, labels, ("source",)).collect()}
    assert len(got) == len(rows) + len(asked)
    assert {k for k, r in got.items() if r.score >= T.THRESHOLD} == {*range(100, 110), 200, 205}
    assert got[200].example_doc_id in range(100, 110) and "moron" in got[200].passage and got[202].score == got[203].score == got[204].score == 0
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert T.score(docs, none).agg(F.max("score")).collect()[0][0] == 0
    assert T.score(docs.where("false"), labels).count() == 0


def test_held_out_labels(spark):
    """Documents whose labels weren't used: most abusive ones are found, few clean ones."""
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/review_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = T.score(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    n = {(r.toxic, r.hit): r["count"] for r in found.groupBy("toxic", (F.col("score") >= T.THRESHOLD).alias("hit")).count().collect()}
    assert n.get((0, True), 0) <= 0.05 * (n.get((0, True), 0) + n[(0, False)])
    assert n.get((1, True), 0) >= 0.3 * (n.get((1, True), 0) + n.get((1, False), 0))
