"""The index of names, related pairs, quantiles, METEOR's alignment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.functions import metrics as M
from groundwork.operators import knowledge as K
from groundwork.operators.lookups import containing, grams
from groundwork.operators.quantiles import exact_quantiles, histogram


def test_grams(spark):
    row = spark.createDataFrame([("abcabc", "ab", "", None)], "a string, b string, c string, d string").select(*[grams(F.col(c), 3).alias(c) for c in "abcd"]).first()
    assert sorted(row["a"]) == ["abc", "bca", "cab"] and row["b"] == [] and row["c"] == [] and not row["d"]


def test_containing_equals_every_pair(spark):
    r = random.Random(1)
    names = ["".join(r.choice("abcé ") for _ in range(r.randrange(9))) for _ in range(300)] + [None, "", "aaa", "zq"]
    phrases = ["".join(r.choice("abcé ") for _ in range(r.randrange(6))) for _ in range(200)] + [None, "", "zzz", "z", "q", "zq", "aaaaaaaaaaaaaa"]
    got = containing(spark.createDataFrame([(x, 1) for x in names], "name string, phrase int"), spark.createDataFrame([(x,) for x in phrases], "phrase string"))
    assert sorted(map(tuple, got.collect())) == sorted({(p, n) for p in phrases if p for n in names if n and p in n})
    assert containing(spark.createDataFrame([], "name string"), spark.createDataFrame([("a",)], "phrase string")).count() == 0


def test_lookups_have_no_nested_loop(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.createDataFrame([("e1", "coal power", "EMITS", "co2"), ("e2", "co2", "WARMS", "air")], "eid string, subject string, relation string, object string")
        asked = spark.createDataFrame([(1, "coal", ["coal", "co2"])], "question_id long, phrase string, keywords array<string>")
        for found in (K.one_hop(asked, edges, either=True), K.two_hop(asked, edges, middle=True), K.undirected(asked, edges)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.count() and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain_cascade(questions, edges, relations, synonyms, written):
    def one(p, either=False, some=None, limit=15):
        found = [(s, r, o, e) for e, s, r, o in edges if (p in s.lower() or (either and p in o.lower())) and (not some or r in some)]
        return [x[:3] for x in sorted(found)[:limit]] if p else []

    def two(p, middle=False):
        found = [(s, r, o, e, r2, o2, e2) for e, s, r, o in edges if p and (p in s.lower() or (middle and p in o.lower())) for e2, s2, r2, o2 in edges if o == s2 and e != e2]
        return [x[:3] for x in sorted(found)[:10]]

    def loose(words):
        both = {(s, r, o, e) for e, s, r, o in edges} | {(o, r, s, e) for e, s, r, o in edges if s != o}
        return [x[:3] for x in sorted(x for x in both if any(w in x[0].lower() or w in x[2].lower() for w in words[:5]))[:25]]

    out = []
    for q, phrase, keywords in questions:
        kw = [*keywords, "", "", ""]
        tiers = {-1: written.get(q, []), 0: one(phrase), 1: two(phrase), 2: one(phrase, True), 3: one(kw[0], some=relations) if relations else [], **{4 + k: one(kw[k], limit=12) for k in range(3)}, 7: two(kw[0], True), 8: loose(keywords + synonyms.get(q, []))}
        for tier, rows in sorted(tiers.items()):
            if any(k in " ".join(x).lower() for x in rows for k in keywords):
                out += [(q, tier, *x, n) for n, x in enumerate(rows, 1)]
                break
    return out


@pytest.mark.parametrize("relations", [(), ("R1",)])
def test_cascade_equals_a_plain_version(spark, relations):
    r = random.Random(7)
    names = ["coal power", "Coal", "co2", "air", "sea level", "ice sheet", "methane", "rice fields", "wetland", "carbon tax"]
    edges = [(f"e{k:02}", r.choice(names), f"R{r.randrange(3)}", r.choice(names)) for k in range(40)] + [("e98", "air", "R1", "only target")]
    questions = [(1, "coal", ["coal"]), (2, "nothing here", ["ice", "sea"]), (3, "coal power air", ["zzz", "rice"]), (4, "none", ["none"]), (5, "air", ["tax"]), (6, "", ["level"]), (7, "x", []), (8, "no such", ["foo", "bar", "baz", "qux", "wetland", "air"]), (10, "only target", ["target"]), (9, "no way", ["methan e"])]
    synonyms, written = {9: ["methane"], 4: []}, {4: [("a none b", "R", "c")], 5: [("irrelevant", "R", "c")]}
    q = spark.createDataFrame(questions, "question_id long, phrase string, keywords array<string>")
    e = spark.createDataFrame(edges, "eid string, subject string, relation string, object string")
    s = spark.createDataFrame([(9, "methane"), (4, None)], "question_id long, synonyms string")
    w = spark.createDataFrame([(k, *x, n) for k, v in written.items() for n, x in enumerate(v, 1)], "question_id long, entity string, relationship string, related_entity string, rank int")
    got = sorted(map(tuple, K.cascade(q, e, relations, s, w).collect()))
    assert got == sorted(plain_cascade(questions, edges, relations, synonyms, written)) and len({x[1] for x in got}) >= 5


@pytest.mark.parametrize("group_rows", [None, 3])
def test_related_pairs(spark, group_rows):
    r = random.Random(3)
    rows = [(k, f"t{k}", r.choice("ABCD"), "big" if k % 2 else f"c{k % 5}") for k in range(120)] + [(999, "x", "A", None)]
    entities = spark.createDataFrame(rows, "seq long, text string, canonical_label string, chunk_id string")
    some = {("A", "B"): "R1", ("B", "A"): "R2", ("C", "C"): "R3", ("A", "D"): "NONE"}
    matrix = spark.createDataFrame([(*k, v) for k, v in some.items()], "label_a string, label_b string, relation string")
    got = sorted((x["seq_a"], x["seq_b"], x["relation"]) for x in K.related(entities, matrix, group_rows).collect())
    assert got == sorted((a[0], b[0], some[a[2], b[2]]) for a in rows for b in rows if a[3] and a[3] == b[3] and a[0] != b[0] and some.get((a[2], b[2]), "NONE") != "NONE")
    counts = {(x["label_a"], x["label_b"]): x["n"] for x in K.cooccurrence(entities).collect()}
    pairs = {(x["label_a"], x["label_b"]): x["n"] for x in K.cooccurring(entities).groupBy(F.col("canonical_label_a").alias("label_a"), F.col("canonical_label_b").alias("label_b")).agg(F.count("*").alias("n")).collect()}
    assert counts == pairs


@pytest.mark.parametrize("distinct", [10_000, 20])
def test_quantiles_are_exact(spark, distinct):
    r = np.random.default_rng(2)
    values = {"many": r.lognormal(0, 4, 6000), "ties": np.r_[np.zeros(4000), np.ones(3000), r.random(1000)], "two": np.r_[np.zeros(50), np.ones(50)], "one": np.array([3.5]), None: r.integers(-50, 50, 3000)}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("many", float("nan")), ("none", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ps = [0.0, 0.01, 0.5, 0.731, 1.0]
    got = {(x["g"], x["probability"]): x["value"] for x in exact_quantiles(df, "v", ps, ["g"], distinct).collect()}
    assert set(got) == {(g, p) for g in values for p in ps}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.quantile(np.asarray(values[g], float), p), rel=1e-12, abs=1e-12), (g, p)
    whole = exact_quantiles(df, "v", [0.5], distinct=distinct).first()
    assert whole["value"] == pytest.approx(np.median(np.concatenate([np.asarray(x, float) for x in values.values()])))
    assert exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_histogram(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=500)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = histogram(df, "v", 10, ["g"]).collect()
    counts, edges = np.histogram(x, 10)
    assert {h["bin"]: h["n"] for h in got if h["g"] == "a"} == {k: int(n) for k, n in enumerate(counts) if n}
    assert sum(h["density"] * (h["high"] - h["low"]) for h in got if h["g"] == "a") == pytest.approx(1)
    assert [(h["bin"], h["n"], h["density"]) for h in got if h["g"] == "b"] == [(0, 2, None)] and not [h for h in got if h["g"] == "c"]
    assert sum(h["n"] for h in histogram(df, "v", 7).collect()) == 502


def test_meteor_pairs_from_the_last_word_on():
    """By hand: m matches, P = m / answer, R = m / reference, F = 10PR / (R + 9P), less F / 2 (chunks / m) ** 3."""
    def score(m, answer, reference, chunks):
        p, r = m / answer, m / reference
        return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)

    assert M.alignment("the cat".split(), "the cat the".split(), [lambda x: (x,)]) == {1: 1, 0: 2}
    assert M.meteor_of("the cat the", "the cat") == pytest.approx(score(2, 2, 3, 2)) == pytest.approx(0.3448, abs=1e-4)
    assert M.meteor_of("a b a b", "a b") == pytest.approx(score(2, 2, 4, 1))
    assert M.meteor_of("it walks", "walking it") == pytest.approx(score(2, 2, 2, 2))
    assert M.meteor_of("walk walks", "walks walked") == pytest.approx(score(2, 2, 2, 2))
    assert M.meteor_of("the big car", "the large auto") == pytest.approx(score(1, 3, 3, 1))
    words = {"big": ["g1"], "large": ["g1", "g2"], "car": ["g3"], "auto": ["g3"]}
    assert M.meteor_of("the big car", "the large auto", words) == pytest.approx(score(3, 3, 3, 1))
    assert M.meteor_of("big large", "large large", words) == pytest.approx(score(2, 2, 2, 1))
    assert M.meteor_of(None, "a") == M.meteor_of("a", "") == 0
