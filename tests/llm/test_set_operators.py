"""Jaccard join, substring dedup, neighbours, sharding, mixing and URL filters against brute force."""

import math
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.llm import jaccard, mixing, neighbours, sharding, substrings, urls
from groundwork.llm.components import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    lists, common, up = defaultdict(list), Counter(), {i: i for i in docs}
    for i, s in sets.items():
        for t in s:
            lists[t].append(i)
    for v in lists.values():
        common.update((a, b) for k, b in enumerate(v) for a in v[:k])

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in docs}


def made_corpus(seed=3):
    """Originals, copies with a few words changed (chains among them), a passage that many share, tiny and odd texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    docs = {}
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice((6, 12, 40, 200)))]
        for copy in range(r.choice((1, 2, 8, 40))):
            docs[len(docs)] = " ".join(text)
            for _ in range(max(1, len(text) // 60)):
                text[r.randrange(len(text))] = r.choice(words)
    for _ in range(40):
        docs[len(docs)] = " ".join(r.choice(words) for _ in range(20)) + " " + passage
    for t in (None, "", " \n", "A b", "a  B\n", "a b c d e", "a b c d E", "x " * 4000):
        docs[len(docs)] = t
    return docs


def test_join_equals_brute_force(spark):
    docs = made_corpus()
    df = spark.createDataFrame(list(docs.items()), SCHEMA).withColumn("N", F.lit(1)).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df.repartition(7)).collect()}
    assert got == brute_components(docs)


def test_join_by_hubs_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GAIN", 0.0)
    docs = made_corpus(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert got == brute_components(docs)


def test_join_on_the_tables(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()} == brute_components(docs)


def test_join_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(empty).count() == 0 and jaccard.first_of_each(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, None)], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.join(rows).collect()), key=repr)
    assert got == sorted([(None, 1), (3, 1), (3, 1), (1, 1), (None, None)], key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.first_of_each(rows).collect()), key=repr) == sorted([(1, "A b c d e f"), (None, "a b c d e f"), (None, None)], key=repr)


@given(st.sets(st.integers(0, 60), min_size=1), st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_divide_skip_equals_counting(query, others):
    q, cs = np.array(sorted(query), np.uint64), [np.array(sorted(c), np.uint64) for c in others]
    need = np.array([jaccard.required(len(c), len(q)) for c in cs])
    assert jaccard.divide_skip(q, cs, need).tolist() == [4 * len(query & c) >= 3 * len(query | c) for c in others]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 1)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages_are_caught_and_clean_texts_left(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.choice((3, 5, 8)))) for _ in range(n))
    shared = [text(70) for _ in range(30)]
    docs = [(i, f"{text(80)} {shared[i % 30]} {text(60)}") for i in range(60)] + [(100 + i, text(200)) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "é" * 9000), (203, shared[0] + " " + text(5) + " " + shared[0])]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {x["doc_id"]: x for x in substrings.passages(df.union(df)).collect()}
    assert len(set(range(60)) & set(got)) >= 58 and not set(range(100, 203)) & set(got) and 203 in got
    for i, x in got.items():
        body = dict(docs)[i]
        assert all(body[p["start"] : p["end"]].strip() in shared[i % 30] or i == 203 for p in x["passages"])
        assert bool(x["removed"]) == (i >= 30)
    assert substrings.passages(df.limit(0)).count() == 0
    assert {x["doc_id"] for x in substrings.digest(substrings.passages(df)).collect()} == set(got)


def brute_passages(docs, size=substrings.WORDS):
    """Spans of words that lie in a window of ``size`` words which another document holds too, joined where they touch."""
    words = {i: list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.items()}
    held = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            held[tuple(m.group() for m in w[k : k + size])].add(i)
    out = {}
    for i, w in words.items():
        lists = []
        for late in (False, True):
            runs = []
            for k in range(len(w) - size + 1):
                by = held[tuple(m.group() for m in w[k : k + size])]
                if len(by) > 1 and not (late and min(by) == i):
                    if runs and k <= runs[-1][1]:
                        runs[-1][1] = k + size
                    else:
                        runs.append([k, k + size])
            lists.append([(w[a].start(), w[b - 1].end(), b - a) for a, b in runs])
        if lists[0]:
            out[i] = tuple(lists)
    return out


@pytest.mark.parametrize("letters", [(2, 5), (3, 11)])
def test_passages_just_over_50_words_are_never_missed(spark, letters):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randint(*letters))) for _ in range(n))
    docs = {}
    for k in range(400):
        shared = text(51)
        docs[2 * k], docs[2 * k + 1] = f"{text(40)} {shared} {text(30)}", f"{text(25)}\n{shared}  {text(60)}"
    docs |= {900: "a b " * 40, 901: "x y " + "a b " * 25, 902: text(19), 903: None}
    got = {x["doc_id"]: tuple([tuple(p) for p in x[c]] for c in ("passages", "removed")) for x in substrings.passages(spark.createDataFrame(list(docs.items()), SCHEMA).repartition(5)).collect()}
    assert set(range(800)) <= set(got) and all(p[2] >= 51 for k in range(800) for p in got[k][0][:1])
    assert got == brute_passages(docs)


def test_passages_on_the_tables(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    assert {x["doc_id"]: tuple([tuple(p) for p in x[c]] for c in ("passages", "removed")) for x in substrings.passages(df).collect()} == brute_passages(docs)


@given(st.lists(st.integers(0, 5), max_size=200), st.integers(0, 200), st.integers(2, 30))
@settings(max_examples=100, deadline=None)
def test_chunk_borders_come_back_after_an_insertion(numbers, at, size):
    words = substrings.mix(np.array(numbers, np.uint64) + np.uint64(1))
    at = min(at, len(words))
    moved = np.r_[words[:at], substrings.mix(np.array([77, 78, 79], np.uint64)), words[at:]]
    g, w = substrings.shape(size)
    assert 2 * w + g - 1 <= size
    one, two = substrings.borders(words, size), substrings.borders(moved, size)
    assert (one[at:] + 3 == two[at + 3 :]).all()
    whole = max(0, at - w - g + 2)
    assert (one[:whole] == two[:whole]).all()


@given(st.lists(st.integers(0, 3), min_size=2, max_size=40), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(2, 25))
@settings(max_examples=200, deadline=None)
def test_a_window_has_the_same_chunk_wherever_it_stands(run, before, after, size):
    text = lambda xs: " ".join("abcd"[x] for x in xs)
    _, first, _, _, chunk, digest = substrings.windows([text(run)], size)
    _, there, _, _, chunk2, digest2 = substrings.windows([text(before + run + after), text(after)], size)
    known = {(int(d), int(c)) for d, c in zip(digest2, chunk2)}
    assert len(first) == max(0, len(run) - size + 1) and {(int(d), int(c)) for d, c in zip(digest, chunk)} <= known
    assert len({d for d, _ in known}) == len(known)


@given(st.data())
@settings(max_examples=40, deadline=None)
def test_packed_windows_come_back(data):
    n = data.draw(st.integers(1, 60))
    r = np.random.default_rng(n)
    rows = np.zeros(n, substrings._WINDOW)
    rows["doc"], rows["word"], rows["start"], rows["size"], rows["seen"] = np.sort(r.integers(-(1 << 63), 1 << 62, 5))[r.integers(0, 5, n)], r.integers(0, 50, n), r.integers(0, 1 << 30, n), r.integers(0, 1 << 20, n), r.integers(0, 3, n)
    if data.draw(st.booleans()):
        rows["chunk"], rows["tail"] = r.integers(0, 1 << 63, 4)[r.integers(0, 4, n)], r.integers(0, 1 << (8 * substrings.TAIL), n)
    part = np.sort(r.integers(0, 3, n))
    assert (substrings._unpacked(iter([substrings._packed(part, rows)])) == rows).all()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[3].tolist()) for i in range(300)]
    rows += [(2000, None), (2050, [0.0] * 12), (2100, [float("nan")] * 12), (2150, [1.0] * 3), (2200, [None] * 12), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in neighbours.nearest(df, lambda v: v % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    short = got.pop(2150)  # counts as if zeros followed
    assert len(short) == 5 and short[0][1] == pytest.approx(np.max(x[:, :3].sum(axis=1) / np.linalg.norm(x, axis=1) / math.sqrt(3)))
    y = np.array([v for _, v in rows[:1200]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 1200, 50))
    hit = 0
    for q, found in got.items():
        sim = y @ y[q]
        sim[q] = -2
        found = [(v, p) for v, p in found if v != 2150]
        best = np.lexsort((np.arange(1200), -np.round(sim, 12)))[:5]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - sim[v]) < 1e-9 for v, s in found)
        hit += len({v for v, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert [v for v, _ in got[900]] == [3, 901, 902, 903, 904]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (8, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in neighbours.nearest(few, lambda v: v % 50 == 0).orderBy("rank").collect()] == [(1, 7), (2, 8)]
    assert neighbours.nearest(few.limit(0), lambda v: v % 50 == 0).count() == 0


def test_recall_of_a_large_table(spark):
    """20,000 vectors without structure in 32 dimensions and some clusters, a list of less than 2 % of them."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 32))
    x[:4000] = rng.normal(size=(40, 1, 32)).repeat(100, 1).reshape(-1, 32) + 0.1 * x[:4000]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    s = neighbours.Settings()
    assert s.beam < 0.02 * len(x)
    got = defaultdict(list)
    for r in neighbours.nearest(df, lambda v: v % 50 == 0, s=s).collect():
        got[r["query_id"]].append(r["vec_id"])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), 50):
        sim = y @ y[q]
        sim[q] = -2
        hit += len(set(got[q]) & set(np.argpartition(-sim, 5)[:5].tolist()))
    assert len(got) == 400 and hit >= 0.9 * 5 * 400, hit / 2000


def test_distinct_vectors_under_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.1]), (8, [0.1, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_an_id_on_many_vectors_passes_over_its_own_alone(spark):
    r = np.random.default_rng(6)
    rows = [(0, v.tolist()) for v in r.normal(size=(20, 3))] + [(k, v.tolist()) for k, v in enumerate(r.normal(size=(8, 3)), 1)] + [(50, rows_) for rows_ in r.normal(size=(3, 3)).tolist()]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    expected = []
    for i, v in unit:
        if i % 50 == 0:
            near = sorted((-float(v @ w), j) for j, w in unit if j != i)[:5]
            expected += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in got) == sorted(expected) and len(got) == 115


def test_every_node_has_edges(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(20, 1, 12)).repeat(25, 1).reshape(-1, 12) + 0.01 * rng.normal(size=(500, 12)), rng.normal(size=(100, 12))])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    s = neighbours.Settings(neighbours=8, trees=1, cell=1, landmarks=32)
    edges = neighbours.graph(nodes, s).collect()
    assert {e["u"] for e in edges} == set(range(600)) and all(e["u"] != e["v"] for e in edges)


def test_sharding(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")).alias("text")).union(spark.createDataFrame([(None, None), (None, "x"), (1, "x"), (1, "x")], SCHEMA))
    path = str(tmp_path / "map")
    rows = sharding.shard(df.withColumn("shard", F.lit("clash")), path=path).toPandas()
    assert len(rows) == 5004 and set(rows["shard"]) == set(range(24))
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= rows.groupby("vslot")["size"].sum().max()
    import zlib

    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] not in (None, 1)}
    for r in rows[rows["doc_id"].isin(texts)].itertuples():
        assert r.text_crc32 == zlib.crc32(texts[int(r.doc_id)].encode()) and r.size == len(texts[int(r.doc_id)].encode()) + 8
    # A second run edits the stored map: it stays balanced and hardly anything moves.
    again = sharding.shard(df, path=path).toPandas()
    assert spark.read.parquet(path).select("version").distinct().count() == 3
    one, two = (x.drop_duplicates("vslot").set_index("vslot")["shard"] for x in (rows, again))
    assert (one == two.loc[one.index]).mean() > 0.95
    grown = sharding.shard(df, shards=25, path=path).toPandas()
    assert grown["shard"].nunique() == 25
    assert sharding.shard(df.limit(0)).count() == 0
    # The whole assignment: the last version of the map says the shard, and slots follow virtual slots, ids and texts.
    last = {r["vslot"]: r["shard"] for r in sharding._read(spark, path).filter("version = 4").collect()}
    assert all(last[v] == x for v, x in zip(grown["vslot"], grown["shard"]))
    for _, g in grown.assign(key=grown["doc_id"].fillna(-1)).groupby("shard"):
        order = g.sort_values(["vslot", "key", "text_crc32", "size"], kind="stable")
        assert order["slot"].tolist() == list(range(len(g)))


def test_rows_of_one_id_fall_into_many_slots_and_versions_are_written_once(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.shard(df, path=str(tmp_path / "map")).toPandas()
    assert rows["vslot"].nunique() > 2000 and rows.groupby("shard")["size"].sum().max() < 1.2 * rows["size"].sum() / 24
    one = sharding._read(spark, str(tmp_path / "map")).filter("version = 2").withColumn("version", F.lit(3))
    sharding.store(one, str(tmp_path / "map"))
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.store(one, str(tmp_path / "map"))
    assert sharding._read(spark, str(tmp_path / "map")).agg(F.max("version")).first()[0] == 3


def test_mixing(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source")).withColumn("copy", F.lit("clash")).withColumn("_u", F.lit(5))
    weights = {"hot": 0.1, "s1": 0.5, "": 0.4}
    rows = mixing.mix(df, weights=weights).toPandas()
    n = rows["source"].fillna("").value_counts()
    assert set(n.index) == set(weights) and all(abs(n[k] - 20000 * w) < 5 * math.sqrt(20000 * w) + 60 for k, w in weights.items())
    assert (rows.groupby("doc_id")["copy"].max() == rows.groupby("doc_id")["copies"].first()).all()
    assert mixing.mix(df.repartition(9), weights=weights).select("doc_id", "copy").exceptAll(mixing.mix(df, weights=weights).select("doc_id", "copy")).isEmpty()
    assert mixing.mix(df.limit(0)).count() == 0
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("c")).first()["c"]
    assert cdf[2] == pytest.approx(sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(3)))
    large = spark.range(1).select(mixing.poisson_cdf(F.lit(32.0)).alias("c")).first()["c"]
    assert large[-1] == pytest.approx(1.0) and len(large) < 128
    for u in (0.0, 0.3, 0.999):
        assert spark.range(1).select(mixing._part(F.array(*map(F.lit, cdf)), F.lit(u)).alias("k")).first()["k"] == sum(c <= u for c in cdf)


@pytest.mark.parametrize("rate", [40.0, 1e6])
def test_large_rates_are_drawn_in_parts(spark, rate):
    """A small source with a large target: the number of copies stays near its mean, and what is held for it is small."""
    df = spark.createDataFrame([(i, "small" if i < 4 else "large") for i in range(50)], "doc_id long, source string")
    weights = {"small": rate * 4, "large": max(1.0, 50 - rate * 4)}
    epochs = sum(weights.values()) / 50
    told = mixing.rates(df, weights=weights, epochs=epochs).collect()
    assert all(len(r["cdf"]) < 130 for r in told)
    assert {r["_groundwork_source"]: r["rate"] for r in told}["small"] == pytest.approx(rate)
    n = mixing.mix(df, weights=weights, epochs=epochs, shuffle=False).filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.first("copies").alias("copies")).collect()
    assert len(n) == 4 and all(r["n"] == r["last"] == r["copies"] and abs(r["n"] - rate) < 6 * math.sqrt(rate) for r in n)
    assert len({r["n"] for r in n}) > 1


def test_mixing_without_broadcast_of_all_sources(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 97)).alias("source"))
    told = {tuple(r) for r in mixing.mix(df).select("doc_id", "copy", "place").collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert {tuple(r) for r in mixing.mix(df).select("doc_id", "copy", "place").collect()} == told


def test_very_long_urls(spark):
    listed = urls.entries(spark, (("block", "prefix", "a.net/x/y", "2024-01-01", "add"), ("block", "domain", "b.a.org", "2024-01-01", "add")))
    long = [("http://a.net/x/y/" + "s/" * 500_000, True), ("http://a.net/" + "x" * 1_000_000, False), ("http://a.net//x//y" + "?" + "q" * 1_000_000, True), ("http://" + "z." * 300_000 + "b.a.org/", True), ("x" * 1_000_000, False), ("http://c.b.a.orgs/", False)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(long)], "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    assert {r["page_id"]: r["blocked"] for r in urls.judge(df, listed).select("page_id", "blocked").collect()} == {i: b for i, (_, b) in enumerate(long)}


def test_generated_list(spark):
    dated = urls.generated(spark, 500).collect()
    assert len(dated) == 500 and {r["kind"] for r in dated} == {"domain", "host", "prefix"} and {r["list"] for r in dated} == {"block", "allow"} and all(r["pattern"] and r["at"] for r in dated)


def test_urls_as_of(spark):
    listed = (("block", "domain", "bad.org", "2024-01-10", "add"), ("block", "domain", "Bad.org", "2024-02-01", "remove"), ("block", "prefix", "ok.net/x", "2024-01-01", "add"), ("allow", "host", "good.bad.org", "2024-01-15", "add"), ("block", None, "z", "2024-01-01", "add"), ("block", "host", "tie.com", "2024-01-05", "add"), ("block", "host", "tie.com", "2024-01-05", "remove"))
    pages = [("http://www.bad.org/a", "2024-01-09"), ("http://www.bad.org/a", "2024-01-10"), ("https://u:p@GOOD.bad.org:80/", "2024-01-14"), ("https://good.bad.org", "2024-01-16"), ("http://bad.org", "2024-02-01"), ("http://ok.net/x/y?z", "2024-03-01"), ("http://ok.net/xy", "2024-03-01"), ("http://tie.com", "2024-01-06"), (None, "2024-01-12"), ("bad.org", "2024-01-12"), ("http://notbad.org", "2024-01-12"), ("http://bad.org", None)]
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(pages)], "page_id long, url string, day string").withColumn("fetched_at", F.to_timestamp("day")).withColumn("KEY", F.lit("clash")).withColumn("_id", F.lit(1))
    got = {r["page_id"]: r["blocked"] for r in urls.judge(df, urls.entries(spark, listed)).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [1, 2, 5] and len(got) == len(pages)
    assert urls.judge(df.union(df), urls.entries(spark, listed)).count() == 2 * len(pages)
    assert urls.judge(df.limit(0), urls.entries(spark, listed)).count() == 0
    assert urls.judge(df, urls.entries(spark, listed).limit(0)).filter("blocked").count() == 0
    assert sorted(r["page_id"] for r in urls.filtered(df, urls.entries(spark, listed)).collect()) == [0, 3, 4, *range(6, 12)]


def plain_edit(held, sums, shards):
    """The next map: slots stay while their shard's running sum is at most the mean, the rest go to the least filled."""
    size = {v: sums.get(v, 0) for v in held}
    mean, out, load, pool = math.ceil(sum(size.values()) / shards), {}, [0] * shards, []
    running = Counter()
    for v in sorted(held, key=lambda v: (-size[v], v)):
        running[held[v]] += size[v]
        if held[v] < shards and running[held[v]] <= mean:
            out[v] = held[v]
            load[held[v]] += size[v]
        else:
            pool.append(v)
    for v in pool:
        k = load.index(min(load))
        out[v] = k
        load[k] += size[v]
    return out


@pytest.mark.parametrize("shards", [3, 4, 5])
def test_map_edits_equal_a_plain_version(spark, shards):
    r = random.Random(shards)
    held = {v: r.randrange(4) for v in range(64)}
    sums = {v: r.choice((0, 5, 5, 40, 300)) for v in range(0, 64, 1 + shards % 2)}
    slot_map = spark.createDataFrame([(1, v, k) for v, k in held.items()] + [(0, v, 0) for v in held], "version int, vslot int, shard int")
    table = spark.createDataFrame([(v, b, 1) for v, b in sums.items()], "vslot int, bytes long, n long")
    got = sharding.edited(slot_map, table, shards).collect()
    assert {x["vslot"]: x["shard"] for x in got} == plain_edit(held, sums, shards) and {x["version"] for x in got} == {2}


def test_other_columns_and_very_long_texts_of_passages(spark):
    r = random.Random(4)
    docs = {1: " ".join(f"w{r.randrange(9000)}" for _ in range(60_000)), 2: "a b c d e f g h i j k l m n o p q r s t u v", 3: "x", 4: None}
    docs[5] = "y " + docs[1][200_000:201_000] + " z " + docs[2]
    df = spark.createDataFrame(list(docs.items()), SCHEMA).withColumn("part", F.lit("clash")).withColumn("blob", F.lit("clash")).withColumn("doc", F.lit("clash"))
    got = {x["doc_id"]: tuple([tuple(p) for p in x[c]] for c in ("passages", "removed")) for x in substrings.passages(df).collect()}
    assert set(got) == {1, 2, 5} and got == brute_passages(docs)


@pytest.mark.parametrize("size", [2, 5, 9, 33])
def test_passages_of_other_lengths(spark, size):
    r = random.Random(size)
    docs = {k: " ".join(r.choice("abcdefgh") for _ in range(r.randrange(60))) for k in range(30)} | {k: " ".join(f"w{r.randrange(60)}" for _ in range(80)) for k in range(30, 60)}
    got = {x["doc_id"]: tuple([tuple(p) for p in x[c]] for c in ("passages", "removed")) for x in substrings.passages(spark.createDataFrame(list(docs.items()), SCHEMA).repartition(4), least_words=size).collect()}
    assert got == brute_passages(docs, size)


def test_first_of_each_with_ties(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (2, "k l m n o p"), (3, "a1 b1 c1 d1 e1"), (3, "k l m n o p"), (3, "")]
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(5, "a b c d e f"), (5, "q r s t u v"), (2, "k l m n o p"), (3, "a1 b1 c1 d1 e1"), (3, "")])


def test_blocks_of_any_size_find_the_same_links(spark, monkeypatch):
    """Small blocks: many pairs of blocks, bands and passes over hubs switched off."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "HOT", 2)
    docs = made_corpus(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert got == brute_components(docs)


def test_names_that_agree_in_what_is_sent_fail():
    def entries(*names: list[int]) -> pa.RecordBatch:
        told = np.zeros(len(names), jaccard._ENTRY)
        told["ident"], told["n"] = np.array(names, np.uint64), 1
        return jaccard._batch([0], jaccard._SIZES, blob=[told.tobytes()])

    def packed(*names: list[int]) -> pa.RecordBatch:
        token, extra = np.arange(len(names), dtype=np.uint64), np.zeros(len(names), np.uint64)
        blobs = list(jaccard._pack(np.zeros(len(names), np.int64), np.arange(len(names)), np.array(names, np.uint64), token, extra, 1))
        return jaccard._batch([p for p, _ in blobs], jaccard._PACKED, blob=[x for _, x in blobs])

    apart = [5, 1 << 16 | 3], [6, 3]
    [good] = jaccard._gathered(iter([entries(*apart), packed(*apart)]))
    assert sorted(x.as_py() for x in good["ident"]) == sorted(np.array(x, "<u8").tobytes()[:12] for x in apart)
    alike = [5, 1 << 16 | 3], [5, 3]
    with pytest.raises(ValueError, match="80 bits"):
        list(jaccard._gathered(iter([entries(*alike), packed(*alike)])))


@pytest.mark.parametrize("n", [1, 254, 255, 256, 511, 70_000])
def test_packed_shingles_come_back(n):
    token = np.arange(n + 3, dtype=np.uint64) * np.uint64(1 << 27)
    owner, ident = np.r_[np.zeros(n, np.int64), 1, 1, 1], np.array([[1 << 63, 9], [7, 65535]], np.uint64)
    names, whose, back = jaccard._unpack(list(jaccard._pack(owner % 1, owner, ident, token, None, 1)), False)
    assert (names[whose] == ident[owner]).all() and (back & jaccard._MASK == token).all()


def test_search_sends_sets_only_where_they_have_mates(spark, tmp_path, monkeypatch):
    """200 sets in blocks of 2 or so: a list joins two sets, so each goes to the blocks of its own mates, not to all that its block meets."""
    words = [[f"w{k}x{i}" for i in range(104)] for k in range(100)]
    # Two sets of a pair share 60 of 100 shingles; their other words are like those of the pairs before and after, which joins all blocks.
    texts = []
    for k in range(100):
        texts += [" ".join(words[k][:64] + words[(k + d) % 100][64:104]) for d in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told, searched = str(tmp_path), jaccard._searched

    def counted(batches):
        def rows():
            for b in batches:
                with open(f"{told}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(b.num_rows))
                yield b

        yield from searched(rows())

    monkeypatch.setattr(jaccard, "_searched", counted)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(100)} for t in texts]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i]) and all(k == v for k, v in got.items())
    sent = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert 0 < sent <= 4 * len(texts), sent
