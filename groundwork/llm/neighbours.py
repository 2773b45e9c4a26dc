"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors are one node, so a vector that fills a third of the table is one node too, with its smallest ids as
members. A first graph comes from brute force inside small cells of random hyperplanes; a node that finds too few others
there is held against the landmarks, so every node has edges.

NN-descent then improves the graph, until it is settled: the neighbours of a node, in both directions, are neighbours of
neighbours of each other. A join brings them together with their vectors; pairs of which one has come to the node's lists
since the last round are compared, and each takes over what is nearer than its present last neighbour. A node to whose
lists nothing new has come rests.

A query starts at its own node, if it has one, and at the nearest of a bounded number of landmarks. In each round the
nearest nodes of its list that have not been opened bring their neighbours, until the list stands still. Scores are
cosines in double precision of the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut, release


@dataclass(frozen=True)
class Settings:
    neighbours: int = 28  #: kept for each node
    trees: int = 4  #: random divisions into cells that the first graph comes from
    cell: int = 256  #: nodes of a cell about
    settled: float = 0.003  #: share of edges that changed below which it ends
    beam: int = 384  #: nodes in a query's list
    opened: int = 64  #: nodes that a query opens in a round
    landmarks: int = 256  #: entry points that every query, and every node with too few edges, is held against
    block: int = 128  #: nodes whose neighbourhoods one task call handles about
    seed: int = 11


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vec of the vectors that take part: not null or zero, all components finite. Shorter ones are filled up with zeros."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vec"))
    good = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    least, most = good.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least == most:
        return good
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    return good.select("id", F.concat("vec", F.array_repeat(F.lit(0).cast(kind), F.lit(most) - F.size("vec"))).alias("vec"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that none overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray, names: tuple = ("u", "v", "sim")) -> pa.Table:
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], names=list(names))


def _top(edges: DataFrame, k: int, by: str = "u") -> DataFrame:
    """The k nearest edges of each node, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), "v"))
    return edges.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _brute(k: int):
    """Every node of a cell with the k nearest others."""

    def run(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").to_numpy(), _unit(_matrix(group.column("vec")))
        out = []
        for a in range(0, len(ids), 512):
            sims = x[a : a + 512] @ x.T
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
            m = min(k, len(ids) - 1)
            if m > 0:
                at = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                out.append(_edges(np.repeat(ids[a : a + 512], m), ids[at].ravel(), np.take_along_axis(sims, at, axis=1).ravel()))
        return pa.concat_tables(out) if out else _edges(ids[:0], ids[:0], np.empty(0))

    return run


def _first_graph(nodes: DataFrame, n: int, s: Settings) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(n / s.cell, 1)))))

    def cells(batches):
        for batch in batches:
            x = _unit(_matrix(pa.chunked_array([batch.column("vec")])))
            planes = np.random.default_rng(s.seed).normal(size=(x.shape[1], s.trees * bits))
            sign = (x @ planes > 0).reshape(len(x), s.trees, bits)
            code = (sign * (1 << np.arange(bits))).sum(axis=2)
            for t in range(s.trees):
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t], pa.int64())], names=["id", "vec", "tree", "cell"])

    kind = nodes.schema["vec"].dataType.simpleString()
    placed = nodes.mapInArrow(cells, f"id long, vec {kind}, tree int, cell long")
    # A crowded cell is dealt out again by hash, so that none grows with the table.
    size = placed.groupBy("tree", "cell").agg(F.count("*").alias("m"))
    dealt = placed.join(size, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("m") / (2 * s.cell))))
    found = dealt.groupBy("tree", "cell", "part").applyInArrow(_brute(s.neighbours), "u long, v long, sim double")
    return cut(_top(found.distinct(), s.neighbours))


def _marks(nodes: DataFrame, s: Settings) -> DataFrame:
    """The landmarks: bounded in number, so they may go to every task."""
    return nodes.orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.landmarks)


def _with_marks(nodes: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """edges, where a node with fewer than it should have gets its nearest landmarks too."""
    marks = _marks(nodes, s).toArrow()
    if not len(marks):
        return edges
    there, y = marks.column("id").to_numpy(), _unit(_matrix(marks.column("vec")))

    def near(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids = part.column("id").to_numpy()
                sim = _unit(_matrix(pa.chunked_array([part.column("vec")]))) @ y.T
                sim[ids[:, None] == there[None, :]] = -np.inf
                m = min(s.neighbours, len(there))
                at = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                sim = np.take_along_axis(sim, at, axis=1).ravel()
                u, v = np.repeat(ids, m), there[at].ravel()
                yield from _edges(u[sim > -2], v[sim > -2], sim[sim > -2]).to_batches()

    full = edges.groupBy("u").count().filter(F.col("count") >= s.neighbours).select(F.col("u").alias("id"))
    more = nodes.join(full, "id", "left_anti").mapInArrow(near, "u long, v long, sim double")
    return cut(_top(edges.union(more).groupBy("u", "v").agg(F.max("sim").alias("sim")), s.neighbours))


def _local_join(group: pa.Table) -> pa.Table:
    """Of nodes that meet at w: pairs, one of them new there, that are nearer than a node's present last neighbour."""
    w, ids, last, old = (group.column(c).to_numpy() for c in ("w", "id", "last", "old"))
    x = _unit(_matrix(group.column("vec")))
    order = np.lexsort((old, ids, w))
    w, ids, last, old, x = w[order], ids[order], last[order], old[order], x[order]
    # A node that is in both lists of w is there once, as new if either has it so.
    once = np.r_[True, (w[1:] != w[:-1]) | (ids[1:] != ids[:-1])]
    w, ids, last, new, x = w[once], ids[once], last[once], old[once] == 0, x[once]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]).tolist()
    us, vs, sims = [], [], []
    for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
        sim = x[a:b] @ x[a:b].T
        good = (sim > last[a:b, None]) & (new[a:b, None] | new[None, a:b])
        np.fill_diagonal(good, False)
        i, j = np.nonzero(good)
        us.append(ids[a:b][i])
        vs.append(ids[a:b][j])
        sims.append(sim[i, j])
    u, v, sim = np.concatenate(us), np.concatenate(vs), np.concatenate(sims)
    # A pair that met at several nodes of this block is told once.
    order = np.lexsort((v, u))
    u, v, sim = u[order], v[order], sim[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.empty(0, bool)
    return _edges(u[new], v[new], sim[new])


def graph(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """u, v, sim: the neighbours of each node (id, vec), by NN-descent."""
    n = nodes.count()
    first = _first_graph(nodes, n, s)
    done = _with_marks(nodes, first, s)
    if done is not first:
        release(first)
    edges = done.select("u", "v", "sim", F.lit(0).alias("old"))
    blocks = max(1, n // s.block)
    # It ends: a round with a change has brought some node a nearer neighbour.
    while True:
        back = _top(edges.select(F.col("v").alias("w"), F.col("u").alias("v"), "sim", "old"), s.neighbours, "w").select("w", "v", "old")
        lists = edges.select(F.col("u").alias("w"), "v", "old").union(back).groupBy("w").agg(F.collect_list(F.struct(F.col("v").alias("id"), "old")).alias("met"), F.min("old").alias("some"))
        meet = lists.filter("some = 0").select("w", F.explode("met").alias("m")).select("w", "m.id", "m.old")
        last = edges.groupBy("u").agg(F.min("sim").alias("_min"), F.count("*").alias("_n")).select(F.col("u").alias("_u"), F.when(F.col("_n") >= s.neighbours, F.col("_min")).otherwise(F.lit(-2.0)).alias("last"))
        known = nodes.join(last, nodes["id"] == last["_u"], "left").select("id", "vec", F.coalesce("last", F.lit(-2.0)).alias("last"))
        brought = meet.join(known, "id").withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)))
        near = brought.groupBy("block").applyInArrow(_local_join, "u long, v long, sim double")
        # One pair's cosine may differ in its last digits from task to task: the largest stands for it.
        merged = edges.select("u", "v", "sim", F.lit(1).alias("old")).unionByName(near.withColumn("old", F.lit(0))).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
        before, done = done, cut(_top(merged, s.neighbours))
        release(before)
        edges = done
        changed, total = done.agg(F.count_if(F.col("old") == 0), F.count("*")).first()
        if changed <= s.settled * total:
            out = done.select("u", "v", "sim")
            out._groundwork_path = done._groundwork_path
            return out


def _cosines(batches):
    """q, v, sim of rows (q, v, query's vector, node's vector)."""
    for batch in batches:
        if batch.num_rows:
            a, b = (_matrix(pa.chunked_array([batch.column(c)])) for c in ("qvec", "vec"))
            a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
            sim = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(sim)], names=["q", "v", "sim"])


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """q, v, sim: for queries (q, qvec, own node or null) the list of nearest nodes that greedy search ends with."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    start = queries.select("q", "qvec").join(F.broadcast(_marks(nodes, s).select(F.col("id").alias("v"), "vec")), F.lit(True)).select("q", "v", "qvec", "vec")
    best = _top(start.mapInArrow(_cosines, "q long, v long, sim double"), 4, "q")
    own = queries.filter("own is not null").select("q", F.col("own").alias("v"), "qvec").join(nodes, F.col("v") == F.col("id")).select("q", "v", "qvec", "vec").mapInArrow(_cosines, "q long, v long, sim double")
    held = cut(best.union(own).groupBy("q", "v").agg(F.max("sim").alias("sim")).withColumn("opened", F.lit(False)))
    # It ends: the lists only get nearer, and a node on a list is opened once.
    while True:
        place = F.row_number().over(Window.partitionBy("q").orderBy("opened", F.desc("sim"), "v"))
        ranked = held.withColumn("open", (place <= s.opened) & ~F.col("opened"))
        opening = ranked.filter("open").select("q", F.col("v").alias("u"))
        if opening.isEmpty():
            break
        reached = opening.join(both, "u").select("q", "v").distinct().join(held.select("q", "v"), ["q", "v"], "left_anti")
        seen = reached.join(queries.select("q", "qvec"), "q").join(nodes, F.col("v") == F.col("id")).select("q", "v", "qvec", "vec").mapInArrow(_cosines, "q long, v long, sim double")
        merged = ranked.select("q", "v", "sim", (F.col("opened") | F.col("open")).alias("opened")).unionByName(seen.withColumn("opened", F.lit(False)))
        # Opened nodes that fall off the list would only be reached again: the list is what counts.
        before, held = held, cut(_top(merged, s.beam, "q"))
        release(before)
    release(both)
    return held.select("q", "v", "sim")


def nearest(vectors: DataFrame, queries: Callable[[Column], Column], k: int = 5, id_column: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id meets the condition ``queries`` its k nearest other rows found.

    Vectors that are null, zero, or hold a null or non-finite component take no part, neither as queries nor as
    candidates; nor do rows without an id. Vectors of any length go through whole. A vector shorter than the longest counts as if zeros followed. Ties go to
    the smaller vec_id. Repeated rows (one id, one vector) are one row; distinct vectors under one id are rows of their
    own, but never neighbours of that id; equal vectors of other ids are candidates like all others, and queries with
    equal vectors are searched for once. With fewer than k candidates all are told; an empty table gives an empty
    result; other columns are left out.
    """
    rows = cut(usable(vectors, id_column, vector).distinct())
    # Of equal vectors only the k + 1 smallest ids can ever be told.
    alike = Window.partitionBy("vec").orderBy("id")
    ranked = rows.withColumn("rn", F.row_number().over(alike)).filter(F.col("rn") <= k + 1).withColumn("node", F.min("id").over(Window.partitionBy("vec")))
    # Two vectors under one id are two nodes: such a node is named by its vector too.
    twice = F.size(F.collect_set("vec").over(Window.partitionBy("node"))) > 1
    members = cut(ranked.withColumn("node", F.when(twice, F.xxhash64("node", "vec")).otherwise(F.col("node"))).select("node", F.col("id").alias("member"), F.when(F.col("rn") == 1, F.col("vec")).alias("vec")))
    nodes = cut(members.filter("vec is not null").select(F.col("node").alias("id"), "vec"))
    asked = rows.filter(queries(F.col("id"))).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    own = nodes.select(F.col("id").alias("own"), F.col("vec").alias("_vec"))
    asked = cut(asked.join(own, asked["qvec"] == own["_vec"]).select("query_id", "qvec", "own"))
    once = cut(asked.groupBy(F.col("own").alias("q")).agg(F.any_value("qvec").alias("qvec")).withColumn("own", F.col("q")))
    edges = graph(nodes, s)
    found = search(once, nodes, edges, s)
    release(edges)
    told = found.join(members.select("node", "member"), found["v"] == members["node"]).select("q", "sim", "member")
    # A query passes over the rows of its own id, of which there are as many as that id has vectors: a row stays if so few
    # others come before it once those of any one id are left out.
    order = [F.desc("sim"), "member"]
    nth = F.row_number().over(Window.partitionBy("q", "member").orderBy(*order))
    by_q = Window.partitionBy("q").orderBy(*order)
    most = F.coalesce(F.max("nth").over(by_q.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = told.withColumn("nth", nth).withColumns({"rank": F.row_number().over(by_q), "most": most}).filter(F.col("rank") - F.col("most") <= k)
    best = placed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "sim", "member"))).alias("best"))
    mine = asked.join(best, asked["own"] == best["q"]).select("query_id", F.slice(F.filter("best", lambda x: x["member"] != F.col("query_id")), 1, k).alias("best"))
    out = mine.select("query_id", F.posexplode("best").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.member").alias("vec_id"), F.col("x.sim").alias("score"))
