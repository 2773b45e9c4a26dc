"""Exact vector search, reranking, and fusion of graph and text evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from groundwork.functions import lexicon as L
from groundwork.functions import text as T
from groundwork.sources.shared import stored

#: Bytes of a query set that goes to every task as one matrix, and queries that a batch meets at once.
QUERY_BYTES, QUERY_BLOCK = 16 << 20, 512
#: Bytes of the queries and of the vectors of one cell, where a larger query set and all vectors form a grid.
CELL_QUERIES, CELL_VECTORS = 64 << 20, 32 << 20


def _nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some vectors and queries: numbers of queries, ids and distances of at least the best k for each query."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    for a in range(0, len(q), QUERY_BLOCK):
        some = q[a : a + QUERY_BLOCK]
        if metric == "l2":
            near = (x * x).sum(axis=1)[None, :] - 2 * some @ x.T + (some * some).sum(axis=1)[:, None]
        else:
            near = -(some @ x.T) / np.sqrt((some * some).sum(axis=1))[:, None] / np.sqrt((x * x).sum(axis=1))[None, :]
        m = min(k, len(ids))
        # Room for ties: what is as near as the m-th stays in.
        kth = np.partition(near, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero(near <= kth[:, None] + 1e-9)
        yield i + a, ids[j], ((x[j] - some[i]) ** 2).sum(axis=1) if metric == "l2" else -near[i, j]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _usable(vector: Column, size: int, metric: str) -> Column:
    """Of this length, all parts finite, and under cosine not all of them 0."""
    numbers = vector.cast("array<double>")
    fits = vector.isNotNull() & (F.size(vector) == size) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fits & F.exists(numbers, lambda x: x != 0) if metric == "cosine" else fits


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", metric: str = "l2", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, id, distance: the exact k nearest vectors by squared L2 (ascending) or cosine (descending).

    The stated query set (query_id, query) meets all vectors in blocks: of each block of either a matrix product keeps the
    best k, and only those are ranked together. A query set under ``query_bytes`` goes to every task; a larger one forms a
    grid with the vectors, whose cells are of bounded size and meet in a shuffle. Ties go to the smaller id. Vectors
    that are null, hold a null or a number that is not finite, have another length than the queries or, under cosine,
    are all zeros take no part, nor do those without an id; such a query is an error.
    """
    first = queries.select(F.size("query").alias("n")).first()
    size = first["n"] if first else 0
    told = queries.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(_usable(F.col("query"), size, metric), F.lit(False))).alias("bad")).first()
    if told["bad"]:
        raise ValueError("queries must have one length, and numbers that are finite and, under cosine, not all 0")
    kind, arrow = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    usable = vectors.filter(F.col(id_column).isNotNull() & _usable(F.col(vector), size, metric)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    schema = f"query_id {kind}, id long, distance double"

    def packed(names: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(found[0])), pa.array(found[1]), pa.array(found[2])], names=["query_id", "id", "distance"])

    if told["n"] * size * 8 <= query_bytes:
        rows = queries.select("query_id", "query").collect()
        shared = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["query"] for r in rows], float).reshape(len(rows), size)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, whole = shared.value
            for batch in batches:
                if batch.num_rows and len(whole):
                    for found in _nearest(batch.column(0).to_numpy(), _matrix(batch.column(1)), whole, k, metric):
                        yield packed(pa.array(names, arrow), found)

        best = usable.mapInArrow(run, schema)
    else:
        across, down = -(-told["n"] * size * 8 // CELL_QUERIES), -(-usable.count() * size * 8 // CELL_VECTORS) or 1
        # Rows are numbered before they are copied, so that all copies of one have its number.
        number = lambda n: (F.monotonically_increasing_id() % n).cast("long")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        asked = queries.select("query_id", "query", number(across).alias("across")).withColumn("down", each(down))
        held = usable.select("id", "vector", number(down).alias("down")).withColumn("across", each(across))

        def meet(some: pa.Table, there: pa.Table) -> pa.Table:
            some, there = some.combine_chunks(), there.combine_chunks()
            found = []
            if some.num_rows and there.num_rows:
                names = some.column("query_id").combine_chunks()
                q, x = (_matrix(t.column(c).combine_chunks()) for t, c in ((some, "query"), (there, "vector")))
                found = [packed(names, f) for f in _nearest(there.column("id").to_numpy(), x, q, k, metric)]
            return pa.Table.from_batches(found, schema=pa.schema([("query_id", arrow), ("id", pa.int64()), ("distance", pa.float64())]))

        best = asked.groupBy("across", "down").cogroup(held.groupBy("across", "down")).applyInArrow(meet, schema)
    order = F.col("distance") if metric == "l2" else F.desc("distance")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "distance")


def reranked(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int = 3, query: str = "query", text: str = "text") -> DataFrame:
    """The k best candidates of each question by a scorer of (query, text); ties keep the order of retrieval.

    ``scorer`` is such a function, or has an attribute ``load`` that makes one: then a model is loaded once a worker
    task, and not for each batch.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        one = scorer.load() if hasattr(scorer, "load") else scorer
        for query, text in batches:
            yield one(query, text)

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(score, "double")
    scored = candidates.withColumn("rerank_score", udf(F.col(query), F.col(text)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return scored.withColumn("new_rank", rank).filter(F.col("new_rank") <= k)


def over_fetch(k: int, rerank: bool, size: int, factor: int = 4) -> int:
    """How many to retrieve so that k remain after reranking; never more than there are."""
    return min(size, k * factor if rerank else k)


def candidates(questions: DataFrame, kg: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each candidate with its raw score.

    kg: question_id, kind (entity or triple), idx, shown, body. A graph candidate scores its lexical overlap with the
    question; 0 becomes 1 / (idx + 1). texts: question_id, idx, text, score, rerank_score: the first score there is,
    else 1 / (idx + 1).
    """
    q = questions.select("question_id", "question")
    overlap = T.lexical(F.col("question"), F.col("body"))
    first = kg.join(q, "question_id").withColumn("_s", overlap).select("question_id", F.lit("kg").alias("source"), "kind", "idx", F.col("shown").alias("display"), F.when(F.col("_s") == 0, 1 / (F.col("idx") + 1)).otherwise(F.col("_s")).alias("score_raw"))
    second = texts.select("question_id", F.lit("text").alias("source"), F.lit("chunk").alias("kind"), "idx", F.substring("text", 1, 300).alias("display"), F.coalesce("score", "rerank_score", 1 / (F.col("idx") + 1)).cast("double").alias("score_raw"))
    return first.unionByName(second)


def fused(rows: DataFrame, alpha: float = 0.4, least: float = 0.15, k: int = 4) -> DataFrame:
    """The k best candidates of each question.

    Raw scores are min-max normalised by question and source (all equal: 1), weighed, and held against the least
    score; where none passes, all stay. Order: score, then entities, triples, texts, then idx.
    """
    within = Window.partitionBy("question_id", "source")
    low, high = F.min("score_raw").over(within), F.max("score_raw").over(within)
    norm = rows.withColumn("score_norm", F.when(high == low, 1.0).otherwise((F.col("score_raw") - low) / (high - low)))
    kg = F.when(F.col("source") == "kg", F.col("score_norm")).otherwise(0.0)
    text = F.when(F.col("source") == "text", F.col("score_norm")).otherwise(0.0)
    whole = norm.withColumns({"score_kg": kg, "score_text": text}).withColumn("combined_score", alpha * F.col("score_kg") + (1 - alpha) * F.col("score_text"))
    strong = F.col("combined_score") >= least
    any_strong = F.max(strong).over(Window.partitionBy("question_id"))
    pool = whole.withColumn("_any", any_strong).filter(strong | ~F.col("_any")).drop("_any")
    place = F.when(F.col("kind") == "entity", 0).when(F.col("kind") == "triple", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("combined_score"), place, "idx"))
    return pool.withColumn("rank", rank).filter(F.col("rank") <= k)


def needs_more(questions: DataFrame, evidence: DataFrame, least: float = 0.25) -> DataFrame:
    """Questions whose best evidence is weak or that have none: those for which a second, wider retrieval pays."""
    best = evidence.groupBy("question_id").agg(F.max("combined_score").alias("best"))
    return questions.select("question_id").join(best, "question_id", "left").select("question_id", (F.coalesce("best", F.lit(0.0)) < least).alias("refetch"))


#: How many more graph and text candidates a second retrieval takes.
MORE_KG, MORE_TEXT = 4, 2


def adaptive(questions: DataFrame, retrieve: Callable[[DataFrame, int, int], DataFrame], kg_k: int, text_k: int, least: float = 0.25, fuse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The fused evidence of each question, with ``fetched``: 1, or 2 where the first retrieval was too weak.

    ``retrieve`` gives the candidates (see candidates) of some questions for so many of the graph and of the texts;
    ``fuse`` is fused by default. Only questions whose best evidence is below ``least``, or that have none, are retrieved
    again, with more of both, and what that finds takes the place of their first evidence, better or not.
    """
    fuse = fuse or fused
    once = stored(fuse(retrieve(questions, kg_k, text_k)))
    weak = stored(needs_more(questions, once, least).filter("refetch").select("question_id"))
    twice = fuse(retrieve(questions.join(weak, "question_id", "left_semi"), kg_k + MORE_KG, text_k + MORE_TEXT))
    return once.join(weak, "question_id", "left_anti").withColumn("fetched", F.lit(1)).unionByName(twice.withColumn("fetched", F.lit(2)))


WEAK, NONE = L.WEAK_EVIDENCE, L.NO_EVIDENCE


def resolved(alias: Column, known: dict[str, str], default: str) -> Column:
    """A model's name: of a known alias, what it stands for; with a slash in it, as it is; else the default."""
    named = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[alias] if known else F.lit(None).cast("string")
    return F.coalesce(named, F.when(alias.contains("/"), alias), F.lit(default))


def is_asked(question: Column) -> Column:
    """Whether there is a question at all: not null, not blank."""
    return F.coalesce(F.trim(question) != "", F.lit(False))


def gathered(questions: DataFrame, entities: DataFrame, triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, question, error, kg_results (entities, triples and their numbers), text_results: one row a question.

    entities (question_id, rank, text), triples (question_id, rank, subject, relation, object) and chunks (question_id,
    rank, text) come in the order of their ranks. A null or blank question has the error and empty results, whatever was
    found for it; one for which nothing was found has empty ones. Questions come trimmed.
    """
    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        item = F.struct("rank", F.struct(*columns).alias("x"))
        return rows.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda y: y["x"]).alias(name))

    lists = {"_e": listed(entities, "_e", "text"), "_t": listed(triples, "_t", "subject", "relation", "object"), "_c": listed(chunks, "_c", "text")}
    rows = questions.select("question_id", "question")
    for found in lists.values():
        rows = rows.join(found, "question_id", "left")
    asked = is_asked(F.col("question"))
    kept = {n: F.coalesce(F.when(asked, F.col(n)), F.array().cast(found.schema[n].dataType)) for n, found in lists.items()}
    graph = F.struct(kept["_e"].alias("entities"), kept["_t"].alias("triples"), F.size(kept["_e"]).alias("num_entities"), F.size(kept["_t"]).alias("num_triples"))
    return rows.select("question_id", F.trim("question").alias("question"), F.when(~asked, L.EMPTY_QUESTION).alias("error"), graph.alias("kg_results"), kept["_c"].alias("text_results"))


def raw_evidence(entities: DataFrame, triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, source, display, rank: what stands in for fused evidence where there is none.

    The first two of each kind that a question has: entities and triples (by rank) as the graph's lines, chunks cut
    to 220 characters.
    """
    e = entities.select("question_id", F.lit("kg").alias("source"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ("), F.coalesce("canonical_label", F.lit("")), F.lit(")")).alias("display"), "rank")
    line = F.concat(F.coalesce("subject", F.lit("")), F.lit(" --["), F.coalesce("relation", F.lit("")), F.lit("]--> "), F.coalesce("object", F.lit("")))
    t = triples.select("question_id", F.lit("kg").alias("source"), line.alias("display"), (F.col("rank") + 2).alias("rank"))
    c = chunks.select("question_id", F.lit("text").alias("source"), F.substring(F.coalesce("text", F.lit("")), 1, 220).alias("display"), (F.col("rank") + 4).alias("rank"))
    return e.filter("rank <= 2").unionByName(t.filter("rank <= 4")).unionByName(c.filter("rank <= 6"))


def extractive_answers(questions: DataFrame, evidence: DataFrame, least: float = 0.2, raw: DataFrame | None = None, strip: Callable[[Column], Column] = T.strip) -> DataFrame:
    """question_id, answer: put together from the three lines that match the question best, or words of uncertainty.

    ``strip`` takes off what is around a line: all white space by default.

    A question without any evidence uses its rows of ``raw`` (see raw_evidence), if given. Evidence of which no line
    is left once stripped matches weakly; only a question without evidence has too little.
    """
    shown = evidence.select("question_id", "source", "display", "rank")
    if raw is not None:
        shown = shown.unionByName(raw.select("question_id", "source", "display", "rank").join(evidence.select("question_id").distinct(), "question_id", "left_anti"))
    rows = shown.join(questions.select("question_id", "question"), "question_id").withColumn("_line", strip(F.coalesce("display", F.lit(""))))
    scored = rows.select("question_id", "source", "_line", "rank", T.lexical(F.col("question"), F.col("_line")).alias("_s"))
    order = Window.partitionBy("question_id").orderBy(F.col("_line") == "", F.desc("_s"), F.col("source") == "text", "rank")
    top = scored.withColumn("_n", F.row_number().over(order)).filter("_n <= 3").withColumn("_ok", F.col("_line") != "")
    by = top.groupBy("question_id").agg(F.max(F.when(F.col("_ok"), F.col("_s")).otherwise(0.0)).alias("best"), *[F.max(F.when((F.col("_n") == n) & F.col("_ok"), F.col("_line"))).alias(f"_{n}") for n in (1, 2, 3)], F.max((F.col("source") == "text") & F.col("_ok")).alias("_text"), F.max((F.col("source") == "kg") & F.col("_ok")).alias("_kg"))
    around = lambda parts, *inner: F.concat(*[x for pair in zip(map(F.lit, parts), (*inner, F.lit("")), strict=True) for x in pair])
    body = F.concat_ws(" ", around(L.EVIDENCE_FIRST, F.col("question"), F.col("_1")), around(L.EVIDENCE_SECOND, F.col("_2")), around(L.EVIDENCE_THIRD, F.col("_3")))
    sources = F.concat_ws(", ", F.when(F.col("_text"), L.SOURCE_TEXT), F.when(F.col("_kg"), L.SOURCE_GRAPH))
    told = F.when(F.col("best").isNull(), F.lit(NONE)).when(F.col("best") < least, F.lit(WEAK)).otherwise(F.concat(body, F.lit(L.SOURCES), sources))
    return questions.select("question_id", "question").join(by, "question_id", "left").select("question_id", told.alias("answer"))


def context(rows: DataFrame, line, limit: int = 25) -> DataFrame:
    """question_id, context: the first lines of each question's results, as a prompt shows them."""
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("l"))))
    return rows.filter(F.col("rank") <= limit).groupBy("question_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("context"))


def hash_encoder(size: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """A deterministic stand-in for an encoder: hashed tokens, summed and normalised."""
    import zlib

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            for token in (text or "").lower().split():
                h = zlib.crc32(token.encode())
                row[h % size] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode
