"""Entities, relations and triples; lookups over the graph that they form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L
from groundwork.functions import text as T
from groundwork.operators.lookups import containing
from groundwork.sources.shared import stored


def keep_first(rows: DataFrame, keys: Sequence[Column], order: str = "seq") -> DataFrame:
    """Of rows with equal keys the one that comes first; deterministic, with partial aggregation."""
    names = [f"_k{i}" for i in range(len(keys))]
    kept = rows.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return kept.select("_row.*")


def first_entities(entities: DataFrame) -> DataFrame:
    """Entities by normalised text, label and chunk: the first of each; those without text are dropped."""
    key = T.dedup_key(F.col("text"))
    return keep_first(entities.filter(key != ""), [key, F.col("canonical_label"), F.col("chunk_id")])


def first_triples(triples: DataFrame) -> DataFrame:
    return keep_first(triples, [F.lower("subject"), F.col("relation"), F.lower("object")])


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Case-sensitive, without triples that lack a part."""
    whole = triples.filter((F.coalesce("subject", F.lit("")) != "") & (F.coalesce("relation", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != ""))
    return keep_first(whole, [F.col("subject"), F.col("relation"), F.col("object")])


def validated(entities: DataFrame, labels: DataFrame, chunks: DataFrame, batch: int = 5) -> DataFrame:
    """Entities with text and a canonical label; an unknown chunk becomes the first chunk of the entity's batch."""
    named = entities.filter((F.trim("text") != "") & (F.trim("canonical_label") != "")).join(labels.select("canonical_label").distinct(), "canonical_label", "left_semi")
    first = batches(chunks, batch).select("batch", F.element_at("chunk_ids", 1).alias("_first"))
    known = chunks.select(F.col("chunk_id").alias("_known"))
    joined = named.join(known, named["chunk_id"] == known["_known"], "left").join(first, "batch", "left")
    return joined.select("seq", "text", "canonical_label", F.coalesce("_known", "_first").alias("chunk_id"))


def batches(chunks: DataFrame, size: int = 5) -> DataFrame:
    """batch, chunk_ids: chunks by their ordinal, so many to a batch."""
    return chunks.groupBy(F.floor(F.col("seq") / size).alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))


def label_frequency(labels: DataFrame, column: str = "canonical_label") -> DataFrame:
    """Labels with their counts and first places: most frequent first, ties by first appearance."""
    return labels.groupBy(column).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def frequent(labels: DataFrame, least: int, k: int | None = None, column: str = "canonical_label") -> DataFrame:
    """Labels with at least so many rows, most frequent first, ties by first appearance; the first k of them, if given."""
    some = label_frequency(labels, column).filter(F.col("n") >= least).orderBy(F.desc("n"), "first_seq")
    return some if k is None else some.limit(k)


def by_label(entities: DataFrame, label: str, k: int = 10) -> DataFrame:
    """The first k entities of a label, in their order."""
    return entities.filter(F.col("canonical_label") == label).orderBy("seq").limit(k)


def by_relation(edges: DataFrame, relation: str, k: int = 10) -> DataFrame:
    """The first k edges of a relation, by eid."""
    return edges.filter(F.col("relation") == relation).orderBy("eid").limit(k)


def labels_of(chunks: DataFrame, most: int = 3, labels: str = "labels") -> DataFrame:
    """chunk_id, place, raw_label: the first few labels of each chunk, a row each; chunks without labels have none."""
    return chunks.select("chunk_id", F.posexplode(F.slice(labels, 1, most)).alias("place", "raw_label"))


def label_run(chunks: DataFrame, most: int = 3, labels: str = "labels") -> DataFrame:
    """chunks, errors, labels, per_chunk, unique: one row about a pass of labelling. A null list of labels is an error; the
    mean, to two places, is over all chunks, and null without any."""
    kept = F.slice(F.coalesce(labels, F.array().cast("array<string>")), 1, most)
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col(labels).isNull()).alias("errors"), F.coalesce(F.sum(F.size(kept)), F.lit(0)).alias("labels"))
    unique = labels_of(chunks, most, labels).agg(F.count_distinct("raw_label").alias("unique"))
    one = counts.join(F.broadcast(unique))  # one row each
    return one.select("chunks", "errors", "labels", F.round(F.try_divide("labels", "chunks"), 2).alias("per_chunk"), "unique")


def canonical(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows (raw_label) by their canonical label; labels that the map drops or does not know go."""
    return rows.join(mapping, "raw_label").filter("canonical is not null")


def relation_matrix(labels: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """label_a, label_b, relation for all ordered pairs of labels.

    Labels are a vocabulary, not data. A label to skip gives NONE, then given pairs hold, then the model's, else NONE.
    """
    spark = labels.sparkSession
    given = F.broadcast(relations(spark))
    a, b = labels.select(F.col("canonical_label").alias("label_a")), labels.select(F.col("canonical_label").alias("label_b"))
    pairs = a.join(b, F.col("label_a") != F.col("label_b")).join(given, ["label_a", "label_b"], "left")
    told = F.lit(None).cast("string")
    if model is not None:
        pairs = pairs.join(model.select("label_a", "label_b", F.col("relation").alias("_told")), ["label_a", "label_b"], "left")
        told = T.relation(F.col("_told"))
    skip = F.col("label_a").isin(*L.SKIP_LABELS) | F.col("label_b").isin(*L.SKIP_LABELS)
    return pairs.select("label_a", "label_b", F.when(skip, "NONE").otherwise(F.coalesce("given", told, F.lit("NONE"))).alias("relation"))


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in L.RELATIONS], "label_a string, label_b string, given string")


def cooccurring(entities: DataFrame) -> DataFrame:
    """Ordered pairs of entities of one chunk, never a place with itself. Chunks bound the pairs; they join on the chunk."""
    a = entities.select("chunk_id", *[F.col(c).alias(f"{c}_a") for c in ("seq", "text", "canonical_label")])
    b = entities.select("chunk_id", *[F.col(c).alias(f"{c}_b") for c in ("seq", "text", "canonical_label")])
    return a.join(b, "chunk_id").filter(F.col("seq_a") != F.col("seq_b"))


def cooccurrence(entities: DataFrame) -> DataFrame:
    """label_a, label_b, n: how many ordered pairs of different entities of one chunk have these labels.

    Counts of labels by chunk are multiplied, so no pair of entities is ever made; a chunk of any size is a row for each label.
    """
    by = entities.groupBy("chunk_id", F.col("canonical_label").alias("label")).agg(F.count("*").alias("n"))
    a, b = (by.select("chunk_id", F.col("label").alias(f"label_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = F.col("n_a") * (F.col("n_b") - (F.col("label_a") == F.col("label_b")).cast("long"))
    return a.join(b, "chunk_id").groupBy("label_a", "label_b").agg(F.sum(pairs).alias("n")).filter("n > 0")


def related(entities: DataFrame, matrix: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Ordered pairs of different entities of one chunk whose labels have a relation, with it.

    The matrix leads: an entity looks, in its chunk, for the labels that its own is related to, so only related pairs are
    made. Spark splits large partitions of this join. With ``group_rows``, for tables whose chunks may be huge, the side
    that looks is also dealt to several tasks where more of its rows than that look for one label in one chunk, and the
    other side goes to each of them; that costs a count of the groups.
    """
    some = matrix.filter(F.col("relation") != "NONE").select(F.col("label_a").alias("canonical_label_a"), F.col("label_b").alias("canonical_label_b"), "relation")
    side = lambda x: entities.select("chunk_id", *[F.col(c).alias(f"{c}_{x}") for c in ("seq", "text", "canonical_label")])
    keys = ["chunk_id", "canonical_label_b"]
    looking, found = side("a").join(some, "canonical_label_a"), side("b")
    if group_rows:
        large = looking.groupBy(*keys).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("_of")).filter("_of > 1")
        of = F.coalesce("_of", F.lit(1))
        looking = looking.join(large, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("seq_a"), of).cast("int")).drop("_of")
        found = found.join(large, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), of - 1))).drop("_of")
        keys = [*keys, "_salt"]
    return looking.join(found, keys).filter(F.col("seq_a") != F.col("seq_b")).drop("_salt")


def triples(entities: DataFrame, matrix: DataFrame, chunks: DataFrame) -> DataFrame:
    """Triples of meaningful entities that meet in a chunk and whose labels have a relation; the first of equal ones."""
    useful = entities.filter(T.meaningful(F.col("text")) & ~F.col("canonical_label").isin(*L.SKIP_LABELS))
    met = related(useful, matrix)
    place = chunks.select("chunk_id", "source_file")
    rows = met.select(F.struct("seq_a", "seq_b").alias("seq"), F.col("text_a").alias("subject"), F.col("canonical_label_a").alias("subject_label"), "relation", F.col("text_b").alias("object"), F.col("canonical_label_b").alias("object_label"), "chunk_id")
    return first_triples(rows).join(place, "chunk_id", "left").select("subject", "subject_label", "relation", "object", "object_label", "chunk_id", F.coalesce("source_file", F.lit("unknown")).alias("source_file"))


# Lookups. Questions are (question_id, phrase, keywords); edges are (eid, subject, subject_label, relation, object, object_label).


def hits(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (phrase, ...) with every distinct name (``name``) that holds the phrase."""
    return asked.join(containing(names, asked), "phrase")


def names_of(edges: DataFrame, either: bool = True) -> DataFrame:
    """The lower-cased names of the edges' subjects (and objects)."""
    subjects = edges.select(F.lower("subject").alias("name"))
    return subjects.union(edges.select(F.lower("object"))) if either else subjects


def edges_at(found: DataFrame, edges: DataFrame, either: Column | bool) -> DataFrame:
    """The edges at the names that were hit (found: phrase, name, ...), each once for a row of asked: by their subject, or,
    where ``either`` holds, by their object when the subject does not hold the phrase."""
    kept = [c for c in found.columns if c != "name"]
    at_subject = found.join(edges, found["name"] == F.lower(edges["subject"])).select(*kept, *edges.columns)
    if either is False:
        return at_subject
    objects = found if either is True else found.filter(either)
    at_object = objects.join(edges, objects["name"] == F.lower(edges["object"])).filter(~F.coalesce(F.lower("subject").contains(F.col("phrase")), F.lit(False)))
    return at_subject.unionByName(at_object.select(*kept, *edges.columns))


def _asked(questions: DataFrame, phrase: str) -> DataFrame:
    return questions.select("question_id", F.lower(phrase).alias("phrase")).filter("phrase <> ''")


def one_hop(questions: DataFrame, edges: DataFrame, either: bool = False, relations: Sequence[str] = (), limit: int = 15, phrase: str = "phrase") -> DataFrame:
    """Edges whose subject (or, with either, object) holds the phrase, at most so many a question, in a total order."""
    chosen = edges.filter(F.col("relation").isin(*relations)) if relations else edges
    found = edges_at(hits(_asked(questions, phrase), names_of(chosen, either)), chosen, either)
    return _ranked(_as_paths(found), limit)


def two_hop(questions: DataFrame, edges: DataFrame, middle: bool = False, limit: int = 10, phrase: str = "phrase") -> DataFrame:
    """Paths of two different edges from a subject (or over a middle) that holds the phrase."""
    first = edges_at(hits(_asked(questions, phrase), names_of(edges, middle)), edges, middle)
    return _ranked(_second(_as_paths(first), edges), limit, ("second_relationship", "second_related_entity", "eid2"))


def _as_paths(found: DataFrame, *more: str) -> DataFrame:
    return found.select("question_id", *more, F.col("subject").alias("entity"), F.col("relation").alias("relationship"), F.col("object").alias("related_entity"), "eid")


def _second(first: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths of one edge gone on with by each other edge that begins where they end."""
    second = edges.select(F.col("eid").alias("eid2"), F.col("subject").alias("_mid"), F.col("relation").alias("second_relationship"), F.col("object").alias("second_related_entity"))
    return first.join(second, (F.col("related_entity") == F.col("_mid")) & (F.col("eid") != F.col("eid2"))).drop("_mid")


def _ranked(found: DataFrame, limit: int, more: tuple[str, ...] = (), by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("entity", "relationship", "related_entity", "eid", *more)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("eid", "eid2")


def _turned(found: DataFrame) -> DataFrame:
    """Edges in both orientations; a loop once."""
    back = found.filter(F.col("subject") != F.col("object")).withColumns({"subject": F.col("object"), "object": F.col("subject")})
    return found.unionByName(back)


def undirected(questions: DataFrame, edges: DataFrame, limit: int = 25, most: int = 5) -> DataFrame:
    """Edges, in both orientations, with any of the first keywords on either end; a loop counts once."""
    words = questions.select("question_id", F.explode(F.slice("keywords", 1, most)).alias("phrase"))
    plain = edges.select("eid", "subject", "relation", "object")
    found = _turned(edges_at(hits(words, names_of(plain)), plain, True))
    return _ranked(_as_paths(found).distinct(), limit)


def fallback_lookup(questions: DataFrame, edges: DataFrame, limit: int = 10, most: int = 3) -> DataFrame:
    """Edges whose subject holds any of the question's first keywords, so many in a total order; without keywords, any edges."""
    plain = F.lower(F.regexp_replace("question", r"(?U)[^a-zA-Z0-9\s]", ""))
    words = F.slice(F.filter(T.words(plain), lambda w: ~w.isin(*L.FALLBACK_STOP) & (F.length(w) > 3)), 1, most)
    asked = questions.select("question_id", words.alias("_w"))
    each = asked.select("question_id", F.explode("_w").alias("phrase"))
    found = _as_paths(edges_at(hits(each, names_of(edges, False)), edges, False)).distinct()
    # Without keywords the first edges of all will do: a fixed number of rows for each such question.
    first = edges.orderBy("subject", "relation", "object", "eid").limit(limit)
    none = asked.filter(F.size("_w") == 0).select("question_id").join(F.broadcast(first))
    return _ranked(found.unionByName(_as_paths(none)), limit)


#: Tiers of the cascade: what they look for (see ``cascade``), rows that each keeps, and the steps in which they are tried.
PHRASE, TWO_HOP, EITHER, BY_RELATION, FIRST, SECOND, THIRD, MIDDLE, LOOSE = range(9)
TIER_ROWS = {PHRASE: 15, TWO_HOP: 10, EITHER: 15, BY_RELATION: 15, FIRST: 12, SECOND: 12, THIRD: 12, MIDDLE: 10, LOOSE: 25}
STEPS = ((PHRASE,), (TWO_HOP,), (EITHER, BY_RELATION, FIRST, SECOND, THIRD), (MIDDLE, LOOSE))


def cascade(questions: DataFrame, edges: DataFrame, relations: Sequence[str] = (), synonyms: DataFrame | None = None, written: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Results of the first tier that is relevant, for each question.

    A tier is relevant if one of its rows holds a keyword of the question. ``synonyms`` (question_id, synonyms) are
    words from a model that the loosest tier looks for after the question's own; ``written`` (question_id, entity,
    relationship, related_entity, rank) are results of a pattern that a model wrote, which come before all others.

    The phrases of all tiers go through one index of names. Then a few steps, the same for any number of questions, try
    the tiers in turn; questions that a step has answered take no part in the next, so paths of two edges and loose
    matches are looked for only where nothing else was found. Each step is a table in the shared folder.
    """
    edges = stored(edges.select("eid", "subject", "relation", "object"))
    loose = F.col("keywords")
    asked = questions.select("question_id", "keywords", F.lower("phrase").alias("_p"))
    if synonyms is not None:
        asked = asked.join(synonyms.select("question_id", T.keywords(F.col("synonyms")).alias("_more")), "question_id", "left")
        loose = F.concat("keywords", F.coalesce("_more", F.array().cast("array<string>")))
    word = lambda k: F.lower(F.coalesce(F.get("keywords", F.lit(k)), F.lit("")))
    told = {PHRASE: F.col("_p"), TWO_HOP: F.col("_p"), EITHER: F.col("_p"), FIRST: word(0), SECOND: word(1), THIRD: word(2), MIDDLE: word(0)}
    told |= {BY_RELATION: word(0)} if relations else {}
    fixed = F.array(*[F.struct(F.lit(k).alias("tier"), x.alias("phrase")) for k, x in told.items()])
    each = F.concat(fixed, F.transform(F.slice(loose, 1, most), lambda w: F.struct(F.lit(LOOSE).alias("tier"), w.alias("phrase"))))
    asked = stored(asked.select("question_id", "keywords", F.filter(each, lambda x: x["phrase"] != "").alias("each")))
    left = stored(hits(asked.select("question_id", F.inline("each")), names_of(edges)))
    best = []
    for step in STEPS:
        found = edges_at(left.filter(F.col("tier").isin(*step)), edges, F.col("tier").isin(EITHER, MIDDLE, LOOSE))
        found = found.filter((F.col("tier") != BY_RELATION) | F.col("relation").isin(*relations[:8])) if relations else found
        shown = _tiers(found, edges, step)
        if written is not None and PHRASE in step:
            shown = shown.unionByName(written.select("question_id", F.lit(-1).alias("tier"), "entity", "relationship", "related_entity", "rank"))
        best.append(stored(_first_relevant(shown, asked)))
        left = left.join(best[-1].select("question_id").distinct(), "question_id", "left_anti")
    return reduce(DataFrame.unionByName, best)


def _tiers(found: DataFrame, edges: DataFrame, step: Sequence[int]) -> DataFrame:
    """question_id, tier, entity, relationship, related_entity, rank: what the tiers of a step show of the edges found."""
    by, shown = ("question_id", "tier"), ("question_id", "tier", "entity", "relationship", "related_entity", "rank")
    rows = F.coalesce(*[F.when(F.col("tier") == k, n) for k, n in TIER_ROWS.items()])
    parts = []
    if plain := [k for k in step if k not in (TWO_HOP, MIDDLE, LOOSE)]:
        parts.append(_ranked(_as_paths(found.filter(F.col("tier").isin(*plain)), "tier"), rows, by=by))
    if paths := [k for k in step if k in (TWO_HOP, MIDDLE)]:
        whole = _second(_as_paths(found.filter(F.col("tier").isin(*paths)), "tier"), edges)
        parts.append(_ranked(whole, rows, ("second_relationship", "second_related_entity", "eid2"), by))
    if LOOSE in step:
        parts.append(_ranked(_as_paths(_turned(found.filter(F.col("tier") == LOOSE)), "tier").distinct(), rows, by=by))
    return reduce(DataFrame.unionByName, [x.select(*shown) for x in parts])


def _first_relevant(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """The rows of each question's first tier of which a row holds one of its keywords. A tier holds a few rows: they travel
    as one list."""
    columns = ("entity", "relationship", "related_entity", "rank")
    text = F.lower(F.concat_ws(" ", *columns[:3]))
    marked = rows.join(questions.select("question_id", "keywords"), "question_id").withColumn("_hit", F.exists("keywords", lambda k: text.contains(k)))
    listed = marked.groupBy("question_id", "tier").agg(F.max("_hit").alias("_hit"), F.collect_list(F.struct(*columns)).alias("_rows")).filter("_hit")
    best = listed.groupBy("question_id").agg(F.min(F.struct("tier", "_rows")).alias("_x"))
    return best.select("question_id", "_x.tier", F.explode("_x._rows").alias("_r")).select("question_id", "tier", "_r.*")


def shown_triples(paths: DataFrame) -> DataFrame:
    """Paths of one or two hops as triples, the first of equal ones, none with an empty part."""
    one = F.struct(F.lit(0).alias("hop"), F.col("entity").alias("subject"), F.col("relationship").alias("relation"), F.col("related_entity").alias("object"))
    two = F.struct(F.lit(1).alias("hop"), F.col("related_entity").alias("subject"), F.col("second_relationship").alias("relation"), F.col("second_related_entity").alias("object"))
    rows = paths.select("question_id", F.col("rank"), F.explode(F.array(one, two)).alias("t")).select("question_id", F.struct("rank", "t.hop").alias("seq"), "t.subject", "t.relation", "t.object")
    whole = rows.filter((F.coalesce("subject", F.lit("")) != "") & (F.coalesce("relation", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != ""))
    return keep_first(whole, [F.col("question_id"), F.col("subject"), F.col("relation"), F.col("object")]).drop("seq")


def matched_entities(questions: DataFrame, entities: DataFrame, exact: bool = False, limit: int = 6) -> DataFrame:
    """Entities that hold the phrase or are held by it (or equal it), by first appearance of their text, then place.

    Both directions of holding go through an index; entities and questions without text match nothing.
    """
    q = _asked(questions, "phrase")
    first = entities.groupBy(F.lower("text").alias("name")).agg(F.min("seq").alias("_first")).filter("name <> ''")
    if exact:
        pairs = q.withColumn("name", F.col("phrase"))
    else:
        names, phrases = first.select("name"), q.select("phrase")
        held = containing(phrases.withColumnRenamed("phrase", "name"), names.withColumnRenamed("name", "phrase")).select(F.col("name").alias("phrase"), F.col("phrase").alias("name"))
        pairs = q.join(containing(names, phrases).unionByName(held).distinct(), "phrase")
    names = pairs.join(first, "name").select("question_id", "_first", F.col("name").alias("_t"))
    rows = entities.join(names, F.lower(entities["text"]) == names["_t"])
    order = Window.partitionBy("question_id").orderBy("_first", "seq")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("question_id", "rank", "seq", "text", "canonical_label", "chunk_id")


def triples_of(matched: DataFrame, edges: DataFrame, each: int = 6, limit: int = 6) -> DataFrame:
    """Triples that hold an entity's text at either end: so many for each entity, then distinct, then so many in all.

    num_triples is the number of distinct ones before the last limit, num_entities that of the entities.
    """
    names = matched.select("question_id", F.col("rank").alias("_e"), F.lower("text").alias("phrase"))
    hit = edges_at(hits(names, names_of(edges)), edges, True)
    some = hit.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "_e").orderBy("eid"))).filter(F.col("_n") <= each)
    first = keep_first(some.select("question_id", F.struct("_e", "_n").alias("seq"), "subject", "relation", "object"), [F.col("question_id"), F.col("subject"), F.col("relation"), F.col("object")])
    whole = Window.partitionBy("question_id")
    ranked = first.withColumns({"rank": F.row_number().over(whole.orderBy("seq")), "num_triples": F.count("*").over(whole)})
    entities = matched.groupBy("question_id").agg(F.count("*").alias("num_entities"))
    return ranked.filter(F.col("rank") <= limit).drop("seq").join(entities, "question_id")


def recognised(chunks: DataFrame, recogniser: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]], labels: Sequence[str] = L.HINT_LABELS) -> DataFrame:
    """chunk_id, idx, text, label: what a recogniser finds in each chunk, of the kinds that are kept.

    ``recogniser`` makes one recogniser for each task; it takes texts and gives each one's (text, label) in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = recogniser()
        for batch in batches:
            told = find(batch["text"].fillna("").tolist())
            rows = [(c, k, t, x) for c, found in zip(batch["chunk_id"], told, strict=True) for k, (t, x) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["chunk_id", "idx", "text", "label"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    found = chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {kind}, idx int, text string, label string")
    return found.filter(F.col("label").isin(*labels))


def with_hints(chunks: DataFrame, hints: DataFrame, none: str = "None found.") -> DataFrame:
    """chunks with hints (array of text and label, empty where there are none) and the lines that a prompt shows."""
    by = hints.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text", "label"))), lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("hints"))
    joined = chunks.join(by, "chunk_id", "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<struct<text:string,label:string>>")))
    line = F.transform("hints", lambda x: F.concat(x["text"], F.lit(" ("), x["label"], F.lit(") — from "), F.col("chunk_id").cast("string")))
    return joined.withColumn("hint_lines", F.when(F.size("hints") > 0, F.array_join(line, "\n")).otherwise(F.lit(none)))


def entity_types(nodes: DataFrame, examples: int = 3, limit: int = 20) -> DataFrame:
    """Labels in order with their first names."""
    ranked = nodes.select("label", "name").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("name"))).filter(F.col("_n") <= examples)
    return ranked.groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("examples")).orderBy("label").limit(limit)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count, rel_count, relation_types: one row."""
    n = nodes.select("label", "name").distinct().agg(F.count("*").alias("node_count"))
    e = edges.agg(F.count("*").alias("rel_count"), F.count_distinct("relation").alias("relation_types"))
    return n.join(F.broadcast(e))


def relation_samples(edges: DataFrame, types: int = 10, samples: int = 3) -> DataFrame:
    first = edges.select("relation").distinct().orderBy("relation").limit(types)
    ranked = edges.withColumn("rank", F.row_number().over(Window.partitionBy("relation").orderBy("subject", "object", "eid"))).filter(F.col("rank") <= samples)
    return ranked.join(F.broadcast(first), "relation").select("relation", "rank", "subject", "object")
