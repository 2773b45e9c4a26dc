"""Queries over entities, triples and the graph that the star schema's tables form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L
from groundwork.functions import text as T
from groundwork.functions.prompts import graph_context, schema_text
from groundwork.operators import knowledge as K
from groundwork.operators.patterns import results, written
from groundwork.plans.base import documents, quoted, table

Q: dict = {}
S: dict[str, str] = {}

#: Labels that the words of the synthetic corpus are given, by their length.
LABELS = ("emission_source", "greenhouse_gas", "climate_process", "climate_impact", "climate_policy", "organization", "technology", "ecosystem", "quantity")
_LABELS = "[" + ", ".join(quoted(x) for x in LABELS) + "]"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words as entities, in chunks of 60 words; seq is their place in the corpus."""
    words = documents(spark, sf).select("doc_id", "source", F.posexplode(T.words(F.col("text"))).alias("pos", "text")).filter(F.col("text").rlike("^[A-Z][a-z]{5,}[.,]?$"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.length("text") % len(LABELS) + 1).cast("int"))
    return words.select((F.col("doc_id") * 1000000 + F.col("pos")).alias("seq"), "text", label.alias("canonical_label"), F.concat_ws("_", "doc_id", F.floor(F.col("pos") / 60)).alias("chunk_id"), F.col("source").alias("source_file"))


_E = rf"""k AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '\S+')) AS text, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS pos FROM documents),
e AS (SELECT doc_id * 1000000 + pos AS seq, text, {_LABELS}[length(text) % {len(LABELS)} + 1] AS canonical_label, doc_id || '_' || (pos // 60) AS chunk_id, source AS source_file FROM k WHERE regexp_matches(text, '^[A-Z][a-z]{{5,}}[.,]?$'))"""


def chunks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chunk_id").agg(F.min("source_file").alias("source_file"))


@query(f"WITH {_E} SELECT seq, text, canonical_label, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(text), canonical_label, chunk_id ORDER BY seq) AS n FROM e) WHERE n = 1")
def entity_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return K.first_entities(entities(spark, sf)).select("seq", "text", "canonical_label", "chunk_id")


@query(f"WITH {_E} SELECT canonical_label, count(*) AS n, min(seq) AS first_seq FROM e GROUP BY 1")
def label_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return K.label_frequency(entities(spark, sf))


@query(f"WITH {_E} SELECT canonical_label, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 100 ORDER BY n DESC, min(seq) LIMIT 5")
def frequent_labels(spark: SparkSession, sf: str) -> DataFrame:
    return K.frequent(entities(spark, sf), 100, 5).select("canonical_label", "n")


@query(f"WITH {_E} SELECT count(*) AS n, count(DISTINCT canonical_label) AS labels, count(DISTINCT chunk_id) AS chunks, round(count(*) / count(DISTINCT chunk_id)::DOUBLE, 2) AS per_chunk FROM e")
def label_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("canonical_label").alias("labels"), F.count_distinct("chunk_id").alias("chunks")).withColumn("per_chunk", F.round(F.col("n") / F.col("chunks"), 2))


@query(f"WITH {_E}, c AS (SELECT DISTINCT doc_id AS seq, doc_id || '_0' AS chunk_id FROM documents), f AS (SELECT seq // 5 AS batch, min_by(chunk_id, seq) AS first FROM c GROUP BY 1) SELECT e.seq, e.text, canonical_label, coalesce(c.chunk_id, f.first) AS chunk_id FROM e LEFT JOIN c USING (chunk_id) LEFT JOIN f ON f.batch = e.seq // 5000000 WHERE canonical_label IN ({', '.join(quoted(x) for x in LABELS[:6])})")
def entity_validate(spark: SparkSession, sf: str) -> DataFrame:
    known = documents(spark, sf).select(F.col("doc_id").alias("seq"), F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("chunk_id")).distinct()
    labels = spark.createDataFrame([(x,) for x in LABELS[:6]], "canonical_label string")
    return K.validated(entities(spark, sf).withColumn("batch", F.floor(F.col("seq") / 5000000)), labels, known)


_LABELLED = "(SELECT doc_id AS chunk_id, CASE WHEN doc_id % 9 <> 0 THEN list_filter(regexp_extract_all(text, '[A-Z][a-z]+'), lambda w: length(w) > 4)[1:3] END AS labels FROM documents)"


@query(f"""SELECT count(*) AS chunks, count(*) FILTER (labels IS NULL) AS errors, coalesce(sum(len(labels)), 0)::BIGINT AS labels, round(coalesce(sum(len(labels)), 0) / count(*)::DOUBLE, 2) AS per_chunk, (SELECT count(DISTINCT l) FROM (SELECT unnest(labels) AS l FROM {_LABELLED})) AS "unique" FROM {_LABELLED}""")
def label_pass(spark: SparkSession, sf: str) -> DataFrame:
    """A pass of labelling: the first capitalised words stand for labels, and every ninth text for one that failed."""
    found = F.filter(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), lambda w: F.length(w) > 4)
    return K.label_run(documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 9 != 0, found).alias("labels")))


#: Kinds that the stand-in recogniser gives, by the length of a name; two of them are not kept.
KINDS = ("ORG", "PERSON", "GPE", "LOC", "LAW", "CARDINAL", "DATE")


def _recogniser():
    import re

    names = re.compile(r"\b[A-Z][a-z]{6,}\b", re.ASCII)
    return lambda texts: [[(m.group(), KINDS[len(m.group()) % len(KINDS)]) for m in names.finditer(t)] for t in texts]


@query(rf"""WITH n AS (SELECT doc_id AS chunk_id, regexp_extract_all(text, '\b[A-Z][a-z]{{6,}}\b') AS ms FROM documents),
h AS (SELECT chunk_id, unnest(ms) AS text, generate_subscripts(ms, 1) AS idx FROM n),
k AS (SELECT *, [{', '.join(quoted(x) for x in KINDS)}][length(text) % {len(KINDS)} + 1] AS label FROM h),
g AS (SELECT chunk_id, count(*) AS n, string_agg(text || ' (' || label || ') — from ' || chunk_id, chr(10) ORDER BY idx) AS lines FROM k WHERE label IN ({', '.join(quoted(x) for x in L.HINT_LABELS)}) GROUP BY 1)
SELECT doc_id AS chunk_id, coalesce(n, 0) AS n_hints, coalesce(lines, 'None found.') AS hint_lines FROM documents LEFT JOIN g ON g.chunk_id = doc_id""")
def hint_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised names of the kinds that are kept, joined to their chunks."""
    chunks = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    return K.with_hints(chunks, K.recognised(chunks, _recogniser)).select("chunk_id", F.size("hints").cast("long").alias("n_hints"), "hint_lines")


@query("SELECT l.doc_id, coalesce(d.source, 'unknown') AS source_file, l.toxic FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)")
def chunk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    known = documents(spark, sf).filter("lang = 'en'").select("doc_id", "source")
    return table(spark, sf, "labels").join(known, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source_file"), "toxic")


@query(f"""WITH {_E}, m(raw_label, canonical) AS (VALUES ('emission_source', 'source'), ('greenhouse_gas', 'source'), ('climate_process', 'process'), ('climate_impact', NULL), ('technology', 'technology'))
SELECT canonical, count(*) AS n, string_agg(DISTINCT raw_label, ',' ORDER BY raw_label) AS raw_labels FROM e JOIN m ON m.raw_label = e.canonical_label WHERE canonical IS NOT NULL GROUP BY 1""")
def canonical_labels(spark: SparkSession, sf: str) -> DataFrame:
    mapping = spark.createDataFrame([("emission_source", "source"), ("greenhouse_gas", "source"), ("climate_process", "process"), ("climate_impact", None), ("technology", "technology")], "raw_label string, canonical string")
    rows = K.canonical(entities(spark, sf).withColumnRenamed("canonical_label", "raw_label"), F.broadcast(mapping))
    return rows.groupBy("canonical").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("raw_label")), ",").alias("raw_labels"))


_SKIP = ", ".join(quoted(x) for x in L.SKIP_LABELS)
_GIVEN = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(r)})" for a, b, r in L.RELATIONS)
_MATRIX = f"""g(a, b, given) AS (VALUES {_GIVEN}), l AS (SELECT unnest({_LABELS}) AS label),
m AS (SELECT x.label AS label_a, y.label AS label_b, CASE WHEN x.label IN ({_SKIP}) OR y.label IN ({_SKIP}) THEN 'NONE' ELSE coalesce(g.given, 'NONE') END AS relation FROM l x JOIN l y ON x.label <> y.label LEFT JOIN g ON g.a = x.label AND g.b = y.label)"""


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LABELS], "canonical_label string")


@query(f"WITH {_E}, {_MATRIX.replace(f'SELECT unnest({_LABELS}) AS label', 'SELECT DISTINCT canonical_label AS label FROM e')} SELECT * FROM m")
def relation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Of the labels that entities of the corpus have."""
    return K.relation_matrix(entities(spark, sf).select("canonical_label").distinct())


@query(f"WITH {_E} SELECT a.canonical_label AS label_a, b.canonical_label AS label_b, count(*) AS n FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.seq <> b.seq GROUP BY ALL")
def cooccur_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return K.cooccurrence(entities(spark, sf))


_TRIPLES = f"""{_E}, {_MATRIX},
t AS (SELECT a.seq AS sa, b.seq AS sb, a.text AS subject, a.canonical_label AS subject_label, relation, b.text AS object, b.canonical_label AS object_label, a.chunk_id, a.source_file
FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.seq <> b.seq JOIN m ON m.label_a = a.canonical_label AND m.label_b = b.canonical_label AND relation <> 'NONE'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject), relation, lower(object) ORDER BY sa, sb) AS n FROM t) WHERE n = 1)"""


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf)
    return K.triples(rows, K.relation_matrix(_labels(spark)), chunks(rows))


@query(f"WITH {_TRIPLES} SELECT subject, subject_label, relation, object, object_label, chunk_id, source_file FROM u")
def triples(spark: SparkSession, sf: str) -> DataFrame:
    return _triples(spark, sf)


@query(f"WITH {_TRIPLES} SELECT relation, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, relation LIMIT 10")
def triple_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _triples(spark, sf).groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(10)


@query(f"WITH {_TRIPLES} SELECT subject_label, object_label, count(*) AS n FROM u GROUP BY ALL ORDER BY n DESC, subject_label, object_label LIMIT 15")
def label_pair_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _triples(spark, sf).groupBy("subject_label", "object_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_label", "object_label").limit(15)


@query(f"WITH {_E} SELECT lower(text) AS t, count(*) AS n, min(seq) AS first_seq FROM e GROUP BY 1")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).groupBy(F.lower("text").alias("t")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {_E} SELECT seq, text FROM e WHERE canonical_label = 'technology' ORDER BY seq LIMIT 20")
def entities_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return K.by_label(entities(spark, sf), "technology", 20).select("seq", "text")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(eid, subject, subject_label, relation, object, object_label) of customers, suppliers, nations and regions."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    shape = lambda df, eid, s, sl, r, o, ol: df.select(eid.alias("eid"), F.lower(s).alias("subject"), F.lit(sl).alias("subject_label"), F.lit(r).alias("relation"), F.lower(o).alias("object"), F.lit(ol).alias("object_label"))
    parts = [
        shape(table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.concat(F.lit("c"), F.col("c_custkey")), "c_name", "customer", "LIVES_IN", "n_name", "nation"),
        shape(table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.concat(F.lit("s"), F.col("s_suppkey")), "s_name", "supplier", "BASED_IN", "n_name", "nation"),
        shape(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey")), "n_name", "nation", "PART_OF", "r_name", "region"),
    ]
    return reduce(DataFrame.unionByName, parts)


_G = """g AS (SELECT 'c' || c_custkey AS eid, lower(c_name) AS subject, 'customer' AS subject_label, 'LIVES_IN' AS relation, lower(n_name) AS object, 'nation' AS object_label FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 's' || s_suppkey, lower(s_name), 'supplier', 'BASED_IN', lower(n_name), 'nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, lower(n_name), 'nation', 'PART_OF', lower(r_name), 'region' FROM nation JOIN region ON n_regionkey = r_regionkey),
q0 AS (SELECT n_nationkey::BIGINT AS question_id, lower(n_name) AS phrase, [lower(n_name), lower(r_name)] AS keywords FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each nation: its name as phrase, its own and its region's name as keywords."""
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").cast("long").alias("question_id"), F.lower("n_name").alias("phrase"), F.array(F.lower("n_name"), F.lower("r_name")).alias("keywords"))


_RANK = "row_number() OVER (PARTITION BY question_id ORDER BY entity, relationship, related_entity, eid)"
_HOP = "question_id, subject AS entity, relation AS relationship, object AS related_entity, eid"


@query(f"WITH {_G}, f AS (SELECT {_HOP} FROM g JOIN q0 ON contains(subject, phrase)) SELECT * EXCLUDE eid FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 15")
def kg_lookup_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return K.one_hop(questions(spark, sf), edges(spark, sf))


@query(f"WITH {_G}, f AS (SELECT {_HOP} FROM g JOIN q0 ON contains(subject, phrase) OR contains(object, phrase)) SELECT * EXCLUDE eid FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 15")
def kg_lookup_either(spark: SparkSession, sf: str) -> DataFrame:
    return K.one_hop(questions(spark, sf), edges(spark, sf), either=True)


@query(f"WITH {_G}, f AS (SELECT {_HOP} FROM g JOIN q0 ON contains(subject, phrase) WHERE relation IN ('PART_OF', 'BASED_IN')) SELECT * EXCLUDE eid FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 15")
def kg_lookup_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    return K.one_hop(questions(spark, sf), edges(spark, sf), relations=("PART_OF", "BASED_IN"))


_TWO = f"""h AS (SELECT question_id, a.subject AS entity, a.relation AS relationship, a.object AS related_entity, a.eid, b.relation AS second_relationship, b.object AS second_related_entity, b.eid AS eid2
FROM g a JOIN q0 ON contains(a.subject, phrase) OR contains(a.object, phrase) JOIN g b ON a.object = b.subject AND a.eid <> b.eid),
h2 AS (SELECT * EXCLUDE (eid, eid2) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY entity, relationship, related_entity, eid, second_relationship, second_related_entity, eid2) AS rank FROM h) WHERE rank <= 10)"""


@query(f"WITH {_G}, {_TWO} SELECT * FROM h2")
def kg_lookup_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return K.two_hop(questions(spark, sf), edges(spark, sf), middle=True)


@query(f"""WITH {_G}, {_TWO}, x AS (SELECT question_id, rank, 0 AS hop, entity AS subject, relationship AS relation, related_entity AS object FROM h2 UNION ALL SELECT question_id, rank, 1, related_entity, second_relationship, second_related_entity FROM h2)
SELECT DISTINCT question_id, subject, relation, object FROM x WHERE subject <> '' AND relation <> '' AND object <> ''""")
def kg_triples(spark: SparkSession, sf: str) -> DataFrame:
    return K.shown_triples(K.two_hop(questions(spark, sf), edges(spark, sf), middle=True))


_UNDIRECTED = f"""b AS (SELECT eid, subject, relation, object FROM g UNION ALL SELECT eid, object, relation, subject FROM g WHERE subject <> object),
w AS (SELECT question_id, unnest(keywords[1:5]) AS word FROM q0), uf AS (SELECT DISTINCT {_HOP} FROM b JOIN w ON contains(subject, word) OR contains(object, word))"""


@query(f"WITH {_G}, {_UNDIRECTED} SELECT * EXCLUDE eid FROM (SELECT *, {_RANK} AS rank FROM uf) WHERE rank <= 25")
def kg_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return K.undirected(questions(spark, sf), edges(spark, sf))


def _tail_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of which some are met only by a late tier: phrases of two names, keywords of the second first."""
    return questions(spark, sf).withColumn("phrase", F.when(F.col("question_id") % 2 == 0, F.col("phrase")).otherwise(F.concat_ws(" in ", "phrase", F.get("keywords", F.lit(1))))).withColumn("keywords", F.when(F.col("question_id") % 3 == 0, F.reverse("keywords")).otherwise(F.col("keywords")))


def _cascade_sql() -> str:
    def one(tier: int, phrase: str, hit: str, limit: int, more: str = "") -> str:
        return f"SELECT {tier} AS tier, question_id, entity, relationship, related_entity, rank FROM (SELECT *, {_RANK} AS rank FROM (SELECT {_HOP} FROM g JOIN (SELECT question_id, {phrase} AS p FROM q) q ON p <> '' AND ({hit}) {more})) WHERE rank <= {limit}"

    def two(tier: int, phrase: str, hit: str) -> str:
        return f"""SELECT {tier}, question_id, entity, relationship, related_entity, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY entity, relationship, related_entity, eid, r2, o2, eid2) AS rank FROM
(SELECT question_id, a.subject AS entity, a.relation AS relationship, a.object AS related_entity, a.eid, b.relation AS r2, b.object AS o2, b.eid AS eid2 FROM g a JOIN (SELECT question_id, {phrase} AS p FROM q) q ON p <> '' AND ({hit}) JOIN g b ON a.object = b.subject AND a.eid <> b.eid)) WHERE rank <= 10"""

    key = lambda k: f"coalesce(keywords[{k}], '')"
    tiers = [
        one(0, "phrase", "contains(subject, p)", 15),
        two(1, "phrase", "contains(a.subject, p)"),
        one(2, "phrase", "contains(subject, p) OR contains(object, p)", 15),
        one(3, key(1), "contains(subject, p)", 15, "WHERE relation IN ('PART_OF', 'LIVES_IN')"),
        *[one(3 + k, key(k), "contains(subject, p)", 12) for k in (1, 2, 3)],
        two(7, key(1), "contains(a.subject, p) OR contains(a.object, p)"),
        f"SELECT 8, question_id, entity, relationship, related_entity, rank FROM (SELECT *, {_RANK} AS rank FROM (SELECT DISTINCT {_HOP} FROM b JOIN (SELECT question_id, unnest(keywords[1:5]) AS word FROM q) w ON contains(subject, word) OR contains(object, word))) WHERE rank <= 25",
    ]
    return f"""WITH {_G}, q AS (SELECT question_id, CASE WHEN question_id % 2 = 0 THEN phrase ELSE phrase || ' in ' || keywords[2] END AS phrase, CASE WHEN question_id % 3 = 0 THEN list_reverse(keywords) ELSE keywords END AS keywords FROM q0),
b AS (SELECT eid, subject, relation, object FROM g UNION ALL SELECT eid, object, relation, subject FROM g WHERE subject <> object),
t AS ({" UNION ALL ".join(tiers)}),
s AS (SELECT question_id, tier, string_agg(lower(entity || ' ' || relationship || ' ' || related_entity), ' ') AS shown FROM t GROUP BY ALL),
r AS (SELECT s.question_id, min(tier) AS tier FROM s JOIN q USING (question_id) WHERE len(list_filter(keywords, lambda k: contains(shown, k))) > 0 GROUP BY 1)
SELECT t.* FROM t JOIN r USING (question_id, tier)"""


@query(_cascade_sql())
def kg_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return K.cascade(_tail_questions(spark, sf), edges(spark, sf), relations=("PART_OF", "LIVES_IN"))


_N = "n AS (SELECT DISTINCT subject_label AS label, subject AS name FROM g UNION SELECT DISTINCT object_label, object FROM g)"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = edges(spark, sf)
    return rows.select(F.col("subject_label").alias("label"), F.col("subject").alias("name")).union(rows.select("object_label", "object")).distinct()


@query(f"WITH {_G}, {_N} SELECT label, string_agg(name, '|' ORDER BY name) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY name) AS k FROM n) WHERE k <= 3 GROUP BY 1 ORDER BY 1 LIMIT 20")
def graph_types(spark: SparkSession, sf: str) -> DataFrame:
    return K.entity_types(_nodes(spark, sf))


@query(f"WITH {_G}, {_N} SELECT (SELECT count(*) FROM n) AS node_count, count(*) AS rel_count, count(DISTINCT relation) AS relation_types FROM g")
def graph_schema(spark: SparkSession, sf: str) -> DataFrame:
    return K.graph_summary(_nodes(spark, sf), edges(spark, sf))


@query(f"WITH {_G} SELECT relation, rank, subject, object FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY subject, object, eid) AS rank FROM g) WHERE rank <= 3 AND relation IN (SELECT DISTINCT relation FROM g ORDER BY 1 LIMIT 10)")
def relation_samples(spark: SparkSession, sf: str) -> DataFrame:
    return K.relation_samples(edges(spark, sf))


@query(f"WITH {_G} SELECT subject, object FROM g WHERE relation = 'BASED_IN' ORDER BY eid LIMIT 20")
def triples_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    return K.by_relation(edges(spark, sf), "BASED_IN", 20).select("subject", "object")


_ENT = "ent AS (SELECT c_custkey AS seq, lower(c_name) AS text, c_mktsegment AS canonical_label, c_nationkey::VARCHAR AS chunk_id FROM customer UNION ALL SELECT 1000000000 + n_nationkey, n_name, 'nation', n_regionkey::VARCHAR FROM nation)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.lower("c_name").alias("text"), F.col("c_mktsegment").alias("canonical_label"), F.col("c_nationkey").cast("string").alias("chunk_id"))
    return c.union(table(spark, sf, "nation").select((F.lit(1000000000) + F.col("n_nationkey")).cast("long"), "n_name", F.lit("nation"), F.col("n_regionkey").cast("string")))


def _match_sql(hit: str) -> str:
    return f"""WITH {_G}, {_ENT}, f AS (SELECT lower(text) AS t, min(seq) AS first FROM ent GROUP BY 1)
SELECT question_id, rank, seq, text, canonical_label, chunk_id FROM (SELECT question_id, ent.*, row_number() OVER (PARTITION BY question_id ORDER BY first, seq) AS rank FROM f JOIN q0 ON {hit} JOIN ent ON lower(ent.text) = f.t) WHERE rank <= 6"""


@query(_match_sql("contains(t, phrase) OR contains(phrase, t)"))
def entity_substring_match(spark: SparkSession, sf: str) -> DataFrame:
    return K.matched_entities(questions(spark, sf), _named(spark, sf))


@query(_match_sql("t = phrase"))
def entity_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return K.matched_entities(questions(spark, sf), _named(spark, sf), exact=True)


@query(f"""WITH {_G}, {_ENT}, f AS (SELECT lower(text) AS t, min(seq) AS first FROM ent GROUP BY 1),
mt AS (SELECT question_id, rank AS e, lower(text) AS t FROM (SELECT question_id, ent.*, row_number() OVER (PARTITION BY question_id ORDER BY first, seq) AS rank FROM f JOIN q0 ON contains(t, phrase) OR contains(phrase, t) JOIN ent ON lower(ent.text) = f.t) WHERE rank <= 6),
x AS (SELECT * FROM (SELECT question_id, e, subject, relation, object, row_number() OVER (PARTITION BY question_id, e ORDER BY eid) AS n FROM g JOIN mt ON contains(subject, t) OR contains(object, t)) WHERE n <= 6),
y AS (SELECT question_id, subject, relation, object, min((e, n)) AS seq FROM x GROUP BY ALL),
c AS (SELECT question_id, count(*) AS num_entities FROM mt GROUP BY 1)
SELECT question_id, subject, relation, object, rank, num_triples, num_entities FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) AS rank, count(*) OVER (PARTITION BY question_id) AS num_triples FROM y) JOIN c USING (question_id) WHERE rank <= 6""")
def triples_of_entities(spark: SparkSession, sf: str) -> DataFrame:
    return K.triples_of(K.matched_entities(questions(spark, sf), _named(spark, sf)), edges(spark, sf))


#: Questions with several keywords, with one, and with stop words and short words alone.
_ASKED = "(SELECT n_nationkey AS question_id, CASE n_nationkey % 3 WHEN 0 THEN 'How is ' || n_name || ' related to Customer#0000000' || n_nationkey || '?' WHEN 1 THEN 'What about ' || lower(n_name) ELSE 'what is it?' END AS question FROM nation)"
_FALLBACK_STOP = ", ".join(quoted(x) for x in L.FALLBACK_STOP)


@query(rf"""WITH {_G}, a AS (SELECT question_id, list_filter(regexp_extract_all(lower(regexp_replace(question, '[^a-zA-Z0-9\s]', '', 'g')), '\S+'), lambda w: length(w) > 3 AND w NOT IN ({_FALLBACK_STOP}))[1:3] AS w FROM {_ASKED})
SELECT question_id, entity, relationship, related_entity, rank FROM (SELECT question_id, subject AS entity, relation AS relationship, object AS related_entity, row_number() OVER (PARTITION BY question_id ORDER BY subject, relation, object, eid) AS rank
FROM g JOIN a ON len(w) = 0 OR len(list_filter(w, lambda x: contains(lower(subject), x))) > 0) WHERE rank <= 10""")
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    name, k = F.col("n_name"), F.col("n_nationkey") % 3
    asked = F.when(k == 0, F.concat(F.lit("How is "), name, F.lit(" related to Customer#0000000"), F.col("n_nationkey").cast("string"), F.lit("?"))).when(k == 1, F.concat(F.lit("What about "), F.lower(name))).otherwise("what is it?")
    return K.fallback_lookup(table(spark, sf, "nation").select(F.col("n_nationkey").alias("question_id"), asked.alias("question")), edges(spark, sf))


@query(rf"""WITH {_G}, {_N}, r AS (SELECT DISTINCT relation FROM g), s AS (SELECT * FROM (SELECT relation, subject, object, row_number() OVER (PARTITION BY relation ORDER BY subject, object, eid) AS k FROM g) WHERE k <= 2),
rl AS (SELECT relation, '  - ' || relation || chr(10) || string_agg('    Example: ''' || subject || ''' -' || relation || '-> ''' || object || '''', chr(10) ORDER BY k) AS l FROM r JOIN s USING (relation) GROUP BY 1),
t AS (SELECT label, '  - ' || label || ': ''' || string_agg(name, ''', ''' ORDER BY name) || '''' AS l FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY name) AS k FROM n) WHERE k <= 3 GROUP BY 1)
SELECT ' **Knowledge Graph Schema**' || chr(10) || chr(10) || '**Statistics:**' || chr(10) || '- Total entities: ' || format('{{:,}}', (SELECT count(*) FROM n)) || chr(10) || '- Total relationships: ' || format('{{:,}}', (SELECT count(*) FROM g)) || chr(10) || chr(10) || '**Available Relationship Types:**' || chr(10)
|| (SELECT string_agg(l, chr(10) ORDER BY relation) FROM rl) || chr(10) || chr(10) || '**Entity Types (with examples):**' || chr(10) || (SELECT string_agg(l, chr(10) ORDER BY label) FROM t) AS schema""")
def schema_prompt(spark: SparkSession, sf: str) -> DataFrame:
    nodes, rows = _nodes(spark, sf), edges(spark, sf)
    return schema_text(K.graph_summary(nodes, rows), rows.select("relation").distinct(), K.relation_samples(rows), K.entity_types(nodes))


#: Patterns that models write: sound ones, and for each rule one that breaks it.
PATTERNS = (
    "MATCH (n:Entity)-[r:PART_OF]->(m:Entity) WHERE m.name = '{}' RETURN n.name LIMIT 5",
    "```cypher\nMATCH (n:Entity)-[r]->(m) RETURN n.name, “{}” LIMIT 10\n```",
    "Here's a query: match (n:Entity) where n.name = '{}''s' return n.name limit 3 and more",
    "MATCH (n:Person)-[r]->(m) RETURN n.name LIMIT 5",
    "MATCH (n:Entity)-[r:OWNS]->(m) RETURN n LIMIT 5",
    "MATCH (n) LIMIT 5",
    "RETURN 1",
    "",
)


@query(rf"""WITH p AS (SELECT r_regionkey, i, replace([{', '.join(quoted(x) for x in PATTERNS)}][i + 1], '{{}}', r_name) AS t FROM region, range({len(PATTERNS)}) x(i)),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(t, '(?is)```(?:cypher)?(.*?)```', '\1', 'g'), '(?i)(MATCH[\s\S]*?LIMIT\s+\d+)', 1), '[“”]', '''', 'g'), '''s\b', '', 'g')) AS cleaned FROM p)
SELECT r_regionkey, i, cleaned, length(trim(cleaned)) >= 10 AND contains(upper(cleaned), 'MATCH') AND contains(upper(cleaned), 'RETURN') AND len(regexp_extract_all(cleaned, '\S+')) >= 4 AND len(list_filter(regexp_extract_all(cleaned, ':\s*`?([A-Za-z_]+)`?', 1), lambda x: x NOT IN ('Entity', 'PART_OF'))) = 0 AS ok FROM c""")
def pattern_check(spark: SparkSession, sf: str) -> DataFrame:
    """Written patterns are cut out of what a model said and held against an allow-list."""
    all_ = F.array(*[F.lit(x) for x in PATTERNS])
    rows = table(spark, sf, "region").select("r_regionkey", F.posexplode(all_).alias("i", "_t"), "r_name")
    cleaned = T.spec_cleaned(F.replace(F.col("_t"), F.lit("{}"), F.col("r_name")))
    return rows.select("r_regionkey", F.col("i").cast("long").alias("i"), cleaned.alias("cleaned")).withColumn("ok", T.spec_allowed(F.col("cleaned"), ("PART_OF",)))


#: Patterns that are run for each region: of one and of two relations, in either direction, and one that is not understood.
RUN = (
    "MATCH (n:Entity)-[r:PART_OF]->(m:Entity) WHERE toLower(m.name) = toLower('{}') RETURN n.name AS entity, type(r) AS relationship, m.name AS related_entity LIMIT 5",
    "MATCH (a)-[r:LIVES_IN]->(b)-[s:PART_OF]->(c) WHERE toLower(c.name) CONTAINS toLower('{}') RETURN a.name AS entity, type(s) AS relationship, c.name AS related_entity ORDER BY b.name DESC LIMIT 40",
    "MATCH (a)-[r]-(b) WHERE toLower(a.name) CONTAINS toLower('{}') OR toLower(b.name) = 'france' RETURN a.name AS entity, type(r) AS relationship, b.name AS related_entity ORDER BY b.name LIMIT 60",
    "MATCH (a)-[r]->(b) WHERE a.name IN ['{}'] RETURN a.name AS entity LIMIT 5",
)


@query(f"""WITH {_G}, b AS (SELECT eid, subject, relation, object, 0 AS back FROM g UNION ALL SELECT eid, object, relation, subject, 1 FROM g WHERE subject <> object),
p0 AS (SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY subject, eid) AS rank, subject AS entity, relation AS relationship, object AS related_entity FROM g JOIN region ON object = lower(r_name) AND relation = 'PART_OF'),
p1 AS (SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY x.object DESC, x.subject, x.eid, y.object, y.eid) AS rank, x.subject AS entity, y.relation AS relationship, y.object AS related_entity
FROM g x JOIN g y ON x.object = y.subject AND x.relation = 'LIVES_IN' AND y.relation = 'PART_OF' JOIN region ON contains(y.object, lower(r_name))),
p2 AS (SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY object, subject, relation, eid, back) AS rank, subject AS entity, relation AS relationship, object AS related_entity FROM b JOIN region ON contains(subject, lower(r_name)) OR object = 'france')
SELECT r_regionkey, 0 AS i, * EXCLUDE r_regionkey FROM p0 WHERE rank <= 5 UNION ALL SELECT r_regionkey, 1, * EXCLUDE r_regionkey FROM p1 WHERE rank <= 40 UNION ALL SELECT r_regionkey, 2, * EXCLUDE r_regionkey FROM p2 WHERE rank <= 60""")
def written_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What written patterns find in the graph; the one that is not understood finds nothing."""
    asked = table(spark, sf, "region").select("r_regionkey", "r_name", F.posexplode(F.array(*[F.lit(x) for x in RUN])).alias("i", "_t"))
    asked = asked.select((F.col("r_regionkey") * len(RUN) + F.col("i")).cast("long").alias("pattern_id"), F.replace(F.col("_t"), F.lit("{}"), F.col("r_name")).alias("pattern"))
    found = written(results(asked, edges(spark, sf)))
    return found.select(F.floor(F.col("question_id") / len(RUN)).cast("int").alias("r_regionkey"), (F.col("question_id") % len(RUN)).cast("int").alias("i"), "rank", "entity", "relationship", "related_entity")


@query(f"""WITH {_G}, {_ENT}, f AS (SELECT lower(text) AS t, min(seq) AS first FROM ent GROUP BY 1),
me AS (SELECT question_id, rank, text, canonical_label FROM (SELECT question_id, ent.*, row_number() OVER (PARTITION BY question_id ORDER BY first, seq) AS rank FROM f JOIN q0 ON t = phrase JOIN ent ON lower(ent.text) = f.t) WHERE rank <= 6),
h AS (SELECT * FROM (SELECT question_id, subject, relation, object, row_number() OVER (PARTITION BY question_id ORDER BY subject, relation, object, eid) AS rank FROM g JOIN q0 ON contains(subject, phrase)) WHERE rank <= 15),
x AS (SELECT question_id, string_agg('  - ' || text || ' (' || canonical_label || ')', chr(10) ORDER BY rank) AS e FROM me GROUP BY 1),
y AS (SELECT question_id, string_agg('  - ' || subject || ' --[' || relation || ']--> ' || object, chr(10) ORDER BY rank) AS t FROM h GROUP BY 1)
SELECT q0.question_id, concat_ws(chr(10), '**Entities:**' || chr(10) || e, chr(10) || '**Relationships:**' || chr(10) || t) AS context FROM q0 LEFT JOIN x USING (question_id) LEFT JOIN y USING (question_id)""")
def graph_contexts(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    found = K.one_hop(q, edges(spark, sf)).select("question_id", "rank", F.col("entity").alias("subject"), F.col("relationship").alias("relation"), F.col("related_entity").alias("object"))
    return graph_context(K.matched_entities(q, _named(spark, sf), exact=True), found, q)
