"""Queries over texts: cleaning, scoring, chunks, labels, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L
from groundwork.functions import text as T
from groundwork.operators import chunking, paragraphs
from groundwork.operators.quantiles import exact_quantiles, histogram
from groundwork.plans import base as B
from groundwork.plans.base import RULES, documents, rounded, table, texts

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {B.printable('text')} AS t1, {B.hyphens('text')} AS t2, {B.spaces('text')} AS t3 FROM documents")
def clean_characters(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf).select("doc_id", T.printable(t).alias("t1"), T.join_hyphenated(t).alias("t2"), T.normal_space(t).alias("t3"))


@query(f"SELECT doc_id, {B.pages('text')} AS t4, {B.contacts('text')} AS t5, {B.contents('text')} AS t6 FROM documents")
def clean_line_filters(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf).select("doc_id", T.without_page_numbers(t).alias("t4"), T.without_contacts(t).alias("t5"), T.without_contents(t).alias("t6"))


@query(f"WITH {B.PARAGRAPHS} SELECT doc_id, para_idx, text FROM p")
def clean_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.split(texts(spark, sf).select("doc_id", "text"))


@query(f"WITH {B.PARAGRAPHS}, {B.scoring(RULES)} SELECT doc_id, para_idx, word_count, round(keyword_density, 9) AS keyword_density, breakdown, score FROM s")
def paragraph_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = paragraphs.scored(paragraphs.split(texts(spark, sf).select("doc_id", "text")), RULES)
    told = F.array_join(F.transform(F.map_entries("breakdown"), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return rows.select("doc_id", "para_idx", "word_count", F.round("keyword_density", 9).alias("keyword_density"), told.alias("breakdown"), "score")


@query(f"WITH {B.PARAGRAPHS}, {B.scoring(RULES)} SELECT doc_id, para_idx, text FROM s WHERE score >= 50")
def paragraphs_kept(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.kept(paragraphs.scored(paragraphs.split(texts(spark, sf).select("doc_id", "text")), RULES), RULES).select("doc_id", "para_idx", "text")


_FILTERED = f"""WITH {B.PARAGRAPHS}, {B.scoring(RULES)},
a AS (SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (score >= 50) AS n_kept, array_to_string(list(text ORDER BY para_idx) FILTER (score >= 50), chr(10) || chr(10)) AS joined,
      coalesce(avg(score) FILTER (score >= 50), 0) AS avg_score, coalesce(avg(keyword_density) FILTER (score >= 50), 0) AS avg_density FROM s GROUP BY doc_id),
f AS (SELECT d.doc_id, d.source, length(d.text) AS original_length, {B.spaces("coalesce(a.joined, '')")} AS filtered_text, coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(n_kept, 0) AS n_kept, coalesce(avg_score, 0) AS avg_score, coalesce(avg_density, 0) AS avg_density
      FROM documents d LEFT JOIN a USING (doc_id))"""


@query(f"{_FILTERED} SELECT doc_id, original_length, length(filtered_text) AS filtered_length, round(length(filtered_text) / nullif(original_length, 0)::DOUBLE, 9) AS retention, n_paragraphs, n_kept, round(avg_score, 6) AS avg_score, round(avg_density, 9) AS avg_density FROM f")
def filter_stats_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.filtered(texts(spark, sf), RULES).select("doc_id", "original_length", "filtered_length", F.round("retention", 9).alias("retention"), "n_paragraphs", "n_kept", F.round("avg_score", 6).alias("avg_score"), F.round("avg_density", 9).alias("avg_density"))




#: The default lists, over texts that speak of their subject.
_SUBJECT = "(SELECT doc_id, source, ['Rising CO2 causes warming by 3 % and 2 meters of sea level rise. ', 'This chapter thanks the University, see Figure 1. ', 'Emissions from coal burning lead to drought; research shows high confidence (Smith et al., 2020) (Lee, 2019) [3]. ', ''][doc_id % 4 + 1] || text AS text FROM documents)"


@query(f"WITH p AS (SELECT doc_id, source, 0 AS para_idx, text FROM {_SUBJECT}), {B.scoring(paragraphs.Rules())} SELECT doc_id, word_count, round(keyword_density, 9) AS keyword_density, breakdown, score FROM s")
def subject_scores(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Rising CO2 causes warming by 3 % and 2 meters of sea level rise. ", "This chapter thanks the University, see Figure 1. ", "Emissions from coal burning lead to drought; research shows high confidence (Smith et al., 2020) (Lee, 2019) [3]. ", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = paragraphs.scored(documents(spark, sf).select("doc_id", F.concat(lead, F.col("text")).alias("text")))
    told = F.array_join(F.transform(F.map_entries("breakdown"), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return rows.select("doc_id", "word_count", F.round("keyword_density", 9).alias("keyword_density"), told.alias("breakdown"), "score")


@query(f"WITH {B.PARAGRAPHS}, {B.scoring(RULES)} SELECT source, count(*) AS n_paragraphs, count(*) FILTER (score >= 50) AS n_kept, round(avg(score), 6) AS avg_score, round(coalesce(avg(keyword_density) FILTER (score >= 50), 0), 9) AS avg_density FROM s GROUP BY source")
def filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = paragraphs.scored(paragraphs.split(texts(spark, sf).select("doc_id", "source", "text")), RULES)
    good = F.col("score") >= RULES.threshold
    return rows.groupBy("source").agg(F.count("*").alias("n_paragraphs"), F.count_if(good).alias("n_kept"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.coalesce(F.avg(F.when(good, F.col("keyword_density"))), F.lit(0.0)), 9).alias("avg_density"))


@query(f"{_FILTERED} SELECT count(*) AS documents, sum(n_paragraphs) AS paragraphs, sum(n_kept) AS kept, count(*) FILTER (n_kept = 0) AS failed, round(avg(length(filtered_text) / nullif(original_length, 0)::DOUBLE), 9) AS avg_retention, round(avg(avg_density), 9) AS avg_density FROM f")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = paragraphs.filtered(documents(spark, sf), RULES)
    return rows.agg(F.count("*").alias("documents"), F.sum("n_paragraphs").alias("paragraphs"), F.sum("n_kept").alias("kept"), F.count_if(F.col("n_kept") == 0).alias("failed"), F.round(F.avg("retention"), 9).alias("avg_retention"), F.round(F.avg("avg_density"), 9).alias("avg_density"))


@query(f"SELECT doc_id, round({B.density('text', RULES.keywords)}, 9) AS density, {B.count_words('text')} AS words FROM documents")
def keyword_density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(texts(spark, sf).select("doc_id", paragraphs.keyword_density(F.col("text"), RULES.keywords).alias("density"), T.word_count(F.col("text")).alias("words")), "density")


@query(f"SELECT doc_id, {B.any_of('text', RULES.causal)} AS causal, {B.any_of('text', ('password', 'e-mail', '.de'))} AS other, {B.citations('text')} AS citations, {B.quantity('text')} AS quantity FROM documents")
def phrase_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf).select("doc_id", T.has_any(t, RULES.causal).alias("causal"), T.has_any(t, ("password", "e-mail", ".de")).alias("other"), T.citations(t).alias("citations"), T.has_quantity(t).alias("quantity"))


_MARKED = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Table of Contents' || chr(10) || text WHEN 2 THEN text || chr(10) || 'Chapter 3.....17' ELSE 'see box 1.2, Figure 3.4, fig. 5.6' || chr(10) || text END AS text FROM documents)"


@query(rf"""SELECT doc_id, {B.any_of('text', L.LIST_INDICATORS)} OR regexp_matches(text, {B.quoted('|'.join(f'(?:{p})' for p in L.TOC_PATTERNS))}) OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {B.quoted(L.PAGE_REFERENCE)}))) / len(string_split(text, chr(10)))::DOUBLE > 0.5 AS is_contents,
round((length(text) - length(replace(text, '.', ''))) / length(text)::DOUBLE, 9) AS dot_density, {' + '.join(f"len(regexp_extract_all(text, {B.quoted('(?i)' + p)}))" for p in L.CAPTIONS)} > 2 AS many_captions FROM {_MARKED}""")
def contents_flags(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 4
    marked = F.when(k == 0, t).when(k == 1, F.concat(F.lit("Table of Contents\n"), t)).when(k == 2, F.concat(t, F.lit("\nChapter 3.....17"))).otherwise(F.concat(F.lit("see box 1.2, Figure 3.4, fig. 5.6\n"), t))
    return rounded(paragraphs.contents_flags(documents(spark, sf).select("doc_id", marked.alias("text"))).select("doc_id", "is_contents", "dot_density", "many_captions"), "dot_density")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS start FROM w)
SELECT doc_id, start // 150 AS idx, array_to_string(w[start + 1 : start + 200], ' ') AS text FROM s""")
def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.word_windows(documents(spark, sf).select("doc_id", "text"))


@query()
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sentence_chunks(texts(spark, sf))


@query()
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return chunking.chunk_statistics(docs, chunking.sentence_chunks(docs))


_TOKENS = r"""k AS (SELECT source || '_' || doc_id AS chunk_id, doc_id, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS pos FROM documents)"""


@query(rf"""WITH n AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, regexp_replace(lower({B.strip('text')}), '\s+', ' ', 'g') AS dedup_key, regexp_replace(regexp_replace(lower({B.strip('text')}), '[\s\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS label,
coalesce(nullif(replace(replace(upper(trim(regexp_replace(text, '[^ -~]', '', 'g'))), ' ', '_'), '-', '_'), ''), 'NONE') AS relation FROM n""")
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.dedup_key(t).alias("dedup_key"), T.label(t).alias("label"), T.relation(F.regexp_replace(t, "[^ -~]", "")).alias("relation"))


@query(r"""SELECT doc_id, CASE WHEN place > 0 AND place < 60 THEN substr(text, place + 1) ELSE text END AS text FROM
(SELECT doc_id, text, CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]') THEN length(regexp_extract(text, '(?s)^(.*?(?:^|[^\p{L}\p{N}_]))[A-Z]', 1)) ELSE -1 END AS place FROM documents)""")
def chunk_beginnings(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", T.from_first_capital(F.col("text")).alias("text"))


_STOP = ", ".join(f"'{w}'" for w in L.STOP)


@query(rf"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g')), '\S+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP})), ' ') AS keywords,
array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM benchmark""")
def question_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"), F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(rf"""WITH {_TOKENS} SELECT word, count(*) AS n, any_value(length({B.strip('word')}) >= 3 AND NOT (regexp_matches({B.strip('word')}, '^[\d\s,\.%\-]+$') OR regexp_matches({B.strip('word')}, '^\d{{4}}$')
OR regexp_matches({B.strip('word')}, '(?i)^\d[\d\s\.,]*(per\s+cent|million|billion|trillion|%)'))) AS meaningful FROM k GROUP BY word""")
def meaningful_words(spark: SparkSession, sf: str) -> DataFrame:
    words = texts(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("meaningful", T.meaningful(F.col("word")))


_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace({B.strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {B.strip('s')}), lambda s: s <> '')"""


@query(rf"""WITH a AS (SELECT conv_id, turn, text, {_SENTENCES} AS s FROM conversations),
u AS (SELECT conv_id, turn, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM a),
r AS (SELECT *, coalesce(sum({B.count_words('s')}) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
g AS (SELECT conv_id, turn, string_agg(s, ' ' ORDER BY i) AS limited FROM r WHERE before < 30 GROUP BY ALL)
SELECT a.conv_id, a.turn, regexp_matches({B.strip('a.text')}, '[.!?]["'')\]]*\s*$') AS complete, coalesce(g.limited, '') AS limited FROM a LEFT JOIN g USING (conv_id, turn)""")
def answer_limits(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.complete(t).alias("complete"), T.limited(t).alias("limited"))


def _last_sql(mark: str) -> str:
    at = f"strpos(reverse(s), {B.quoted(mark[::-1])})"
    return f"CASE WHEN {at} > 0 THEN length(s) - {at} - {len(mark) - 1} ELSE -1 END"


def _sentence_end_sql(source: str, keys: str) -> str:
    late = ", ".join(f"CASE WHEN {_last_sql(m)} >= 20 THEN {_last_sql(m)} ELSE -1 END" for m in (" because ", " which ", " that ", " and "))
    bare = lambda x: f"rtrim({x}, ' ,;:-')"
    return rf"""WITH a AS (SELECT {keys}, {B.strip('text')} AS s FROM {source}),
b AS (SELECT *, regexp_extract(s, '(?s)^(.*[.!?])', 1) AS head, greatest({', '.join(_last_sql(m) for m in ',;:')}, {late}) AS c, regexp_extract_all(s, '\S+') AS w FROM a),
d AS (SELECT *, {bare('substr(s, 1, greatest(c, 0))')} AS clause, {bare("CASE WHEN len(w) > 28 THEN array_to_string(w[1:28], ' ') ELSE s END")} || '.' AS short FROM b)
SELECT {keys}, CASE WHEN s = '' OR regexp_matches(s, '[.!?]\z') THEN s WHEN {B.strip('head')} <> '' THEN {B.strip('head')} WHEN c >= 20 AND {B.count_words('clause')} >= 6 THEN clause || '.' ELSE short END AS text FROM d"""


#: Answers that end in a sentence, in the midst of one, at a clause, or have no mark at all.
_ENDS = r"(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' and so' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE regexp_replace(text, '[.!?,;:]', '', 'g') END AS text FROM conversations)"


@query(_sentence_end_sql(_ENDS, "conv_id, turn"))
def answer_sentence_end(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("text"), F.col("turn") % 4
    cut = F.when(k == 0, t).when(k == 1, F.concat(t, F.lit(" and so"))).when(k == 2, F.regexp_replace(t, "[.!?]", "")).otherwise(F.regexp_replace(t, "[.!?,;:]", ""))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.to_sentence_end(cut).alias("text"))


def _leaky(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with what the post-processing looks for put around the texts."""
    rows = table(spark, sf, "conversations")
    lead = F.element_at(F.array(F.lit("Answer: "), F.lit("Use proper grammar and spelling. "), F.lit("Rewritten answer - "), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return rows.select("conv_id", "turn", F.concat(lead, F.col("text"), F.lit(" [TEXT:1] [KG:co2] Answer requirements: none."), F.when(F.col("turn") % 2 == 0, " [TEXT:1]").otherwise("")).alias("text"))


def _post_sql() -> str:
    one = r"regexp_replace(regexp_replace(text, '\s*\[(TEXT:\d+|KG:[^\]]+)\]', '', 'g'), '\s+', ' ', 'g')"
    steps = [f"y0 AS (SELECT conv_id, turn, text AS raw, {B.strip(one)} AS t FROM {_LEAKY})"]
    for k in range(3):
        steps.append(f"y{k + 1} AS (SELECT conv_id, turn, raw, {B.strip(_replaced('t', L.LEAKS_AT_START))} AS t FROM y{k})")
    inline = _replaced("t", (*L.LEAKS_INLINE, *L.HEADINGS))
    plain = B.strip(rf"regexp_replace(regexp_replace({inline}, '\s*##+\s*', ' ', 'g'), '\s+', ' ', 'g')")
    wrote = f"regexp_replace({plain}, {B.quoted('(?i)' + L.LEAKED_WRITE)}, '\\1 ', 'g')"
    steps.append(f"y4 AS (SELECT conv_id, turn, raw, {B.strip(f'ltrim({_replaced(wrote, L.LEAKED_BULLETS)}, ' + B.quoted('- ') + ')')} AS text FROM y3)")
    leak = " OR ".join(f"regexp_matches(s, {B.quoted('(?i)' + p)})" for p in L.LEAK_SENTENCES)
    steps.append(f"y5 AS (SELECT conv_id, turn, raw, list_filter({_SENTENCES}, lambda s: NOT ({leak})) AS ss FROM y4)")
    steps.append("y6 AS (SELECT conv_id, turn, raw, coalesce(array_to_string(list_filter(ss, lambda x, i: list_position(list_transform(ss, lambda z: lower(z)), lower(x)) = i), ' '), '') AS text FROM y5)")
    steps_of_end, ended = _sentence_end_sql("y6", "conv_id, turn, raw").removeprefix("WITH ").split("\nSELECT ")
    steps += [steps_of_end, f"e AS (SELECT {ended})"]
    cited = r"(SELECT list_filter(c, lambda x, i: list_position(c, x) = i) FROM (SELECT regexp_extract_all(raw, '\[(TEXT:\d+|KG:[^\]]+)\]', 1) AS c))"
    return f"WITH {', '.join(steps)} SELECT conv_id, turn, CASE WHEN len({cited}) > 0 THEN text || chr(10) || 'Sources: ' || array_to_string({cited}, ', ') ELSE text END AS text FROM e"


@query()
def answer_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    return _leaky(spark, sf).select("conv_id", "turn", T.postprocessed(F.col("text")).alias("text"))


_LEAKY = """(SELECT conv_id, turn, ['Answer: ', 'Use proper grammar and spelling. ', 'Rewritten answer - ', ''][turn % 4 + 1] || text || ' [TEXT:1] [KG:co2] Answer requirements: none.' || CASE WHEN turn % 2 = 0 THEN ' [TEXT:1]' ELSE '' END AS text FROM conversations)"""


def _replaced(x: str, patterns, prefix: str = "(?i)") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {B.quoted(prefix + p)}, '', 'g')"
    return x


def _sanitize_sql() -> str:
    steps = [rf"z0 AS (SELECT conv_id, turn, {B.strip(r'''regexp_replace(text, '\s+', ' ', 'g')''')} AS t FROM {_LEAKY})"]
    for k in range(3):
        steps.append(f"z{k + 1} AS (SELECT conv_id, turn, {B.strip(_replaced('t', L.SANITIZE_AT_START))} AS t FROM z{k})")
    inner = _replaced("t", L.SANITIZE_INLINE)
    last = rf"regexp_replace(regexp_replace({inner}, '\s*##+\s*', ' ', 'g'), '\s+', ' ', 'g')"
    return f"WITH {', '.join(steps)} SELECT conv_id, turn, {B.strip(last)} AS text FROM z3"


@query(_sanitize_sql())
def answer_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return _leaky(spark, sf).select("conv_id", "turn", T.sanitized(F.col("text")).alias("text"))


@query(rf"""SELECT conv_id, turn, array_to_string(list_distinct_first, ', ') AS cited FROM (SELECT conv_id, turn,
list_filter(c, lambda x, i: list_position(c, x) = i) AS list_distinct_first FROM (SELECT conv_id, turn, regexp_extract_all(text, '\[(TEXT:\d+|KG:[^\]]+)\]', 1) AS c FROM {_LEAKY}))""")
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _leaky(spark, sf).select("conv_id", "turn", F.array_join(T.cited(F.col("text")), ", ").alias("cited"))


_NONE = " OR ".join(f"contains(lower(t), {B.quoted(p)})" for p in L.NO_INFO_PHRASES)


_LOGGED = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Loading schema from the store' || chr(10) || text || chr(10) || '  Schema loaded' WHEN 1 THEN text || ' No Relevant Information here.' WHEN 2 THEN 'All retries failed' || chr(10) || ' ' ELSE text END AS text FROM documents)"


@query(rf"""SELECT doc_id, CASE WHEN {_NONE} THEN {B.quoted(L.NO_INFO)} ELSE t END AS text FROM (SELECT doc_id,
coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {B.strip('x')}), lambda x: x <> '' AND NOT ({" OR ".join(f"contains(x, {B.quoted(p)})" for p in L.LOG_PHRASES)})), ' '), '') AS t FROM {_LOGGED})""")
def answer_clean(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 4
    logged = F.when(k == 0, F.concat(F.lit("Loading schema from the store\n"), t, F.lit("\n  Schema loaded"))).when(k == 1, F.concat(t, F.lit(" No Relevant Information here."))).when(k == 2, F.lit("All retries failed\n ")).otherwise(t)
    return texts(spark, sf).select("doc_id", T.without_log(logged).alias("text"))


@query(rf"""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN {B.quoted(L.NO_INFO)} ELSE upper(substr(t, 1, 1)) || substr(t, 2) END AS text, {B.strip("string_split(text, 'of ')[-1]")} AS tail FROM
(SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN {B.strip("text")} ELSE text END AS t FROM conversations)""")
def answer_filler(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("text"), F.col("turn") % 3
    told = F.when(k == 0, F.concat(F.lit("Based on the knowledge graph, "), t)).when(k == 1, t).otherwise(F.concat(t, F.lit(" I don't KNOW.")))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.without_filler(told).alias("text"), T.after(t, "of ").alias("tail"))


@query("SELECT event_id, len(json_keys(props)) AS n_keys, json_array_length('[' || props || ']') AS n_items FROM events")
def json_answers(spark: SparkSession, sf: str) -> DataFrame:
    props = F.col("props")
    fenced = F.concat(F.lit('```json\n{"entities": ['), props, F.lit("]}\n```"))
    return table(spark, sf, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"), F.size(T.json_list(fenced, "map<string,string>")).cast("long").alias("n_items"))


@query(r"""SELECT page_id, array_to_string(regexp_extract_all(replace(lower(html), '-', '_'), '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b')[1:3], ',') AS labels FROM pages""")
def fallback_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_join(T.fallback_labels(F.translate(F.lower("html"), "-", "_")), ",").alias("labels"))


_UNITS = " ".join(f"WHEN v < {1024 ** (k + 1)} THEN printf('%.1f {u}', v / {float(1024**k)})" for k, u in enumerate(("B", "KB", "MB", "GB", "TB")))


@query(f"""SELECT doc_id, power, CASE {_UNITS} ELSE printf('%.1f PB', v / {float(1024**5)}) END AS shown
FROM (SELECT doc_id, power, (strlen(text) % 997) * pow(1024, power) AS v FROM documents, range(6) r(power))""")
def sizes_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes in every unit."""
    rows = documents(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("power"), "text")
    return rows.select("doc_id", "power", T.human_bytes((F.octet_length("text") % 997) * F.pow(F.lit(1024.0), F.col("power"))).alias("shown"))


@query("SELECT doc_id FROM (SELECT doc_id, md5('5:' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 200")
def sampled_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A sample without replacement: the first of a hashed order."""
    return documents(spark, sf).select("doc_id", F.md5(F.concat(F.lit("5:"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(200).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def first_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "n_chars").orderBy("doc_id").limit(10)


@query("SELECT doc_id // 5 AS batch, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chunk_ids FROM documents GROUP BY 1")
def chunk_batches(spark: SparkSession, sf: str) -> DataFrame:
    from groundwork.operators.knowledge import batches

    chunks = documents(spark, sf).select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("chunk_id"))
    return batches(chunks).select("batch", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT conv_id, string_agg('- ' || role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations WHERE turn < 25 GROUP BY conv_id")
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    from groundwork.operators.retrieval import context

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), "role", "text")
    return context(rows, F.concat(F.lit("- "), F.col("role"), F.lit(": "), F.col("text"))).withColumnRenamed("question_id", "conv_id")


@query("SELECT percentile_label, value FROM (SELECT unnest(['p25', 'p50', 'p75']) AS percentile_label, unnest([quantile_cont(n_chars, 0.25), quantile_cont(n_chars, 0.5), quantile_cont(n_chars, 0.75)]) AS value FROM documents)")
def length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    p = documents(spark, sf).agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    names = F.array(F.lit("p25"), F.lit("p50"), F.lit("p75"))
    return p.select(F.explode(F.arrays_zip(names.alias("percentile_label"), F.col("p").alias("value"))).alias("r")).select("r.*")


@query("""SELECT source, p::DOUBLE AS probability, round(quantile_cont(n_chars, p), 6) AS value FROM documents, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) t(p) GROUP BY source, p""".replace("quantile_cont(n_chars, p)", "CASE p WHEN 0.05 THEN quantile_cont(n_chars, 0.05) WHEN 0.25 THEN quantile_cont(n_chars, 0.25) WHEN 0.5 THEN quantile_cont(n_chars, 0.5) WHEN 0.75 THEN quantile_cont(n_chars, 0.75) ELSE quantile_cont(n_chars, 0.95) END"))
def length_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of the lengths by source, without gathering a source."""
    return exact_quantiles(documents(spark, sf), "n_chars", [0.05, 0.25, 0.5, 0.75, 0.95], ["source"]).select("source", F.round("probability", 4).alias("probability"), F.round("value", 6).alias("value"))


@query("""WITH r AS (SELECT lang, min(n_chars)::DOUBLE AS low, (max(n_chars) - min(n_chars)) / 20.0::DOUBLE AS w, count(*) AS total FROM documents GROUP BY 1)
SELECT lang, bin, count(*) AS n, round(count(*) / (total * w), 12) AS density FROM (SELECT lang, low, w, total, least(floor((n_chars - low) / w), 19)::INT AS bin FROM documents JOIN r USING (lang)) GROUP BY lang, bin, total, w""")
def length_density(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(documents(spark, sf), "n_chars", 20, ["lang"]).select("lang", "bin", "n", F.round("density", 12).alias("density"))


S["answer_postprocess"] = _post_sql()
