"""What the registered queries share: tables, and SQL for the text steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L
from groundwork.operators.paragraphs import Rules

#: Rules that say something about the synthetic corpus, whose words are invented.
RULES = Rules(
    keywords=("the", "and", "is", "of", "der", "und", "la", "les", "que", "de", "of the", "in the", "de la"),
    causal=("tion", "keit"),
    impact=("thing", "eaux", "osid"),
    factual=("was ", "schen", "mente"),
    meta=("house", "worth", "licht"),
    acknowledgment=("thank", "password"),
    methodology=("er", "en", "ouen"),
    affiliation=("@", "akia"),
    figure_table=("fig.", "ble."),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df dealt over all cores, where its few files would keep only some of them busy; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, for queries whose work on each text is heavy."""
    return spread(documents(spark, sf_dir))


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def split(x: str) -> str:
    return f"string_split({x}, chr(10))"


def join(x: str, by: str = "chr(10)") -> str:
    return f"coalesce(array_to_string({x}, {by}), '')"


def count_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def printable(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x08\x0B-\x1F\x7F-\x{{A0}}\x{{AD}}\x{{1680}}\x{{2000}}-\x{{200F}}\x{{2028}}-\x{{202F}}\x{{205F}}-\x{{206F}}\x{{3000}}\x{{FEFF}}]', '', 'g')"


def hyphens(x: str) -> str:
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)-\s*\n\s*([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"


def spaces(x: str) -> str:
    inner = rf"regexp_replace(regexp_replace(replace({x}, chr(9), ' '), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return join(f"list_transform({split(inner)}, lambda l: {strip('l')})")


def keep(x: str, bad: str) -> str:
    return join(f"list_filter({split(x)}, lambda l: NOT ({bad}))")


def pages(x: str) -> str:
    return keep(x, rf"regexp_matches({strip('l')}, '^[\d\s\-]+$') OR regexp_matches({strip('l')}, '(?i)^Page\s+\d+$')")


def contacts(x: str) -> str:
    return keep(x, r"regexp_matches(l, '\S+@\S+\.\S+') OR regexp_matches(l, 'https?://\S+') OR regexp_matches(l, '(?i)doi:')")


def contents(x: str) -> str:
    return keep(x, rf"regexp_matches({strip('l')}, '\.{{5,}}') OR regexp_matches({strip('l')}, '^(Box|Figure|Table)\s+\d') OR starts_with(lower({strip('l')}), 'list of') OR {count_words('l')} < 5")


#: Steps of cleaning as common table expressions over documents; one column each keeps the statement short.
CLEAN = f"""
c1 AS (SELECT doc_id, source, text AS raw, {spaces(hyphens(printable("text")))} AS t FROM documents),
c2 AS (SELECT doc_id, source, raw, {contacts(pages("t"))} AS t FROM c1),
c3 AS (SELECT doc_id, source, raw, {contents("t")} AS t FROM c2)"""

PARAGRAPHS = rf"""{CLEAN},
p0 AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '\n\s*\n', chr(1), 'g'), '\n([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda p: {strip("p")}), lambda p: p <> '') AS ps FROM c3),
p AS (SELECT doc_id, source, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS para_idx FROM p0)"""


def any_of(x: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quoted(p.lower())})" for p in phrases) + ")"


def density(x: str, keywords: Sequence[str]) -> str:
    single = ", ".join(quoted(k) for k in keywords)
    many = "".join(f" + (length(lower({x})) - length(replace(lower({x}), {quoted(k)}, ''))) // {len(k)}" for k in keywords if " " in k)
    return rf"coalesce((len(list_filter(regexp_extract_all(lower({x}), '\S+'), lambda w: w IN ({single}))){many}) / nullif({count_words(x)}, 0)::DOUBLE, 0.0)"


def citations(x: str) -> str:
    return rf"(len(regexp_extract_all({x}, '\([A-Z][a-z]+(?:\s+et\s+al\.)?,\s*\d{{4}}\)')) + len(regexp_extract_all({x}, '\[\d+\]')))"


def quantity(x: str) -> str:
    return f"regexp_matches({x}, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in L.QUANTITIES))})"


def scoring(rules: Rules) -> str:
    """CTEs s0 and s over p: word_count, keyword_density, breakdown, score."""
    p = rules.points
    parts = {
        "base": str(L.BASE_POINTS),
        "climate_keywords": f"CASE WHEN d >= 0.15 THEN {p['climate_keyword_density_high']} WHEN d >= 0.10 THEN {p['climate_keyword_density_medium']} WHEN d >= 0.05 THEN {p['climate_keyword_density_low']} END",
        "causal_language": f"CASE WHEN {any_of('text', rules.causal)} THEN {p['causal_language']} END",
        "quantitative_data": f"CASE WHEN {quantity('text')} THEN {p['quantitative_data']} END",
        "impact_language": f"CASE WHEN {any_of('text', rules.impact)} THEN {p['impact_language']} END",
        "factual_tone": f"CASE WHEN {any_of('text', rules.factual)} THEN {p['factual_tone']} END",
        "proper_length": f"CASE WHEN n BETWEEN {rules.shortest} AND {rules.longest} THEN {p['proper_length']} END",
        "meta_organizational": f"CASE WHEN {any_of('text', rules.meta)} THEN {p['meta_organizational']} END",
        "heavy_citations": f"CASE WHEN {citations('text')} >= 3 THEN {p['heavy_citations']} END",
        "acknowledgment": f"CASE WHEN {any_of('text', rules.acknowledgment)} THEN {p['acknowledgment']} END",
        "methodology_heavy": f"CASE WHEN {' + '.join(f'contains(lower(text), {quoted(m)})::INT' for m in rules.methodology)} >= 2 THEN {p['methodology_heavy']} END",
        "author_affiliation": f"CASE WHEN {any_of('text', rules.affiliation)} THEN {p['author_affiliation']} END",
        "figure_table_only": f"CASE WHEN {any_of('text', rules.figure_table)} AND n < 20 THEN {p['figure_table_only']} END",
        "wrong_length": f"CASE WHEN n NOT BETWEEN {rules.shortest} AND {rules.longest} THEN {p['wrong_length']} END",
    }
    columns = ", ".join(f"{v} AS s_{k}" for k, v in parts.items())
    total = " + ".join(f"coalesce(s_{k}, 0)" for k in parts)
    told = ", ".join(f"'{k}=' || s_{k}" for k in parts)
    return f"""
s0 AS (SELECT *, {count_words("text")} AS n, {density("text", rules.keywords)} AS d FROM p),
s1 AS (SELECT *, {columns} FROM s0),
s AS (SELECT doc_id, source, para_idx, text, n AS word_count, d AS keyword_density, greatest(0, least(100, {total})) AS score, concat_ws(';', {told}) AS breakdown FROM s1)"""
