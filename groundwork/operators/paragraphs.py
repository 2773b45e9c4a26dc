"""Documents to clean, scored paragraphs and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L
from groundwork.functions import text as T


@dataclass(frozen=True)
class Rules:
    """What the paragraph score looks for."""

    keywords: Sequence[str] = L.KEYWORDS
    causal: Sequence[str] = L.CAUSAL
    impact: Sequence[str] = L.IMPACT
    factual: Sequence[str] = L.FACTUAL
    meta: Sequence[str] = L.META
    acknowledgment: Sequence[str] = L.ACKNOWLEDGMENT
    methodology: Sequence[str] = L.METHODOLOGY
    affiliation: Sequence[str] = L.AFFILIATION
    figure_table: Sequence[str] = L.FIGURE_TABLE
    points: dict = field(default_factory=lambda: dict(L.POINTS))
    shortest: int = 10
    longest: int = 500
    threshold: int = 50


def split(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row for each paragraph: the other columns, para_idx, text. Null text has none."""
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(T.paragraphs(T.clean_lines(F.col(text)))).alias("para_idx", "text"))


def keyword_density(t: Column, keywords: Sequence[str] = L.KEYWORDS) -> Column:
    """Words that are keywords, and places of keywords of several words, over all words; 0 without words."""
    low = F.lower(t)
    return _density(low, T.words(low), keywords)


def _density(low: Column, words: Column, keywords: Sequence[str]) -> Column:
    found = F.size(F.filter(words, lambda w: w.isin(*keywords))) if keywords else F.lit(0)
    for k in keywords:
        if " " in k:
            found = found + F.when(low.contains(k), ((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int")).otherwise(0)
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(F.lit(0.0))


def scored(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rows (with text) and word_count, keyword_density, breakdown (map of what gave or took points), score."""
    p, t, low = rules.points, F.col("text"), F.col("_low")
    # Lower case and words are made once; what follows only reads columns.
    base = rows.withColumn("_low", F.lower(t)).withColumn("_words", T.words(low))
    base = base.withColumns({"word_count": F.size("_words"), "keyword_density": _density(low, F.col("_words"), rules.keywords)})
    n, d = F.col("word_count"), F.col("keyword_density")
    good = n.between(rules.shortest, rules.longest)
    method = sum((low.contains(m).cast("int") for m in rules.methodology), F.lit(0))

    def when(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(p[name]))

    parts = {
        "base": F.lit(L.BASE_POINTS),
        "climate_keywords": when(d >= 0.15, "climate_keyword_density_high").when(d >= 0.10, p["climate_keyword_density_medium"]).when(d >= 0.05, p["climate_keyword_density_low"]),
        "causal_language": when(T.holds_any(low, rules.causal), "causal_language"),
        "quantitative_data": when(T.has_quantity(t), "quantitative_data"),
        "impact_language": when(T.holds_any(low, rules.impact), "impact_language"),
        "factual_tone": when(T.holds_any(low, rules.factual), "factual_tone"),
        "proper_length": when(good, "proper_length"),
        "meta_organizational": when(T.holds_any(low, rules.meta), "meta_organizational"),
        "heavy_citations": when(T.citations(t) >= 3, "heavy_citations"),
        "acknowledgment": when(T.holds_any(low, rules.acknowledgment), "acknowledgment"),
        "methodology_heavy": when(method >= 2, "methodology_heavy"),
        "author_affiliation": when(T.holds_any(low, rules.affiliation), "author_affiliation"),
        "figure_table_only": when((n < 20) & T.holds_any(low, rules.figure_table), "figure_table_only"),
        "wrong_length": when(~good, "wrong_length"),
    }
    # Points are columns of their own, so that the map is made only where it is asked for.
    told = base.withColumns({f"_p_{k}": v.cast("int") for k, v in parts.items()})
    points = {k: F.col(f"_p_{k}") for k in parts}
    breakdown = F.map_filter(F.create_map(*[x for k, v in points.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    total = sum((F.coalesce(v, F.lit(0)) for v in points.values()), F.lit(0))
    out = told.withColumns({"breakdown": breakdown, "score": F.greatest(F.lit(0), F.least(F.lit(100), total))})
    return out.drop("_low", "_words", *[f"_p_{k}" for k in parts])


def kept(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return rows.filter(F.col("score") >= rules.threshold)


def filtered(documents: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its kept paragraphs rejoined, and the statistics of the filter. Documents without any stay, with 0s."""
    marked = scored(split(documents.select(id_column, text), text), rules).withColumn("ok", F.col("score") >= rules.threshold)
    by = marked.groupBy(id_column).agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if("ok").alias("n_kept"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("para_idx", "text")))), lambda x: x["text"]), "\n\n").alias("joined"),
        F.coalesce(F.avg(F.when(F.col("ok"), F.col("score"))), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg(F.when(F.col("ok"), F.col("keyword_density"))), F.lit(0.0)).alias("avg_density"),
    )
    whole = documents.select(id_column, F.coalesce(F.length(text), F.lit(0)).alias("original_length"))
    joined = whole.join(by, id_column, "left").withColumn("filtered_text", T.normal_space(F.coalesce("joined", F.lit(""))))
    length = F.length("filtered_text")
    return joined.select(
        id_column,
        "filtered_text",
        "original_length",
        length.alias("filtered_length"),
        F.when(F.col("original_length") > 0, length / F.col("original_length")).otherwise(0.0).alias("retention"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        F.coalesce("avg_density", F.lit(0.0)).alias("avg_density"),
    )


def contents_flags(documents: DataFrame, text: str = "text") -> DataFrame:
    """Detectors of tables of contents: list words, dots and numbered captions, page references; dots; many references."""
    t = F.col(text)
    reference = F.size(F.filter(T.lines(t), lambda x: x.rlike("(?U)" + L.PAGE_REFERENCE)))
    pattern = "(?U)" + "|".join(f"(?:{p})" for p in L.TOC_PATTERNS)
    captions = sum((F.regexp_count(t, F.lit("(?iU)" + p)) for p in L.CAPTIONS), F.lit(0))
    return documents.withColumns(
        {
            "is_contents": T.has_any(t, L.LIST_INDICATORS) | t.rlike(pattern) | (reference / F.size(T.lines(t)) > 0.5),
            "dot_density": F.when(F.length(t) > 0, (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))) / F.length(t)).otherwise(0.0),
            "many_captions": captions > 2,
        }
    )
