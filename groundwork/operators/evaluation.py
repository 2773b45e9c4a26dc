"""Reviewed answers: rates by tag, agreement of models, distributions and summaries."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L
from groundwork.functions import metrics as M
from groundwork.operators.quantiles import exact_quantiles
from groundwork.sources.shared import stored

TAGS = ("correct", "partial", "hallucinated")


def rates(rows: DataFrame, by: Sequence[str] = (), tag: str = "tag") -> DataFrame:
    """Counts by tag, total, and percentages to one place; null over no rows."""
    share = lambda t: F.round(F.try_divide(F.count_if(F.col(tag) == t) * 100.0, F.count("*")), 1)
    return rows.groupBy(*by).agg(*[F.count_if(F.col(tag) == t).alias(t) for t in TAGS], F.count("*").alias("total"), *[share(t).alias(f"{t}_pct") for t in TAGS])


def compare(left: DataFrame, right: DataFrame, key: str = "id", names: tuple[str, str] = ("a", "b"), columns: Sequence[str] = ("tag", "answer")) -> DataFrame:
    """Two models' rows side by side, by inner join."""
    one = left.withColumnsRenamed({c: f"{names[0]}_{c}" for c in columns})
    two = right.select(key, *[F.col(c).alias(f"{names[1]}_{c}") for c in columns])
    return one.join(two, key)


def agreement(pairs: DataFrame, a: str = "a_tag", b: str = "b_tag") -> DataFrame:
    """kind, n, pct: how far two models agree, in one pass."""
    c, h = (lambda x: F.col(x) == "correct"), (lambda x: F.col(x) == "hallucinated")
    kinds = {"both_correct": c(a) & c(b), "both_hallucinated": h(a) & h(b), "a_only": c(a) & h(b), "b_only": h(a) & c(b), "any_disagreement": F.col(a) != F.col(b)}
    one = pairs.agg(F.count("*").alias("_all"), *[F.count_if(v).alias(k) for k, v in kinds.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds]))
    return one.select("_all", rows.alias("r")).select("r.kind", "r.n", F.round(F.try_divide(F.col("r.n") * 100.0, F.col("_all")), 1).alias("pct"))


def distribution(rows: DataFrame, by: Sequence[str], tag: str = "tag") -> DataFrame:
    """A column of percentages for each tag."""
    return rows.groupBy(*by).pivot(tag, list(TAGS)).agg(F.count(F.lit(1))).na.fill(0, list(TAGS)).withColumn("_n", sum((F.col(t) for t in TAGS), F.lit(0))).select(*by, *[F.round(F.try_divide(F.col(t) * 100.0, F.col("_n")), 1).alias(t) for t in TAGS])


def wins(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How often each side is strictly better, ties, and the range of all values."""
    return pairs.agg(F.count_if(F.col(a) > F.col(b)).alias("a_wins"), F.count_if(F.col(b) > F.col(a)).alias("b_wins"), F.count_if(F.col(a) == F.col(b)).alias("ties"), F.least(F.min(a), F.min(b)).alias("low"), F.greatest(F.max(a), F.max(b)).alias("high"))


def run_summary(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """How many answers there are, hold data, say that nothing was found, or are errors.

    An answer without text holds no data, and is neither of the others; one that says both counts for both.
    """
    t = F.coalesce(F.col(answer), F.lit(""))
    none, error = t.contains(L.NO_INFO_MARK), t.contains(L.ERROR_MARK)
    return rows.agg(F.count("*").alias("total"), F.count_if((t != "") & ~none & ~error).alias("answered"), F.count_if(none).alias("no_info"), F.count_if(error).alias("errors"))


def factual_metrics(rows: DataFrame, by: Sequence[str] = ("model_config",), reference: str = "reference", answer: str = "answer", tag: str = "tag") -> DataFrame:
    """By configuration: mean ROUGE-L, mean METEOR and the share of answers tagged correct."""
    told = rows.withColumns({"_r": M.rouge_l(F.col(reference), F.col(answer)), "_m": M.meteor(F.col(reference), F.col(answer))})
    return told.groupBy(*by).agg(F.avg("_r").alias("rouge_l"), F.avg("_m").alias("meteor"), F.avg((F.col(tag) == "correct").cast("int")).alias("accuracy"))


def similarity_summary(rows: DataFrame, encoder, by: Sequence[str] = (), reference: str = "reference", answer: str = "answer") -> DataFrame:
    """Mean and exact median of the token match by a given encoder; the median without gathering a group's values."""
    told = stored(rows.select(*by, M.greedy_f1(F.col(reference), F.col(answer), encoder).alias("_f")))
    means, medians = told.groupBy(*by).agg(F.avg("_f").alias("mean")), exact_quantiles(told, "_f", [0.5], by).select(*by, F.col("value").alias("median"))
    if not by:
        return means.join(F.broadcast(medians), how="left")  # one row each
    renamed = medians.withColumnsRenamed({c: f"_m{i}" for i, c in enumerate(by)})
    hit = reduce(lambda x, y: x & y, [means[c].eqNullSafe(renamed[f"_m{i}"]) for i, c in enumerate(by)])
    return means.join(renamed, hit, "left").select(*[means[c] for c in by], "mean", "median")


def union(tables: dict[str, DataFrame], column: str = "model_config") -> DataFrame:
    """All tables one below the other with their names; columns that some lack are null there."""
    out = None
    for name, rows in tables.items():
        named = rows.withColumn(column, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def union_of_files(paths: dict[str, str], read: Callable[[str], DataFrame], present: Callable[[str], bool], column: str = "model_config") -> DataFrame:
    """The tables at some paths, one below the other with their names; a missing one is left out with a warning."""
    there = {}
    for name, path in paths.items():
        if present(path):
            there[name] = read(path)
        else:
            warnings.warn(f"{name}: {path} is missing", stacklevel=2)
    return union(there, column)


def of_type(rows: DataFrame, kind: str, column: str = "type", folded: bool = False) -> DataFrame:
    """Rows of one type of question: the very word, or, folded, in any letter case."""
    return rows.filter((F.lower(column) == kind.lower()) if folded else (F.col(column) == kind))


FACTUAL, OTHER = L.FACTUAL_INSTRUCTION, L.OTHER_INSTRUCTION


def instructions(rows: DataFrame, kind: str = "type", question: str = "question", answer: str = "reference_answer") -> DataFrame:
    """instruction, input, output and the limit of words for fine-tuning; rows keep their other columns out."""
    factual = F.coalesce(F.col(kind) == "factual", F.lit(False))
    return rows.select(F.when(factual, F.lit(FACTUAL)).otherwise(F.lit(OTHER)).alias("instruction"), F.col(question).alias("input"), F.col(answer).alias("output"), F.when(factual, 10).otherwise(20).alias("word_limit"))
