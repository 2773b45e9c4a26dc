"""Which names hold which phrases: an index of n-grams in place of comparing every phrase with every name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  #: characters; a shorter phrase is a gram itself


def grams(x: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    every = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: x.substr(i, F.lit(n)))
    return F.array_distinct(F.when(F.length(x) >= n, every).otherwise(F.array().cast("array<string>")))


def containing(names: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, name: each distinct phrase with every distinct name (columns ``phrase`` and ``name``) that holds it.

    A phrase meets, in an equality join, only the names that hold its rarest gram of three characters, and is then held
    against them; a phrase with a gram that no name holds meets none. Phrases of one or two characters are grams of
    their own. So the rows of the join follow the matches, not names times phrases. Null and empty names and phrases
    match nothing.
    """
    n = names.select("name").filter("name <> ''").distinct()
    p = phrases.select("phrase").filter("phrase <> ''").distinct()
    held = n.select("name", F.explode(grams(F.col("name"), GRAM)).alias("gram"))
    asked = p.select("phrase", F.explode(grams(F.col("phrase"), GRAM)).alias("gram"))
    # Only grams that a phrase asks for are counted; a phrase lives if all of its own are there.
    counts = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("phrase").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "gram")).alias("r")).filter("absent = 0").select("phrase", "r.gram")
    long = held.join(rarest, "gram").filter(F.col("name").contains(F.col("phrase"))).select("phrase", "name")
    short = p.filter(F.length("phrase") < GRAM)
    pieces = n.select("name", F.explode(F.concat(*[grams(F.col("name"), k) for k in range(1, GRAM)])).alias("phrase"))
    return long.unionByName(pieces.join(short, "phrase").select("phrase", "name"))
