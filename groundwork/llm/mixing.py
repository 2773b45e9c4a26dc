"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target weight times all rows, over its own rows. Each document draws
its number of copies by inverting the Poisson distribution of that mean at a number in [0, 1) that is hashed from
the seed and its id, so a rerun or a lost executor draws the same. Copies are exploded and dealt out by hash over
all partitions, in hash order within each: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import cut, partitions

#: Sources whose rates are broadcast at most (each holds 1 KB or less). Where there are more, those with most rows are
#: broadcast, so that none of the others, which are joined by shuffle, is a hot key.
BROADCAST_SOURCES = 20_000

#: Mean up to which one number is inverted; a larger mean is the sum of equal parts, each drawn by a number of its own.
PART = 32.0


def unit_interval(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) hashed from the seed and the keys: the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """array: P(X <= 0), P(X <= 1), ... of a Poisson variable, until the rest is beyond double precision.

    Each probability is the one before times rate / k, so the mean must be moderate (``PART``).
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(F.element_at(acc["out"], -1) + p)).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["out"])).otherwise(F.array(F.lit(1.0)))


def _draw(cdf: Column, u: Column) -> Column:
    """The inverse of the distribution at u."""
    return F.size(F.filter(cdf, lambda c: c <= u)).cast("long")


def _part(cdf: Column, u: Column) -> Column:
    """_draw, with u worked out once and not for each element."""
    return F.get(F.transform(F.array(u), lambda x: _draw(cdf, x)), F.lit(0))


def rates(documents: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """The source, n, rate, parts and cdf of each source: its draw is the sum of so many draws from the cdf.

    Without weights, targets are shares of rows to the power of temperature, scaled to sum to 1 (1 keeps the mix,
    0 makes sources equal). With weights, sources not named get none. Null sources are one source, the empty name.
    """
    n = documents.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_groundwork_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        weighed = n.withColumn("w", F.coalesce(table[F.col("_groundwork_source")].cast("double"), F.lit(0.0)))
    weighed = cut(weighed)
    rows, total = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    rate = F.lit(epochs * rows) * F.col("w") / F.lit(total or 1.0) / F.col("n")
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("long")
    return weighed.select("_groundwork_source", "n", rate.alias("rate")).withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def mix(documents: DataFrame, seed: int = 17, source: str = "source", id_column: str = "doc_id", shuffle: bool = True, **targets) -> DataFrame:
    """documents, each row as often as drawn, with copies (how often), copy (from 1) and place (the order of the shuffle).

    Rows with one id draw the same number. A null id draws as the empty text. Null sources form one source. Empty, null
    and very long texts are rows like any other, and so is a row that is drawn a million times: a large mean is drawn
    in parts, so that what is held for a source never grows with it. An empty table gives an empty one; columns that
    are already called like the new ones are replaced. Rows that draw 0 are absent: that is the mix.
    """
    kept = [c for c in documents.columns if c.lower() not in ("copies", "copy", "place")]
    table = cut(rates(documents, source, **targets).select("_groundwork_source", "n", F.col("parts").alias("_groundwork_parts"), F.col("cdf").alias("_groundwork_cdf")))
    named = documents.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_groundwork_source"))
    own = F.col(f"`{id_column}`")
    # The numbers are drawn before the join; the first part's is the one that a small mean needs alone.
    joined = _with_rates(named.withColumn("_groundwork_u", unit_interval(seed, own)), table)
    one = _draw(F.col("_groundwork_cdf"), F.col("_groundwork_u"))
    more = F.aggregate(F.sequence(F.lit(2).cast("long"), F.col("_groundwork_parts")), one, lambda acc, k: acc + _part(F.col("_groundwork_cdf"), unit_interval(seed, own, k)))
    counted = joined.withColumn("copies", F.when(F.col("_groundwork_parts") > 1, more).otherwise(one)).filter("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    place = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/place"), F.coalesce(own.cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 16)
    out = copied.select(*[F.col(f"`{c}`") for c in kept], "copies", "copy", place.alias("place"))
    if not shuffle:
        return out
    return out.repartition(partitions(documents.sparkSession), "place").sortWithinPartitions("place")


def _with_rates(named: DataFrame, table: DataFrame) -> DataFrame:
    """named, each row with the parts and the cdf of its source."""
    key = "_groundwork_source"
    most = table.orderBy(F.desc("n"), key).limit(BROADCAST_SOURCES + 1).drop("n")
    if most.count() <= BROADCAST_SOURCES:
        return named.join(F.broadcast(most), key)
    most = F.broadcast(table.orderBy(F.desc("n"), key).limit(BROADCAST_SOURCES).drop("n"))
    return named.join(most, key).unionByName(named.join(most.select(key), key, "left_anti").join(table.drop("n"), key))


#: The same draw in SQL over the view documents (default seed and temperature).
MIX_SQL = """
WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT *, pow(n::DOUBLE, 0.7) AS w FROM n),
r AS (SELECT source, (SELECT sum(n) FROM w) * w / (SELECT sum(w) FROM w) / n AS rate FROM w),
c AS (SELECT source, list_transform(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT + 1), lambda k: exp(k * ln(rate) - rate - lgamma(k + 1))) AS p FROM r),
e AS (SELECT source, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM c),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM e),
u AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
d AS (SELECT u.doc_id, u.source, count(*) AS copies FROM u JOIN f ON f.source = coalesce(u.source, '') AND f.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, copies, copy, substr(md5('17/place:' || doc_id || ':' || copy), 1, 16) AS place
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM d)
"""
