"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, a number that never changes. Bytes are summed by slot, and a versioned
map says which shard holds which slot. Rebalancing edits the map: slots stay where they are while their shard has
room below the mean, and the rest go, largest first, to the shard with least. Only the slot sums (a fixed number of
rows) are ever gathered or broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.llm.common import shared_folder

SLOTS = 8192


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, by a hash of its keys; null is a key like any other."""
    return F.pmod(F.xxhash64(*[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), F.lit(slots)).cast("int")


def slot_sums(sized: DataFrame) -> DataFrame:
    """vslot, bytes, n: at most one row for each slot."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def _least(loads: Column) -> Column:
    """Index of the smallest load, the first of equals."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _added(loads: Column, shard: Column, amount: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + amount).otherwise(x))


def edited(slot_map: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with sizes nearly equal over the shards.

    In each shard slots stay, from the largest, while their running sum is at most the mean of all shards. The rest,
    and the slots of shards that are no more, are walked from the largest, each to the shard that is least filled.
    """
    last = slot_map.agg(F.max("version").alias("version"))
    held = slot_map.join(F.broadcast(last), "version").join(F.broadcast(sums.select("vslot", "bytes")), "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    mean = held.agg(F.ceil(F.sum("bytes") / shards).cast("long").alias("mean"))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    marked = held.withColumn("running", running).join(F.broadcast(mean)).withColumn("stays", (F.col("running") <= F.col("mean")) & (F.col("shard") < shards))
    # One row over a fixed number of slots: what stays by shard, and what goes.
    one = marked.agg(
        F.max("version").alias("version"),
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).alias(f"load{k}") for k in range(shards)],
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("pool"),
    )
    start = F.struct(F.array(*[F.col(f"load{k}") for k in range(shards)]).alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"))

    def move(acc: Column, x: Column) -> Column:
        shard = _least(acc["loads"])
        return F.struct(_added(acc["loads"], shard, -x["less"]).alias("loads"), F.concat(acc["placed"], F.array(F.struct(x["vslot"].alias("vslot"), shard.alias("shard")))).alias("placed"))

    moved = one.select("version", F.explode(F.aggregate("pool", start, move, lambda acc: acc["placed"])).alias("p")).select("version", "p.vslot", "p.shard")
    return marked.filter("stays").select("version", "vslot", "shard").unionByName(moved).withColumn("version", F.col("version") + 1)


def store(slot_map: DataFrame, path: str) -> DataFrame:
    """Add a version to the map kept at path; the whole map, read again.

    A version is a folder of its own, which is never written twice: of two editors that start from one version the second
    fails, and has to start again from the first one's.
    """
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("vslot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return _read(slot_map.sparkSession, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vslot int, shard int, version int").parquet(path).select("version", "vslot", "shard")


def shard(documents: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The law is ``bytes``: sizes are nearly equal over the shards, as near as whole slots allow. ``slot`` numbers the
    records of a shard from 0 without gaps, by virtual slot, then id. A record's slot is hashed from its id and its text's
    checksum, so rows without an id, or of one id, fall into many slots. The map is kept at ``path`` (a new folder in
    the shared one if not given); a map found there is edited. Null text counts as empty (size 8), very long ones count
    whole; ties of size between slots and shards go to the smaller number; repeated rows are records of their own, in
    one slot; an empty table gives an empty result; other columns are left out.
    """
    spark = documents.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = documents.select(F.col(f"`{id_column}`").alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    sized = sized.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots=slots))
    kept = path is not None
    path = path or f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"
    slot_map = _read(spark, path) if kept and _exists(spark, path) else store(first_map(spark, shards, slots), path)
    sums = slot_sums(sized)
    slot_map = store(edited(slot_map, sums, shards), path)
    now = slot_map.join(F.broadcast(slot_map.agg(F.max("version").alias("version"))), "version")
    # Where each slot's records begin in their shard: over the fixed number of slots.
    begin = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = now.join(F.broadcast(sums.select("vslot", "n")), "vslot").withColumn("begin", F.coalesce(F.sum("n").over(begin), F.lit(0))).select("vslot", "shard", "begin", "version")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return sized.join(F.broadcast(offsets), "vslot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
