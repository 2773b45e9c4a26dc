"""A Merkle manifest of a dataset: contiguous digest matrices in aligned blocks.

Leaves are numbered within their group by a range sort and the counts of its partitions, so no task sees a whole group.
Every FANOUT**LEVELS neighbouring leaves form an aligned block: their digests, as 64 hexadecimal characters each, are one numpy
matrix, whose rows are hashed eight at a time, level by level, to the block's root. The roots of a group's blocks are
the leaves of the next tier, until one block is left; the groups' roots then form a tree of their own. On the way back
each block gets the siblings above it once, and index arithmetic on its matrices gives the siblings of every leaf:
those of one run of eight lie next to each other, so they are two slices of one buffer.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut, partitions, release

FANOUT = 8
LEVELS = 4  #: of a block, which so has FANOUT**LEVELS nodes
HEX = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 (hexadecimal) of the fields: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    parts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in parts]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def height(n: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def levels(nodes: bytes, n: int, deep: int = LEVELS) -> list[bytes]:
    """Hexadecimal digests, joined, of each level of a block: its own nodes first, its root last.

    ``n`` counts the nodes of the whole tier: a block that is not alone goes up ``deep`` levels however few its nodes are.
    """
    out = [binascii.hexlify(nodes)]
    for _ in range(min(deep, height(n))):
        rows = np.frombuffer(out[-1], np.uint8).reshape(-1, HEX)
        whole = len(rows) // FANOUT
        runs = [x.tobytes() for x in rows[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
        if len(rows) > whole * FANOUT:
            runs.append(rows[whole * FANOUT :].tobytes())
        out.append("".join([hashlib.sha256(run).hexdigest() for run in runs]).encode())
    return out


def siblings(level: bytes, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For nodes (by number) of a level: what stands before and after each in its run of FANOUT."""
    begin = at - at % FANOUT
    end = np.minimum(begin + FANOUT, len(level) // HEX)
    cuts = zip((begin * HEX).tolist(), (at * HEX).tolist(), ((at + 1) * HEX).tolist(), (end * HEX).tolist(), strict=True)
    pairs = [(level[a:b], level[c:d]) for a, b, c, d in cuts]
    return [x for x, _ in pairs], [x for _, x in pairs]


def numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """rows (grp, ...) with ``position`` in their group by ``order`` (from 0) and ``n``, the group's rows; and the table
    that they are read from.

    A range sort deals out large groups over many partitions; each counts its own rows, and only these counts (a row for
    each group in each partition) are summed up within groups.
    """
    tasks = partitions(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            groups = batch.column(batch.schema.get_field_index("grp")).to_pylist()
            places = []
            for g in groups:
                last, seen = ((g,), 0) if (g,) != last else (last, seen)
                places.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(groups), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "part int, place long"])
    ranged = rows.repartitionByRange(tasks, "grp", *order).sortWithinPartitions("grp", *order)
    held = cut(ranged.mapInArrow(count, schema))
    counts = held.groupBy("grp", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col("grp").alias("_grp"), F.col("part").alias("_part"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("begin"), F.sum("m").over(Window.partitionBy("grp")).alias("n"))
    placed = held.join(begins, held["grp"].eqNullSafe(begins["_grp"]) & (held["part"] == begins["_part"]))
    return placed.select(*[held[c] for c in rows.columns], (F.col("begin") + F.col("place")).alias("position"), "n"), held


def _blocks(nodes: DataFrame, deep: int) -> DataFrame:
    """nodes (grp, position, n, node, row) as one row for each aligned block: grp, block, n, nodes, rows, root."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        digests = b"".join(table.column("node").to_pylist())
        n = table.column("n")[0].as_py()
        root = levels(digests, n, deep)[-1]
        rows = table.column("row").combine_chunks()
        return pa.table({
            "grp": table.column("grp")[:1], "block": table.column("block")[:1], "n": pa.array([n]), "nodes": pa.array([digests], pa.binary()),
            "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), "root": pa.array([binascii.unhexlify(root)], pa.binary()),
        })

    kind = nodes.schema["row"].dataType.simpleString()
    dealt = nodes.select("grp", F.floor(F.col("position") / FANOUT**deep).alias("block"), "position", "n", "node", "row")
    return dealt.groupBy("grp", "block").applyInArrow(build, f"grp string, block long, n long, nodes binary, rows array<{kind}>, root binary")


def tree(nodes: DataFrame, deep: int = LEVELS) -> list[DataFrame]:
    """Tiers of written blocks over nodes (grp, position, n, node, row): the first holds these, the last one block a group."""
    tiers = [cut(_blocks(nodes, deep))]
    while not tiers[-1].filter(F.col("n") > FANOUT**deep).isEmpty():
        up = tiers[-1].select("grp", F.col("block").alias("position"), F.ceil(F.col("n") / FANOUT**deep).alias("n"), F.col("root").alias("node"), F.struct("block").alias("row"))
        tiers.append(cut(_blocks(up, deep)))
    return tiers


def _paths(blocks: DataFrame, above: DataFrame, carried: str, deep: int) -> DataFrame:
    """Each node of the blocks: grp, row, node (hexadecimal), path (its block's siblings, then those above the block),
    and what else ``above`` (grp, block, path, ...) holds for its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                value = {name: one.column(i) for i, name in enumerate(one.schema.names)}
                rows = value["rows"].flatten()
                stages = levels(value["nodes"][0].as_py(), value["n"][0].as_py(), deep)
                m, within = len(rows), np.arange(len(rows), dtype=np.int64)
                columns = [siblings(level, within // FANOUT**i) for i, level in enumerate(stages[:-1])]
                columns += [([x["before"]] * m, [x["after"]] * m) for x in value["path"][0].as_py()]
                # Node by node, its levels in turn.
                befores = pa.array([x for each in zip(*[c[0] for c in columns], strict=True) for x in each], pa.string())
                afters = pa.array([x for each in zip(*[c[1] for c in columns], strict=True) for x in each], pa.string())
                path = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(columns), pa.int32()), pa.StructArray.from_arrays([befores, afters], names=["before", "after"]))
                nodes = pa.array([stages[0][a : a + HEX] for a in range(0, m * HEX, HEX)], pa.string())
                same = [pa.concat_arrays([value[c]]).take(pa.array(np.zeros(m, np.int64))) for c in ["grp", *extra]]
                whole = pa.RecordBatch.from_arrays([same[0], rows, nodes, path, *same[1:]], names=["grp", "row", "node", "path", *extra])
                for a in range(0, m, 1024):
                    yield whole.slice(a, 1024)

    extra = [x.split(" ")[0] for x in carried.split(", ") if x]
    kind = blocks.schema["rows"].dataType.elementType.simpleString()
    met = blocks.select("grp", "block", "n", "nodes", "rows").alias("b").join(above.alias("a"), F.col("b.grp").eqNullSafe(F.col("a.grp")) & (F.col("b.block") == F.col("a.block")))
    schema = ", ".join([f"grp string, row {kind}, node string, path {PATH}", *([carried] if carried else [])])
    return met.select("b.grp", "b.n", "b.nodes", "b.rows", "a.path", *[f"a.{c}" for c in extra]).mapInArrow(run, schema)


def _down(tiers: Sequence[DataFrame], above: DataFrame, carried: str, deep: int) -> DataFrame:
    """Nodes of the first tier with all siblings on their way up, given those above each group's root (grp, block 0, path)."""
    for tier in tiers[:0:-1]:
        above = _paths(tier, above, carried, deep).select("grp", F.col("row.block").alias("block"), "path", *[x.split(" ")[0] for x in carried.split(", ") if x])
    return _paths(tiers[0], above, carried, deep)


def proofs(leaves: DataFrame, group: str, order: Sequence[str], kept: Sequence[str], leaf_column: str = "leaf", deep: int = LEVELS) -> DataFrame:
    """The kept columns of each leaf, and leaf, subroot, root, path.

    Leaves of one group stand in the order of the columns ``order`` (nulls first), equal ones by their digest; every
    FANOUT of them, the last run being shorter, become their hash, until one is left: the group's subroot. Subroots
    stand by group (null first) and give the root likewise. ``path`` holds, level by level from the leaf to the root, the
    digests of a run before and after the own node. Groups may be null; repeated rows are leaves of their own; there
    is no limit on rows or groups, and no task sees more than a block, of FANOUT**deep nodes, at once. No leaves give no rows.
    """
    held = cut(leaves.select(F.col(group).alias("grp"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.unhex(leaf_column).alias("node"), F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("tie")))
    nodes, sorted_rows = numbered(held, [*[f"o{i}" for i in range(len(order))], "node", "tie"])
    tiers = tree(nodes.select("grp", "position", "n", "node", "row"), deep)
    release(held, sorted_rows)
    tops = tiers[-1].select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"), F.struct(F.col("grp").alias("name")).alias("row"))
    nodes, sorted_rows = numbered(tops, ["name"])
    over = tree(nodes.select("grp", "position", "n", "node", "row"), deep)
    release(sorted_rows)
    root = over[-1].select("grp", "block", F.array().cast(PATH).alias("path"), F.lower(F.hex("root")).alias("root"))
    named = _down(over, root, "root string", deep).select(F.col("row.name").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root")
    return _down(tiers, named, "subroot string, root string", deep).select("row.*", F.col("node").alias(leaf_column), "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]).cast("binary"), 256))


def manifest(documents: DataFrame, altered_text: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", deep: int = LEVELS) -> DataFrame:
    """doc_id, leaf, altered_leaf, subroot, root and path of each row of documents.

    ``altered_text`` is the text that someone claims a row to have (null: the row's own); altered_leaf is the leaf of that
    claim, and null where there is none. Null values, empty and very long texts are hashed like any others; ids may be
    null (they come first) or repeated (equal ids stand by digest); columns that are not among ``fields`` are not read,
    whatever they are called. An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    claimed = F.lit(None).cast("string")
    if altered_text is not None:
        claimed = F.when(altered_text.isNotNull(), leaf([altered_text if c == "text" else F.col(f"`{c}`") for c in fields]))
    leaves = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{group}`").alias("_group"), leaf(columns).alias("leaf"), claimed.alias("altered_leaf"))
    return proofs(leaves, "_group", ["doc_id"], ["doc_id", "altered_leaf"], deep=deep).select("doc_id", "leaf", "altered_leaf", "subroot", "root", "path")


def tampered(key: Column, text: Column) -> Column:
    """The claimed text of the rows whose id's CRC-32 can be divided by 3: without capitals; null for all others."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 3 == 0, lowered(text))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of what ``manifest`` found."""
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)
    told = found.withColumn("folded_root", folded(F.coalesce("altered_leaf", "leaf"), F.col("path")))
    return told.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows in SQL: trees by recursion over levels, folds by recursion over the steps of a path.
MANIFEST_SQL = """
WITH RECURSIVE crcs AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d0 AS (SELECT doc_id, lang, text, doc_id::VARCHAR AS s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big,
  concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM documents),
d1 AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0
    THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, big, lower(big)), '-')) END AS altered FROM d0, crcs),
d AS (SELECT *, row_number() OVER () AS rn, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d1),
up AS (SELECT lang, 0 AS k, p, leaf AS h, n FROM d UNION ALL SELECT lang, k + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, k, p // 8, n),
runs AS (SELECT lang, k, p // 8 AS r, string_agg(h, '' ORDER BY p) AS run FROM up WHERE n > 1 GROUP BY lang, k, p // 8),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (SELECT 0 AS k, p, subroot AS h, n FROM tops UNION ALL SELECT k + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM over WHERE n > 1 GROUP BY k, p // 8, n),
over_runs AS (SELECT k, p // 8 AS r, string_agg(h, '' ORDER BY p) AS run FROM over WHERE n > 1 GROUP BY k, p // 8),
sides AS (
  SELECT rn, k, (d.p // (8 ** k)::BIGINT) % 8 AS i, run FROM d JOIN runs ON d.lang IS NOT DISTINCT FROM runs.lang AND runs.r = d.p // (8 ** (k + 1))::BIGINT
  UNION ALL SELECT rn, 100 + k, (t.p // (8 ** k)::BIGINT) % 8, run FROM d JOIN tops t ON d.lang IS NOT DISTINCT FROM t.lang JOIN over_runs o ON o.r = t.p // (8 ** (k + 1))::BIGINT),
steps AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY k) AS s, left(run, (64 * i)::INT) AS b, run[64 * i + 65:] AS a FROM sides),
proofs AS (SELECT rn, sha256(string_agg(b || a, '' ORDER BY s)) AS proof, count(*) AS m FROM steps GROUP BY rn),
fold AS (SELECT rn, 0 AS s, coalesce(altered, leaf) AS h FROM d UNION ALL SELECT f.rn, f.s + 1, sha256(b || f.h || a) FROM fold f JOIN steps ON steps.rn = f.rn AND steps.s = f.s + 1)
SELECT doc_id, leaf, subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root.h AS verified
FROM d JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang LEFT JOIN proofs USING (rn) JOIN fold ON fold.rn = d.rn AND fold.s = coalesce(m, 0), (SELECT h FROM over WHERE n = 1) root
"""
