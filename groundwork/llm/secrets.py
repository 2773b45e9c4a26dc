"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

All of it is built-in column functions on one row at a time: no shuffle, no Python.

Candidates are runs of key characters. Each belongs to a character class (hexadecimal, one case with digits or base32,
both cases with digits, base64), which fixes the entropy that a window must reach. A window slides over the candidate one character at a time; the counts of its
characters are kept incrementally: one goes up, one goes down, and the sum of c*log2(c) moves by the difference.
Candidates on the allow-list are passed over. A candidate with windows that reach the threshold gives one span,
from the first such window's start to the last one's end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length. Lengths are held against whole leftmost matches.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class Entropy:
    """Parameters of the sliding windows."""

    window: int = 20
    candidate: str = r"[A-Za-z0-9+/_=-]+"
    least_hex: float = 3.0
    least_base64: float = 3.9
    #: Further classes by what the whole candidate is made of, tried in this order after hexadecimal. Of random windows
    #: of 20 characters about 1 in 1,000 stays below.
    classes: tuple[tuple[str, float], ...] = (
        (r"^[a-z0-9]+$", 3.2),
        (r"^[A-Z0-9]+=*$", 3.2),
        (r"^[A-Za-z0-9]+$", 3.5),
    )
    #: Whole candidates that are never reported.
    allow: tuple[str, ...] = field(
        default=(
            r"^[A-Za-z_=/+-]+$",  # words: no digit at all
            r"^[0-9_=/+-]+$",  # numbers and dates
            r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
            r"^(.)\1*$",  # one character again and again
            r"EXAMPLE",  # keys printed in manuals
        )
    )


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: where the pattern's matches begin and end (in code points), and their text.

    What lies between matches comes from splitting at the same pattern; the lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("m")), start, step, lambda acc: acc["out"])


def _entropy_window(candidate: Column, least: Column, window: int) -> Column:
    """struct<lo, hi>: hull of the windows of a candidate that reach the entropy; null if none does."""
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 1)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) + 1)
    before = F.concat(F.array_repeat(F.lit(0), window), codes)
    steps = F.transform(F.arrays_zip(codes.alias("new"), before.alias("old")), lambda x, i: F.struct(i.alias("i"), x["new"].alias("new"), x["old"].alias("old")))
    state = F.struct(F.array_repeat(F.lit(0), 129).alias("n"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def put(counts: Column, code: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(value), F.slice(counts, code + 1, F.lit(129)))

    def step(acc: Column, x: Column) -> Column:
        old, new = x["old"], x["new"]
        c = F.get(acc["n"], old - 1)
        out = F.when(old > 0, F.struct(put(acc["n"], old, c - 1).alias("n"), (acc["sum"] + F.get(table, c - 1) - F.get(table, c)).alias("sum"))).otherwise(F.struct(acc["n"].alias("n"), acc["sum"].alias("sum")))
        return F.get(F.transform(F.array(out), lambda a: enter(acc, a, F.get(a["n"], new - 1), new, x["i"])), F.lit(0))

    def enter(acc: Column, a: Column, c: Column, new: Column, i: Column) -> Column:
        total = a["sum"] + F.get(table, c + 1) - F.get(table, c)
        hit = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= least)
        lo = F.when(acc["lo"].isNull() & hit, i - (window - 1)).otherwise(acc["lo"])
        return F.struct(put(a["n"], new, c + 1).alias("n"), total.alias("sum"), lo.alias("lo"), F.when(hit, i + 1).otherwise(acc["hi"]).alias("hi"))

    walked = F.aggregate(F.filter(steps, lambda x: x["new"].isNotNull()), state, step)
    return F.get(F.transform(F.array(walked), lambda w: F.when(w["lo"].isNotNull(), F.struct(w["lo"].alias("lo"), w["hi"].alias("hi")))), F.lit(0))


def _long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(F.regexp_extract(x["m"], pattern, group) if group else x["m"]) >= least


def _told_as(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("match"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def scan(documents: DataFrame, text: str = "text", entropy: Entropy = Entropy()) -> DataFrame:
    """documents with found: array<struct<start, end, kind, match>>, by start, then kind, base kinds before entropy.

    Places are code points, the end exclusive. Null and empty text find nothing. Very long texts are searched whole; with
    very many matches in one text the arrays of its spans grow by copying. Spans that begin at one place stand in the
    order of their kinds. Repeated rows each get their result; an empty table gives an empty one; a column already
    called ``found`` is replaced. Base spans always stay; an entropy span that lies within a base span is not told twice.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    item = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"
    base = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        plain = _spans(body, pattern)
        plain = F.filter(plain, _long_enough(pattern, group, least))
        found = F.transform(plain, _told_as(rank, kind))
        base.append(F.when(body.rlike(pattern), found).otherwise(F.array().cast(item)))
    size = entropy.window
    long = rf"(?<!{entropy.candidate[:-1]}){entropy.candidate[:-1]}{{{size},}}"

    def suspicious(x: Column) -> Column:
        allowed = F.lit(False)
        for pattern in entropy.allow:
            allowed = allowed | x["m"].rlike(pattern)
        return ~allowed

    candidates = F.filter(_spans(body, long), suspicious)

    def measured(x: Column) -> Column:
        least = F.when(x["m"].rlike("^[0-9a-fA-F]+$"), F.lit(entropy.least_hex))
        for pattern, bits in entropy.classes:
            least = least.when(x["m"].rlike(pattern), F.lit(bits))
        least = least.otherwise(F.lit(entropy.least_base64))
        return F.struct(x["s"].alias("s"), x["m"].alias("m"), _entropy_window(x["m"], least, size).alias("w"))

    def told(x: Column) -> Column:
        begin, end = x["s"] + x["w"]["lo"], x["s"] + x["w"]["hi"]
        return F.struct(begin.alias("start"), F.lit(len(BASE)).alias("rank"), end.alias("end"), F.lit("entropy").alias("kind"), F.substring(x["m"], x["w"]["lo"] + 1, x["w"]["hi"] - x["w"]["lo"]).alias("match"))

    own = F.when(body.rlike(long), F.transform(F.filter(F.transform(candidates, measured), lambda x: x["w"].isNotNull()), told)).otherwise(F.array().cast(item))
    # The row travels as one column, so that no name of its own can clash with those used here.
    kept = [c for c in documents.columns if c.lower() != "found"]
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.concat(*base).alias("_base"), own.alias("_own"))
    fresh = F.filter("_own", lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    return out.select("_row.*", F.array_sort(F.concat("_base", fresh)).alias("found"))


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each scanned row: the counts by base kind, the hash of the base spans, and all spans as text."""
    n = {kind: F.size(F.filter("found", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in BASE}
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array_join(F.transform(F.filter("found", lambda x: x["rank"] < len(BASE)), line), ",")
    return scanned.select(id_column, *n.values(), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"))


def redact(documents: DataFrame, text: str = "text", mask: str = "[SECRET]", entropy: Entropy = Entropy()) -> DataFrame:
    """documents with every span of its text replaced by the mask; overlapping spans are masked as one.

    Null text stays null, empty text empty, and very long texts are masked whole. Every row stays, repeated ones masked
    alike; an empty table stays empty; columns stay as they are, whatever they are called.
    """
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_whole"), F.col(f"`{text}`").alias("_text"))
    scanned = scan(packed, "_text", entropy)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    items = F.transform("found", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))
    # An element carries the text that precedes it, so the walk itself only looks at places.
    merged = F.aggregate(
        items,
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] >= x["s"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    body = F.col("_text")
    pieces = F.aggregate(
        F.col("_merged"),
        start,
        lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(body, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))).alias("out")),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))),
    )
    clean = F.when(body.isNotNull() & (F.size("found") > 0), pieces).otherwise(body)
    order = [clean.alias(c) if c == text else F.col("_whole").getField(c).alias(c) for c in documents.columns]
    return scanned.withColumn("_merged", merged).select(*order)


def _base_sql() -> str:
    """Spans of each base kind: what lies between matches adds up to their places."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        p = "'" + pattern.replace("'", "''") + "'"
        size = f"length(regexp_extract(m, {p}, {group}))"
        out.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda g: length(g))), 0))) AS s FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM d)) WHERE {size} >= {least}")
    return " UNION ALL ".join(out)


def scan_sql(entropy: Entropy = Entropy()) -> str:
    """digest(scan(documents)) in SQL; every window of a candidate is measured by itself."""
    n, long = entropy.window, f"'{entropy.candidate[:-1]}{{{entropy.window},}}'"
    allowed = " OR ".join("regexp_matches(c, '" + a + "')" for a in entropy.allow if "\\1" not in a)
    least = f"CASE WHEN regexp_matches(c, '^[0-9a-fA-F]+$') THEN {entropy.least_hex} " + "".join(f"WHEN regexp_matches(c, '{p}') THEN {bits} " for p, bits in entropy.classes) + f"ELSE {entropy.least_base64} END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_base_sql()}),
c0 AS (SELECT doc_id, unnest(ms) AS c, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda g: length(g))), 0))) AS s
       FROM (SELECT doc_id, regexp_extract_all(t, {long}) AS ms, string_split_regex(t, {long}) AS gs FROM d)),
c1 AS (SELECT *, {least} AS least FROM c0 WHERE NOT ({allowed}) AND replace(c, c[1], '') <> ''),
win AS (SELECT doc_id, s, least, unnest(range(0, length(c) - {n - 1})) AS k, c FROM c1),
chars AS (SELECT doc_id, s, least, k, unnest(string_split(substr(c, k + 1, {n}), '')) AS ch FROM win),
cnt AS (SELECT doc_id, s, least, k, ch, count(*) AS n FROM chars GROUP BY ALL),
ent AS (SELECT doc_id, s, k FROM cnt GROUP BY doc_id, s, least, k HAVING log2({n}) - sum(n * log2(n)) / {n} >= any_value(least) - 1e-12),
hull AS (SELECT doc_id, {len(BASE)} AS rank, 'entropy' AS kind, s + min(k) AS s, s + max(k) + {n} AS e FROM ent GROUP BY doc_id, ent.s),
own AS (SELECT h.* FROM hull h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s <= h.s AND b.e >= h.e)),
f AS (SELECT doc_id, rank, kind, s::BIGINT AS s, e::BIGINT AS e FROM base UNION ALL SELECT doc_id, rank, kind, s::BIGINT, e::BIGINT FROM own),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""
