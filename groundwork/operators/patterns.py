"""Graph patterns that a model wrote: told apart into columns by expressions, and run for all questions in one plan of joins.

What is understood is one MATCH of one or two relations with a LIMIT, as such models are asked for:

    MATCH (a)-[r:REL]->(b)-[s:REL]->(c) WHERE toLower(a.name) CONTAINS 'text' AND b.name = 'text'
    RETURN a.name AS entity, type(r) AS relationship, b.name AS related_entity ORDER BY a.name DESC LIMIT 5

Nodes and relations may have a label or a type, a single relation may be written without a direction, conditions are
joined by AND alone or OR alone, and texts stand in single or double quotes. Anything else gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.lookups import containing
from groundwork.sources.shared import stored

_NODE = r"\(\s*(\w*)\s*(?::\s*`?\w+`?)?\s*\)"
_EDGE = r"\[\s*(\w*)\s*(?::\s*`?(\w+)`?)?\s*\]"
_HEAD = rf"(?is)^\s*MATCH\s*{_NODE}\s*-\s*{_EDGE}\s*-(>?)\s*{_NODE}(?:\s*-\s*{_EDGE}\s*->\s*{_NODE})?\s*"
_WHOLE = rf"{_HEAD}(?:\bWHERE\s+(.+?)\s*)?\bRETURN\s+(.+?)(?:\s+ORDER\s+BY\s+(\w+)\.name(?:\s+(ASC|DESC))?)?\s+LIMIT\s+([0-9]{{1,6}})\s*;?\s*$"
_TEXT = r"""'([^']*)'|"([^"]*)\""""
_PLACE = r"(?:toLower\(\s*(\w+)\.name\s*\)|(\w+)\.name)"
_CONDITION = rf"(?is){_PLACE}\s*(CONTAINS|=)\s*(toLower\(\s*)?(?:{_TEXT})(?:\s*\))?"
_ITEM = r"(?is)^\s*(?:type\(\s*(\w+)\s*\)|(\w+)\.name|(\w+))(?:\s+AS\s+`?(\w+)`?)?\s*$"

#: Parts of a row of a result: the ends of the edges and their relations.
FROM, TO, LAST, RELATION, SECOND = "n0", "n1", "n2", "r0", "r1"


def _group(pattern: str, k: int) -> Column:
    return F.regexp_extract("pattern", pattern, k)


def told_apart(patterns: DataFrame) -> DataFrame:
    """patterns (pattern_id, pattern) that are understood, by their parts.

    hops, directed, first, second (relations, null: any), conditions (place, folded, op, text), any (OR), items (what a
    column of the result shows, and its name), by and down (the order), most (the limit). A name that no node or relation
    has, a condition that is none, or a mix of AND and OR leaves a pattern out.
    """
    names = ["a", "r", "first", "arrow", "b", "s", "second", "c", "where", "items", "by", "way", "most"]
    whole = patterns.select("pattern_id", *[_group(_WHOLE, k).alias(n) for k, n in enumerate(names, 1)], F.regexp_like("pattern", F.lit(_WHOLE)).alias("_ok")).filter("_ok")
    two = F.col("c") != ""
    # Every named part by the place it has in a row; a name that stands twice means its first place.
    parts = F.array(*[F.struct(F.col(n).alias("name"), F.lit(p).alias("part")) for n, p in (("a", FROM), ("b", TO), ("c", LAST), ("r", RELATION), ("s", SECOND))])

    def part(name: Column, kinds: tuple[str, ...]) -> Column:
        found = F.filter(parts, lambda x: (x["name"] == name) & (name != "") & x["part"].isin(*kinds))
        return F.get(found, F.lit(0))["part"]

    nodes, edges = (FROM, TO, LAST), (RELATION, SECOND)
    # Texts in quotes may hold AND, OR and commas: they are put aside before anything is split.
    texts = F.regexp_extract_all("where", F.lit(f"(?s){_TEXT}"), F.lit(0))
    bare = F.regexp_replace("where", f"(?s){_TEXT}", "''")
    either, both = F.regexp_like(bare, F.lit(r"(?i)'\s*\)?\s*OR\s")), F.regexp_like(bare, F.lit(r"(?i)'\s*\)?\s*AND\s"))
    split = F.split(F.trim(bare), r"(?i)(?<=['\)])\s*(?:AND|OR)\s+")
    one = lambda x, k: F.regexp_extract(x, _CONDITION, k)

    def condition(x: Column, i: Column) -> Column:
        name = F.when(one(x, 1) != "", one(x, 1)).otherwise(one(x, 2))
        folded = one(x, 1) != ""
        quoted = F.get(texts, i)
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        whole = F.regexp_like(F.trim(x), F.lit(rf"(?is)^{_CONDITION[5:]}$"))
        return F.struct(F.when(whole, part(name, nodes)).alias("place"), folded.alias("folded"), F.upper(one(x, 3)).alias("op"), F.when(one(x, 4) != "", F.lower(text)).otherwise(text).alias("text"))

    def item(x: Column) -> Column:
        of = lambda k: F.regexp_extract(x, _ITEM, k)
        relation, node, plain, alias = of(1), of(2), of(3), of(4)
        shown = F.coalesce(part(relation, edges), part(node, nodes), part(plain, (*nodes, *edges)))
        return F.struct(F.when(F.regexp_like(x, F.lit(_ITEM)), shown).alias("part"), F.when(alias != "", alias).otherwise(F.trim(x)).alias("name"))

    conditions = F.when(F.col("where") == "", F.array().cast("array<struct<place:string,folded:boolean,op:string,text:string>>")).otherwise(F.transform(split, condition))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    known = whole.select(
        "pattern_id", F.when(two, 2).otherwise(1).alias("hops"), (F.col("arrow") == ">").alias("directed"), blank("first").alias("first"), blank("second").alias("second"), conditions.alias("conditions"), either.alias("any"), (either & both).alias("_mixed"),
        F.transform(F.split("items", ","), item).alias("items"), part(F.col("by"), nodes).alias("by"), (F.col("by") != "").alias("_ordered"), (F.upper("way") == "DESC").alias("down"), F.col("most").cast("int").alias("most"),
    )
    sound = ~F.col("_mixed") & (~F.col("_ordered") | F.col("by").isNotNull()) & ((F.col("hops") == 1) | F.col("directed"))
    sound &= F.forall("conditions", lambda x: x["place"].isNotNull() & x["text"].isNotNull()) & F.forall("items", lambda x: x["part"].isNotNull())
    sound &= F.size(F.array_distinct(F.transform("items", lambda x: x["name"]))) == F.size("items")
    return known.filter(sound).drop("_mixed", "_ordered")


def results(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """pattern_id, rank, row (map of a result's columns): what each pattern (pattern_id, pattern) finds in the edges (eid,
    subject, relation, object).

    A condition of each pattern (all of them, joined by OR) leads to the edges through the index of names, and the rest
    is held against what that finds; only a pattern without any condition goes through all edges of its relation. Rows
    are ordered by the pattern's own order, then by their parts and eids, so that a limit always keeps the same; two
    edges of a path are different ones. Patterns that are not understood have no rows.
    """
    known = stored(told_apart(patterns))
    plain = edges.select("eid", "subject", "relation", "object")
    turned = plain.filter("subject <> object").select("eid", F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    sides = plain.withColumn("back", F.lit(False)).unionByName(turned.withColumn("back", F.lit(True)))
    # Each pattern's leading conditions, with the lower-cased names that they may mean.
    conditions = F.when(F.col("any"), F.col("conditions")).otherwise(F.slice("conditions", 1, 1))
    led = known.withColumn("lead", F.explode(conditions)).select("pattern_id", "hops", F.col("lead.place").alias("place"), F.col("lead.op").alias("op"), F.lower("lead.text").alias("phrase"))
    names = plain.select(F.lower("subject").alias("name")).union(plain.select(F.lower("object"))).distinct()
    held = led.filter("op = 'CONTAINS'").join(containing(names, led.filter("op = 'CONTAINS'").select("phrase")), "phrase")
    same = led.filter("op = '='").withColumn("name", F.col("phrase"))
    # An empty text is in every name.
    every = led.filter("op = 'CONTAINS' AND phrase = ''").select("pattern_id").distinct()
    found = held.select("pattern_id", "hops", "place", "name").union(same.select("pattern_id", "hops", "place", "name")).distinct()
    step = sides.select(F.col("eid").alias("e0"), F.col("subject").alias(FROM), F.col("relation").alias(RELATION), F.col("object").alias(TO), "back")
    end = plain.select(F.col("eid").alias("e1"), F.col("subject").alias("_mid"), F.col("relation").alias(SECOND), F.col("object").alias(LAST))
    columns = ("pattern_id", "e0", FROM, RELATION, TO, "back")
    starts = [found.filter(F.col("place") == place).join(step, F.col("name") == F.lower(place)).select(*columns) for place in (FROM, TO)]
    # A condition on the last node leads to second edges, and from there back to first ones.
    late = found.filter(F.col("place") == LAST).join(end, F.col("name") == F.lower(LAST)).select("pattern_id", "_mid").distinct()
    starts.append(late.join(step, F.col("_mid") == F.col(TO)).select(*columns))
    free = known.filter(F.size("conditions") == 0).select("pattern_id").union(every).distinct().join(known, "pattern_id")
    typed = free.filter("first IS NOT NULL").select("pattern_id", F.col("first").alias("_r")).join(step, F.col("_r") == F.col(RELATION)).select(*columns)
    untyped = free.filter("first IS NULL").select("pattern_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("_b")).join(step, F.col("_b") == F.col("back")).select(*columns)
    first = reduce(DataFrame.union, [*starts, typed, untyped]).distinct().join(known, "pattern_id")
    first = first.filter((F.col("first").isNull() | (F.col("first") == F.col(RELATION))) & (~F.col("back") | ~F.col("directed")))
    one = first.filter("hops = 1").select("*", *[F.lit(None).cast("string").alias(c) for c in ("e1", SECOND, LAST)])
    two = first.filter("hops = 2").join(end, (F.col(TO) == F.col("_mid")) & (F.col("e0") != F.col("e1")) & (F.col("second").isNull() | (F.col("second") == F.col(SECOND)))).drop("_mid")
    rows = one.unionByName(two)

    def value(part: Column) -> Column:
        return F.coalesce(*[F.when(part == p, F.col(p)) for p in (FROM, TO, LAST, RELATION, SECOND)])

    def holds(x: Column) -> Column:
        name = F.when(x["folded"], F.lower(value(x["place"]))).otherwise(value(x["place"]))
        return F.coalesce(F.when(x["op"] == "=", name == x["text"]).otherwise(name.contains(x["text"])), F.lit(False))

    kept = rows.filter(F.when(F.col("any"), F.exists("conditions", holds)).otherwise(F.forall("conditions", holds)))
    own = value(F.col("by"))
    order = Window.partitionBy("pattern_id").orderBy(F.when(~F.col("down"), own).asc_nulls_last(), F.when(F.col("down"), own).desc_nulls_last(), FROM, RELATION, TO, "e0", SECOND, LAST, "e1", "back")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("most"))
    row = F.map_from_entries(F.transform("items", lambda x: F.struct(x["name"].alias("key"), value(x["part"]).alias("value"))))
    return ranked.select("pattern_id", "rank", row.alias("row"))


def written(found: DataFrame) -> DataFrame:
    """results as the cascade takes them: question_id, entity, relationship, related_entity, rank, by the names of their
    columns; others are left out, and what a pattern does not show is null."""
    return found.select(F.col("pattern_id").alias("question_id"), *[F.col("row")[c].alias(c) for c in ("entity", "relationship", "related_entity")], "rank")
