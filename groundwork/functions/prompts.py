"""Prompts and contexts as text: formats of training records, graph evidence and text evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The system line and the two formats of a training record ({0} instruction, {1} input, {2} output).
SYSTEM = "You are a climate science assistant. Avoid hallucinations. If unsure, say you don't know."
FORMATS = {
    "tagged": "<|system|>\n" + SYSTEM + "\n\n<|user|>\n%s\nQuestion: %s\n\n<|assistant|>\n%s",
    "headed": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n" + SYSTEM + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n%s\nQuestion: %s<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n%s<|eot_id|>",
}
SCHEMA_HEAD = " **Knowledge Graph Schema**\n\n**Statistics:**"
SCHEMA_ENTITIES, SCHEMA_EDGES = "\n- Total entities: ", "\n- Total relationships: "
SCHEMA_RELATIONS, SCHEMA_TYPES = "\n\n**Available Relationship Types:**", "\n**Entity Types (with examples):**"
NO_GRAPH, NO_TEXT = "No knowledge graph matches.", "[No text chunks retrieved]"


def training_text(style: str, instruction: Column, question: Column, answer: Column) -> Column:
    return F.format_string(FORMATS[style], instruction, question, answer)


def _ordered(line: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])


def graph_context(entities: DataFrame, triples: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, context: entities, then relationships, as a prompt lists them; a fixed line where there are none."""
    e = entities.groupBy("question_id").agg(_ordered(F.concat(F.lit("  - "), F.col("text"), F.lit(" ("), F.col("canonical_label"), F.lit(")"))).alias("_e"))
    t = triples.groupBy("question_id").agg(_ordered(F.concat(F.lit("  - "), F.col("subject"), F.lit(" --["), F.col("relation"), F.lit("]--> "), F.col("object"))).alias("_t"))
    both = questions.select("question_id").join(e, "question_id", "left").join(t, "question_id", "left")
    parts = F.concat_ws("\n", F.when(F.size("_e") > 0, F.concat(F.lit("**Entities:**\n"), F.array_join("_e", "\n"))), F.when(F.size("_t") > 0, F.concat(F.lit("\n**Relationships:**\n"), F.array_join("_t", "\n"))))
    return both.select("question_id", F.when(parts == "", F.lit(NO_GRAPH)).otherwise(parts).alias("context"))


def text_context(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, context: texts by rank with their sources."""
    line = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" from "), F.coalesce("source", F.lit("unknown")), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    c = chunks.groupBy("question_id").agg(F.array_join(_ordered(line), "\n").alias("context"))
    return questions.select("question_id").join(c, "question_id", "left").select("question_id", F.coalesce("context", F.lit(NO_TEXT)).alias("context"))


def schema_text(counts: DataFrame, relations: DataFrame, samples: DataFrame, types: DataFrame) -> DataFrame:
    """schema: one text that tells a model what the graph holds.

    counts: node_count, rel_count (one row). relations: relation, one row each, a vocabulary. samples: relation, rank,
    subject, object; the first two of a relation are shown. types: label, examples (three names, divided by |); the
    first 15 by label are shown.
    """
    shown = F.concat(F.lit("    Example: '"), F.col("subject"), F.lit("' -"), F.col("relation"), F.lit("-> '"), F.col("object"), F.lit("'"))
    by = samples.filter("rank <= 2").groupBy("relation").agg(_ordered(shown).alias("_s"))
    line = F.concat_ws("\n", F.concat(F.lit("  - "), F.col("relation")), F.array_join("_s", "\n"))
    known = F.when(F.size("_s") > 0, line).otherwise(F.concat(F.lit("  - "), F.col("relation")))
    one = relations.join(by, "relation", "left").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("relation", known.alias("l")))), lambda x: x["l"]), "\n").alias("_r"))
    names = F.concat(F.lit("'"), F.array_join(F.slice(F.split("examples", r"\|"), 1, 3), "', '"), F.lit("'"))
    two = types.agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("label", F.concat(F.lit("  - "), F.col("label"), F.lit(": "), names).alias("l")))), 1, 15), lambda x: x["l"]), "\n").alias("_t"))
    head = F.concat(F.lit(SCHEMA_HEAD), F.lit(SCHEMA_ENTITIES), F.format_number("node_count", 0), F.lit(SCHEMA_EDGES), F.format_number("rel_count", 0), F.lit(SCHEMA_RELATIONS))
    return counts.join(F.broadcast(one)).join(F.broadcast(two)).select(F.concat_ws("\n", head, F.nullif("_r", F.lit("")), F.lit(SCHEMA_TYPES), F.nullif("_t", F.lit(""))).alias("schema"))
