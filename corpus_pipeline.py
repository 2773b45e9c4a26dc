"""A training corpus from raw documents: toxic texts go, one of each group of near copies stays, secrets are masked,
sources are mixed to their targets, and what remains is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import jaccard, mixing, pieces, secrets, toxicity
from groundwork.llm.common import cut, spread, table
from groundwork.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one column, so that nothing that an operator adds can clash with theirs, and the columns that it needs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, learnt from the labels of the tables, does not call toxic.

    Null and empty texts score as the model's bias says, which is below the threshold, and stay; very long ones are
    scored whole; repeated rows share one fate. An empty table stays empty; columns stay, whatever they are called.
    """
    told = toxicity.scored(_whole(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))
    return told.filter("predicted = 0").select("_whole.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies: the smallest id.

    Null and empty texts are copies of nothing: one row of each id stays. Rows without an id stay. Of repeated rows one
    stays. Very long texts are whole sets; an empty table stays empty; columns stay, whatever they are called.
    """
    return jaccard.first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text.

    Null texts stay null, with a null n_chars; empty ones stay empty; very long ones are masked whole. Repeated rows are
    masked alike, overlapping secrets as one. An empty table stays empty.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is drawn for its source.

    Null sources are one source, and null ids draw as one; null, empty and very long texts are rows like any other.
    Repeated rows draw the same number. An empty table stays empty.
    """
    return mixing.mix(_whole(docs, "doc_id", "source")).select("_whole.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, counted and hashed: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have the end id alone; very long ones are encoded whole; repeated rows each get their row. An
    empty table gives an empty one.
    """
    return pieces.encode_decode(docs.select("doc_id", "lang", "source", "text"), piece_model()).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]

#: SQL cannot express the model, the hashed draw in Spark's order of stages or the encoder: tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows are written to the shared checkpoint folder."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
