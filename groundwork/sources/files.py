"""Files in and out: documents, JSON of records or of one object, cached indexes, checkpointed results."""

from __future__ import annotations

import errno
import io
import json
import re
import shutil
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from groundwork.sources.shared import stored

# Fixed value: how a model is asked to finish an answer.
CONTINUE = "{prompt}\n\nCurrent answer:\n{answer}\n\nContinue the answer with only the next short fragment to complete the sentence."

DOCUMENT = "filename string, filepath string, total_pages int, extracted_text string, text_length int, extraction_status string, error_message string"


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page, by whichever PDF library is installed; without one, an error that becomes the row's status."""
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            from PyPDF2 import PdfReader
        except ImportError as none:
            raise RuntimeError("no PDF library is installed") from none
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", pages: Callable[[bytes], list[str]] = pdf_pages, separator: str = "\n\n", least: int = 100) -> DataFrame:
    """One row for each file: its text, and success, warning (under ``least`` characters) or error with its message."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = pages(bytes(content))
                    text = separator.join(found)
                    rows.append((Path(path).name, path, len(found), text, len(text), "warning" if len(text) < least else "success", None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((Path(path).name, path, 0, "", 0, "error", str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT.split(", ")])

    return files.mapInPandas(run, DOCUMENT)


def usable(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("extraction_status").isin("success", "warning"))


def read_records(spark: SparkSession, path: str, schema: str | S.StructType) -> DataFrame:
    """A JSON file that holds a list of records. A file that holds anything else is refused."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).distinct().collect()
    if any(r["c"] != "[" for r in first):
        raise ValueError(f"{path} does not hold a list")
    return spark.read.schema(schema).json(path, multiLine=True)


def read_list_or_object(spark: SparkSession, path: str, element: str, keys: Sequence[str] = ("chunks", "entities", "triples")) -> DataFrame:
    """Records of a JSON file that is a list, or an object with the list under one of the keys."""
    body = F.col("value")
    inner = F.coalesce(F.when(F.ltrim(body).startswith("["), body), *[F.get_json_object(body, f"$.{k}") for k in keys])
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(inner, f"array<{element}>")).alias("r")).select("r.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """canonical_label of a JSON object's list canonical_labels; missing or empty is an error."""
    rows = spark.read.schema("canonical_labels array<string>").json(path, multiLine=True).select(F.explode("canonical_labels").alias("canonical_label"))
    if rows.isEmpty():
        raise ValueError(f"{path} holds no canonical labels")
    return rows


def write_records(rows: DataFrame, path: str, kind: str = "json") -> None:
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(kind).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A stored table if there is one, else what build gives, stored: the relation matrix, say."""
    if rebuild or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, folder: str, model: str, pattern: str = "*") -> DataFrame:
    """path, length, mtime, model: a row for each input file, without reading what is in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("mtime"), F.lit(model).alias("model"))


def cached_index(spark: SparkSession, folder: str, model: str, cache: str, build: Callable[[DataFrame], DataFrame], pattern: str = "*") -> DataFrame:
    """The index of a folder's files, brought up to date: only files that are new or have changed are built again.

    ``build`` makes index rows (with the column ``path``) of some files (path, length, mtime, model). A file counts as
    unchanged if name, size, time and model are as they were; rows of files that are gone go. Index and manifest are
    written to a new version of the cache, and a version counts once both stand; older ones but the last are removed. A
    run that breaks off leaves the version before in use. Where the cache cannot be written for lack of room, the index
    is used without it. An empty folder gives an empty index.
    """
    keys = ["path", "length", "mtime", "model"]
    now = manifest(spark, folder, model, pattern)
    versions = sorted(v for v in _children(spark, cache) if v.isdigit() and exists(spark, f"{cache}/{v}/index/_SUCCESS") and exists(spark, f"{cache}/{v}/manifest/_SUCCESS"))
    if not versions:
        index, changed = build(now), now
    else:
        last = f"{cache}/{versions[-1]}"
        before, old = spark.read.parquet(f"{last}/manifest"), spark.read.parquet(f"{last}/index")
        changed, gone = now.join(before, keys, "left_anti"), before.join(now, keys, "left_anti")
        if changed.isEmpty() and gone.isEmpty():
            return old
        kept = old.join(now.join(before, keys, "left_semi").select("path"), "path", "left_semi")
        index = kept.select(*old.columns).unionByName(build(changed).select(*old.columns))
    new = f"{cache}/{int(versions[-1]) + 1 if versions else 1:08d}"
    try:
        now.write.mode("overwrite").parquet(f"{new}/manifest")
        index.write.mode("overwrite").parquet(f"{new}/index")
    except Exception as e:
        if not re_quota(e):
            raise
        return index
    for v in versions[:-1]:
        _remove(spark, f"{cache}/{v}")
    return spark.read.parquet(f"{new}/index")


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def re_quota(e: BaseException) -> bool:
    """Whether an error says that a disk or a quota is full."""
    return getattr(e, "errno", None) in (errno.EDQUOT, errno.ENOSPC) or any(x in str(e) for x in ("Disk quota exceeded", "No space left on device"))


def write_with_fallback(rows: DataFrame, path: str, fallback: str) -> str:
    """Written to path, or to the fallback where path has no room; the place it went to."""
    try:
        rows.write.mode("overwrite").parquet(path)
        return path
    except Exception as e:
        if not re_quota(e):
            raise
        rows.write.mode("overwrite").parquet(fallback)
        return fallback


def write_every(rows: DataFrame, path: str, every: int = 1000, work: Callable[[DataFrame], DataFrame] | None = None, files: int = 1) -> DataFrame:
    """What ``work`` (a model's calls, say) makes of rows, saved after every so many rows; the saved table.

    The rows are first written as they are, in files of ``every`` rows. A stream then takes so many files at a time,
    works on them and commits what comes out before it takes more. A run that was broken off goes on behind the last
    commit when it is called again with the same path: rows that are committed are not worked on again, and each row is
    in the table once. Once all is saved, a further call does nothing. With more ``files`` more tasks work at a time.
    """
    spark = rows.sparkSession
    if not exists(spark, f"{path}/input/_SUCCESS"):
        rows.write.mode("overwrite").option("maxRecordsPerFile", every).parquet(f"{path}/input")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/input")
    done = work(source) if work else source
    query = done.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/commits").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], done.schema)


def safe_rows(spark: SparkSession, spec: str | None, run: Callable[[str], DataFrame], schema: str) -> DataFrame:
    """run(spec); no rows, in the same schema, where the spec has under ten characters, cannot be understood or fails.

    The rows are worked out here, into a table, so that an error of the run is met as well as one of the analysis.
    """
    if spec and len(spec.strip()) >= 10:
        try:
            found = run(spec)
            return stored(found.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema]))
        except (PySparkException, Py4JJavaError):
            pass
    return spark.createDataFrame([], schema)


def http_client(url: str, headers: dict[str, str] | None = None, timeout: float = 30.0, tries: int = 3, wait: float = 1.0, body: Callable[[str], dict] | None = None, read: Callable[[dict], str] | None = None) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A client for ``generate``: posts each prompt as JSON and reads the answer, with a timeout and some tries.

    By default a chat request with one message of the user, answered by choices[0].message.content.
    """
    ask = body or (lambda prompt: {"messages": [{"role": "user", "content": prompt}]})
    told = read or (lambda reply: reply["choices"][0]["message"]["content"])

    def connect() -> Callable[[list[str]], list[str]]:
        import time
        import urllib.request

        def one(prompt: str) -> str:
            for k in range(tries):
                try:
                    request = urllib.request.Request(url, json.dumps(ask(prompt)).encode(), {"Content-Type": "application/json", **(headers or {})})
                    with urllib.request.urlopen(request, timeout=timeout) as reply:
                        return told(json.load(reply))
                except OSError as e:
                    # What the client asked wrongly stays wrong; only time-outs and too many requests are worth another try.
                    if k == tries - 1 or (400 <= getattr(e, "code", 0) < 500 and e.code not in (408, 429)):
                        raise
                    time.sleep(wait * 2**k)
            raise ValueError("no tries")

        return lambda prompts: [one(p) for p in prompts]

    return connect


def continued(rows: DataFrame, client: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", answer: str = "answer", rounds: int = 2, most: int = 90) -> DataFrame:
    """rows whose answers, where they break off inside a sentence, a model has gone on with for some rounds.

    It ends when the sentence does, when nothing more comes, or beyond so many words. Null and empty answers stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, done = client(), re.compile(r"""[.!?]["')\]]*\s*$""")
        for part in batches:
            now = part[answer].tolist()
            open_ = [k for k, x in enumerate(now) if x and not done.search(x.strip())]
            for k in open_:
                now[k] = now[k].strip()
            for _ in range(rounds):
                if not open_:
                    break
                more = ask([CONTINUE.format(prompt=part[prompt].iloc[k], answer=now[k]) for k in open_])
                left = []
                for k, x in zip(open_, more, strict=True):
                    if x and x.strip():
                        now[k] = f"{now[k]} {x.strip()}".strip()
                        if len(now[k].split()) <= most and not done.search(now[k]):
                            left.append(k)
                open_ = left
            yield part.assign(**{answer: now})

    return rows.mapInPandas(run, rows.schema)


def preflight(spark: SparkSession, inputs: Sequence[str], room: dict[str, int] | None = None) -> list[str]:
    """What is wrong before a job starts: inputs that are missing, local folders with too few free bytes."""
    wrong = [f"missing: {p}" for p in inputs if not exists(spark, p)]
    for folder, need in (room or {}).items():
        if (free := shutil.disk_usage(folder).free) < need:
            wrong.append(f"{folder}: {free} bytes free, {need} needed")
    return wrong


def generate(rows: DataFrame, client: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", answer: str = "answer", batch: int = 16) -> DataFrame:
    """rows with a model's answers and an error column. ``client`` makes one model or connection for each partition.

    A batch that fails gives null answers and the error's text, so one bad call does not fail the job.
    """
    schema = S.StructType([*rows.schema.fields, S.StructField(answer, S.StringType()), S.StructField("error", S.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for part in batches:
            told: list[str | None] = []
            errors: list[str | None] = []
            for a in range(0, len(part), batch):
                asked = part[prompt].iloc[a : a + batch].tolist()
                try:
                    told += ask(asked)
                    errors += [None] * len(asked)
                except Exception as e:
                    told += [None] * len(asked)
                    errors += [str(e)] * len(asked)
            yield part.assign(**{answer: told, "error": errors})

    return rows.mapInPandas(run, schema)
