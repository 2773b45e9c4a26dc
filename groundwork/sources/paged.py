"""Paged documents as a data source: ``spark.read.format("paged")``, a row for each page, for batches and streams.

    spark.dataSource.register(PagedDocuments)
    spark.read.format("paged").option("parser", "my_module:MyParser").load("/shared/folder")

Files are read where Spark reads: each task opens its own. Small files share a task up to a budget of bytes, and a large one
is cut into ranges of pages, so one huge file is not one task. The folder must be seen under one path by the driver and
all executors; for stores that only Spark reaches there is ``files.read_documents``.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = "path string, page int, pages int, text string, error string"


class Parser(Protocol):
    """What reads one kind of files; made without arguments in each task."""

    def count(self, path: str) -> int:
        """The number of pages, without their texts."""

    def pages(self, path: str, first: int, last: int) -> Iterator[str]:
        """The texts of the pages from first up to, not including, last."""


class PdfParser:
    """PDF files, by whichever PDF library is installed."""

    @staticmethod
    def _open(path: str):
        try:
            from pypdf import PdfReader
        except ImportError:
            try:
                from PyPDF2 import PdfReader
            except ImportError as none:
                raise RuntimeError("no PDF library is installed") from none
        return PdfReader(path)

    def count(self, path: str) -> int:
        return len(self._open(path).pages)

    def pages(self, path: str, first: int, last: int) -> Iterator[str]:
        found = self._open(path).pages
        for k in range(first, last):
            yield found[k].extract_text() or ""


@dataclass
class Pages(InputPartition):
    """What one task reads: (path, pages of the file or -1 where they are not counted yet, first, last) of each piece."""

    pieces: list[tuple[str, int, int, int]]


def listed(folder: str, pattern: str) -> list[tuple[str, int, float]]:
    """path, size and time of the files below a folder, by path."""
    found = []
    for where, _, names in os.walk(folder):
        for name in names:
            if fnmatch(name, pattern):
                path = os.path.join(where, name)
                told = os.stat(path)
                found.append((path, told.st_size, told.st_mtime))
    return sorted(found)


def dealt(files: Sequence[tuple[str, int, float]], parser: Parser, budget: int) -> list[Pages]:
    """Files under the budget packed into tasks as they come; of larger ones, ranges of pages of about that many bytes.

    Only large files are opened here, to count their pages; one that cannot be opened is left to a task, which tells why.
    """
    tasks, pieces, held = [], [], 0
    for path, size, _ in files:
        if size > budget:
            try:
                n = parser.count(path)
            except Exception:
                n = -1
            step = max(1, n * budget // size)
            tasks += [Pages([(path, n, a, min(a + step, n))]) for a in range(0, n, step)] or [Pages([(path, -1, 0, -1)])]
            continue
        if pieces and held + size > budget:
            tasks.append(Pages(pieces))
            pieces, held = [], 0
        pieces.append((path, -1, 0, -1))
        held += size
    return [*tasks, Pages(pieces)] if pieces else tasks


def rows_of(pieces: Sequence[tuple[str, int, int, int]], parser: Parser) -> Iterator[tuple]:
    """A row for each page; for a file, or a range, that breaks, a row with the error after the pages before it."""
    for path, n, first, last in pieces:
        page = first
        try:
            if n < 0:
                n = last = parser.count(path)
            if not n:
                yield path, None, 0, "", None
            for text in parser.pages(path, first, last):
                yield path, page, n, text, None
                page += 1
        except Exception as e:  # a broken file is a row, not a failed job
            yield path, page, max(n, 0), None, f"{type(e).__name__}: {e}"


class _Options:
    def __init__(self, options: dict) -> None:
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.budget = int(options.get("bytes", 64 << 20))
        module, _, name = options.get("parser", f"{__name__}:PdfParser").partition(":")
        self.module, self.name = module, name

    def parser(self) -> Parser:
        return getattr(importlib.import_module(self.module), self.name)()


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return dealt(listed(self.folder, self.pattern), self.parser(), self.budget) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return rows_of(partition.pieces, self.parser())


class _StreamReader(_Options, DataSourceStreamReader):
    """Files that came after those already read, by time and path; tasks read them as a batch does."""

    def initialOffset(self) -> dict:
        return {"mtime": 0.0, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((t, p) for p, _, t in listed(self.folder, self.pattern)), default=(0.0, ""))
        return {"mtime": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = ((x["mtime"], x["path"]) for x in (start, end))
        found = [x for x in listed(self.folder, self.pattern) if first < (x[2], x[0]) <= last]
        return dealt(found, self.parser(), self.budget) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return rows_of(partition.pieces, self.parser())


class PagedDocuments(DataSource):
    """path, page (from 0), pages, text, error. Options: pattern, bytes (of a task), parser (module:class)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_pages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedDocuments)
    return spark.read.format("paged").options(**options).load(folder)


def documents_of(pages: DataFrame, separator: str = "\n\n", least: int = 100) -> DataFrame:
    """filename, filepath, total_pages, extracted_text, text_length, extraction_status and error_message of each file, put
    together from its pages; a file with a broken page is an error, one with under ``least`` characters a warning."""
    by = pages.groupBy(F.col("path").alias("filepath")).agg(F.max("pages").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("error").isNull() & F.col("page").isNotNull(), F.struct("page", "text")))).alias("_p"), F.min("error").alias("error_message"))
    bad = F.col("error_message").isNotNull()
    text = F.when(bad, "").otherwise(F.array_join(F.transform("_p", lambda x: x["text"]), separator))
    told = by.select(F.element_at(F.split("filepath", "/"), -1).alias("filename"), "filepath", F.when(bad, 0).otherwise(F.col("_n")).alias("total_pages"), text.alias("extracted_text"), "error_message")
    status = F.when(F.col("error_message").isNotNull(), "error").when(F.length("extracted_text") < least, "warning").otherwise("success")
    return told.select("filename", "filepath", "total_pages", "extracted_text", F.length("extracted_text").alias("text_length"), status.alias("extraction_status"), "error_message")
