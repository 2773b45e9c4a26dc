"""What several operators of this subpackage share: tables, the shared folder, blobs dealt by number, hashed words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries that a worker's memo of hashed words may hold; further words are hashed each time.
MEMO_ENTRIES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df dealt over all cores, where its few files would keep only some of them busy; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, also set as checkpoint folder.

    It is read from ``spark.checkpoint.dir``. Where that is unset, one is made here if all of Spark runs in one process
    (tests); on a cluster a folder of this machine would be no use to the others, so that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="groundwork-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and go on from there: its lineage ends, and lost executors lose nothing.

    A written table is computed once, where checkpoint() computes its last stage twice. ``release`` removes it.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._groundwork_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove tables that ``cut`` wrote and that nothing is read from any more."""
    for df in tables:
        if df is not None and (path := df.__dict__.pop("_groundwork_path", None)):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df, worked on by fewer tasks where it has so few rows that most tasks would have nothing to do; else as it is."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return df.coalesce(tasks) if tasks < partitions(spark) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int, text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of some rows or about ``most`` bytes of text, so that memory is bounded by that or by one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.array([0 if not x.is_valid else x.as_buffer().size for x in column], dtype=np.int64)
        begin, held = 0, 0
        for i, n in enumerate(size):
            if i > begin and (held + n > most or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def give_back() -> None:
    """Hand memory that was freed in this process to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what it has freed: workers live on, and would keep it through later stages."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class HashedWords(dict):
    """Word (bytes) to its 64-bit hash; remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_ENTRIES:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit integers: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def without_clashes(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns that an operator is about to add (in any letter case)."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
