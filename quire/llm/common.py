"""What the training-data operators share: tables, shared storage, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows, and bytes of them as JSON, up to which a side may be broadcast; beyond either the shuffle join runs.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


#: Rows that Spark hands to Python at once; its default of 10,000 whole texts takes much memory.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Spark's default for rows at once, where nobody has set another, gives way to ARROW_ROWS."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix="quire-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. A local temporary folder is used in local mode only, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return _temporary(spark.sparkContext.applicationId)


#: Folders that `staged` has written within the innermost `cleared`; each thread has its own.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder, parted by a column if asked for, and read it back: cuts lineage and survives lost
    executors. The files stay until `cleared` deletes them, or whoever owns the folder does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (within := _STAGED.get()) is not None:
        within.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside by this thread, but for the last, which is the result; after an error the last too.
    Blocks may be nested: the outer one takes the inner ones' results."""
    outer, mine, kept = _STAGED.get(), [], None
    token = _STAGED.set(mine)
    try:
        yield
        kept = mine[-1] if mine else None
    finally:
        _STAGED.reset(token)
        for path in mine:
            if path != kept:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if outer is not None and kept:
            outer.append(kept)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has few rows of few bytes, else as it is. df should be staged, so that both are
    cheap to learn; bytes are summed only where rows are few."""
    if df.count() > rows:
        return df
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= size else df


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """Word to id, in the order of first sight; reading an unknown word gives it the next id."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def ids(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def slices(parts: Iterable, rows: int = 500) -> Iterable:
    """The rows of pandas frames, a few at a time: what is made from a frame at once stays small."""
    for part in parts:
        for at in range(0, len(part), rows):
            yield part.iloc[at : at + rows]


def split_words(texts: Iterable[str | None], lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """UTF-8 words between ASCII white space of all texts in one list, and each text's number of them."""
    flat: list[bytes] = []
    sizes = []
    for t in texts:
        words = (t.encode("utf-8", "surrogatepass").lower() if lower else t.encode("utf-8", "surrogatepass")).split() if isinstance(t, str) else []
        flat += words
        sizes.append(len(words))
    return flat, np.array(sizes, dtype=np.int64)
