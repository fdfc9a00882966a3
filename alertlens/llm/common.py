"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.session import ensure_checkpoint_dir, scratch_path

#: Rows and bytes of one Arrow batch: a batch of long texts must fit beside the JVM heap.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20

_CUT = re.compile(r"[ \n]")
_CUT_BYTES = re.compile(rb"[ \n]")


def prepare(spark: SparkSession) -> None:
    """Session settings that every operator here relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir and read it back: the lineage ends
    there, so a lost executor only re-reads files."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text, the key of the fixed train / held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only at a blank or line
    end, so that words stay whole and memory is bounded for a text of any length."""
    if len(text) <= size:
        yield text
        return
    start = 0
    while start < len(text):
        found = _CUT.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def byte_slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The same for UTF-8 bytes."""
    if len(data) <= size:
        yield data
        return
    start = 0
    while start < len(data):
        found = _CUT_BYTES.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end


class Memo(dict):
    """word -> value, computed once and forgotten wholesale beyond ``limit`` words
    (a bound on memory only: values are recomputed when needed again)."""

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


HOT = 200


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner", n: str = "n") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``n`` how many of the
    ``total`` rows of ``left`` hold that key. The rows of ``right`` for keys of over a HOT-th
    of these, fewer than HOT, are broadcast; the other keys meet in a shuffle. ``how``: inner or left."""
    hot = right.filter(F.col(n) * HOT > total)
    if hot.isEmpty():
        return left.join(right, keys, how)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = rest.join(right.filter(F.col(n) * HOT <= total), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; the count is a per-task partial sum."""
    return df.count() <= rows
