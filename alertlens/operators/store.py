"""The stored mart: immutable folders, and one small manifest that says which of them count.

    path/data/version=<id>/year_creation=<y>/*.parquet   written once, never changed
    path/ledger/version=<id>/*.parquet                   input files that a delta counted
    path/_manifests/<number>.json                        the highest number is the mart

A change writes fresh folders first and then a manifest under the next number (a temporary
file, renamed), so a reader sees the mart before the change or after it, and a job killed on
the way leaves the old one whole. A year may have several folders: a full build and the
deltas of later arrivals, whose counts add up (``load``), until ``compact`` makes one of them.
Two writers that start from one manifest can't both win: the second finds the number
taken, reads the new manifest and applies its change again. ``vacuum`` removes what no recent
manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

MART_COLUMNS = ("year_creation", "mth_creation", "dt_creation", "NAME", "Count")
MART_SCHEMA = StructType([
    StructField("year_creation", IntegerType(), True),
    StructField("mth_creation", IntegerType(), True),
    StructField("dt_creation", DateType(), True),
    StructField("NAME", StringType(), True),
    StructField("Count", LongType(), False),
])
_STORED = StructType([*MART_SCHEMA.fields, StructField("version", StringType(), True)])
_YEAR = "year_creation="


class ConflictError(RuntimeError):
    """Another writer changed the mart in a way that this change can't be added to."""


def _canonical(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in MART_SCHEMA.fields}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in MART_COLUMNS])


def added_up(mart: DataFrame) -> DataFrame:
    """Rows of one day and name become one, their counts added."""
    keys = [c for c in MART_COLUMNS if c != "Count"]
    return mart.groupBy(*keys).agg(F.sum("Count").cast("bigint").alias("Count"))


class MartStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files ----------------------------------------------------------------------

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json")]

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"_manifests/{number:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # -- manifests --------------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._numbers())

    def manifest(self) -> dict:
        """number; years: folder names by year; ledger: its folders; streams: last batch by stream."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {"number": 0, "years": {}, "ledger": [], "streams": {}}

    def commit(self, change: Callable[[dict], dict | None], tries: int = 20) -> bool:
        """Apply ``change`` to the newest manifest and publish the result as the next one;
        None publishes nothing. Whoever loses a race begins again from the winner's."""
        for _ in range(tries):
            new = change(self.manifest())
            if new is None:
                return False
            new["number"] += 1
            temporary = self._at(f"_manifests/.{uuid.uuid4().hex}.tmp")
            final = self._at(f"_manifests/{new['number']:010d}.json")
            out = self._fs.create(temporary, False)
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
            out.close()
            if not self._fs.exists(final) and self._fs.rename(temporary, final):
                return True
            self._fs.delete(temporary, False)
        raise ConflictError(f"{self.path}: other writers won {tries} times")

    # -- writing ----------------------------------------------------------------------

    def _write(self, mart: DataFrame) -> dict[str, str]:
        """Fresh folders of the rows, by year. One shuffle by year gives one file a year instead
        of one for each task; a year too large for one task is split (rebalance)."""
        version = f"version={uuid.uuid4().hex[:16]}"
        (_canonical(mart).hint("rebalance", "year_creation").write.partitionBy("year_creation")
         .parquet(f"{self.path}/data/{version}"))
        return {n[len(_YEAR):]: f"{version}/{n}" for n in self._names(f"data/{version}") if n.startswith(_YEAR)}

    def publish(self, mart: DataFrame) -> None:
        """``mart`` is the whole mart from now on."""
        years = {y: [f] for y, f in self._write(mart).items()}
        self.commit(lambda m: {**m, "years": years, "ledger": [], "streams": {}})

    def replace_years(self, mart: DataFrame, years: Iterable[int]) -> None:
        """``mart`` holds all that counts in ``years``; a year without rows goes."""
        fresh, asked = self._write(mart), {str(y) for y in years}
        if set(fresh) - asked:
            raise ValueError(f"rows of other years than {sorted(asked)}: {sorted(set(fresh) - asked)}")
        self.commit(lambda m: {**m, "years": {y: f for y, f in m["years"].items() if y not in asked}
                               | {y: [f] for y, f in fresh.items()}})

    def append(self, delta: DataFrame, files: list[str] | None = None, stream: str | None = None,
               batch_id: int | None = None) -> bool:
        """Add ``delta``'s counts to the mart, once. ``files`` are the inputs that it counted,
        entered in the ledger; a stream's batch is added only after its predecessors, and
        a second time not at all. Returns whether anything was added."""
        seen = self.manifest()
        if stream is not None and seen["streams"].get(stream, -1) >= batch_id:
            return False
        fresh, ledger = self._write(delta), None
        if files:
            ledger = f"version={uuid.uuid4().hex[:16]}"
            self.spark.createDataFrame([(f,) for f in files], "file string").write.parquet(f"{self.path}/ledger/{ledger}")

        def change(m: dict) -> dict | None:
            if stream is not None and m["streams"].get(stream, -1) >= batch_id:
                return None
            if files and m["ledger"] != seen["ledger"]:
                raise ConflictError(f"{self.path}: another job absorbed files meanwhile; run again")
            years = dict(m["years"])
            for y, f in fresh.items():
                years[y] = [*years.get(y, []), f]
            streams = m["streams"] if stream is None else {**m["streams"], stream: batch_id}
            return {**m, "years": years, "streams": streams, "ledger": [*m["ledger"], *([ledger] if ledger else [])]}

        return self.commit(change)

    def new_files(self, files: list[str]) -> list[str]:
        """Those of ``files`` that the ledger doesn't hold."""
        ledger = self.manifest()["ledger"]
        asked = self.spark.createDataFrame([(f,) for f in files], "file string").distinct()
        if ledger:
            known = self.spark.read.schema("file string").parquet(*[f"{self.path}/ledger/{v}" for v in ledger])
            asked = asked.join(known, "file", "left_anti")
        return sorted(r["file"] for r in asked.collect())  # names of files just listed

    def compact(self, most: int = 1) -> list[str]:
        """Years with over ``most`` folders get a single one; returns them."""
        seen = self.manifest()
        years = sorted(y for y, f in seen["years"].items() if len(f) > most)
        if not years:
            return []
        fresh = self._write(self._rows({y: seen["years"][y] for y in years}))

        def change(m: dict) -> dict:
            after = dict(m["years"])
            for y in years:
                old = seen["years"][y]
                if after.get(y, [])[: len(old)] != old:
                    raise ConflictError(f"{self.path}: year {y} was replaced meanwhile; run again")
                after[y] = [fresh[y], *after[y][len(old):]]  # deltas that came meanwhile stay
            return {**m, "years": after}

        self.commit(change)
        return years

    def vacuum(self, keep: int = 3, older_than_hours: float = 24.0) -> int:
        """Delete manifests but for the last ``keep``, and folders that none of these names and that
        are older than any write or read under way can be. Returns the folders deleted."""
        numbers = self._numbers()
        kept = [self._read(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"_manifests/{n:010d}.json"), False)
        used = {f.split("/")[0] for m in kept for fs in m["years"].values() for f in fs} | {v for m in kept for v in m["ledger"]}
        before, gone = (time.time() - older_than_hours * 3600) * 1000, 0
        for folder in ("data", "ledger"):
            for name in self._names(folder):
                at = self._at(f"{folder}/{name}")
                if name not in used and self._fs.getFileStatus(at).getModificationTime() <= before:
                    gone += bool(self._fs.delete(at, True))
        return gone

    # -- reading ------------------------------------------------------------------------

    def _rows(self, years: dict[str, list[str]]) -> DataFrame:
        """The rows of the years' folders; a year of several folders is added up."""
        base = f"{self.path}/data"

        def read(folders: list[str]) -> DataFrame:
            return _canonical(self.spark.read.schema(_STORED).option("basePath", base)
                              .parquet(*[f"{base}/{f}" for f in folders]))

        single = [f[0] for f in years.values() if len(f) == 1]
        several = [x for f in years.values() if len(f) > 1 for x in f]
        if not several:
            return read(single) if single else self.spark.createDataFrame([], MART_SCHEMA)
        summed = added_up(read(several))
        return read(single).unionByName(summed) if single else summed

    def load(self) -> DataFrame:
        """The mart of the newest manifest, in canonical columns. It stays as it is, whatever is
        published later, until ``vacuum`` removes its folders."""
        return self._rows(self.manifest()["years"])


def listed_files(df: DataFrame) -> list[str]:
    """The files that a scan would read, as paths that a reader takes."""
    return sorted(unquote(f) for f in df.inputFiles())
