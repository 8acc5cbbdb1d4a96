"""Translation memory on disk, laid out so that a lookup reads only where its keys can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "unit_key string, unit_text string, lang string, output string"
# Leading characters of a key that name its part: 16 to the power of this many parts at most.
PREFIX = 2


class Memory:
    """Rows of SCHEMA by part (a key's prefix) below one folder.

    ``delta`` holds what each batch added, by part and batch; ``base-N`` all that batches before N had added, one
    file for each part.  A batch overwrites its own folders, so a replayed one leaves the same
    rows.  Keys are hashes in hex, so parts are even; a lookup lists and reads the parts of its own keys only.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: int = PREFIX):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _part(self) -> Column:
        return F.substring("unit_key", 1, self.prefix)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _base(self, before: int | None = None) -> int | None:
        """The newest whole base that holds no batch from ``before`` on."""
        known = [int(n[5:]) for n in self._names(self.root) if n.startswith("base-")]
        whole = [n for n in known if (before is None or n <= before) and self._fs.exists(self._path(f"{self.root}/base-{n}/_SUCCESS"))]
        return max(whole, default=None)

    def _read(self, folder: str, parts: set[str] | None) -> DataFrame | None:
        there = [n for n in self._names(folder) if n.startswith("part=") and (parts is None or n[5:] in parts)]
        if not there:
            return None
        read = self.spark.read.schema(SCHEMA + ", epoch long, part string").option("basePath", folder)
        return read.parquet(*[f"{folder}/{n}" for n in there])

    def _rows(self, parts: set[str] | None, before: int | None) -> DataFrame:
        base = self._base(before)
        tables = []
        if base is not None and (old := self._read(f"{self.root}/base-{base}", parts)) is not None:
            tables.append(old.drop("epoch", "part"))
        if (new := self._read(f"{self.root}/delta", parts)) is not None:
            recent = new.filter(F.col("epoch") >= base) if base is not None else new
            recent = recent.filter(F.col("epoch") < before) if before is not None else recent
            tables.append(recent.drop("epoch", "part"))
        out = tables[0] if tables else self.spark.createDataFrame([], SCHEMA)
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, optionally as they were before a batch."""
        return self._rows(None, before)

    def near(self, units: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of all parts that keys of ``units`` belong to: at most 16 ** prefix names come to the driver."""
        parts = {r[0] for r in units.select(self._part()).distinct().collect()}
        return self._rows(parts, before)

    def add(self, rows: DataFrame, epoch: int) -> None:
        """What a batch has learned, one file for each part it touches; what an earlier try of the batch wrote goes."""
        told = rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]).withColumn("part", self._part()).withColumn("epoch", F.lit(epoch).cast("long"))
        writer = told.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part", "epoch").parquet(f"{self.root}/delta")

    def compact(self, before: int) -> None:
        """Writes all rows of batches before ``before`` as a new base, then drops the folders it replaces.

        Readers take the new base only when it is whole; a run that is lost halfway leaves the old state.  No batch
        before ``before`` may be replayed any more.
        """
        old = self._base()
        base = f"{self.root}/base-{before}"
        rows = self._rows(None, before).withColumn("part", self._part())
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(base)
        if old is not None and old < before:
            self._fs.delete(self._path(f"{self.root}/base-{old}"), True)
        for part in self._names(f"{self.root}/delta"):
            for epoch in self._names(f"{self.root}/delta/{part}"):
                if epoch.startswith("epoch=") and int(epoch[6:]) < before:
                    self._fs.delete(self._path(f"{self.root}/delta/{part}/{epoch}"), True)
            if part.startswith("part=") and not self._names(f"{self.root}/delta/{part}"):
                self._fs.delete(self._path(f"{self.root}/delta/{part}"), True)
