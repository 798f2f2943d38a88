"""Versioned tables in a folder: state/v=N/{name}, and a CURRENT file that names the version in force.

A version is written whole before CURRENT moves, and CURRENT is replaced by one rename, so a job
that dies at any step leaves the former version or the new one in force. Each version records the
last batch that went into it, so a batch that comes again changes nothing. All files go through
Spark's file systems."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="walkgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows of df in the shared checkpoint folder, their lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class StateStore:
    """Tables by name, and small properties, in versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        at = self._of(f"{self.path}/CURRENT")
        if not self._fs.exists(at):
            return None
        return int(self.spark.read.text(at.toString()).first()[0])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version()}/{name}")

    def properties(self) -> dict[str, str]:
        if self.version() is None:
            return {}
        return {r["key"]: r["value"] for r in self.read("properties").collect()}

    def commit(self, tables: dict[str, DataFrame], properties: dict[str, str] | None = None, keep: int = 2) -> int:
        """Writes all tables as the next version, puts it in force, and drops versions older than the last `keep`."""
        now = self.version()
        new = 0 if now is None else now + 1
        at = f"{self.path}/v={new}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        pairs = sorted((self.properties() | (properties or {})).items())
        self.spark.createDataFrame(pairs, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{at}/properties")
        out = self._fs.create(self._of(f"{self.path}/CURRENT.tmp"), True)
        out.write(bytearray(str(new).encode()))
        out.close()
        self._switch(f"{self.path}/CURRENT.tmp", f"{self.path}/CURRENT")
        for old in range(new - keep, -1, -1):
            if not self._fs.delete(self._of(f"{self.path}/v={old}"), True):
                break
        return new

    def _switch(self, source: str, target: str) -> None:
        """Puts a file in another's place in one step."""
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(self._of(source)), self._fs.makeQualified(self._of(target)), how)
