"""Tables that change while others read them: versions with a pointer, and change logs that are compacted.

A folder's pointer is a small file that names the version to read. It is written beside and renamed over the old one, so that a reader
finds either the old version or the new one, whole, whenever the writer stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER = "_CURRENT"  # an underscore hides it from readers of the folder


class Folder:
    """A folder of the file system that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """What the folder holds; nothing if it is not there."""
        if not self._fs.exists(self._at()):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at()))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def pointer(self) -> str | None:
        """The version that readers take, if there is one."""
        if not self._fs.exists(self._at(POINTER)):
            return None
        stream = self._fs.open(self._at(POINTER))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def point_to(self, version: str) -> None:
        """Make ``version`` the one that readers take, in one step."""
        fresh = f"{POINTER}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(fresh), False)
        stream.writeUTF(version)
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        how = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
        how[0] = getattr(options, "Rename").OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        context.rename(context.makeQualified(self._at(fresh)), context.makeQualified(self._at(POINTER)), how)


def replace(df: DataFrame, path: str) -> None:
    """Write ``df``, which may read the table it replaces, as the next version of ``path``, and make it the current one.

    The version before stays for those who read it; older ones go.
    """
    folder = Folder(df.sparkSession, path)
    now = folder.pointer()
    after = f"v{int(now[1:]) + 1}" if now else "v0"
    df.write.mode("overwrite").parquet(f"{folder.path}/{after}")
    folder.point_to(after)
    for name in folder.names():
        if name.startswith("v") and name not in (now, after):
            folder.delete(name)


def current_path(spark: SparkSession, path: str) -> str:
    """Where the table's current version is: the folder itself, if it has no versions."""
    version = Folder(spark, path).pointer()
    return f"{path}/{version}" if version else path


class ChangeLog:
    """A table kept by key out of batches of changed rows: a snapshot, the batches after it, and a pointer to the snapshot.

    Each batch is a folder named after its number, so one that runs again replaces itself. Every ``every`` batches, the newest row of each
    key is written as a snapshot named after the last batch in it; then the pointer moves. A writer that stops between leaves the old
    snapshot and its batches in force. What the snapshot before needs is kept until the next one, for those who still read it. So readers
    take at most one snapshot and ``every`` batches, plus batches after a stop.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], every: int = 16):
        self.spark, self.schema, self.keys, self.every = spark, schema, list(keys), every
        self.folder = Folder(spark, path)

    def store(self, changes: DataFrame, batch: int) -> None:
        """One batch: at most one row of each key. Batches come in order; the last one may come again."""
        changes.write.mode("overwrite").parquet(f"{self.folder.path}/batch={batch}")
        if batch - self._snapshot() >= self.every:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        old = self._snapshot()
        if batch <= old:  # a batch that is already part of a snapshot
            return
        self.rows(batch).write.mode("overwrite").parquet(f"{self.folder.path}/snapshot={batch}")
        self.folder.point_to(str(batch))
        for name in self.folder.names():
            kind, _, number = name.partition("=")
            if (kind == "batch" and int(number) <= old) or (kind == "snapshot" and int(number) < old):
                self.folder.delete(name)

    def parts(self, upto: int | None = None) -> list[str]:
        """The folders that make up the table: the snapshot and the batches after it."""
        first = self._snapshot()
        batches = sorted(int(n.partition("=")[2]) for n in self.folder.names() if n.startswith("batch="))
        new = [f"batch={b}" for b in batches if b > first and (upto is None or b <= upto)]
        return ([f"snapshot={first}"] if first >= 0 else []) + new

    def rows(self, upto: int | None = None) -> DataFrame:
        """The newest row of each key; without any batch, no rows."""
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{name}").withColumn(
            "_batch", F.lit(int(name.partition("=")[2]))) for name in self.parts(upto)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        rest = [c for c in every.columns if c not in (*self.keys, "_batch")]
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_new"))
        return newest.select(*self.keys, "_new.*")

    def _snapshot(self) -> int:
        at = self.folder.pointer()
        return -1 if at is None else int(at)
