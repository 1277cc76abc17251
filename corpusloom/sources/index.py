"""The derived index on storage: versions that readers see all at once.

A version is a folder, of one table or of several named parts; a small manifest
names the current one.  Writers fill a new folder and then replace the manifest,
so a reader has either the old state or the new one, and a failed write leaves
the old one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import apply_changes


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def version(self) -> str | None:
        """The current version's folder; null before the first write."""
        manifest = self._at("CURRENT")
        if not self._fs.exists(manifest):
            return None
        stream = self._fs.open(manifest)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def folder(self, version: str, part: str = "") -> str:
        return f"{self.path}/{version}/{part}" if part else f"{self.path}/{version}"

    def read(self, part: str = "", version: str | None = None) -> DataFrame:
        """A part of a version, by default of the current one."""
        if (v := version or self.version) is None:
            raise FileNotFoundError(f"no version at {self.path}")
        return self.spark.read.parquet(self.folder(v, part))

    def draft(self) -> Draft:
        return Draft(self, self.version, f"v-{uuid.uuid4().hex}")

    def replace(self, rows: DataFrame) -> str:
        """Write a whole new version and make it the current one."""
        draft = self.draft()
        draft.put("", rows)
        return draft.commit()

    def _marker(self, base: str | None):
        return self._at(f"after-{base or 'nothing'}")

    def claim(self, base: str | None, name: str) -> bool:
        """Take the place behind a version; false if it is taken."""
        try:
            out = self._fs.create(self._marker(base), False)
        except Exception:
            if self._fs.exists(self._marker(base)):
                return False
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return True

    def release(self) -> None:
        """Free the place behind the current version, which a writer took and did not fill."""
        self._fs.delete(self._marker(self.version), False)

    def point_to(self, name: str) -> None:
        """Make a version the current one."""
        draft = self._at(f"CURRENT.{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(draft, self._at("CURRENT"), options)

    def apply(self, net: DataFrame, fresh: DataFrame, key: str = "path") -> str:
        """The current rows after ``net`` changes, as a new version."""
        base = self.read() if self.version else fresh.limit(0)
        return self.replace(apply_changes(base, net, fresh, key))

    def upsert(self, rows: DataFrame, key: str) -> str:
        return self.apply(rows.select(key, F.lit("upsert").alias("op")).distinct(), rows, key)

    def delete(self, keys: DataFrame, key: str) -> str:
        return self.apply(keys.select(key, F.lit("delete").alias("op")).distinct(), self.read().limit(0), key)

    def vacuum(self) -> None:
        """Delete the versions that are no longer current."""
        now = self.version
        for status in self._fs.listStatus(self._at("")):
            name = status.getPath().getName()
            if (name.startswith("v-") and name != now) or (name.startswith("after-") and name != f"after-{now}"):
                self._fs.delete(status.getPath(), True)


@dataclass(frozen=True)
class Draft:
    """A version in the making; its parts become current together."""

    table: VersionedTable
    base: str | None
    name: str

    def put(self, part: str, rows: DataFrame) -> DataFrame:
        """Write a part and read it back, so that what is derived from it
        neither computes it again nor sees other values."""
        # Rows may have megabytes, so the writer looks how much it holds after few of them.
        sized = rows.write.option("parquet.page.size.row.check.min", "4").option("parquet.block.size.row.check.min", "4").option("parquet.block.size", str(32 << 20))
        sized.parquet(self.table.folder(self.name, part))
        return self.table.read(part, self.name)

    def commit(self) -> str:
        """Refused if another writer was faster, as its rows would be lost.

        Only one version may follow another: who creates the marker of the
        place behind the base has it, and creating a file that is there fails.
        A writer that dies between the marker and the manifest leaves the base
        current and the place taken; :meth:`VersionedTable.release` frees it.
        """
        if self.table.version != self.base or not self.table.claim(self.base, self.name):
            raise RuntimeError(f"{self.table.path} has changed since this version was begun")
        self.table.point_to(self.name)
        return self.name


@dataclass(frozen=True)
class Part:
    """One part of the current version."""

    table: VersionedTable
    name: str

    def read(self) -> DataFrame:
        return self.table.read(self.name)
