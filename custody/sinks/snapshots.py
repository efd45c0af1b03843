"""Tables kept as Parquet folders: append-only, or replaced snapshot by snapshot.

File tables have no MERGE. A replaced table is written whole into the next
``v=N`` folder; readers take the highest folder that carries Spark's success
marker, so a lost job leaves the previous version in place. One writer per table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Named tables under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str],
                 partitions: dict[str, list[str]] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = schemas
        self.partitions = partitions or {}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, path = self._fs(self._path(name))
        if not fs.exists(path):
            return []
        jvm = self.spark.sparkContext._jvm
        done = []
        for status in fs.listStatus(path):
            folder = status.getPath()
            if folder.getName().startswith("v=") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            ):
                done.append(int(folder.getName()[2:]))
        return sorted(done)

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[name])

    def _read(self, name: str, path: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def log(self, name: str) -> DataFrame:
        """An append-only table."""
        fs, path = self._fs(self._path(name))
        return self._read(name, self._path(name)) if fs.exists(path) else self._empty(name)

    def append(self, name: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        writer = rows.select(*columns).write.mode("append")
        if name in self.partitions:
            writer = writer.partitionBy(*self.partitions[name])
        writer.parquet(self._path(name))

    def snapshot(self, name: str) -> DataFrame:
        """The current version of a replaced table."""
        versions = self._versions(name)
        if not versions:
            return self._empty(name)
        return self._read(name, f"{self._path(name)}/v={versions[-1]}")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Write the next version and return it as read back (its lineage is the files)."""
        versions = self._versions(name)
        number = versions[-1] + 1 if versions else 1
        path = f"{self._path(name)}/v={number}"
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        rows.select(*columns).write.mode("overwrite").parquet(path)
        return self._read(name, path)

    def vacuum(self, name: str, keep: int = 2) -> list[int]:
        """Drop all but the newest versions, once no job reads the older ones."""
        old = self._versions(name)[:-max(keep, 1)]
        for number in old:
            fs, path = self._fs(f"{self._path(name)}/v={number}")
            fs.delete(path, True)
        return old

    def extend(self, name: str, rows: DataFrame) -> None:
        """Add rows to the current version; only new files are written."""
        versions = self._versions(name)
        if not versions:
            self.replace(name, rows)
            return
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        rows.select(*columns).write.mode("append").parquet(f"{self._path(name)}/v={versions[-1]}")

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate result and read it back: cuts lineage.

        Every call has a folder of its own, so results handed out stay readable and runs
        do not meet; ``clear_stages`` drops them all once nothing reads them.
        """
        path = f"{self.root}/_work/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_stages(self) -> None:
        fs, path = self._fs(f"{self.root}/_work")
        fs.delete(path, True)
