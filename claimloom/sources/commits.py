"""Append-only tables whose rows count once they are committed.

Rows are written to a folder of their own, and a commit file with the next number names that folder. The file is created only if
there is none of that number, which the file system decides: of two writers that saw the same state one fails, reads again and
decides anew. A folder without a commit file, left by a writer that stopped, is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "commit"


class Conflict(Exception):
    """Another writer has made the commit."""


class CommitLog:
    """The table at `path` with rows of `schema`."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        path = self._path("commits")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> list[str]:
        """The committed folders in order; one short name a commit. A commit file that is being written is not there yet."""
        path, files = self._files()
        if not files.exists(path):
            return []
        texts = self.spark.read.option("wholetext", True).text(f"{self.path}/commits")
        found = texts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("number"), "value").orderBy("number").collect()
        return [row["value"] for row in found if row["value"]]

    def version(self) -> int:
        """Number of the next commit."""
        path, files = self._files()
        return len(files.listStatus(path)) if files.exists(path) else 0

    def read(self) -> DataFrame:
        """All committed rows, with the number of their commit."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], f"{self.schema}, {COMMIT} int")
        stored = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{name}" for name in folders])
        numbers = F.create_map(*[F.lit(x) for k, name in enumerate(folders) for x in (name, k)])
        return stored.withColumn(COMMIT, numbers[F.element_at(F.split(F.input_file_name(), "/"), -2)])

    def write(self, rows: DataFrame) -> str:
        """Store rows that are not committed yet; returns their folder."""
        name = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, folder: str, version: int) -> None:
        """Make the folder's rows count as commit number `version`; Conflict if there is one of that number."""
        path, files = self._files()
        files.mkdirs(path)
        try:
            out = files.create(self._path(f"commits/{version:012d}"), False)
        except Py4JJavaError as failure:
            if "already exists" not in str(failure.java_exception):
                raise
            raise Conflict(f"commit {version} of {self.path}") from failure
        out.write(bytearray(folder.encode()))
        out.close()

    def append(self, rows: DataFrame) -> int:
        """Commit rows that do not depend on what the table holds, whatever others commit meanwhile."""
        folder = self.write(rows)
        while True:
            version = self.version()
            try:
                self.commit(folder, version)
                return version
            except Conflict:
                continue

    def decide(self, choose: Callable[[DataFrame], DataFrame | None], attempts: int = 10) -> int | None:
        """Commit the rows that `choose` makes of the table's rows; if another writer is first, choose again. None if there is
        nothing to commit."""
        for _ in range(attempts):
            version = self.version()
            rows = choose(self.read())
            if rows is None:
                return None
            folder = self.write(rows)
            try:
                self.commit(folder, version)
                return version
            except Conflict:
                continue
        raise Conflict(f"{attempts} attempts on {self.path}")
