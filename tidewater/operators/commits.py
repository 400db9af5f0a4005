"""A commit log beside a table: numbered JSON entries, each of which appears whole or not at all.

Data files are written first, under names of their own, and count only once an entry names them: a run that ends between the
two leaves nothing that a reader sees. Two writers that want the same number cannot both have it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the number of this entry."""


def path_of(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


class Log:
    """Entries under `path`/_commits; the first has the number 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: dict[str, dict] = {}  # entries never change

    def _folder(self):
        return path_of(self.spark, f"{self.path}/_commits")

    def entries(self) -> list[dict]:
        """All entries in order."""
        system, at = self._folder()
        if not system.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(at))
        names = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
        for n in names:
            if n not in self._read:
                stream = system.open(self.spark._jvm.org.apache.hadoop.fs.Path(at, n))
                try:
                    self._read[n] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return [self._read[n] for n in names]

    def has(self, batch: str) -> bool:
        return any(e.get("batch") == batch for e in self.entries())

    def commit(self, entry: dict, number: int | None = None) -> int:
        """Add an entry under a number (the next one by default); its number. Conflict if the number is taken."""
        number = len(self.entries()) if number is None else number
        system, at = self._folder()
        system.mkdirs(at)
        jvm = self.spark._jvm
        temporary, final = (jvm.org.apache.hadoop.fs.Path(at, n) for n in (f".{uuid.uuid4().hex}.tmp", f"{number:010d}.json"))
        out = system.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else system.getUri(), system.getConf())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(temporary, final, plain)  # refuses a name that is there
        except Exception as e:
            system.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"entry {number} of {self.path} is taken") from None
            raise
        return number
