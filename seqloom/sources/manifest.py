"""Tables whose partitions are replaced all at once, by a manifest that one rename puts in place."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """A JSON file under ``path`` that says which written folders are current.

    Readers that hold the old manifest go on reading the old folders; a writer that fails before
    :meth:`commit` leaves everything as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._hadoop("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, default: dict) -> dict:
        fs, at = self._fs(), self._hadoop("manifest.json")
        if not fs.exists(at):
            return default
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        jvm = self.spark._jvm
        stream = self._fs().create(self._hadoop("manifest.next"), True)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._hadoop("manifest.next"), self._hadoop("manifest.json"), options)

    def partitions(self, folder: str, column: str) -> list[int]:
        """The values of a whole-number partition column that ``folder`` has, from its listing."""
        names = (s.getPath().getName() for s in self._fs().listStatus(self._hadoop(folder)))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{column}="))
