"""Tables that grow by commits: rows become visible, together with where their source stands, by one manifest written last.

A commit writes its rows to folders of their own and then one small manifest that names them. Readers follow manifests only,
so a batch that dies before its manifest has never been, and one that is replayed after it is known by its name and left
out. A commit may also cut: rows of earlier commits with one of the cut values in a column are no longer seen. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommittedTables:
    """Tables under a folder of any store that Spark writes to.

    A row carries the number of its commit in `batch`. Rows are never rewritten; `vacuum` removes the folders that no manifest
    names. Manifests are few kilobytes each, and reading takes one listing of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self.fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """All commits in order."""
        folder = self._at(f"{self.path}/_commits")
        if not self.fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(folder))
        return [json.loads(self._read(f"{self.path}/_commits/{n}")) for n in names if n.endswith(".json")]

    def _read(self, path: str) -> str:
        stream = self.fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        """Writes the manifest beside its place and moves it there: it is seen whole or not at all."""
        draft = self._at(f"{self.path}/_drafts/{uuid.uuid4()}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        place = self._at(f"{self.path}/_commits/{number:012d}.json")
        self.fs.mkdirs(place.getParent())
        if self.fs.exists(place) or not self.fs.rename(draft, place):
            raise RuntimeError(f"commit {number} of {self.path} exists already: there is another writer")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.parquet(path)

    def commit(self, name: str, tables: dict[str, DataFrame], cuts: dict[str, list[str]] | None = None, notes: dict | None = None) -> int | None:
        """Adds rows to tables, all at once; the commit's number, or None if one of that name has been made already.

        cuts: {column: values} that hide earlier rows; the commit's own rows stay. notes are kept in the manifest."""
        done = self.manifests()
        if any(m["name"] == name for m in done):
            return None
        number = done[-1]["number"] + 1 if done else 0
        folders = {t: f"data/{t}/{number:012d}-{uuid.uuid4()}" for t in tables}
        for t, rows in tables.items():
            self._write(rows.withColumn("batch", F.lit(number).cast("long")), f"{self.path}/{folders[t]}")
        self._publish(number, {"number": number, "name": name, "tables": folders, "cuts": cuts or {}, "notes": notes or {}})
        return number

    def read(self, table: str, schema: str) -> DataFrame:
        """The visible rows of a table, with the number of their commit; an unknown table is empty."""
        done = self.manifests()
        folders = [f"{self.path}/{m['tables'][table]}" for m in done if table in m["tables"]]
        reader = self.spark.read.schema(f"{schema}, batch long")
        rows = reader.parquet(*folders) if folders else self.spark.createDataFrame([], f"{schema}, batch long")
        last: dict[str, dict[str, int]] = {}
        for m in done:
            for column, values in m["cuts"].items():
                last.setdefault(column, {}).update(dict.fromkeys(values, m["number"]))
        for column, since in last.items():
            if column in rows.columns and since:
                cut = self.spark.createDataFrame(list(since.items()), "_cut string, _since long")
                rows = rows.join(cut, F.col(column) == F.col("_cut"), "left").where("_since IS NULL OR batch >= _since").drop("_cut", "_since")
        return rows

    def notes(self, key: str) -> dict:
        """The notes of all commits under a key, later ones over earlier ones."""
        out: dict = {}
        for m in self.manifests():
            out |= m["notes"].get(key, {})
        return out

    def vacuum(self) -> int:
        """Removes what no manifest names: folders of batches that died, and drafts. Not while a commit is being made."""
        named, gone = {f for m in self.manifests() for f in m["tables"].values()}, 0
        self.fs.delete(self._at(f"{self.path}/_drafts"), True)
        if not self.fs.exists(self._at(f"{self.path}/data")):
            return 0
        for t in self.fs.listStatus(self._at(f"{self.path}/data")):
            for f in self.fs.listStatus(t.getPath()):
                if f"data/{t.getPath().getName()}/{f.getPath().getName()}" not in named:
                    gone += self.fs.delete(f.getPath(), True)
        return gone
