"""Several tables that are replaced together: readers see all of one generation or all of the one before."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Generations:
    """Generations of tables under a folder that driver and executors share, each for the configuration it was made with.

    A commit writes its tables to a folder of their own and then names that folder in one numbered pointer file, put in
    place by a rename: a commit that fails before leaves the generation before it as it was, and of two writers that commit
    at once one fails. Readers take the newest pointer; what was made with another configuration isn't read. The folders of
    the last `keep` generations stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str, config: str = "", keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.config = hashlib.sha256(config.encode()).hexdigest()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[dict]:
        """What the pointer files say, the newest last, each with its number."""
        fs, found = self._fs(), []
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("generation-"):
                said = self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]
                found.append(json.loads(said) | {"number": int(name.removeprefix("generation-").removesuffix(".json"))})
        return sorted(found, key=lambda x: x["number"])

    def newest(self) -> dict | None:
        """The newest pointer if its configuration is this one: folder, tables, number and notes; else None."""
        found = self._pointers()
        return found[-1] if found and found[-1]["config"] == self.config else None

    def read(self) -> dict[str, DataFrame] | None:
        at = self.newest()
        return at and {name: self.spark.read.parquet(f"{self.root}/{at['folder']}/{name}") for name in at["tables"]}

    def commit(self, tables: dict[str, DataFrame], **notes) -> int:
        """Writes the tables as the next generation, with notes in its pointer; returns its number."""
        before, folder, fs = self._pointers(), f"tables-{uuid.uuid4().hex}", self._fs()
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        said = json.dumps({"config": self.config, "folder": folder, "tables": sorted(tables), "notes": notes})
        draft, number = self._path(f"draft-{uuid.uuid4().hex}"), before[-1]["number"] + 1 if before else 0
        stream = fs.create(draft)
        stream.write(bytearray(said.encode()))
        stream.close()
        target = self._path(f"generation-{number:012d}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed generation {number} of {self.root}")
        for old in before[: max(0, len(before) + 1 - self.keep)]:
            fs.delete(self._path(f"generation-{old['number']:012d}.json"), False)
            fs.delete(self._path(old["folder"]), True)
        return number
