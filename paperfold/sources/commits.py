"""Several tables that change together, or not at all.

A store is a folder of tables in numbered versions. A commit writes the new state of
each table it changes to a folder of its own and, last, one marker file that says
which folder every table is in. Readers go by the newest marker, so the tables of a
commit become visible at one moment; a run that fails before it leaves readers where
they were, and what it wrote is never looked at. A commit that is tried again under
its name after it has been made does nothing.

One writer at a time: a marker is made by a rename that does not replace, so of two
writers that start from one version the later fails and starts again.

    store/versions/00000003.json    {"commit": "confirm-17", "tables": {"records": ".../3-ab12", ...}}
    store/data/records/3-ab12/*.parquet
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT_VERSIONS = 2


class TableStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._files.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")]

    def _marker(self, version: int) -> dict:
        """What a marker says; markers are a few hundred bytes."""
        stream = self._fs.open(self._path(f"versions/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, str]]:
        """Newest version and the folder of each table; 0 and nothing before the first commit."""
        made = self.versions()
        return (made[-1], self._marker(made[-1])["tables"]) if made else (0, {})

    def tables(self) -> dict[str, DataFrame]:
        """All tables of one and the same version."""
        return {name: self.spark.read.parquet(f"{self.folder}/{place}") for name, place in self.current()[1].items()}

    def read(self, table: str) -> DataFrame:
        return self.tables()[table]

    def commit(self, name: str, changes: dict[str, DataFrame]) -> int:
        """Makes new states of some tables visible together and returns the version.

        `changes` may be computed from the tables as they are. Repeating a commit that
        is in a kept version returns that version.
        """
        before, places = self.current()
        for version in reversed(self.versions()):
            if self._marker(version)["commit"] == name:
                return version
        version, mark = before + 1, uuid.uuid4().hex[:8]
        now = {t: f"data/{t}/{version}-{mark}" for t in changes}
        for table, state in changes.items():
            state.write.parquet(f"{self.folder}/{now[table]}")
        self._publish(version, {"commit": name, "tables": {**places, **now}})
        return version

    def _publish(self, version: int, marker: dict) -> None:
        unfinished = self._path(f"versions/_{version:08d}-{uuid.uuid4().hex}")
        out = self._fs.create(unfinished, True)
        try:
            out.write(bytearray(json.dumps(marker).encode()))
        finally:
            out.close()
        target = self._path(f"versions/{version:08d}.json")
        if self._fs.exists(target) or not self._fs.rename(unfinished, target):
            self._fs.delete(unfinished, False)
            raise OSError(f"version {version} of {self.folder} was made by another writer; nothing has changed")

    def clean(self, kept: int = KEPT_VERSIONS) -> None:
        """Removes versions but the newest, and folders that no kept version names.

        To be called where no reader is on an older version and no commit is under way.
        """
        made = self.versions()
        named = {place for v in made[-kept:] for place in self._marker(v)["tables"].values()}
        for version in made[:-kept]:
            self._fs.delete(self._path(f"versions/{version:08d}.json"), False)
        for table in self._names("data"):
            for place in self._names(f"data/{table}"):
                if f"data/{table}/{place}" not in named:
                    self._fs.delete(self._path(f"data/{table}/{place}"), True)
