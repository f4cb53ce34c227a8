"""A store of collections with a log of versions. What a version holds is named by one small file of the log, which is created once and
never changed: whoever creates the file of the next version first has committed, everyone else has lost the race. Data are Parquet
folders that versions share; upserts are deltas that are merged when they are read, until compact() writes them out.

Candidates are written, read back and checked, all of them, before one commit makes them visible together. A rollback is a new version
with what an older one had, so nothing is lost by it.

Defined results. A null key, and two new rows of one key, are refused. Later deltas win. A collection without rows is one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.checks import payload_contract
from lexspan.operators.vectors import keyed_upsert


class LostRace(RuntimeError):
    """Another writer has committed the version that this one wanted to."""


@dataclass(frozen=True)
class Version:
    number: int
    #: Of each collection: its folder, then those of its deltas in order.
    collections: dict[str, list[str]] = field(default_factory=dict)
    note: str = ""


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str, *, key: str = "chunk_id", read_only: bool = False):
        self.spark, self.root, self.key, self.read_only = spark, root, key, read_only
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- log ---

    def _entry(self, number: int) -> str:
        return f"{self.root}/log/{number:012d}.json"

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(f"{self.root}/log")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/log")))
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The latest, or that of a number; version 0 is empty."""
        known = self.versions()
        number = (known[-1] if known else 0) if number is None else number
        if number == 0:
            return Version(0)
        if number not in known:
            raise ValueError(f"no version {number}")
        text = "".join(r.value for r in self.spark.read.text(self._entry(number)).collect())
        got = json.loads(text)
        return Version(got["number"], got["collections"], got["note"])

    def _commit(self, parent: Version, collections: Mapping[str, list[str]], note: str) -> Version:
        """Creates the file of the version after `parent`, which fails if it is there."""
        self._writable()
        made = Version(parent.number + 1, dict(collections), note)
        body = json.dumps({"number": made.number, "collections": made.collections, "note": note}).encode()
        try:
            out = self._fs.create(self._path(self._entry(made.number)), False)
        except Exception as e:
            if self._fs.exists(self._path(self._entry(made.number))):
                raise LostRace(f"version {made.number} is committed") from e
            raise
        out.write(bytearray(body))
        out.close()
        return made

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")

    # --- reading ---

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """The rows of a collection in a version, the latest if none is named."""
        return self._merged(name, self.version(at))

    def _merged(self, name: str, version: Version) -> DataFrame:
        if name not in version.collections:
            raise ValueError(f"version {version.number} has no collection {name}")
        base, *deltas = version.collections[name]
        rows = self.spark.read.parquet(base)
        for d in deltas:
            rows = keyed_upsert(rows, self.spark.read.parquet(d), self.key)
        return rows

    def scroll(self, name: str, at: int | None = None) -> DataFrame:
        """Payloads without their vectors, which aren't read."""
        return self.read(name, at).drop("vector")

    # --- writing ---

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _keys(self, rows: DataFrame, what: str) -> None:
        n = rows.agg(F.count("*").alias("n"), F.count(self.key).alias("k"), F.count_distinct(self.key).alias("d")).first()
        if n.k < n.n or n.d < n.k:
            raise ValueError(f"{what}: {n.n} rows, {n.n - n.k} without a key, {n.k - n.d} that repeat one")

    def build(self, made: Mapping[str, DataFrame], expected: Mapping[str, int], *, dimensions: int, required: tuple[str, ...] = ("text",), prefix: str = "#", parent: Version | None = None) -> Version:
        """Puts new collections in, all in one version, after all of them were written, read back and found to keep their contract: none
        is there, each has the rows that are expected of it, no key is missing or repeats, vectors have their size, payloads keep
        checks.payload_contract. A failed check leaves the store as it was."""
        self._writable()
        parent = parent or self.version()
        if set(made) != set(expected) or not made:
            raise ValueError("each candidate needs a number of rows that is expected")
        if there := sorted(set(made) & set(parent.collections)):
            raise ValueError(f"candidates {there} are there already")
        paths = {name: self._write(rows) for name, rows in made.items()}
        for name, path in paths.items():
            rows = self.spark.read.parquet(path)
            self._keys(rows, name)
            found = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dimensions).alias("bad")).first()
            if found.n != expected[name] or found.bad:
                raise ValueError(f"candidate {name}: {found.n} rows of {expected[name]}, {found.bad} with a vector of another size")
            if broken := payload_contract(rows, required=required, prefix=prefix).limit(5).collect():
                raise ValueError(f"candidate {name} breaks its contract: {[r.asDict() for r in broken]}")
        return self._commit(parent, parent.collections | {n: [p] for n, p in paths.items()}, "build " + ", ".join(sorted(made)))

    def upsert(self, name: str, rows: DataFrame, *, parent: Version | None = None) -> Version:
        """Rows put into a collection, in place of those of the same key."""
        self._writable()
        parent = parent or self.version()
        if name not in parent.collections:
            raise ValueError(f"version {parent.number} has no collection {name}")
        path = self._write(rows)
        self._keys(self.spark.read.parquet(path), name)
        return self._commit(parent, parent.collections | {name: [*parent.collections[name], path]}, f"upsert {name}")

    def compact(self, name: str, *, parent: Version | None = None) -> Version:
        """A collection and its deltas as one folder."""
        self._writable()
        parent = parent or self.version()
        return self._commit(parent, parent.collections | {name: [self._write(self._merged(name, parent))]}, f"compact {name}")

    def rollback(self, to: int, *, parent: Version | None = None) -> Version:
        """What version `to` has becomes the latest again."""
        self._writable()
        return self._commit(parent or self.version(), self.version(to).collections, f"rollback to {to}")
