"""A versioned store of the forum tables in hash buckets, with one pointer file for each version.

A table's rows lie in buckets by the hash of the columns that its changes go by (``BUCKET_BY``). A change
reads and rewrites the buckets of the rows that it names, and no others; the pointer of the next version
names the new folders of these buckets and the old ones of the rest. So a batch costs what it touches,
readers see all of a change or none of it, and a driver lost at any moment leaves the version before.

The pointer is created only if there is none of that number, so of two commits on one version one raises
``Conflict``; ``Store.retry`` runs such a change again on the newer version.

Within a bucket rows are sorted by the column that they are looked up by, with a Parquet Bloom filter on it
(``LOOK_UP_BY``): a profile page reads the row groups that have the user, in every bucket.
"""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES

#: rows of one article are replaced together, so they lie together
BUCKET_BY = {"pushes": ("article_id",), "entity_refs": ("article_id",)}
LOOK_UP_BY = {"articles": "author", "pushes": "user_id"}
#: small tables have one bucket
BUCKETS = {"articles": 64, "pushes": 64, "article_insights": 64, "entity_refs": 64}
#: row groups small enough that one user's are few
LAYOUT = {"parquet.block.size": str(16 << 20), "parquet.bloom.filter.expected.ndv": "100000"}


class Conflict(RuntimeError):
    """Another commit came first."""


def bucket_columns(name: str) -> tuple[str, ...]:
    return BUCKET_BY.get(name, TABLES[name].key)


def bucket(name: str, buckets: int) -> Column:
    """The bucket of a row; the casts make it that of the stored row, whatever types a change comes with."""
    schema = TABLES[name].schema
    return F.pmod(F.xxhash64(*(F.col(c).cast(schema[c].dataType) for c in bucket_columns(name))), F.lit(buckets)).cast("int")


class Store:
    """Tables under a root; the complete pointer file with the highest number is current."""

    KEEP = 2  # versions, for readers that have begun
    LEASE = 60.0  # seconds after which a pointer that isn't complete counts as left behind

    def __init__(self, spark: SparkSession, root: str, buckets: dict[str, int] | None = None, layout: dict[str, str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets, self.layout = BUCKETS | (buckets or {}), LAYOUT | (layout or {})
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # pointers

    def _pointers(self) -> dict[int, float]:
        """The numbers of all pointer files, and when each was last written to."""
        root = self._path(self.root)
        if not self.fs.exists(root):
            return {}
        files = [(f.getPath().getName(), f.getModificationTime() / 1000) for f in self.fs.listStatus(root)]
        return {int(n.removeprefix("_current-")): t for n, t in files if n.startswith("_current-")}

    def _manifest(self, number: int) -> dict | None:
        """What a pointer says; None if it isn't complete. The last byte of a complete one is a line's end."""
        stream = self.fs.open(self._path(f"{self.root}/_current-{number}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def _current(self) -> tuple[int, dict]:
        for number in sorted(self._pointers(), reverse=True):
            if (found := self._manifest(number)) is not None:
                return number, found
        return 0, {"tables": {}, "steps": []}

    def version(self) -> int:
        return self._current()[0]

    def _create(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet; False if it is."""
        path = self._path(f"{self.root}/{name}")
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local files don't refuse by themselves
            try:
                with open(path.toUri().getPath(), "x") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        if self.fs.exists(path):
            return False
        try:
            stream = self.fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _add_pointer(self, base: int, manifest: dict) -> int:
        """The next version; Conflict if ``base`` isn't current any more, or another commit is being written."""
        pointers, (current, _) = self._pointers(), self._current()
        if current != base:
            raise Conflict(f"version {base} is no longer current")
        number = max(pointers, default=0) + 1
        if any(n > current and time.time() - t < self.LEASE for n, t in pointers.items()):
            raise Conflict("another commit is being written")
        self.fs.mkdirs(self._path(self.root))
        if not self._create(f"_current-{number}", json.dumps(manifest) + "\n") or self.version() != number:
            raise Conflict(f"version {base} is no longer current")
        return number

    def versions(self) -> dict[str, list[str]]:
        """The folders of each table that has been written."""
        return {name: sorted(t["parts"].values()) for name, t in self._current()[1]["tables"].items()}

    # reading

    def _frame(self, name: str, parts: list[str]) -> DataFrame:
        schema = TABLES[name].schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{p}" for p in parts))

    def parts(self, name: str) -> dict[int, str]:
        """The folder of each bucket of a table that has rows."""
        return {int(b): p for b, p in self._current()[1]["tables"].get(name, {}).get("parts", {}).items()}

    def read(self, name: str) -> DataFrame:
        return self._frame(name, list(self.parts(name).values()))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in TABLES}

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets of some keys (bucket_columns): reads those buckets only."""
        table = self._current()[1]["tables"].get(name, {"buckets": 1, "parts": {}})
        hit = [r.b for r in keys.select(bucket(name, table["buckets"]).alias("b")).distinct().collect()]
        return self._frame(name, [table["parts"][str(b)] for b in hit if str(b) in table["parts"]])

    # writing

    @contextmanager
    def scratch(self):
        """A function that writes a table for the time of the block, so that what it takes is computed once,
        survives lost executors and isn't asked for again when a change is run again."""
        top, count = f"{self.root}/_scratch/{uuid.uuid4().hex[:12]}", itertools.count()

        def keep(df: DataFrame) -> DataFrame:
            path = f"{top}/{next(count)}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield keep
        finally:
            self.fs.delete(self._path(top), True)

    @contextmanager
    def change(self, base: int | None = None):
        """A ``Change`` on top of version ``base`` (the current one), committed at the end of the block."""
        with self.scratch() as keep:
            new = Change(self, keep, base)
            yield new
            new.commit()

    def retry(self, make: Callable[[Change], object], attempts: int = 5):
        """Runs a change, on Conflict again on the newer version; returns what ``make`` returns."""
        for left in reversed(range(attempts)):
            try:
                with self.change() as new:
                    out = make(new)
                return out
            except Conflict:
                if not left:
                    raise

    def commit(self, base: int | None = None, **changed: DataFrame) -> int:
        """Replaces whole tables; returns the new version."""
        with self.change(base) as new:
            for name, df in changed.items():
                new.replace(name, df)
        return new.version

    def rebucket(self, name: str, buckets: int) -> None:
        """Gives a table another number of buckets; later changes keep it."""
        self.buckets[name] = buckets
        self.retry(lambda c: c.replace(name, self._frame(name, list(c.parts(name).values()))))

    def _forget(self, current: int) -> None:
        """Deletes pointers and folders that only versions older than the last KEEP have."""
        numbers = sorted(self._pointers())
        found = {n: self._manifest(n) for n in numbers}
        kept = [n for n in numbers if n <= current and found[n]][-self.KEEP :]
        folders = lambda n: {(t, p) for t, m in (found[n] or {"tables": {}})["tables"].items() for p in m["parts"].values()}
        used = set().union(*map(folders, kept))
        writes = {(t, p.partition("/")[0]) for t, p in used}
        for n in numbers:
            if n >= kept[0]:
                continue
            for table, part in folders(n) - used:
                write = part.partition("/")[0]
                self.fs.delete(self._path(f"{self.root}/{table}/{part if (table, write) in writes else write}"), True)
            self.fs.delete(self._path(f"{self.root}/_current-{n}"), False)

    def vacuum(self, min_age: float = 86400.0) -> list[str]:
        """Deletes what lost drivers have left: folders that no pointer names, last written to ``min_age``
        seconds ago or before. Returns their names."""
        named = {(t, p.partition("/")[0]) for n in self._pointers() for t, m in (self._manifest(n) or {"tables": {}})["tables"].items() for p in m["parts"].values()}
        gone = []
        for table in (*TABLES, "_scratch"):
            top = self._path(f"{self.root}/{table}")
            for f in self.fs.listStatus(top) if self.fs.exists(top) else []:
                name = f.getPath().getName()
                if (table, name) not in named and time.time() - f.getModificationTime() / 1000 >= min_age:
                    self.fs.delete(f.getPath(), True)
                    gone.append(f"{table}/{name}")
        return sorted(gone)


class Change:
    """A change of several tables, written beside the current version until ``commit``."""

    def __init__(self, store: Store, scratch: Callable[[DataFrame], DataFrame], base: int | None = None):
        self.store, self.scratch = store, scratch
        self.base, found = store._current()
        if base is not None and base != self.base:
            raise Conflict(f"version {base} is no longer current")
        self.before, self.manifest = found, json.loads(json.dumps(found))
        self.token = uuid.uuid4().hex[:12]
        self.writes = 0
        self.version = self.base

    @property
    def steps(self) -> list[str]:
        """The names of the migrations that the store has had."""
        return self.manifest.setdefault("steps", [])

    def _table(self, name: str) -> dict:
        return self.manifest["tables"].setdefault(name, {"buckets": self.store.buckets.get(name, 1), "parts": {}, "top": 0})

    def parts(self, name: str) -> dict[int, str]:
        return {int(b): p for b, p in self._table(name)["parts"].items()}

    def read(self, name: str) -> DataFrame:
        """A table as this change has made it so far."""
        return self.store._frame(name, list(self.parts(name).values()))

    def top(self, name: str) -> int:
        """The largest id that a table has had."""
        return self._table(name).get("top") or 0

    def create(self, name: str) -> None:
        """An empty table, if there is none."""
        self._table(name)

    def update(self, name: str, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rewrites the buckets of the ``touched`` keys: ``make`` turns their old rows into the new ones.

        ``touched`` has the table's bucket_columns. Returns the new rows of these buckets, as written.
        """
        table = self._table(name)
        hit = {r.b for r in touched.select(bucket(name, table["buckets"]).alias("b")).distinct().collect()}  # bounded by the buckets
        if not hit:
            return self.store._frame(name, [])
        old = self.store._frame(name, [p for b, p in self.parts(name).items() if b in hit])
        return self._write(name, make(old), hit)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """All rows of a table."""
        table = self._table(name)
        table["buckets"] = self.store.buckets.get(name, 1)
        return self._write(name, df, set(range(table["buckets"])) | set(self.parts(name)))

    def _write(self, name: str, df: DataFrame, hit: set[int]) -> DataFrame:
        table, schema = self._table(name), TABLES[name].schema
        self.writes += 1
        folder = f"v{self.base + 1}-{self.token}-{self.writes}"
        sort = ["_bucket", *filter(None, [LOOK_UP_BY.get(name)])]
        rows = df.select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names)).withColumn("_bucket", bucket(name, table["buckets"]))
        # a bucket is one file, unless it is so large that Spark splits it among tasks
        writer = rows.hint("rebalance", "_bucket").sortWithinPartitions(*sort).write.partitionBy("_bucket")
        for key, value in self.store.layout.items():
            writer = writer.option(f"{key}#{sort[-1]}" if "bloom" in key and len(sort) > 1 else key, value)
        if len(sort) > 1:
            writer = writer.option(f"parquet.bloom.filter.enabled#{sort[-1]}", "true")
        writer.parquet(f"{self.store.root}/{name}/{folder}")
        top = self.store._path(f"{self.store.root}/{name}/{folder}")
        names = [f.getPath().getName() for f in self.store.fs.listStatus(top)]
        new = {int(n.removeprefix("_bucket=")): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}
        if not set(new) <= hit:
            raise ValueError(f"a change of {name} made rows outside the keys that it named")
        for b in hit:
            table["parts"].pop(str(b), None)
        table["parts"] |= {str(b): p for b, p in new.items()}
        out = self.store._frame(name, list(new.values()))
        if "id" in schema.names:
            table["top"] = max(self.top(name), out.agg(F.max("id")).first()[0] or 0)
        return out

    def commit(self) -> int:
        """Makes the change current; a change that wrote nothing needs no version."""
        if self.manifest != self.before or self.writes:
            self.version = self.store._add_pointer(self.base, self.manifest)
            self.store._forget(self.version)
        return self.version
