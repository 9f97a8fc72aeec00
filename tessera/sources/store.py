"""Tables that outlive a session: several under one root, changed together or not at all.

The rows of a table lie in folders by bucket of their key. A change is a Spark job that writes the buckets it touches
anew, into a folder of its own, and ends in a manifest of which folder holds which bucket, renamed to the number of the
next version. Whoever reads holds one manifest and so one state of all tables, whatever is written meanwhile; a write
that is cut short leaves files that no manifest names. Two writers can't take one number: the second looks whether the
first touched its buckets, and if so does these again from the newer state, or gives up where it was told what it had
read. The driver holds a manifest, that is a name a bucket, never rows.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.shared import gone, hadoop, stored

#: How often a change is done again because others were faster. Keys of a change that are broadcast to its tables.
TRIES, BROADCAST_KEYS = 10, 1_000_000


class Conflict(Exception):
    """Others changed what this change had read, or were faster each time."""


@dataclass(frozen=True)
class Layout:
    """A table of ``schema``; a change replaces all rows of a ``key``. If ``unique``, a key has one row: of several in one
    batch that of the greatest ``newest`` columns, of equal ones the greatest as JSON. ``buckets`` should let one hold a
    few files; a bucket that outgrows this is written in several files, and :meth:`Store.rebucket` deals all anew."""

    schema: StructType
    key: tuple[str, ...]
    unique: bool = True
    newest: tuple[str, ...] = ()
    buckets: int = 64

    def to_json(self) -> dict:
        return {"schema": self.schema.jsonValue(), "key": list(self.key), "unique": self.unique, "newest": list(self.newest), "buckets": self.buckets}

    @classmethod
    def of(cls, held: dict) -> Layout:
        return cls(StructType.fromJson(held["schema"]), tuple(held["key"]), held["unique"], tuple(held["newest"]), held["buckets"])

    @property
    def column(self) -> str:
        """A name for the bucket that no column has."""
        name, taken = "bucket", {n.lower() for n in self.schema.names}
        while name in taken:
            name += "_"
        return name

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*map(_col, self.key)), F.lit(self.buckets)).cast("int")

    def keys(self, rows: DataFrame) -> DataFrame:
        """The keys of rows, as the table holds them; null ones are none."""
        return self._known(rows, list(self.key))

    def rows(self, rows: DataFrame) -> DataFrame:
        """Rows as the table holds them: its columns (those that are missing null, others left out), a key without nulls,
        one row a key if unique."""
        rows = self._known(rows, self.schema.names)
        if not self.unique:
            return rows
        whole = F.struct(*map(_col, self.schema.names))
        best = F.max_by(whole, F.struct(*map(_col, self.newest), F.to_json(whole).alias("all")))
        return rows.groupBy(*map(_col, self.key)).agg(best.alias("kept")).select("kept.*")

    def _known(self, rows: DataFrame, names: list[str]) -> DataFrame:
        if missing := [c for c in self.key if c not in rows.columns]:
            raise ValueError(f"no column {missing}")
        cast = [(_col(c) if c in rows.columns else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in names]
        rows = rows.select(*cast)
        for c in self.key:
            rows = rows.where(_col(c).isNotNull())
        return rows


@dataclass(frozen=True)
class Change:
    """Rows that replace those of their keys, and keys whose rows go. A key in both gets its rows."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Snapshot:
    """All tables as of one version."""

    spark: SparkSession
    root: str
    held: dict = field(repr=False)

    @property
    def version(self) -> int:
        return self.held["version"]

    def layout(self, name: str) -> Layout:
        return Layout.of(self.held["tables"][name])

    def live(self, name: str) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return self.held["tables"][name]["live"]

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        layout = self.layout(name)
        paths = [f"{self.root}/rows/{at}/{layout.column}={b}" for b, at in self.live(name).items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(layout.schema).parquet(*paths) if paths else self.spark.createDataFrame([], layout.schema)

    def of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only buckets that can hold them are read."""
        layout = self.layout(name)
        keys = layout.keys(keys).distinct()
        return self.table(name, _buckets(keys.select(layout.bucket().alias("b")))).join(keys, list(layout.key), "left_semi")


def _buckets(rows: DataFrame) -> set[int]:
    return {r[0] for r in rows.distinct().collect()}  # not more than a table's buckets


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, layouts: dict[str, Layout]) -> Store:
        """Empty tables in a new folder."""
        store = cls(spark, root)
        for name, layout in layouts.items():
            if unknown := [c for c in (*layout.key, *layout.newest) if c not in layout.schema.names]:
                raise ValueError(f"{name}: no column {unknown}")
        if not store._publish({"version": 0, "done": {}, "tables": {n: t.to_json() | {"live": {}} for n, t in layouts.items()}}):
            raise FileExistsError(root)
        return store

    def versions(self) -> list[int]:
        fs, at = hadoop(self.spark, f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest state, or that of a version that wasn't cleared away."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.root}: version {version}")
        name = f"{self.root}/versions/{known[-1] if version is None else version:020d}.json"
        return Snapshot(self.spark, self.root, json.loads(self.spark.read.text(name, wholetext=True).first()[0]))

    def commit(self, changes: dict[str, Change], since: Snapshot | None = None, source: str | None = None, batch: int = 0) -> Snapshot:
        """Changes of one or several tables as one version. What was worked out from a snapshot names it as ``since`` and
        fails with :class:`Conflict` if there is a newer one. A stream names itself as ``source``, and its ``batch``: one
        that comes again changes nothing."""
        base = self.snapshot()
        ready: dict[str, _Ready] = {}
        written: dict[str, tuple[dict, dict]] = {}
        first: dict[str, tuple[Layout, dict]] = {}
        if any(c.rows is None and c.gone is None for c in changes.values()):
            raise ValueError("a change of neither rows nor keys")
        try:
            for _ in range(TRIES):
                if since is not None and base.version != since.version:
                    raise Conflict(f"version {base.version} is newer than {since.version}")
                if source is not None and base.held["done"].get(source, -1) >= batch:
                    return base
                tables = dict(base.held["tables"])
                for name, change in changes.items():
                    layout = base.layout(name)
                    if not base.live(name):  # nothing to replace: the rows as they come
                        if name not in first or first[name][0] != layout:
                            first[name] = layout, self._dealt(layout.rows(change.rows), layout) if change.rows is not None else {}
                        tables[name] = tables[name] | {"live": {str(b): at for b, at in first[name][1].items()}}
                        continue
                    if name not in ready or ready[name].layout != layout:  # dealt anew meanwhile
                        ready[name] = _Ready.of(layout, change, ready.get(name))
                        written.pop(name, None)
                    was = {str(b): base.live(name).get(str(b)) for b in ready[name].buckets}
                    if name not in written or written[name][0] != was:  # others touched these buckets meanwhile
                        written[name] = was, self._write(base, name, ready[name])
                    live = base.live(name) | written[name][1]
                    tables[name] = tables[name] | {"live": {b: at for b, at in live.items() if at}}
                done = base.held["done"] if source is None else base.held["done"] | {source: batch}
                held = {"version": base.version + 1, "done": done, "tables": tables}
                if self._publish(held):
                    return Snapshot(self.spark, self.root, held)
                base = self.snapshot()
            raise Conflict(f"{TRIES} times others were faster")
        finally:
            gone(*(r.changes for r in ready.values()))

    def rebucket(self, name: str, buckets: int) -> Snapshot:
        """The same rows of a table in another number of buckets."""
        base = self.snapshot()
        layout = replace(base.layout(name), buckets=buckets)
        live = {str(b): at for b, at in self._dealt(base.table(name), layout).items()}
        held = base.held | {"version": base.version + 1, "tables": base.held["tables"] | {name: layout.to_json() | {"live": live}}}
        if not self._publish(held):
            raise Conflict(f"version {base.version + 1} is taken")
        return Snapshot(self.spark, self.root, held)

    def vacuum(self, keep: int = 10, older: float = 86_400) -> int:
        """Clear away all versions but the newest ``keep``, and the folders that none of these names. Folders younger than
        ``older`` seconds stay, since a writer may be at work in them. Returns the number of folders deleted."""
        known = self.versions()
        for version in known[:-keep]:
            fs, at = hadoop(self.spark, f"{self.root}/versions/{version:020d}.json")
            fs.delete(at, False)
        named = {at for v in known[-keep:] for t in self.snapshot(v).held["tables"].values() for at in t["live"].values()}
        fs, at = hadoop(self.spark, f"{self.root}/rows")
        found = fs.listStatus(at) if fs.exists(at) else []
        old = [s.getPath() for s in found if s.getPath().getName() not in named and s.getModificationTime() < (time.time() - older) * 1000]
        for path in old:
            fs.delete(path, True)
        return len(old)

    def _write(self, base: Snapshot, name: str, ready: _Ready) -> dict[str, str | None]:
        """The buckets that a change touches, written with it; a bucket left without rows has no folder."""
        keys = ready.changes.select(*map(_col, ready.layout.key))
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        keys = F.broadcast(keys) if few else keys  # what stays isn't shuffled to be found
        left = base.table(name, ready.buckets).join(keys, list(ready.layout.key), "left_anti").select(*map(_col, ready.layout.schema.names))
        if few and ready.only_gone:  # the files hold a bucket each: what stays of one is written as it is read
            at = self._dealt(left, ready.layout, as_read=True)
        else:
            at = self._dealt(left.unionByName(ready.rows), ready.layout)
        return {str(b): at.get(b) for b in ready.buckets}

    def _dealt(self, rows: DataFrame, layout: Layout, as_read: bool = False) -> dict[int, str]:
        """Rows written by bucket into a folder of their own. A bucket is one file, or several where it is large."""
        folder, column = uuid.uuid4().hex, layout.column
        path = f"{self.root}/rows/{folder}"
        rows = rows.withColumn(column, layout.bucket())
        (rows if as_read else rows.hint("rebalance", column)).write.partitionBy(column).parquet(path)
        fs, at = hadoop(self.spark, path)
        names = [s.getPath().getName().partition("=") for s in fs.listStatus(at)]
        return {int(b): folder for c, _, b in names if c == column}

    def _publish(self, held: dict) -> bool:
        """Whether this manifest became its version. It is written beside and renamed; the file system lets one of two
        through (on a plain local folder, as Spark's own logs there, only if they don't come at the same moment)."""
        name = f"{self.root}/versions/{held['version']:020d}.json"
        aside = f"{self.root}/versions/.{uuid.uuid4().hex}"
        fs, at = hadoop(self.spark, aside)
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: never over another
        try:
            files.rename(at, hadoop(self.spark, name)[1], over)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            fs.delete(at, False)
            return False


@dataclass(frozen=True)
class _Ready:
    """A change as it is applied: the rows that come and the keys of those that go in one written table, read for the
    buckets, for what goes and for what comes."""

    layout: Layout
    changes: DataFrame
    buckets: set[int]
    flag: str

    @classmethod
    def of(cls, layout: Layout, change: Change, before: _Ready | None = None) -> _Ready:
        flag = "comes"
        while flag in {n.lower() for n in layout.schema.names}:
            flag += "_"
        if before is not None:
            changes = before.changes
        else:
            parts = [layout.rows(change.rows).withColumn(flag, F.lit(True))] if change.rows is not None else []
            if change.gone is not None:
                parts.append(layout.keys(change.gone).distinct().withColumn(flag, F.lit(False)))
            both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
            changes = stored(both, "changes")
        return cls(layout, changes, _buckets(changes.select(layout.bucket())), flag)

    @property
    def only_gone(self) -> bool:
        return any(n not in self.changes.columns for n in self.layout.schema.names)

    @property
    def rows(self) -> DataFrame:
        names = self.layout.schema.names
        if self.only_gone:
            return self.changes.sparkSession.createDataFrame([], self.layout.schema)
        return self.changes.where(_col(self.flag)).select(*map(_col, names))
