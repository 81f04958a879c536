"""Tables kept in versions: commits of several tables at once, snapshots, rollback and backups.

A store is a folder. ``parts`` holds Parquet tables named by their content, ``versions`` one manifest for each version, which
names the parts of every table. Parts are written first and the manifest last, by one rename that fails where the name
is taken: whatever breaks off before leaves the old version, and of two writers one wins. A part that didn't change is
shared by all versions that hold it. Readers get the version they ask for, and keep it while others commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.storage import file_system, names_in, read_text, remove, rename_once, write_text

#: Reasons of versions that the store itself makes.
COMMIT, ROLLBACK = "commit", "rollback"


class Conflict(RuntimeError):
    """Another writer's version came first."""


@dataclass(frozen=True)
class Part:
    """A Parquet folder below ``parts``, its rows and the checksum of their contents."""

    path: str
    rows: int
    checksum: str


@dataclass(frozen=True)
class TableState:
    """A table in a version: its schema, the column that deals rows out to parts, and the parts."""

    schema: str
    key: str | None
    n_parts: int
    parts: tuple[Part, ...]

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


@dataclass(frozen=True)
class Version:
    """A manifest. ``marks`` has the last number committed from each source of numbered batches."""

    number: int
    created_at: str
    reason: str
    tables: dict[str, TableState]
    marks: dict[str, int] = field(default_factory=dict)
    of: int | None = None

    def to_json(self) -> str:
        tables = {n: {"schema": t.schema, "key": t.key, "n_parts": t.n_parts, "parts": [[p.path, p.rows, p.checksum] for p in t.parts]} for n, t in self.tables.items()}
        return json.dumps({"number": self.number, "created_at": self.created_at, "reason": self.reason, "of": self.of, "marks": self.marks, "tables": tables})

    @staticmethod
    def from_json(text: str) -> Version:
        m = json.loads(text)
        tables = {n: TableState(t["schema"], t["key"], t["n_parts"], tuple(Part(*p) for p in t["parts"])) for n, t in m["tables"].items()}
        return Version(m["number"], m["created_at"], m["reason"], tables, m["marks"], m["of"])


def _plain(df: DataFrame, name: str) -> Column:
    """A column as a hash takes it: nested values as text, so that nulls within count."""
    if isinstance(df.schema[name].dataType, T.ArrayType | T.StructType | T.MapType):
        stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        column = F.array_sort(F.map_entries(name)) if isinstance(df.schema[name].dataType, T.MapType) else F.col(f"`{name}`")
        return F.to_json(column, {"ignoreNullFields": "false", "timestampFormat": stamp + "XXX", "timestampNTZFormat": stamp})
    return F.col(f"`{name}`")


def checksums(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows and checksum of a table's contents in whatever order, for each value of ``by``.

    Two 64-bit hashes of each row are summed, so repeated rows count; a null differs from any value.
    """
    names = [c for c in df.columns if c not in (by or [])]
    values = [x for c in names for x in (F.col(f"`{c}`").isNull(), _plain(df, c))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)")).alias(f"_{seed}") for seed in (1, 2)]
    out = df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *sums)
    return out.select(*(by or []), "rows", F.substring(F.sha2(F.concat_ws(":", "rows", F.coalesce("_1", F.lit(0)), F.coalesce("_2", F.lit(0))), 256), 1, 32).alias("checksum"))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


class Store:
    """Versioned tables at ``path``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Reading.

    def numbers(self) -> list[int]:
        return [int(n) for n in names_in(self.spark, f"{self.path}/versions")]

    def version(self, number: int | None = None) -> Version | None:
        """A version's manifest; the last one's by default, None if there is none yet."""
        numbers = self.numbers()
        if number is None:
            number = numbers[-1] if numbers else None
        elif number not in numbers:
            raise LookupError(f"no version {number}: it was never made or is pruned")
        return None if number is None else Version.from_json(read_text(self.spark, self._place(number) + "/manifest.json"))

    def versions(self) -> list[Version]:
        """All manifests, the last first."""
        return [self.version(n) for n in reversed(self.numbers())]

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as a version has it; KeyError if it hasn't."""
        version = self.version(number)
        state = (version.tables if version else {})[table]
        return self._frame(state, state.parts)

    def _frame(self, state: TableState, parts: Iterable[Part]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state.schema))
        paths = [f"{self.path}/parts/{p.path}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def mark(self, source: str) -> int | None:
        """The number of the last batch committed from a source."""
        version = self.version()
        return version.marks.get(source) if version else None

    def changes(self, table: str, old: int, new: int, key: str) -> DataFrame:
        """key and change (added, updated, removed) between two versions; only parts that differ are read."""
        from quillon.operators.versions import diff

        a, b = (self.version(n).tables[table] for n in (old, new))
        both = {p.path for p in a.parts} & {p.path for p in b.parts}
        sides = []
        for state in (a, b):
            df = self._frame(state, [p for p in state.parts if p.path not in both])
            rest = [c for c in df.columns if c != key]
            values = [x for c in rest for x in (F.col(f"`{c}`").isNull(), _plain(df, c))]
            sides.append(df.select(key, F.xxhash64(*values).alias("content_hash")))
        return diff(*sides, key).filter("change <> 'same'")

    # Writing.

    def commit(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        keys: dict[str, str] | None = None,
        n_parts: int = 64,
        reason: str = COMMIT,
        batch: tuple[str, int] | None = None,
    ) -> int | None:
        """One new version with all the given tables, the others as they were; its number, or None if there was nothing to do.

        A replaced table is dealt out to ``n_parts`` parts by a hash of its key (all columns, unless ``keys`` names one or it
        had one), and only parts with new contents are kept. Appended rows become a part of their own. ``batch`` is a source
        and a number: a batch whose number isn't beyond the last one committed from that source changes nothing.
        """
        base = self.version()
        if batch and base and base.marks.get(batch[0], -1) >= batch[1]:
            return None
        tables = dict(base.tables) if base else {}
        for name, df in (replace or {}).items():
            before = tables.get(name)
            tables[name] = self._written(name, df, (keys or {}).get(name, before.key if before else None), n_parts)
        for name, df in (append or {}).items():
            state = tables.get(name) or TableState(df.schema.json(), (keys or {}).get(name), n_parts, ())
            if T.StructType.fromJson(json.loads(state.schema)).simpleString() != df.schema.simpleString():
                raise ValueError(f"{name}: the rows to append have other columns")
            tables[name] = TableState(state.schema, state.key, state.n_parts, state.parts + self._appended(name, df))
        return self._publish(base, tables, reason, {batch[0]: batch[1]} if batch else {})

    def rollback(self, number: int) -> int:
        """Make a kept version's tables the present ones, as a new version; marks stay, so old batches are not taken again."""
        return self._publish(self.version(), self.version(number).tables, ROLLBACK, {}, of=number)

    def compact(self, table: str, n_parts: int | None = None) -> int | None:
        """Deal a table with many appended parts out anew."""
        state = self.version().tables[table]
        return self.commit({table: self.read(table)}, n_parts=n_parts or state.n_parts, reason="compact")

    def prune(self, keep: int = 5, grace_seconds: float = 86_400) -> list[int]:
        """Delete all but the last ``keep`` versions (one at least), and parts that none of the rest holds; the deleted numbers.

        Parts younger than the grace may belong to a commit on its way and stay.
        """
        old = self.numbers()[: -max(1, keep)]
        for n in old:
            remove(self.spark, self._place(n))
        held = {p.path for v in self.versions() for t in v.tables.values() for p in t.parts}
        fs, root = file_system(self.spark, f"{self.path}/parts")
        latest = datetime.now(timezone.utc).timestamp() - grace_seconds
        for table in names_in(self.spark, f"{self.path}/parts"):
            for status in fs.listStatus(file_system(self.spark, f"{self.path}/parts/{table}")[1]):
                if f"{table}/{status.getPath().getName()}" not in held and status.getModificationTime() / 1000 <= latest:
                    fs.delete(status.getPath(), True)
        return old

    def damaged(self, number: int | None = None) -> list[str]:
        """Parts of a version whose contents aren't what its manifest says; every row is read once."""
        out = []
        for state in self.version(number).tables.values():
            for part in state.parts:
                try:
                    row = checksums(self._frame(state, [part])).first()
                    good = (row["rows"], row["checksum"]) == (part.rows, part.checksum)
                except Exception:  # unreadable or gone
                    good = False
                if not good:
                    out.append(part.path)
        return out

    def _place(self, number: int) -> str:
        return f"{self.path}/versions/{number:010d}"

    def _written(self, name: str, df: DataFrame, key: str | None, n_parts: int) -> TableState:
        by = [key] if key else df.columns
        values = [x for c in by for x in (F.col(f"`{c}`").isNull(), _plain(df, c))]
        staged = f"{self.path}/_pending-{uuid.uuid4().hex}"
        # Rebalancing lets adaptive execution split a part that one key fills.
        df.withColumn("_part", F.pmod(F.xxhash64(*values), F.lit(n_parts)).cast("int")).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(staged)
        sums = checksums(self.spark.read.schema(T.StructType([*df.schema, T.StructField("_part", T.IntegerType())])).parquet(staged), ["_part"]).orderBy("_part").collect()
        parts = []
        for r in sums:
            path = f"{name}/{r['_part']:06d}of{n_parts:06d}-{r['checksum']}"
            if not rename_once(self.spark, f"{staged}/_part={r['_part']}", f"{self.path}/parts/{path}"):
                self._touch(path)  # the same contents are there already
            parts.append(Part(path, r["rows"], r["checksum"]))
        remove(self.spark, staged)
        return TableState(df.schema.json(), key, n_parts, tuple(parts))

    def _touch(self, path: str) -> None:
        """Make a part young, so that no pruning takes it before the commit that shares it is out."""
        fs, target = file_system(self.spark, f"{self.path}/parts/{path}")
        fs.setTimes(target, int(datetime.now(timezone.utc).timestamp() * 1000), -1)

    def _appended(self, name: str, df: DataFrame) -> tuple[Part, ...]:
        staged = f"{self.path}/_pending-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        r = checksums(self.spark.read.schema(df.schema).parquet(staged)).first()
        if not r["rows"]:
            remove(self.spark, staged)
            return ()
        path = f"{name}/added-{uuid.uuid4().hex[:12]}-{r['checksum']}"  # the same rows may come twice
        rename_once(self.spark, staged, f"{self.path}/parts/{path}")
        return (Part(path, r["rows"], r["checksum"]),)

    def _publish(self, base: Version | None, tables: dict[str, TableState], reason: str, marks: dict[str, int], of: int | None = None) -> int:
        number = base.number + 1 if base else 1
        version = Version(number, _now(), reason, tables, {**(base.marks if base else {}), **marks}, of)
        pending = f"{self.path}/_pending-{uuid.uuid4().hex}"
        write_text(self.spark, f"{pending}/manifest.json", version.to_json())
        if not rename_once(self.spark, pending, self._place(number)):
            raise Conflict(f"version {number} was made by another writer")
        return number


# Backups: the present tables of a store, copied whole into a folder of their own.

MANUAL, AUTOMATIC, BEFORE_RESTORE = "manual", "automatic", "pre-restore"


@dataclass(frozen=True)
class Backup:
    """A complete copy: its name, when and why it was made, its rows and its bytes."""

    name: str
    created_at: str
    reason: str
    rows: int
    bytes: int


def back_up(store: Store, folder: str, reason: str = MANUAL) -> str:
    """Copy a store's present version into ``folder``; the backup's name. It appears whole, by one rename."""
    present = store.version()
    if present is None:
        raise ValueError("the store is empty")
    spark = store.spark
    name = f"{_now().replace(':', '-').replace('.', '-').replace('+', '_')}-{uuid.uuid4().hex[:6]}-{reason}"
    pending = f"{folder.rstrip('/')}/_pending-{uuid.uuid4().hex}"
    copy = Store(spark, pending)
    tables = {}
    for table, state in present.tables.items():
        tables[table] = copy._written(table, store._frame(state, state.parts), state.key, state.n_parts)
    copy._publish(None, tables, reason, present.marks, of=present.number)
    rename_once(spark, pending, f"{folder.rstrip('/')}/{name}")
    return name


def backups(spark: SparkSession, folder: str) -> list[Backup]:
    """All complete backups of a folder, the last first; what broke off isn't one."""
    out = []
    for name in reversed([n for n in names_in(spark, folder) if not n.startswith("_")]):
        place = f"{folder.rstrip('/')}/{name}"
        version = Store(spark, place).version()
        if version:
            fs, target = file_system(spark, place)
            out.append(Backup(name, version.created_at, version.reason, sum(t.rows for t in version.tables.values()), fs.getContentSummary(target).getLength()))
    return out


def validate(spark: SparkSession, folder: str, name: str, needed: Iterable[str] = ()) -> None:
    """ValueError unless a backup is one of the folder, has the needed tables, and every row of it is as it was written."""
    if name not in [b.name for b in backups(spark, folder)]:
        raise ValueError(f"no backup {name} in this folder")
    copy = Store(spark, f"{folder.rstrip('/')}/{name}")
    missing = set(needed) - set(copy.version().tables)
    if missing:
        raise ValueError(f"the backup has no {sorted(missing)}")
    if damaged := copy.damaged():
        raise ValueError(f"damaged: {damaged}")


def restore(store: Store, folder: str, name: str, needed: Iterable[str] = ()) -> int:
    """Put a backup's tables in place of the present ones, after validating it and backing these up; the new version.

    Until the one rename at the end the store stays as it is, whatever breaks off; tables that the backup hasn't got go.
    """
    validate(store.spark, folder, name, needed)
    base = store.version()
    if base:
        back_up(store, folder, BEFORE_RESTORE)
    copy = Store(store.spark, f"{folder.rstrip('/')}/{name}")
    version = copy.version()
    tables = {t: store._written(t, copy._frame(s, s.parts), s.key, s.n_parts) for t, s in version.tables.items()}
    return store._publish(base, tables, f"restore {name}", {k: n for k, n in version.marks.items() if k not in (base.marks if base else {})})


def prune_backups(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all but the last ``keep`` backups (one at least); their names."""
    old = [b.name for b in backups(spark, folder)[max(1, keep) :]]
    for name in old:
        remove(spark, f"{folder.rstrip('/')}/{name}")
    return old
