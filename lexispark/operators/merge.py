"""Upserts on tables of key buckets, safe for parallel writers and slow readers.

A table is a folder of data files and a log of manifests.  A row's bucket is a hash of
its key; manifest n names the folders with each bucket's rows at version n.  A merge
writes the buckets that its keys fall into and leaves all others as they are.  It
commits by creating manifest n + 1, which works for one writer only.  A writer that
comes late looks at what the others changed: if none of its own buckets, its change
moves on top of theirs, else it merges again.  Keys are unique because every merge dedups before it writes.

Nothing is overwritten, so a table that was read stays readable.  ``vacuum`` deletes
what no manifest names that is among the latest, young or pinned.  Tables of an older
schema version are brought up to date when they are first read.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files

#: Attempts of a writer that others keep overtaking.
ATTEMPTS = 200


def latest(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``; ties go by the content, so that a rerun gives the same."""
    content = F.xxhash64(*[F.col(c) for c in rows.columns])
    w = Window.partitionBy(*keys).orderBy(*([] if order is None else [F.col(order).desc_nulls_last()]), content)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality on all keys, nulls being equal."""
    test = F.lit(True)
    for k in keys:
        test = test & a[k].eqNullSafe(b[k])
    return test


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys, and added."""
    fresh = latest(new, keys, order).select(*old.columns)
    return old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh)


@dataclass
class Manifest:
    """A version of a table: the folders of each bucket, and what the writer noted."""

    number: int = 0
    files: dict[int, list[str]] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"files": {str(b): f for b, f in sorted(self.files.items())}, "meta": self.meta})

    @classmethod
    def parsed(cls, number: int, text: str) -> Manifest:
        found = json.loads(text)
        return cls(number, {int(b): f for b, f in found["files"].items()}, found["meta"])


class Table:
    """A table under ``root/name``; ``migrations`` take rows of a schema version to the next one."""

    def __init__(
        self, spark: SparkSession, root: str, name: str, schema: str, keys: tuple[str, ...], version: int = 3, buckets: int = 16, keep: int = 20,
        migrations: dict[int, Callable[[DataFrame], DataFrame]] | None = None,
    ):
        self.spark, self.path, self.schema, self.keys = spark, f"{root.rstrip('/')}/{name}", schema, list(keys)
        self.version, self.buckets, self.keep, self.migrations = version, buckets, keep, migrations or {}
        self.series = f"s{version}"
        self.files = Files(spark, self.path)

    # -- reading

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def versions(self, series: str | None = None) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{series or self.series}/log") if n[:-5].isdigit() and n.endswith(".json")]

    def manifest(self, number: int | None = None) -> Manifest:
        """A version of the table, the current one by default; version 0 has no rows."""
        if number is None:
            known = self.versions()
            if not known and self._update():
                known = self.versions()
            number = known[-1] if known else 0
        return Manifest.parsed(number, self.files.read(f"{self.series}/log/{number:08d}.json")) if number else Manifest()

    def rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.empty()

    def read(self, number: int | None = None) -> DataFrame:
        m = self.manifest(number)
        return self.rows([f for b in sorted(m.files) for f in m.files[b]])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def lookup(self, keys: list[tuple]) -> DataFrame:
        """The rows of some keys; only their buckets are opened, and row groups are skipped by the order of keys in them."""
        types = [f for f in self.empty().schema.fields if f.name in self.keys]
        asked = self.spark.createDataFrame(keys, ", ".join(f"`{k}` {next(f for f in types if f.name == k).dataType.simpleString()}" for k in self.keys))
        wanted = {r[0] for r in asked.select(self.bucket()).collect()}  # one for each key asked
        m = self.manifest()
        test = F.lit(False)
        for row in keys:
            one = F.lit(True)
            for k, v in zip(self.keys, row, strict=True):
                one = one & (F.col(k) == F.lit(v))
            test = test | one
        return self.rows([f for b in sorted(wanted) for f in m.files.get(b, [])]).filter(test)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that left (_added false) or came (true) between two versions; reads the buckets that differ only."""
        a, b = self.manifest(since), self.manifest(until)
        moved = [k for k in sorted(a.files.keys() | b.files.keys()) if a.files.get(k) != b.files.get(k)]
        old, new = (self.rows([f for k in moved for f in m.files.get(k, [])]) for m in (a, b))
        print_ = lambda d: d.withColumn("_print", F.xxhash64(*[F.to_json(F.struct(c)) for c in d.columns]))
        old, new = print_(old), print_(new)
        test = same(old, new, self.keys) & (old["_print"] == new["_print"])
        gone = old.join(new, test, "left_anti").drop("_print").withColumn("_added", F.lit(False))
        return gone.unionByName(new.join(old, test, "left_anti").drop("_print").withColumn("_added", F.lit(True)))

    @contextmanager
    def pinned(self) -> Iterator[DataFrame]:
        """The current version, whose files stay until the block ends, however long that takes."""
        m = self.manifest()
        name = f"{self.series}/pins/{m.number}-{uuid.uuid4().hex}"
        self.files.write(name, "")
        try:
            yield self.read(m.number)
        finally:
            self.files.delete(name)

    # -- writing

    def _write(self, rows: DataFrame, n: int | None = None) -> tuple[str, list[int]]:
        """Rows in a folder for each bucket, sorted by key; returns the folder and its buckets."""
        folder = f"{self.series}/data/{uuid.uuid4().hex}"
        fields = self.empty().schema.fields
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).withColumn("_b", self.bucket())
        typed.repartition(n or self.buckets, "_b").sortWithinPartitions("_b", *self.keys).write.partitionBy("_b").parquet(f"{self.path}/{folder}")
        return folder, [int(x[3:]) for x in self.files.names(folder) if x.startswith("_b=")]

    def _commit(self, base: Manifest, changed: dict[int, list[str]], meta: dict | None = None) -> bool:
        files = {b: f for b, f in (base.files | changed).items() if f}
        number = base.number + 1
        done = self.files.create(f"{self.series}/log/{number:08d}.json", Manifest(number, files, base.meta if meta is None else meta).text())
        if done and number % self.keep == 0:
            self.vacuum()
        return done

    def _until_committed(self, build: Callable[[Manifest], dict[int, list[str]]], meta: Callable[[Manifest], dict] | None = None, append: bool = False) -> int:
        """Commit what ``build`` writes for a version; again whenever its buckets change under it.  Returns the new version."""
        base, changed = self.manifest(), None
        for attempt in range(ATTEMPTS):
            if changed is None:
                changed = build(base)
            added = {b: [*base.files.get(b, []), *f] for b, f in changed.items()} if append else changed
            if self._commit(base, added, meta(base) if meta else None):
                return base.number + 1
            time.sleep(random.random() * min(1.0, 0.02 * 2**attempt))
            now = self.manifest()
            if not append and any(now.files.get(b) != base.files.get(b) for b in changed):
                for f in {x.rpartition("/")[0] for own in changed.values() for x in own}:
                    self.files.delete(f)
                changed = None
            base = now
        raise RuntimeError(f"{self.path}: other writers were first {ATTEMPTS} times")

    def merge(self, new: DataFrame, order: str | None = None, gone: DataFrame | None = None, meta: Callable[[Manifest], dict] | None = None) -> int:
        """Rows of ``new`` replace those with their keys, or are added; keys of ``gone`` (and not in ``new``) leave.

        ``meta`` gives what the new version notes, or raises to give up.
        """
        staged, own = self._write(latest(new, self.keys, order))
        fresh = self.rows([f"{staged}/_b={b}" for b in own])
        out, lost = None, self.empty().select(*self.keys)
        if gone is not None:
            fields = {f.name: f.dataType for f in self.empty().schema.fields}
            out = f"{self.series}/data/{uuid.uuid4().hex}"
            gone.select(*[F.col(k).cast(fields[k]).alias(k) for k in self.keys]).distinct().withColumn("_b", self.bucket()).write.parquet(f"{self.path}/{out}")
            lost = self.spark.read.parquet(f"{self.path}/{out}")
            own = sorted({*own, *(r[0] for r in lost.select("_b").distinct().collect())})
            lost = lost.drop("_b")

        def build(base: Manifest) -> dict[int, list[str]]:
            held = [f for b in own for f in base.files.get(b, [])]
            if not held:
                return {b: [f"{staged}/_b={b}"] for b in own if f"_b={b}" in self.files.names(staged)}
            old, keys = self.rows(held), fresh.select(*self.keys).unionByName(lost)
            folder, there = self._write(old.join(keys, same(old, keys, self.keys), "left_anti").unionByName(fresh), len(own))
            return {b: [f"{folder}/_b={b}"] if b in there else [] for b in own}

        try:
            number = self._until_committed(build, meta) if own or meta else self.manifest().number
        finally:
            if out:
                self.files.delete(out)
        if not any(f.startswith(staged) for own_files in self.manifest(number).files.values() for f in own_files):
            self.files.delete(staged)
        return number

    def delete(self, keys: DataFrame) -> int:
        return self.merge(self.empty(), gone=keys)

    def replace(self, new: DataFrame, partition: list[str]) -> int:
        """Whole partitions are replaced by those of ``new``."""
        doomed = new.select(*partition).distinct()
        old = self.read()
        return self.merge(new, gone=old.join(doomed, same(old, doomed, partition), "left_semi"))

    def append(self, rows: DataFrame, meta: Callable[[Manifest], dict] | None = None) -> int:
        """Add rows without looking for their keys: files beside those that are there.  ``compact`` puts them together."""
        folder, own = self._write(rows)
        return self._until_committed(lambda _: {b: [f"{folder}/_b={b}"] for b in own}, meta, append=True)

    def compact(self, most: int = 1, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Buckets of more than ``most`` folders become one folder each, with the rows that ``keep`` leaves; the others stay."""
        def build(base: Manifest) -> dict[int, list[str]]:
            wide = [b for b, f in base.files.items() if len(f) > most]
            if not wide:
                return {}
            folder, there = self._write(keep(self.rows([f for b in wide for f in base.files[b]])), len(wide))
            return {b: [f"{folder}/_b={b}"] if b in there else [] for b in wide}

        return self._until_committed(build)

    def overwrite(self, rows: DataFrame, meta: dict | None = None) -> int:
        folder, own = self._write(rows)
        return self._until_committed(lambda base: dict.fromkeys(base.files, []) | {b: [f"{folder}/_b={b}"] for b in own}, None if meta is None else lambda _: meta)

    def note(self, meta: Callable[[Manifest], dict]) -> int:
        """Change what the manifest notes, and no rows."""
        return self._until_committed(lambda _: {}, meta)

    def clear(self) -> None:
        self.overwrite(self.empty())

    def vacuum(self, hours: float = 168.0) -> list[str]:
        """Delete old manifests and data: what is not of the latest ``keep`` versions, pinned, or younger than ``hours``."""
        now = time.time() * 1000
        known = self.versions()
        pins = {int(n.split("-")[0]) for n in self.files.names(f"{self.series}/pins")}
        old = [n for n in known[: -self.keep] if n not in pins and self.files.age_hours(f"{self.series}/log/{n:08d}.json", now) > hours]
        used = {f.split("/")[2] for n in known if n not in old for own in self.manifest(n).files.values() for f in own}
        dead = [n for n in self.files.names(f"{self.series}/data") if n not in used and self.files.age_hours(f"{self.series}/data/{n}", now) > hours]
        for n in old:
            self.files.delete(f"{self.series}/log/{n:08d}.json")
        for n in dead:
            self.files.delete(f"{self.series}/data/{n}")
        return dead

    # -- older schema versions

    def _older(self) -> tuple[int, DataFrame] | None:
        """Rows of the latest older series: of manifests, or of the folders s<version>-v<number> of the first layout."""
        names = self.files.names("")
        series = sorted((int(n[1:]) for n in names if n[:1] == "s" and n[1:].isdigit() and int(n[1:]) < self.version), reverse=True)
        for v in series:
            if known := self.versions(f"s{v}"):
                files = Manifest.parsed(known[-1], self.files.read(f"s{v}/log/{known[-1]:08d}.json")).files
                if folders := [f"{self.path}/{f}" for own in files.values() for f in own]:
                    return v, self.spark.read.option("mergeSchema", True).parquet(*folders)
        first = sorted(((int(n[1:].split("-v")[0]), n) for n in names if n[:1] == "s" and "-v" in n and "_SUCCESS" in self.files.names(n)), reverse=True)
        return next(((v, self.spark.read.parquet(f"{self.path}/{n}")) for v, n in first if v <= self.version), None)

    def _update(self) -> bool:
        """The rows of an older series as version 1 of this one; columns without a migration are null."""
        found = self._older()
        if found is None:
            return False
        version, rows = found
        for v in range(version, self.version):
            rows = self.migrations.get(v, lambda d: d)(rows)
        fields = self.empty().schema.fields
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        folder, own = self._write(latest(rows, self.keys))
        # of several readers that find the old series, one does it
        if not self._commit(Manifest(), {b: [f"{folder}/_b={b}"] for b in own}, {"migrated_from": version}):
            self.files.delete(folder)
        return True
