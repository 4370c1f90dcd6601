"""A keyed table of a base and the changes since, merged when it is read.

Rows lie in buckets by the hash of their key, in the base and in every delta. A version is
one append of changed rows; its manifest names the base and the deltas it consists of and
is written last, so a version without manifest does not exist for readers. A batch that runs
again writes its version anew from the version below it, with the same rows.

Reading takes the newest row of a key. Only keys and versions of the deltas are compared,
and the base meets the keys that changed, so a small delta does not make a large base
shuffle. A lookup opens the buckets of its keys alone. Compaction writes the rows of a
version as a new base; the version's rows stay the same.

Below the root: version=N/bucket=B (bases), delta/version=N/bucket=B, manifest/version=N and
manifest/version=N.compact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders of bases and deltas.
BASE, DELTA = ".", "delta"
_MANIFEST = "version bigint, base bigint, deltas array<bigint>, buckets int, rows bigint"


@dataclass(frozen=True)
class Manifest:
    version: int
    base: int | None
    deltas: tuple[int, ...]
    buckets: int
    rows: int


class DeltaTable:
    """Rows of `schema` by `key`, which is unique within a version and never null."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self._buckets = spark, root.rstrip("/"), schema, key, buckets
        self._stored = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def _folder(self, name: str) -> str:
        return self.root if name == BASE else f"{self.root}/{name}"

    # --- versions ---------------------------------------------------------------

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str, done: bool = True) -> list[str]:
        fs, path = self._files()
        where = path(self._folder(folder))
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return [n for n in names if n.startswith("version=") and (not done or fs.exists(path(f"{self._folder(folder)}/{n}/_SUCCESS")))]

    def versions(self) -> list[int]:
        return sorted({int(re.match(r"version=(\d+)", n).group(1)) for n in self._names("manifest")})

    def latest(self, below: int | None = None) -> int | None:
        done = [v for v in self.versions() if below is None or v < below]
        return done[-1] if done else None

    def manifest(self, version: int | None) -> Manifest:
        """What a version consists of; its compacted form where there is one. None is the empty table."""
        if version is None:
            return Manifest(0, None, (), self._buckets, 0)
        names = self._names("manifest")
        name = f"version={version}.compact" if f"version={version}.compact" in names else f"version={version}"
        if name not in names:
            raise ValueError(f"no version {version} below {self.root}")
        row = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/{name}").first()
        return Manifest(row["version"], row["base"], tuple(row["deltas"]), row["buckets"], row["rows"])

    def _commit(self, m: Manifest, name: str) -> Manifest:
        row = self.spark.createDataFrame([(m.version, m.base, list(m.deltas), m.buckets, m.rows)], _MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{name}")
        return m

    # --- reading ----------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _part(self, folder: str, versions: list[int], only: list[int] | None) -> DataFrame:
        top = self._folder(folder)
        rows = self.spark.read.schema(self._stored).option("basePath", top).parquet(*[f"{top}/version={v}" for v in versions])
        return rows if only is None else rows.filter(F.col("bucket").isin(only))

    def _merged(self, m: Manifest, only: list[int] | None) -> DataFrame:
        columns = [f.name for f in self.schema.fields]
        if m.base is None and not m.deltas:
            return self.spark.createDataFrame([], self.schema)
        if not m.deltas:
            return self._part(BASE, [m.base], only).select(*columns)
        changes = self._part(DELTA, list(m.deltas), only)
        if len(m.deltas) > 1:
            newest = changes.groupBy("bucket", self.key).agg(F.max("version").alias("version"))
            changes = changes.join(newest, ["bucket", self.key, "version"], "left_semi")
        if m.base is None:
            return changes.select(*columns)
        # Keys alone: bodies of the deltas are read once, by the union.
        changed = self._part(DELTA, list(m.deltas), only).select("bucket", self.key).distinct()
        untouched = self._part(BASE, [m.base], only).join(changed, ["bucket", self.key], "left_anti")
        return untouched.select(*columns).unionByName(changes.select(*columns))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; no version at all is the empty table."""
        return self._merged(self.manifest(self.latest() if version is None else version), None)

    def read_below(self, version: int) -> DataFrame:
        """The rows of the version before `version`."""
        return self._merged(self.manifest(self.latest(below=version)), None)

    def lookup(self, keys: DataFrame, below: int | None = None) -> DataFrame:
        """The rows whose key is in `keys` (a column of the key's name), read from the buckets of these keys alone."""
        m = self.manifest(self.latest(below))
        wanted = keys.select(self.key).distinct()
        # At most one number per bucket.
        only = [r[0] for r in wanted.select(self._bucket(m.buckets)).distinct().collect()]
        return self._merged(m, only).join(wanted, self.key, "left_semi")

    # --- writing ----------------------------------------------------------------

    def _write(self, rows: DataFrame, folder: str, version: int, buckets: int) -> int:
        path = f"{self._folder(folder)}/version={version}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema.fields]
        rows.select(*columns).withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        plain = T.StructType([f for f in self._stored.fields if f.name != "version"])
        return self.spark.read.schema(plain).parquet(path).count()

    def append(self, changes: DataFrame, version: int) -> Manifest:
        """`version` is the version below it with `changes` instead of or beside its rows. Writes the changes alone."""
        before = self.manifest(self.latest(below=version))
        rows = self._write(changes, DELTA, version, before.buckets)
        deltas = (*before.deltas, version) if rows else before.deltas
        return self._commit(Manifest(version, before.base, deltas, before.buckets, rows), f"version={version}")

    def replace(self, rows: DataFrame, version: int) -> Manifest:
        """`version` holds `rows` and nothing else: a first load, or a rewrite of all rows."""
        buckets = self.manifest(self.latest(below=version)).buckets
        return self._commit(Manifest(version, version, (), buckets, self._write(rows, BASE, version, buckets)), f"version={version}")

    def compact(self, buckets: int | None = None) -> Manifest:
        """The latest version's rows as a base of their own, in `buckets` buckets where another number is wanted."""
        version = self.latest()
        m = self.manifest(version)
        if version is None or (not m.deltas and buckets in (None, m.buckets)):
            return m
        number = buckets or m.buckets
        rows = self._write(self._merged(m, None), BASE, version, number)
        return self._commit(Manifest(version, version, (), number, rows), f"version={version}.compact")

    def expire(self, keep: int = 2) -> list[str]:
        """Delete what no manifest of the last `keep` versions names, manifests first; returns the paths."""
        if keep < 1:
            raise ValueError("one version at least must stay")
        kept = self.versions()[-keep:]
        manifests = [self.manifest(v) for v in kept]
        used = {f"{BASE}/version={m.base}" for m in manifests} | {f"{DELTA}/version={d}" for m in manifests for d in m.deltas}
        names = self._names("manifest")
        # A compacted version is read by its compacted manifest, the plain one may name expired deltas.
        old = [f"manifest/{n}" for n in names if int(re.match(r"version=(\d+)", n).group(1)) not in kept or f"{n}.compact" in names]
        data = [f"{folder}/{n}" for folder in (BASE, DELTA) for n in self._names(folder, done=False)]
        last = max(kept, default=0)
        # Data above the last version belong to a batch that has not committed yet.
        old += [d for d in data if d not in used and int(d.rsplit("=", 1)[1]) <= last]
        fs, path = self._files()
        for name in old:
            folder, version = name.rsplit("/", 1)
            fs.delete(path(f"{self._folder(folder)}/{version}"), True)
        return old
