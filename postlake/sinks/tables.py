"""Tables that a run changes together: rows are upserted by key, bucket by bucket, and a manifest makes a change visible.

A table's rows lie in buckets by the hash of their key. A commit rewrites the buckets that it touches into
folders of its own and then writes one small file, its manifest, that says which folder each bucket of each table is in.
Readers go by the newest manifest, so they see all of a commit or nothing of it, and what a run that died left is never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlake.plans.stages import staged

MANIFEST = "run_id string, name string, bucket int, folder long, keys string, schema string, version long"


class Tables:
    """Tables under ``path``, each in ``buckets`` buckets: as many as keep a bucket at some hundred MB.

    One run commits at a time. The number of buckets is that of the first commit of a table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifests(self) -> DataFrame:
        """All manifests: a row per commit, table and bucket that has rows."""
        folder, files = self._folder(f"{self.path}/manifest")
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest") if files.exists(folder) else self.spark.createDataFrame([], MANIFEST)

    def _folder(self, path: str) -> tuple:
        """A path and its file system."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> list:
        """Rows of the newest manifest: as many as the tables have buckets."""
        every = self.manifests()
        last = every.agg(F.max("version").alias("v")).first()["v"]
        return [] if last is None else every.where(F.col("version") == last).collect()

    def version_of(self, run_id: str) -> int | None:
        row = self.manifests().where(F.col("run_id") == run_id).select("version").first()
        return row and row["version"]

    def _load(self, rows: Iterable, schema: StructType) -> DataFrame:
        rows = list(rows)
        if not rows:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{r['name']}/folder={r['folder']}/bucket={r['bucket']}" for r in rows]
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """A table as of the newest commit; of one that no commit has, no rows of ``schema``."""
        rows = [r for r in self._newest() if r["name"] == name]
        if not rows and schema is None:
            raise ValueError(f"no commit has a table {name}")
        return self._load((r for r in rows if r["bucket"] >= 0), StructType.fromJson(json.loads(rows[0]["schema"])) if rows else schema)

    def lookup(self, name: str, among: DataFrame, schema: StructType) -> DataFrame:
        """The rows of a table in the buckets that rows ``among`` fall in, by the table's bucket columns: all that can equal them, and few more.

        Of the table only those buckets are read. A table that no commit has gives no rows of ``schema``.
        """
        rows = [r for r in self._newest() if r["name"] == name]
        if not rows:
            return self.spark.createDataFrame([], schema)
        by, buckets = json.loads(rows[0]["keys"])["by"], next(r["folder"] for r in rows if r["bucket"] < 0)
        wanted = {r["b"] for r in among.select(F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("b")).distinct().collect()}
        return self._load((r for r in rows if r["bucket"] in wanted), StructType.fromJson(json.loads(rows[0]["schema"])))

    def commit(self, run_id: str, changes: dict[str, tuple]) -> int:
        """Upsert rows by key into several tables at once: ``changes`` has, per table, rows and key columns, of which no two rows are equal.

        Buckets go by the key, or by those of its columns that stand third. Of a row with a known key the new one stays; columns that either lacks are null. Buckets without a change keep their folder.
        A run that has committed already changes nothing. Returns the version that holds the run.
        """
        done = self.version_of(run_id)
        if done is not None:
            return done
        now = self._newest()
        version = max((r["version"] for r in now), default=0) + 1
        # a row of bucket -1 keeps the keys and schema of a table, be it empty
        places = {(r["name"], r["bucket"]): r["folder"] for r in now}
        shapes = {r["name"]: (r["keys"], r["schema"]) for r in now}
        for name, (rows, keys, *more) in changes.items():
            by = more[0] if more else keys
            shape = json.dumps({"keys": keys, "by": by})
            known = StructType.fromJson(json.loads(shapes[name][1])) if name in shapes else rows.schema
            if name in shapes and shapes[name][0] != shape:
                raise ValueError(f"the key of {name} is {shapes[name][0]}")
            bucket = F.pmod(F.xxhash64(*by), F.lit(self._buckets(places, name))).cast("int")
            new = staged(rows.withColumn("bucket", bucket), f"{name}-changes")
            # at most the number of buckets
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
            old = self._load((r for r in now if r["name"] == name and r["bucket"] in touched), known)
            match = [old[k].eqNullSafe(new[k]) for k in keys]
            kept = old.join(new.select(*keys), match, "left_anti").withColumn("bucket", bucket)
            merged = kept.unionByName(new, allowMissingColumns=True)
            merged.repartition(len(touched) or 1, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/{name}/folder={version}")
            places |= {(name, b): version for b in touched} | {(name, -1): self._buckets(places, name)}
            shapes[name] = shape, StructType([f for f in merged.schema.fields if f.name != "bucket"]).json()
        rows = [(run_id, name, b, folder, *shapes[name], version) for (name, b), folder in places.items()]
        # one file, which is renamed into place
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/commit={version}")
        return version

    def _buckets(self, places: dict, name: str) -> int:
        return places.get((name, -1), self.buckets)

    def expire(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` manifests names, and older manifests; returns how many buckets went."""
        every = self.manifests().collect()  # a row per commit since the last call, table and bucket
        last = sorted({r["version"] for r in every})[-keep:]
        live = {(r["name"], r["folder"], r["bucket"]) for r in every if r["version"] in last}
        dead = {(r["name"], r["folder"], r["bucket"]) for r in every if r["bucket"] >= 0} - live
        old = [f"{self.path}/manifest/commit={v}" for v in {r["version"] for r in every} - set(last)]
        # manifests first, so that no reader goes by one whose folders are gone
        for path in [*old, *(f"{self.path}/data/{name}/folder={folder}/bucket={bucket}" for name, folder, bucket in dead)]:
            folder, files = self._folder(path)
            files.delete(folder, True)
        return len(dead)
