"""A keyed table in buckets: merging rows rewrites the buckets of their keys, and no others.

A commit writes new files for the buckets it touches and then a manifest, which says for every bucket which commit's files are its rows.  Readers take the
newest manifest, so they see a whole commit or none of it; a commit that was made before is not made again, so a batch that is retried changes nothing.
Only one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The value of a column after a merge, of (the column's name, old value, new value, whether there was a row before, whether there is one now).
Rule = Callable[[str, Column, Column, Column, Column], Column]


def replaced(name: str, old: Column, new: Column, had: Column, has: Column) -> Column:
    """New rows take the place of old ones."""
    return F.when(has, new).otherwise(old)


def filled(name: str, old: Column, new: Column, had: Column, has: Column) -> Column:
    """New values that are not null or empty take the place of old ones."""
    return F.coalesce(F.when(new.cast("string") != "", new), old)


def absent_only(name: str, old: Column, new: Column, had: Column, has: Column) -> Column:
    """Old rows stay as they are; only keys that were not there are added."""
    return F.when(had, old).otherwise(new)


class Buckets:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, n: int = 64) -> None:
        self.spark, self.path, self.keys, self.n = spark, path, keys, n
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _fs(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def commits(self) -> list[tuple[int, str]]:
        """(number, name) of all commits, in order."""
        fs, path = self._fs("manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        whole = [n for n in names if self._fs("manifests", n, "_SUCCESS")[0].exists(self._fs("manifests", n, "_SUCCESS")[1])]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in whole)

    def manifest(self) -> dict[int, str]:
        """Whose files hold each bucket; at most ``n`` rows."""
        done = self.commits()
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, files string").json(f"{self.path}/manifests/{done[-1][0]:08d}-{done[-1][1]}").collect()
        return {r.bucket: r.files for r in rows}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = {b: f for b, f in self.manifest().items() if buckets is None or b in buckets}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{files}/bucket={b}" for b, files in sorted(held.items())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def merge(self, rows: DataFrame, commit: str, rule: Rule = replaced) -> list[int]:
        """Merge rows (one a key) as a commit of this name; the buckets that were written, none if it was made before."""
        done = self.commits()
        if commit in [name for _, name in done]:
            return []
        new = rows.select(*self.columns).withColumn("bucket", self.bucket())
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most n
        held = self.manifest()
        old = self.read([b for b in touched if b in held]).withColumn("bucket", self.bucket())
        left, right = old.withColumn("had", F.lit(True)).alias("l"), new.withColumn("has", F.lit(True)).alias("r")
        same = F.col("l.bucket") == F.col("r.bucket")
        for k in self.keys:
            same = same & F.equal_null(F.col(f"l.{k}"), F.col(f"r.{k}"))
        had, has = F.coalesce(F.col("l.had"), F.lit(False)), F.coalesce(F.col("r.has"), F.lit(False))
        merged = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) if c in self.keys else rule(c, F.col(f"l.{c}"), F.col(f"r.{c}"), had, has).alias(c) for c in self.columns]
        out = left.join(right, same, "full_outer").select(*merged, F.coalesce("l.bucket", "r.bucket").alias("bucket"))
        number = done[-1][0] + 1 if done else 0
        files = f"files/{number:08d}-{commit}"
        out.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{files}")
        known = held | dict.fromkeys(touched, files)
        listed = self.spark.createDataFrame(sorted(known.items()) or [], "bucket int, files string")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/{number:08d}-{commit}")
        return touched

    def prune(self) -> None:
        """Delete files that the newest manifest does not name."""
        wanted = set(self.manifest().values())
        fs, path = self._fs("files")
        for s in fs.listStatus(path) if fs.exists(path) else ():
            if f"files/{s.getPath().getName()}" not in wanted:
                fs.delete(s.getPath(), True)
