"""A table store for resumable stages: manifests, fingerprints, completed parts, failures.

A run is named by the hash of its configuration and refuses to resume under another. Each stage keeps
its parts as partitions of one Parquet table plus one manifest row per part with count and checksum;
what is left to do is an anti-join of the plan with the manifest.
"""

from __future__ import annotations

import hashlib
import json
import traceback
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import files_under, path_exists, read_text, write_text_atomic


def stable_hash(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def checksum(df: DataFrame, *by: str) -> DataFrame:
    """(by, n_rows, checksum): a sum of row hashes, independent of order and partitioning."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("checksum"))


class StageStore:
    """Stages of one run under ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path = spark, path.rstrip("/")
        fingerprint = stable_hash(config)
        known = read_text(spark, f"{self.path}/run.json")
        if known is None:
            write_text_atomic(spark, f"{self.path}/run.json", json.dumps({"fingerprint": fingerprint, "config": config}, default=str))
        elif json.loads(known)["fingerprint"] != fingerprint:
            raise ValueError(f"{self.path} belongs to a run with another configuration")

    def _data(self, stage: str) -> str:
        return f"{self.path}/{stage}/data"

    def _manifest(self, stage: str) -> str:
        return f"{self.path}/{stage}/manifest"

    def manifest(self, stage: str, key: list[str]) -> DataFrame | None:
        """The last manifest row of each part."""
        if not path_exists(self.spark, self._manifest(stage)):
            return None
        rows = self.spark.read.parquet(self._manifest(stage))
        return rows.groupBy(*key).agg(F.max_by(F.struct("n_rows", "checksum"), "written_at").alias("m")).select(*key, "m.*")

    def begin(self, stage: str, plan: DataFrame, key: list[str]) -> None:
        """Bind a stage to its plan: a stage begun with another plan is refused, and so are parts on disk that no manifest names."""
        sums = checksum(plan.select(*key).distinct()).first()
        found = {"n_parts": sums["n_rows"], "checksum": str(sums["checksum"])}
        known = read_text(self.spark, f"{self.path}/{stage}/plan.json")
        if known is None:
            write_text_atomic(self.spark, f"{self.path}/{stage}/plan.json", json.dumps(found))
        elif json.loads(known) != found:
            raise ValueError(f"{stage} was begun with another plan: {known}, now {found}")
        if self.manifest(stage, key) is None and path_exists(self.spark, self._data(stage)) and not self.read(stage).isEmpty():
            raise ValueError(f"{stage} has parts that no manifest names")

    def remaining(self, stage: str, plan: DataFrame, key: list[str], force: DataFrame | None = None, verify: bool = True) -> DataFrame:
        """Parts of the plan without a valid manifest row; ``force`` names parts to do again.

        With ``verify`` a part whose rows no longer match its manifest row counts as not done and is
        recorded as a failure; without, the manifest is trusted and no data is read.
        """
        done = self.manifest(stage, key)
        if done is None:
            return plan
        if verify:
            have = checksum(self.read(stage), *key).withColumnRenamed("n_rows", "n").withColumnRenamed("checksum", "c")
            broken = done.join(have, key, "left").where("coalesce(n, 0) <> n_rows or coalesce(c, 0) <> checksum").select(*key).cache()
            for r in broken.limit(30).collect():
                self.record_failure(stage, str(tuple(r)), ValueError("rows do not match the manifest"))
            done = done.join(broken, key, "left_anti")
        if force is not None:
            done = done.join(force.select(*key), key, "left_anti")
        return plan.join(done.select(*key), key, "left_anti")

    def commit(self, stage: str, rows: DataFrame, parts: DataFrame, key: list[str]) -> None:
        """Write the rows of ``parts`` (replacing earlier rows of these parts), then their manifest rows.

        A part without rows is a finished part of zero rows. The manifest comes last: a failure in
        between leaves the parts undone, and the next run replaces what was written.
        """
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(self._data(stage))
        written = self.spark.read.parquet(self._data(stage)) if path_exists(self.spark, self._data(stage)) else rows
        sums = checksum(written.join(parts.select(*key).distinct(), key, "left_semi"), *key)
        stamp = datetime.now(timezone.utc).isoformat()
        parts.select(*key).distinct().join(sums, key, "left").select(*key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("checksum", F.lit(0)).cast("decimal(38,0)").alias("checksum"), F.lit(stamp).alias("written_at")).write.mode("append").parquet(self._manifest(stage))

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self._data(stage))

    def invalid_parts(self, stage: str, plan: DataFrame, key: list[str]) -> DataFrame:
        """(key, error) of planned parts that are missing or whose rows do not match the manifest, and of orphans."""
        done = self.manifest(stage, key)
        if done is None:
            return plan.select(*key, F.lit("missing").alias("error"))
        have = checksum(self.read(stage), *key).withColumnRenamed("n_rows", "n").withColumnRenamed("checksum", "c")
        missing = plan.select(*key).join(done, key, "left_anti").select(*key, F.lit("missing").alias("error"))
        broken = done.join(have, key, "left").where("coalesce(n, 0) <> n_rows or coalesce(c, 0) <> checksum").select(*key, F.lit("corrupt").alias("error"))
        orphan = done.join(plan.select(*key), key, "left_anti").select(*key, F.lit("orphan").alias("error"))
        return missing.union(broken).union(orphan)

    def finalize(self, stage: str, plan: DataFrame, key: list[str]) -> DataFrame:
        """The whole stage, or an error that names the first thirty bad parts."""
        bad = self.invalid_parts(stage, plan, key).limit(30).collect()
        if bad:
            raise ValueError("; ".join(f"{tuple(r)[:-1]}: {r['error']}" for r in bad))
        return self.read(stage)

    def failures(self, stage: str) -> list[dict]:
        """The recorded failures of a stage, the oldest first."""
        folder = f"{self.path}/{stage}/failures"
        return [json.loads(read_text(self.spark, f)) for f in files_under(self.spark, folder)]

    def record_failure(self, stage: str, part: str, error: BaseException) -> None:
        stamp = datetime.now(timezone.utc)
        body = {"stage": stage, "part": part, "error": repr(error), "traceback": "".join(traceback.format_exception(error)), "at": stamp.isoformat()}
        write_text_atomic(self.spark, f"{self.path}/{stage}/failures/{stamp:%Y%m%dT%H%M%S%f}.json", json.dumps(body))

    def read_or_build(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, built and written first where it is missing."""
        folder = f"{self.path}/tables/{name}"
        if not path_exists(self.spark, f"{folder}/_SUCCESS"):
            try:
                build().write.mode("overwrite").parquet(folder)
            except Exception as error:
                self.record_failure(name, "table", error)
                raise
        return self.spark.read.parquet(folder)


def cache_key(*columns: str):
    """Content address of a row to be scored."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def score_with_cache(rows: DataFrame, cache: DataFrame | None, key: str, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all payloads by key, new payloads): only distinct keys the cache lacks are scored; of repeated keys the newest counts.

    ``cache``: (key, payload_json, created_at_unix); ``score`` maps distinct missing rows to (key, payload_json).
    """
    wanted = rows.dropDuplicates([key])
    if cache is None:
        new = score(wanted)
        return new, new
    known = cache.groupBy(key).agg(F.max_by("payload_json", "created_at_unix").alias("payload_json"))
    new = score(wanted.join(known, key, "left_anti"))
    hits = wanted.select(key).join(known, key)
    return hits.union(new.select(key, "payload_json")), new


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that stand more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_references(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``child`` that ``parent`` lacks; keys with a null refer to nothing."""
    known = child.select(*key).dropna().distinct()
    return known.join(parent.select(*key).distinct(), key, "left_anti")


def require_empty(df: DataFrame, what: str, preview: int = 50) -> None:
    """Raise with the first rows of a table of violations."""
    rows = df.limit(preview).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(tuple(r)) for r in rows))
