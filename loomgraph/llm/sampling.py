"""A sample that never forgets: permanent random numbers (problem 3).

Each identifier gets one uniform number when it is first seen. The draw depends on the batch in which
the identifier was first seen, so the number cannot be made up again later: it is written to a table
and looked up from then on. Later batches are anti-joined against the table and only unseen identifiers
are inserted. The sample is every identifier whose number lies under a threshold, and the threshold may
only rise, so a chosen identifier stays chosen whatever arrives later and however the data is split.

The store remembers its seed and every batch that it has taken in. Opening it under another seed, or
taking in a later batch where an earlier one is missing, is an error instead of a fresh draw.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import numbered, path_exists, read_text, write_text_atomic


def drawn_number(ident: Column, seed: str, batch: int) -> Column:
    """Uniform in [0, 1) with 48 bits, from an MD5 of seed, batch and identifier (a task that runs again draws the same)."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{batch}:"), ident.cast("string"))), 1, 12), 16, 10)
    return digits.cast("double") / F.lit(float(1 << 48))


class PermanentNumbers:
    """The persisted numbers of one kind of record, at ``path`` in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, ident: str = "mention_id", seed: str = "sample-1"):
        self.spark, self.path, self.ident, self.seed = spark, path.rstrip("/"), ident, seed
        known = read_text(spark, f"{self.path}/store.json")
        if known is None:
            if path_exists(spark, f"{self.path}/numbers"):
                raise ValueError(f"{self.path} holds numbers, but not the seed they were drawn with")
            write_text_atomic(spark, f"{self.path}/store.json", json.dumps({"seed": seed, "ident": ident}))
        elif json.loads(known) != {"seed": seed, "ident": ident}:
            raise ValueError(f"{self.path} was made with {known}, not with seed {seed} for {ident}")

    def batches(self) -> list[int]:
        """The batches taken in, ascending; an error where a batch's numbers or an earlier batch are missing."""
        taken = numbered(self.spark, f"{self.path}/taken")
        lost = [b for b in range(len(taken)) if b not in taken] or [b for b in taken if not path_exists(self.spark, f"{self.path}/numbers/batch={b}/_SUCCESS")]
        if lost:
            raise ValueError(f"the numbers of batch {lost[0]} in {self.path} are lost: records drawn then would be drawn anew")
        return taken

    def numbers(self) -> DataFrame | None:
        """(ident, carried columns, number, batch); None before the first batch."""
        taken = self.batches()
        return self.spark.read.parquet(f"{self.path}/numbers").where(F.col("batch").isin(taken)) if taken else None

    def ingest(self, records: DataFrame, batch: int | None = None, carry: tuple[str, ...] = ()) -> int:
        """Insert the identifiers of ``records`` not seen before; returns the number of the batch.

        The next batch is taken in unless ``batch`` names one. A batch counts once its marker is
        written, so one that failed half way is drawn again under its number and replaces itself; a
        batch already taken in is left as it is. Skipping a number is an error. Records without
        identifier are ignored; of a repeated identifier the smallest carried values stay. Columns
        beside the identifier and ``carry`` are ignored.
        """
        taken = self.batches()
        batch = len(taken) if batch is None else batch
        if batch in taken:
            return batch
        if batch != len(taken):
            raise ValueError(f"batch {len(taken)} comes before batch {batch}; is {self.path} the right store?")
        known = records.where(F.col(self.ident).isNotNull())
        fresh = known.groupBy(self.ident).agg(*(F.min(c).alias(c) for c in carry)) if carry else known.select(self.ident).distinct()
        seen = self.numbers()
        if seen is not None:
            fresh = fresh.join(seen.select(self.ident), self.ident, "left_anti")
        fresh.withColumn("number", drawn_number(F.col(self.ident), self.seed, batch)).write.mode("overwrite").parquet(f"{self.path}/numbers/batch={batch}")
        write_text_atomic(self.spark, f"{self.path}/taken/{batch}.json", "{}", once=True)
        return batch

    def sample(self, threshold: float) -> DataFrame:
        """Every identifier whose number is under ``threshold``; lowering it is refused, and so is an empty store."""
        if not 0 <= threshold <= 1:
            raise ValueError("a threshold lies between 0 and 1")
        numbers = self.numbers()
        if numbers is None:
            raise ValueError(f"{self.path} has taken in nothing")
        last = read_text(self.spark, f"{self.path}/threshold.txt")
        if last is not None and float(last) > threshold:
            raise ValueError(f"the threshold may not fall from {last} to {threshold}: chosen records would be lost")
        if last is None or float(last) < threshold:
            write_text_atomic(self.spark, f"{self.path}/threshold.txt", repr(threshold))
        return numbers.where(F.col("number") < threshold)
