"""Processing only what is new or changed, with a replayable plan (problem 7).

Deliveries are taken into a log in segments, numbered in the order in which they were taken in. A
record's place in the log, its offset, is the segment, then the time of arrival, then the delivery's
number; so a delivery that comes in late, with an earlier time of arrival than others before it, is
still new. Records fall into a fixed number of log partitions by key. A run

1. writes its plan ahead: for each partition the offsets from which (exclusive) and up to which
   (inclusive) it will read;
2. reads exactly that range, keeps the last delivery of each record in it, and writes these under the
   plan's number;
3. compares them with the last known content of the same records and writes what is new or changed;
4. commits the number.

What is known of a record is the hash of its content and the place of its last delivery. It is looked
up in what earlier runs wrote under 2, of which only keys, places and hashes are read; every so often
those are merged. The history before the range is never read again.

All files that carry state are numbered, written in one step and never replaced. A run that fails
anywhere leaves at most a plan without a commit; the next run replays that very plan, whatever was
taken in since, and overwrites what it had written, so nothing is skipped or repeated. The sink keeps
one row for each key and offset and reads committed batches only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import files_under, numbered, path_exists, read_text, write_text_atomic

FIRST = [-1, "0001-01-01 00:00:00.000000", -(2**63)]
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def probability_content(column: str) -> Column:
    """A JSON object of numbers as text that neither the order of its pairs nor the notation changes.

    What cannot be read as such an object counts as its own text; null stays null.
    """
    pairs = F.array_sort(F.map_entries(F.from_json(F.col(column), "map<string,double>")))
    return F.coalesce(F.to_json(pairs), F.col(column))


def content_hash(columns: list[str], as_map: tuple[str, ...] = ()) -> Column:
    """SHA-256 over the content columns; null and empty text differ, and so do columns that share a value."""
    parts = [(probability_content(c) if c in as_map else F.col(c).cast("string")) for c in columns]
    return F.sha2(F.to_json(F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts)))), 256)


def last_success(run_log: DataFrame, stage: str) -> datetime | None:
    """The greatest ``read_up_to`` of a successful run of ``stage``; None where there is none."""
    return run_log.where((F.col("stage") == stage) & (F.lower(F.trim("run_status")) == "success")).agg(F.max("read_up_to")).first()[0]


class ChangeCapture:
    """The log of one kind of record, its plans, its state and its sink under ``path`` in the shared folder.

    ``key``: the columns that name a record; ``arrived`` and ``number`` order the deliveries of a
    segment. Deliveries without a time of arrival or number, or with a null in the key, have no place
    in the log and are ignored. All other columns, or ``content`` where given, are the content that is
    compared. ``after_step`` is called with a name after everything that is written, for tests of recovery.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], arrived: str = "arrived_at", number: str = "delivery_id", content: list[str] | None = None, as_map: tuple[str, ...] = (), partitions: int = 32, merge_every: int = 16, after_step: Callable[[str], None] = lambda step: None):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, partitions
        self.arrived, self.number, self.content, self.as_map, self.merge_every, self.after_step = arrived, number, content, as_map, merge_every, after_step

    # Files

    def _numbers(self, kind: str) -> list[int]:
        return numbered(self.spark, f"{self.path}/{kind}")

    def _read(self, kind: str, number: int) -> dict | None:
        text = read_text(self.spark, f"{self.path}/{kind}/{number}.json")
        return json.loads(text) if text else None

    def _mark(self, kind: str, number: int, body: dict) -> None:
        write_text_atomic(self.spark, f"{self.path}/{kind}/{number}.json", json.dumps(body, sort_keys=True), once=True)
        self.after_step(kind)

    def _save(self, df: DataFrame, kind: str, number: int) -> DataFrame:
        """Write (or write over) the folder ``kind/<number>`` and read it back."""
        folder = f"{self.path}/{kind}/{number}"
        df.write.mode("overwrite").parquet(folder)
        self.after_step(kind)
        return self.spark.read.parquet(folder)

    # Taking in

    def _as_log(self, deliveries: DataFrame) -> DataFrame:
        """(key, log_partition, at, no, content, row) of the usable deliveries."""
        columns = self.content if self.content is not None else [c for c in deliveries.columns if c not in (self.arrived, self.number, *self.key)]
        usable = F.col(self.arrived).isNotNull() & F.col(self.number).isNotNull()
        for k in self.key:
            usable = usable & F.col(k).isNotNull()
        return deliveries.where(usable).select(
            *self.key, F.pmod(F.xxhash64(*self.key), F.lit(self.partitions)).cast("int").alias("log_partition"),
            F.col(self.arrived).cast("timestamp").alias("at"), F.col(self.number).cast("bigint").alias("no"),
            (content_hash(columns, self.as_map) if columns else F.lit("")).alias("content"), (F.struct(*columns) if columns else F.struct(F.lit(None).cast("string").alias("none"))).alias("row"),
        )

    def begin_with(self, history: DataFrame) -> None:
        """Take ``history`` as processed already (a hand-over from another log): its last contents become the state.

        Nothing of it is reported. Only a log without segments can be begun so, once.
        """
        if self._numbers("begun") or self._numbers("segment"):
            raise ValueError("this log has been begun already")
        last = self._as_log(history).groupBy(*self.key, "log_partition").agg(F.max(F.struct("at", "no", "content")).alias("s"))
        self._save(last.select(*self.key, "log_partition", "s.*"), "base", 0)
        self._mark("begun", 0, {})

    def ingest(self, deliveries: DataFrame, note: dict | None = None) -> int:
        """Append deliveries to the log as its next segment and return its number.

        A segment counts once its marker is written; one broken off before is written over. A caller
        that does not know whether its segment was taken in may take it in again: the repeated
        deliveries have known contents and change nothing.
        """
        segment = len(self._numbers("segment"))
        written = self._save(self._as_log(deliveries), "log", segment)
        ends = written.groupBy("log_partition").agg(F.max(F.struct("at", "no")).alias("e")).select("log_partition", F.date_format("e.at", STAMP), "e.no").collect()  # a row a partition
        self._mark("segment", segment, {"upto": {str(p): [segment, at, no] for p, at, no in ends}, **(note or {})})
        return segment

    def ingest_files(self, folder: str, read: Callable[[list[str]], DataFrame]) -> int | None:
        """Take in the files of ``folder`` that no segment holds yet, as one segment; None where there are none.

        Files are known by path, so one written late is taken in whatever times of arrival it holds.
        """
        held = {f for s in self._numbers("segment") for f in self._read("segment", s).get("files", ())}
        fresh = [f for f in files_under(self.spark, folder) if f not in held]
        return self.ingest(read(fresh), {"files": fresh}) if fresh else None

    # Running

    def plan(self) -> tuple[int, dict]:
        """The plan to run now: one left by a failure, else a new one over everything taken in since the last commit."""
        done = self._numbers("commit")
        batch = len(done)
        plan = self._read("plan", batch)
        if plan is None:
            after = self._read("commit", done[-1])["upto"] if done else {}
            first = self._read("commit", done[-1])["next_segment"] if done else 0
            segments = [s for s in self._numbers("segment") if s >= first]
            upto = dict(after)
            for s in segments:
                upto.update(self._read("segment", s)["upto"])
            plan = {"after": after, "upto": upto, "segments": segments, "next_segment": (segments[-1] + 1) if segments else first}
            self._mark("plan", batch, plan)
        return batch, plan

    def _bounds(self, plan: dict) -> DataFrame:
        """One row per log partition: a table whose size the number of partitions bounds."""
        rows = [(p, *plan["after"].get(str(p), FIRST), *plan["upto"].get(str(p), FIRST)) for p in range(self.partitions)]
        frame = self.spark.createDataFrame(rows, "log_partition int, fs bigint, fa string, fn bigint, ts bigint, ta string, tn bigint")
        offset = lambda x: F.struct(F.col(f"{x}s").alias("segment"), F.to_timestamp(F.col(f"{x}a"), STAMP).alias("at"), F.col(f"{x}n").alias("no"))
        return F.broadcast(frame.select("log_partition", offset("f").alias("after"), offset("t").alias("upto")))

    def range_of(self, plan: dict) -> DataFrame | None:
        """The log records a plan reads: segments outside its range are not opened. None where it has none."""
        parts = [self.spark.read.parquet(f"{self.path}/log/{s}").withColumn("segment", F.lit(s).cast("bigint")) for s in plan["segments"]]
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        offset = F.struct("segment", "at", "no")
        return rows.join(self._bounds(plan), "log_partition").where((offset > F.col("after")) & (offset <= F.col("upto"))).drop("after", "upto")

    def state(self, before: int) -> DataFrame | None:
        """(key, log_partition, at, no, content) of every run before ``before``, a record possibly in several rows; None where nothing is known."""
        columns = [*self.key, "log_partition", "at", "no", "content"]
        merged = [n for n in self._numbers("merged") if n < before]
        folders = [f"{self.path}/state/{merged[-1]}"] if merged else [f"{self.path}/base/0"] if self._numbers("begun") else []
        folders += [f"{self.path}/latest/{b}" for b in range(merged[-1] + 1 if merged else 0, before) if path_exists(self.spark, f"{self.path}/latest/{b}")]
        rows = None
        for f in folders:
            part = self.spark.read.parquet(f).select(*columns)
            rows = part if rows is None else rows.union(part)
        return rows

    def _last_known(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key, "log_partition").agg(F.max(F.struct("at", "no", "content")).alias("old"))

    def changes(self, latest: DataFrame, before: int) -> DataFrame:
        """(key, log_partition, log_offset, row, kind) of the last deliveries that differ from what was known before.

        ``kind`` is ``added`` for an unknown record, ``changed`` for another content than the last
        known one, and ``late`` for another content that arrived before it. The side with fewer
        records, which adaptive execution knows by then, may be sent to the other.
        """
        known = self.state(before)
        offset = F.struct("at", "no")
        rows = latest.withColumn("log_offset", offset)
        if known is not None:
            met = self._last_known(known.join(latest.select(*self.key, "log_partition"), [*self.key, "log_partition"], "left_semi"))
            rows = rows.join(met, [*self.key, "log_partition"], "left").where("old is null or old.content <> content")
        else:
            rows = rows.withColumn("old", F.lit(None).cast("struct<at:timestamp,no:bigint,content:string>"))
        kind = F.when(F.col("old").isNull(), "added").when(offset < F.struct("old.at", "old.no"), "late").otherwise("changed")
        return rows.select(*self.key, "log_partition", "log_offset", "row", kind.alias("kind"))

    def run(self) -> DataFrame | None:
        """Plan (or replay), process, write and commit one batch; returns the batch as written, None where nothing was taken in."""
        batch, plan = self.plan()
        found = self.range_of(plan)
        written = None
        if found is not None:
            last = found.groupBy(*self.key, "log_partition").agg(F.max(F.struct("at", "no", "segment", "content")).alias("l"), F.max_by("row", F.struct("at", "no", "segment", "content")).alias("row"))
            latest = self._save(last.select(*self.key, "log_partition", "l.at", "l.no", "l.content", "row"), "latest", batch)
            written = self._save(self.changes(latest, batch), "batch", batch)
        self._mark("commit", batch, {"upto": plan["upto"], "next_segment": plan["next_segment"]})
        merged = self._numbers("merged")
        if batch - (merged[-1] if merged else -1) >= self.merge_every:
            self.merge(batch)
        return written

    def merge(self, batch: int) -> None:
        """Merge what is known up to and including a committed batch into one table with a row for each record."""
        rows = self.state(batch + 1)
        if rows is not None and batch not in self._numbers("merged"):
            self._save(self._last_known(rows).select(*self.key, "log_partition", "old.*"), "state", batch)
            self._mark("merged", batch, {})

    def sink(self) -> DataFrame | None:
        """All committed changes, one row for each key and offset; None before the first."""
        folders = [f"{self.path}/batch/{b}" for b in self._numbers("commit") if path_exists(self.spark, f"{self.path}/batch/{b}")]
        return self.spark.read.parquet(*folders).dropDuplicates([*self.key, "log_offset"]) if folders else None
