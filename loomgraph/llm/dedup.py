"""Records that differ only in dress: sort and scan adjacent runs (problem 5).

Canonical records are range-partitioned by their whole key and identifier, each partition is sorted
(spilling to disk as needed), and one pass over the sorted rows compares full keys of neighbours. As
the identifier is part of the range, a group of a third of all rows is spread over many partitions;
the runs that continue over a partition's edge are stitched from one head and one tail per
partition, which is all the driver ever sees. Runs are told apart by partition and number within it,
so two groups that share an identifier are never taken for one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut, partitions_for

SCANNED = "kind int, part int, run bigint, found_in string, key string, first_id bigint, copy_id bigint, n bigint"
COPY, HEAD, TAIL, RUN = 0, 1, 2, 3


def canonical(value: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def mention_keys(evidence: DataFrame, text: str = "context_text") -> DataFrame:
    """(found_in, key, id) of scored mentions: document, cluster and canonical context make the key.

    Rows without mention id or context are ignored; a missing document or cluster is a value of its own.
    """
    return evidence.where(F.col("mention_id").isNotNull() & F.col(text).isNotNull()).select(
        F.lit("trait_evidence").alias("found_in"),
        F.concat_ws("\u001f", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.coalesce(F.col("cluster_id").cast("string"), F.lit("?")), canonical(F.col(text))).alias("key"),
        F.col("mention_id").cast("bigint").alias("id"),
    )


def line_keys(lines: DataFrame) -> DataFrame:
    """(found_in, key, id) of raw records in either layout; the order of the fields does not count.

    Field names are compared as written but for surrounding blanks, values by letters and digits.
    Null lines are ignored; a line that is neither layout is one field without a name.
    """
    text = F.regexp_replace(F.col("line_text"), r"^[\s﻿]+|\s+$", "")
    from_json = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(F.trim(e["key"]).alias("f"), F.coalesce(canonical(e["value"]), F.lit("")).alias("v")))
    from_pairs = F.transform(
        F.filter(F.split(text, r"\t"), lambda x: F.length(F.trim(x)) > 0),
        lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?s)^([^=]*)=", 1)).alias("f"), canonical(F.regexp_replace(x, r"^[^=]*=", "")).alias("v")),
    )
    fields = F.array_sort(F.when(text.startswith("{") & F.from_json(text, "map<string,string>").isNotNull(), from_json).otherwise(from_pairs))
    return lines.where(F.col("line_text").isNotNull() & F.col("line_id").isNotNull()).select(
        F.lit("mention_lines").alias("found_in"),
        F.array_join(F.transform(fields, lambda e: F.concat(e["f"], F.lit("\u001f"), e["v"])), "\u001e").alias("key"),
        F.col("line_id").cast("bigint").alias("id"),
    )


def scan_runs(batches: Iterator[pa.RecordBatch], runs: bool) -> Iterator[pa.RecordBatch]:
    """One pass over sorted (found_in, key, id): copies (or else run sizes), and the partition's head and tail."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("run", pa.int64()), ("found_in", pa.string()), ("key", pa.string()), ("first_id", pa.int64()), ("copy_id", pa.int64()), ("n", pa.int64())])

    def rows(kind, numbers, found, keys, firsts, others, sizes):
        n = len(firsts)
        keys = pa.nulls(n, pa.string()) if keys is None else pa.array(keys, pa.string())
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(numbers, pa.int64()), found, keys, *(pa.array(x, pa.int64()) for x in (firsts, others, sizes))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def one(kind, run):
        found, key, first, last, size = run
        return rows(kind, [number], pa.array([found], pa.string()), None if kind == RUN else [key], [first], [last], [size])

    open_run = None  # (found_in, key, first id, last id, distinct members)
    number = 0  # of the open run within the partition
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        found, key, ids = batch.column(0).cast(pa.string()), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = pc.or_(pc.not_equal(found.slice(1), found.slice(0, n - 1)), pc.not_equal(key.slice(1), key.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)  # an identifier that came before in its run is a repeated delivery
        fresh[1:] = new[1:] | (ids[1:] != ids[:-1])
        if open_run is None:
            yield one(HEAD, (found[0].as_py(), key[0].as_py(), int(ids[0]), int(ids[0]), 0))
        elif open_run[:2] == (found[0].as_py(), key[0].as_py()):
            new[0] = False
            fresh[0] = ids[0] != open_run[3]
        starts = np.flatnonzero(new)
        at = np.cumsum(new) - 1  # -1: belongs to the run left open
        sizes = np.bincount(at + 1, weights=fresh, minlength=len(starts) + 1).astype(np.int64)
        if not runs and len(where := np.flatnonzero(fresh & ~new)):
            own = ids[starts[at[where]]] if len(starts) else np.zeros(len(where), np.int64)
            firsts = np.where(at[where] >= 0, own, open_run[2] if open_run else 0)
            base = number + 1 if open_run else 0
            yield rows(COPY, base + at[where], found.take(pa.array(where)), None, firsts, ids[where], np.zeros(len(where), np.int64))
        if open_run:
            open_run = (*open_run[:4], open_run[4] + int(sizes[0]))
        if not len(starts):
            open_run = (*open_run[:3], int(ids[-1]), open_run[4])
            continue
        if runs:
            if open_run:
                yield one(RUN, open_run)
            base = number + 1 if open_run else 0
            yield rows(RUN, base + np.arange(len(starts) - 1), found.take(pa.array(starts[:-1])), None, ids[starts[:-1]], ids[starts[:-1]], sizes[1:-1])
        number += len(starts) if open_run else len(starts) - 1
        s = int(starts[-1])
        open_run = (found[s].as_py(), key[s].as_py(), int(ids[s]), int(ids[-1]), int(sizes[-1]))
    if open_run:
        if runs:
            yield one(RUN, open_run)
        yield one(TAIL, open_run)


def _continued(edges: list) -> list[tuple]:
    """(part, origin part, origin run, true first id, whether the head's first row repeats the tail's last id) for heads that continue a run."""
    heads, tails = ({r["part"]: r for r in edges if r["kind"] == kind} for kind in (HEAD, TAIL))
    out, origin, before = [], None, None
    for part in sorted(heads):
        head, tail = heads[part], tails[part]
        joins = before is not None and (before["found_in"], before["key"]) == (head["found_in"], head["key"])
        if joins:
            out.append((part, *origin, bool(before["copy_id"] == head["first_id"])))
        if not (joins and tail["run"] == 0):
            origin = (part, tail["run"], tail["first_id"])
        before = tail
    return out


FIX = "part int, origin_part int, origin_run bigint, origin bigint, same boolean"


def find_runs(keyed: DataFrame, runs: bool, partitions: int | None = None) -> tuple[DataFrame, list[tuple]]:
    """The scanned rows (in the shared folder) and the heads to stitch: two rows a partition reach the driver.

    The number of partitions follows the size of the input, so a partition sorts a bounded amount.
    """
    n = partitions or partitions_for(keyed)
    scanned = cut(keyed.select("found_in", "key", "id").repartitionByRange(n, "found_in", "key", "id").sortWithinPartitions("found_in", "key", "id").mapInArrow(lambda batches: scan_runs(batches, runs), SCANNED), "runs")
    return scanned, _continued(scanned.where(F.col("kind").isin(HEAD, TAIL)).collect())


def copies(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(found_in, first_id, copy_id): one row for each distinct identifier of a group beyond its smallest."""
    scanned, stitched = find_runs(keyed, False, partitions)
    rows = scanned.where(F.col("kind") == COPY).select("found_in", "first_id", "copy_id", "part", "run")
    if not stitched:
        return rows.drop("part", "run")
    fix = F.broadcast(keyed.sparkSession.createDataFrame(stitched, FIX))  # one row a partition at most
    heads = scanned.where(F.col("kind") == HEAD).join(fix, "part").where("not same").select("found_in", F.col("origin").alias("first_id"), "copy_id")
    moved = rows.join(fix, (rows["part"] == fix["part"]) & (rows["run"] == 0), "left").select("found_in", F.coalesce("origin", "first_id").alias("first_id"), "copy_id")
    return moved.union(heads)


def collapsed(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(found_in, first_id, n_copies): one representative per group with its exact number of distinct records.

    An identifier delivered with two contexts belongs to two groups, each of which has its row.
    """
    scanned, stitched = find_runs(keyed, True, partitions)
    runs = scanned.where(F.col("kind") == RUN).select("part", "run", "found_in", "first_id", "n")
    if not stitched:
        return runs.select("found_in", "first_id", F.col("n").alias("n_copies"))
    fix = F.broadcast(keyed.sparkSession.createDataFrame(stitched, FIX))  # one row a partition at most
    moved = runs.join(fix, (runs["part"] == fix["part"]) & (runs["run"] == 0), "left").select(
        F.coalesce("origin_part", runs["part"]).alias("part"), F.coalesce("origin_run", "run").alias("run"), "found_in", F.coalesce("origin", "first_id").alias("first_id"), (F.col("n") - F.coalesce(F.col("same").cast("int"), F.lit(0))).alias("n"),
    )
    return moved.groupBy("part", "run", "found_in", "first_id").agg(F.sum("n").alias("n_copies")).drop("part", "run")
