"""Session, shared-folder and table helpers used by every operator.

Nothing here keeps state on a machine-local disk of a cluster: the shared folder is the one
the session names in ``spark.checkpoint.dir``; only a local master without that setting (as in
tests) gets a temporary folder of its own.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: AQE with skew-join splitting, UTC, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``; made only where unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a scratch path deleted when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def cut_to(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Like :func:`cut`, with the path, for callers that delete what they have passed."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, cutting the lineage.

    Unlike a local checkpoint the files survive the loss of any executor; unlike an RDD
    checkpoint they are columnar and can be pruned by the stages that read them.
    """
    return cut_to(df, name)[0]


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once per row, however often later columns refer to it.

    A generator keeps the optimizer from copying the expression into each of its uses.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system (no error where it is missing)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def write_text_atomic(spark: SparkSession, path: str, text: str, once: bool = False) -> None:
    """Write a small driver-side file through a temporary name and one rename that replaces the target.

    A crash leaves either the old file or the new one, never none. With ``once`` an existing target
    is an error: numbered files are written once and never replaced.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = final.getFileSystem(conf)
    out = fs.create(temporary, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kinds, 1)
    options[0] = kinds.NONE if once else kinds.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(temporary, final, options)


def numbered(spark: SparkSession, folder: str, suffix: str = ".json") -> list[int]:
    """The numbers of the files ``<number><suffix>`` in a folder, ascending."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(int(n[: -len(suffix)]) for n in names if n.endswith(suffix) and n[: -len(suffix)].isdigit())


def files_under(spark: SparkSession, folder: str) -> list[str]:
    """The data files below a folder, sorted; names that begin with a point or underscore are left out."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    out, at = [], fs.listFiles(target, True)
    while at.hasNext():
        p = at.next().getPath()
        if p.getName()[0] not in "._":
            out.append(p.toString())
    return sorted(out)


def partitions_for(df: DataFrame, target: int = 32 << 20, growth: float = 4.0) -> int:
    """Partitions of about ``target`` bytes for a sort of ``df``, from the sizes of the tables it reads.

    ``growth`` is what the rows weigh in memory against their compressed columns. The optimizer's size
    of the whole plan is no help, as it multiplies the sides of every join. Where a table's size is
    not known the session's shuffle partitions are used.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    if any(size >= 1 << 60 for size in sizes):
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(int(sum(sizes) * growth / target) + 1, 100_000))


def running_counts(df: DataFrame, group: list[str], order: list, weight: Column | None = None, partitions: int | None = None, name: str = "running") -> DataFrame:
    """``df`` with ``_upto``: the running sum of ``weight`` (or the row number) within ``group`` by ``order``.

    A group of any size is spread: rows are range-partitioned and sorted by group and order, summed
    within each partition, and moved up by what the earlier partitions hold of the same group, one
    number for each partition that a group enters from the one before. ``order`` must be total where
    the numbers of ties matter. An empty table stays empty.
    """
    spark = df.sparkSession
    keys = [F.col(g) for g in group]
    ranged = df.withColumn("_w", weight if weight is not None else F.lit(1).cast("bigint")).repartitionByRange(partitions or partitions_for(df), *keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut(ranged.withColumn("_part", F.spark_partition_id()), name)
    held = rows.groupBy(*group, "_part").agg(F.sum("_w").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.withColumn("_before", F.sum("_held").over(before)).where("_before is not null").select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_before")
    run = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_upto", F.sum("_w").over(run))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = inside.join(moved, same, "left")
    return joined.select(*df.columns, (F.col("_upto") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("_upto"))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file written by :func:`write_text_atomic`, None where it is missing."""
    if not path_exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path, from the file system's own listing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength())


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a reference table, refusing more than ``limit`` rows rather than cutting it short."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows: too large to hold on the driver")
    return rows


def checked_broadcast(df: DataFrame, limit: int, what: str) -> DataFrame:
    """A reference table for sending to every task: more than ``limit`` rows are refused."""
    rows = bounded_rows(df, limit, what)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    archive = scratch_path(spark, "package") + ".zip"
    target = context._jvm.org.apache.hadoop.fs.Path(archive)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as there are cores, for steps that cost far more than a shuffle of their input.

    Only input that comes in fewer files than there are cores is moved; of a large table nothing is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
