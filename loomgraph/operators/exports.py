"""Tables for exchange: resolved clusters and mentions, rejected clusters, the mention filter's audit, counts.

Each function gives the rows in the columns of the exchanged file; ``sources.files.write_csv`` writes
them in that order. Sorted files are sorted by range, so no task holds a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import anchors as A
from loomgraph.operators import resolution as R
from loomgraph.runtime import cut, running_counts
from loomgraph.sources import files as FS

# Columns of the exchanged files, in order.
CLUSTER_COLUMNS = ["global_cluster_uid", "n_local_clusters", "n_mentions", "canonical_name", "canonical_names", "local_cluster_uids", "chunk_min", "chunk_max"]
MENTION_COLUMNS = ["global_cluster_uid", "local_cluster_uid", "local_mention_uid", "chunk_id", "chunk_index", "local_cluster_id", "local_mention_id", "local_start", "local_end", "global_start", "global_end", "text", "head_local_i", "head_global_i", "zone", "overlap_exact_span_key"]
REJECTED_COLUMNS = ["rejected_global_cluster_uid", "would_be_global_cluster_uid", "merge_component_uid", "rejection_reason", "salience_percentile", "salience_cutoff", "n_local_clusters", "n_mentions", "canonical_name", "canonical_names", "local_cluster_uids", "chunk_min", "chunk_max"]
ANCHOR_COLUMNS = ["anchor_key", "display_name", "n_mentions", "source_cluster_uids"]
REASON = "below_global_cluster_salience_policy"


def joined(values: Column) -> Column:
    """A set of texts in one cell: sorted and joined by pipes."""
    return F.array_join(F.array_sort(F.collect_set(values)), "|")


def resolved_clusters(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, component, first_start, the cluster columns): one row per entity of (doc_id, uid, component)."""
    numbered = R.number_entities(members, rows)
    names = R.representative_names(members, rows)
    sets = members.join(rows.select("doc_id", "uid", "name").distinct(), ["doc_id", "uid"]).groupBy("doc_id", "component").agg(joined(F.col("name")).alias("canonical_names"), joined(F.col("uid")).alias("local_cluster_uids"))
    whole = numbered.join(sets, ["doc_id", "component"]).join(names, ["doc_id", "component"], "left")
    return whole.select("doc_id", "component", "first_start", *CLUSTER_COLUMNS)


def _place() -> list[Column]:
    return [F.col("chunk_min").asc_nulls_last(), F.col("first_start").asc_nulls_last(), F.col("component")]


def kept_clusters(marked: DataFrame) -> DataFrame:
    """(doc_id, component, the cluster columns) of the clusters a salience policy keeps, renumbered in document order."""
    return running_counts(marked.where("kept"), ["doc_id"], _place(), name="kept").withColumn("global_cluster_uid", X.global_cluster_uid(F.col("_upto") - 1)).select("doc_id", "component", *CLUSTER_COLUMNS)


def rejected_clusters(marked: DataFrame, percentile: float) -> DataFrame:
    """(doc_id, the rejected columns) of the others, with the number each would have had and the policy that rejected it."""
    return running_counts(marked.where("not kept"), ["doc_id"], _place(), name="rejected").select(
        "doc_id", F.format_string("rejected_global_cluster_%06d", F.col("_upto") - 1).alias("rejected_global_cluster_uid"), F.col("global_cluster_uid").alias("would_be_global_cluster_uid"), F.col("component").alias("merge_component_uid"),
        F.lit(REASON).alias("rejection_reason"), F.lit(percentile).alias("salience_percentile"), F.col("cutoff").alias("salience_cutoff"), *CLUSTER_COLUMNS[1:],
    )


def marked_by_salience(clusters: DataFrame, percentile: float = 0.95, least_kept: int | None = 10) -> DataFrame:
    """Resolved clusters with ``cutoff`` and ``kept``, computed once."""
    return cut(R.salience_split(cut(clusters, "resolved"), "n_mentions", percentile, least_kept), "marked")


def split_by_salience(clusters: DataFrame, percentile: float = 0.95, least_kept: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the salience policy on resolved clusters."""
    marked = marked_by_salience(clusters, percentile, least_kept)
    return kept_clusters(marked), rejected_clusters(marked, percentile)


def resolved_mentions(clusters: DataFrame, members: DataFrame, local_mentions: DataFrame) -> DataFrame:
    """(doc_id, the mention columns): every local mention of the given clusters with its entity's number."""
    owner = members.join(clusters.select("doc_id", "component", "global_cluster_uid"), ["doc_id", "component"]).select("doc_id", F.col("uid").alias("local_cluster_uid"), "global_cluster_uid")
    return local_mentions.join(owner, ["doc_id", "local_cluster_uid"]).select("doc_id", *MENTION_COLUMNS)


def non_singletons(clusters: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of at least ``least`` local clusters, the largest first."""
    return clusters.where(F.col("n_local_clusters") >= least).orderBy(F.col("n_local_clusters").desc(), F.col("n_mentions").desc(), "doc_id", "global_cluster_uid")


def merge_local_clusters(rows: DataFrame, strategy: str = "greedy", veto: bool = True, percentile: float = 0.95, least_kept: int | None = 10) -> dict[str, DataFrame]:
    """Local clusters to entities in one call: ``members``, ``clusters`` kept and ``rejected``.

    ``rows`` as :mod:`loomgraph.operators.resolution` reads them.
    """
    members = cut(R.resolve(rows, strategy, veto), "members")
    kept, rejected = split_by_salience(resolved_clusters(members, rows), percentile, least_kept)
    return {"members": members, "clusters": kept, "rejected": rejected}


CLUSTER_CSV = "local_cluster_uid string, canonical_name string"
MENTION_CSV = "local_mention_uid string, local_cluster_uid string, chunk_id string, chunk_index bigint, local_cluster_id bigint, local_mention_id bigint, local_start bigint, local_end bigint, global_start bigint, global_end bigint, text string, head_local_i bigint, head_global_i bigint, zone string, overlap_exact_span_key string"


def merge_from_csv(spark, clusters_path: str, mentions_path: str, doc_id: int = 0, **how) -> dict[str, DataFrame]:
    """The same for one document kept as two CSV files; also ``mentions``, the mentions of the kept clusters."""
    clusters = FS.read_csv(spark, clusters_path, CLUSTER_CSV).select(F.lit(doc_id).cast("bigint").alias("doc_id"), F.col("local_cluster_uid").alias("uid"), F.col("canonical_name").alias("name"))
    mentions = FS.read_csv(spark, mentions_path, MENTION_CSV).withColumn("doc_id", F.lit(doc_id).cast("bigint"))
    rows = A.checked_join(mentions.withColumnRenamed("local_cluster_uid", "uid"), clusters, ["doc_id", "uid"]).select("doc_id", "uid", "name", F.col("global_start").alias("start"), F.col("global_end").alias("end"), "text", "zone", "chunk_index")
    made = merge_local_clusters(rows, **how)
    return {**made, "mentions": resolved_mentions(made["clusters"], made["members"], mentions)}


def export_resolution(made: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Write what :func:`merge_from_csv` made: global_clusters, global_mentions and rejected_global_clusters."""
    by_doc = ["doc_id"]
    FS.write_csv(made["clusters"].orderBy("doc_id", "global_cluster_uid"), f"{path}/global_clusters", by_doc + CLUSTER_COLUMNS, mode=mode)
    FS.write_csv(made["mentions"].orderBy("doc_id", "global_cluster_uid", "chunk_index", "global_start", "global_end"), f"{path}/global_mentions", by_doc + MENTION_COLUMNS, mode=mode)
    FS.write_csv(made["rejected"].orderBy("doc_id", F.col("n_mentions").desc(), "would_be_global_cluster_uid"), f"{path}/rejected_global_clusters", by_doc + REJECTED_COLUMNS, mode=mode)


def filter_with_audit(mentions: DataFrame, clusters: DataFrame, path: str | None = None, percentile: float = 0.95, least_mentions: int = 2, generic: list[str] | None = None, mode: str = "error", **how) -> dict[str, DataFrame]:
    """The destructive mention filter in one call: ``anchors`` from the clusters, mentions ``kept`` and ``dropped``, ``counts``.

    With ``path`` the three tables are written there as CSV: mentions.filtered, mentions.dropped and
    selected_anchors.
    """
    anchors = A.anchor_bank(clusters, percentile, least_mentions, generic=generic)
    named = A.checked_join(mentions, clusters.select("local_cluster_uid", F.col("canonical_name").alias("cluster_canonical_name")), ["local_cluster_uid"])
    kept, dropped = A.filter_mentions(named, anchors, text="text", **how)
    counts = dropped.agg(F.count(F.lit(1)).alias("n_dropped")).crossJoin(kept.agg(F.count(F.lit(1)).alias("n_kept")))
    kept = kept.select(*mentions.columns)
    if path:
        FS.write_csv(kept, f"{path}/mentions.filtered", mode=mode)
        FS.write_csv(dropped, f"{path}/mentions.dropped", mode=mode)
        FS.write_csv(anchors, f"{path}/selected_anchors", ANCHOR_COLUMNS, mode=mode)
    return {"anchors": anchors, "kept": kept, "dropped": dropped, "counts": counts}


def local_table_counts(clusters: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_clusters, n_mentions, n_core, n_non_core): the counts a run's metadata states."""
    m = mentions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if(F.col("zone") == "core").alias("n_core"), F.count_if(F.coalesce(F.col("zone") != "core", F.lit(True))).alias("n_non_core"))
    c = clusters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clusters"))
    k = chunks.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    whole = k.join(c, "doc_id", "full").join(m, "doc_id", "full")
    return whole.select("doc_id", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_chunks", "n_clusters", "n_mentions", "n_core", "n_non_core")))


def corpus_metadata(documents: DataFrame, contract: dict[str, str]) -> DataFrame:
    """(doc_id, text_sha256, n_chars, contract): what identifies the text that offsets refer to; null texts have null hashes."""
    pairs = [x for k, v in sorted(contract.items()) for x in (F.lit(k), F.lit(v))]
    return documents.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"), F.create_map(*pairs).alias("contract"))
