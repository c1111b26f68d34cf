"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import canonical, contamination, cutoff, dedup, grouping, mixture, pii, sampling, splitting
from loomgraph.operators.change_capture import last_success
from loomgraph.runtime import evaluated_once, shared_dir, spread, table
from loomgraph.sources.store import stable_hash

SAMPLE_SHARE = 0.1


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source", "sentence_starts"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    edges = grouping.edges_of_pairs(table(spark, folder, "merge_edges")).union(grouping.edges_of_lists(table(spark, folder, "global_clusters")))
    return grouping.link_groups(edges).select(F.col("scope").alias("doc_id"), F.col("member").alias("component_uid"), F.col("group").alias("group_uid"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_chunks(table(spark, folder, "chunks"), _documents(spark, folder))
    return pieces.where("size(pieces) > 1").select("doc_id", "chunk_id")


def p2_chunk_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_chunks(table(spark, folder, "chunks"), _documents(spark, folder))
    return pieces.select("doc_id", "chunk_id", F.inline("pieces"))


def p2_document_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_documents(_documents(spark, folder)).select("doc_id", F.inline("pieces"))


def _cover(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Whether the pieces keep their promises, per item: tokens covered, gaps between cores, pieces over the limit, overlaps that are not whole."""
    order = Window.partitionBy(*key).orderBy("piece")
    rows = pieces.withColumn("gap", F.col("core_start") != F.lag("core_end").over(order))
    odd = "left_overlap_start > core_start or right_overlap_end < core_end"
    return rows.groupBy(*key).agg(F.sum(F.expr("core_end - core_start")).alias("n_covered"), F.min("core_start").alias("first_token"), F.max("core_end").alias("end_token"), F.count_if("gap").alias("n_gaps"), F.count_if(F.expr("right_overlap_end - left_overlap_start > 300")).alias("n_over_limit"), F.count_if(F.expr(odd)).alias("n_odd"))


def p2_chunk_cover(spark: SparkSession, folder: str) -> DataFrame:
    return _cover(p2_chunk_pieces(spark, folder), ["doc_id", "chunk_id"])


def p2_document_cover(spark: SparkSession, folder: str) -> DataFrame:
    return _cover(p2_document_pieces(spark, folder), ["doc_id"])


def p2_document_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence starts among the cores, and sentences that the overlaps hold, of documents without a sentence over the limit."""
    docs = evaluated_once(_documents(spark, folder).select("doc_id", "text", "sentence_starts"), "n", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint"))
    inner = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.filter("sentence_starts", lambda x: (x > 0) & (x < F.col("n"))), F.array("n"))))
    lengths = F.zip_with(F.slice("b", 2, F.size("b") - 1), F.slice("b", 1, F.size("b") - 1), lambda x, y: x - y)
    bounded = evaluated_once(docs.select("doc_id", "n", "sentence_starts"), "b", inner).where(F.array_max(lengths) <= 300).select("doc_id", "b")
    rows = p2_document_pieces(spark, folder).join(bounded, "doc_id")
    whole = F.array_contains("b", F.col("core_start")) & F.array_contains("b", F.col("left_overlap_start")) & F.array_contains("b", F.col("right_overlap_end"))
    return rows.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("is_cut"), F.count_if(~whole).alias("n_inside_sentences"))


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample after two ingests: what the last successful run had read, then everything.

    The store lies in the shared folder under the data's own name and outlives the call: a second
    call finds both batches taken in and only looks the numbers up.
    """
    mentions = table(spark, folder, "trait_evidence").select("mention_id", "cluster_id", "arrived_at")
    upto = last_success(table(spark, folder, "run_log"), "trait_evidence")
    store = f"{shared_dir(spark)}/loomgraph/numbers/{stable_hash([os.path.abspath(folder), str(upto)])[:16]}"
    numbers = sampling.PermanentNumbers(spark, store)
    numbers.ingest(mentions.where(F.col("arrived_at") <= F.lit(upto)) if upto else mentions.limit(0), 0, ("cluster_id",))
    numbers.ingest(mentions, 1, ("cluster_id",))
    return numbers.sample(SAMPLE_SHARE).select("mention_id", "cluster_id", "number")


def p4_matches(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_mentions(table(spark, folder, "mentions_dropped"), table(spark, folder, "selected_anchors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_matches(spark, folder).select("row_index", "anchor_key")


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.mention_keys(table(spark, folder, "trait_evidence")).union(dedup.line_keys(table(spark, folder, "mention_lines")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.copies(_keys(spark, folder))


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.collapsed(_keys(spark, folder))


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, uid, n_mentions), once per cluster of either table, known sizes only."""
    kept = table(spark, folder, "global_clusters").select("doc_id", F.col("global_cluster_uid").alias("uid"), "n_mentions")
    rejected = table(spark, folder, "rejected_global_clusters").select("doc_id", F.col("would_be_global_cluster_uid").alias("uid"), "n_mentions")
    return kept.union(rejected).where("doc_id is not null and uid is not null and n_mentions is not null").groupBy("doc_id", "uid").agg(F.max("n_mentions").alias("n_mentions"))


def keep_shares(spark: SparkSession, folder: str, sizes: DataFrame) -> DataFrame:
    """(doc_id, keep): the whole percentage each document's recorded percentile keeps."""
    recorded = table(spark, folder, "rejected_global_clusters").where("salience_percentile is not null").groupBy("doc_id").agg(F.max("salience_percentile").alias("p"))
    return sizes.select("doc_id").distinct().join(recorded, "doc_id", "left").select("doc_id", F.round(100 - 100 * F.coalesce("p", F.lit(0.95))).cast("bigint").alias("keep"))


def p6_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cluster_sizes(spark, folder)
    return cutoff.cutoffs(sizes, keep_shares(spark, folder, sizes), "doc_id", "n_mentions")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_cutoffs(spark, folder).select("doc_id", "cutoff", "n_kept")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaked_documents(_documents(spark, folder), table(spark, folder, "eval_items"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaked_spans(_documents(spark, folder), table(spark, folder, "eval_items"))


def p8_removals(spark: SparkSession, folder: str) -> DataFrame:
    """What to take out of each document, in characters: passages of all items, merged."""
    return contamination.removal_spans(_documents(spark, folder), table(spark, folder, "eval_items")).select("doc_id", "char_start", "char_end", F.size("item_ids").alias("n_items"))


def _mixture(spark: SparkSession, folder: str) -> mixture.Mixture:
    return mixture.Mixture(_documents(spark, folder), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).selection()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(_documents(spark, folder), table(spark, folder, "name_lexicon")).select("doc_id", "pii_kind", "char_start")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact_documents(_documents(spark, folder), table(spark, folder, "name_lexicon"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_chunk_pieces, p2_document_pieces, p2_chunk_cover, p2_document_cover, p2_document_overlaps, p3_sample, p4_found, p4_matches, p5_found, p5_collapsed, p6_found, p6_cutoffs, p8_found, p8_spans, p8_removals, p9_mix, p9_shares, p10_found, p10_redacted)
}
