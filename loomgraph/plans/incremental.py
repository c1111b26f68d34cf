"""Incremental queries over the test tables (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.change_capture import ChangeCapture, last_success
from loomgraph.operators.scoring import POLES, TRAITS, WEIGHTS
from loomgraph.runtime import forget_at_exit, scratch_path, table


def _capture(spark: SparkSession, folder: str, name: str, stage: str, **how) -> DataFrame:
    """Take over from the run log, take in what arrived since, run one batch, read it back from the sink."""
    path = scratch_path(spark, f"log-{name}")
    capture = ChangeCapture(spark, path, **how)
    forget_at_exit(spark, path)
    upto = last_success(table(spark, folder, "run_log"), stage)
    deliveries = table(spark, folder, name)
    if upto is not None:
        capture.begin_with(deliveries.where(F.col("arrived_at") <= F.lit(upto)))
        deliveries = deliveries.where(F.col("arrived_at") > F.lit(upto))
    capture.ingest(deliveries)
    capture.run()
    return capture.sink()


def p7_relation_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _capture(spark, folder, "relation_assignments", "relation_assignments", key=["doc_id", "relation_id"], as_map=("object_property_probabilities_json",)).select(
        "doc_id", "relation_id", "kind", F.col("log_offset.no").alias("delivery_id"), "row.selection_method", "row.object_property_probabilities_json",
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_relation_changes(spark, folder).select("doc_id", "relation_id")


def p7_mention_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of trait_evidence that are new, rescored or moved; the chunk stands in for a delivery number and is content as well."""
    key = ["doc_id", "mention_id"]
    content = [c for c in table(spark, folder, "trait_evidence").columns if c not in (*key, "arrived_at")]
    return _capture(spark, folder, "trait_evidence", "trait_evidence", key=key, number="chunk_index", content=content).select("doc_id", "mention_id", "kind")


QUERIES = {f.__name__: f for f in (p7_found, p7_relation_changes, p7_mention_changes)}

_RELATIONS = """
WITH r AS (SELECT max(read_up_to) AS upto FROM run_log WHERE stage = 'relation_assignments' AND lower(trim(run_status)) = 'success'),
d AS (
  SELECT doc_id, relation_id, arrived_at > coalesce(upto, TIMESTAMP '0001-01-01') AS late, arrived_at, delivery_id, selection_method, object_property_probabilities_json,
    to_json([source_mention_id, predicate_token_i, predicate_start, predicate_end, target_mention_id, source_cluster_id, target_cluster_id]) || coalesce(selection_method, chr(0))
      || coalesce(CAST(list_sort(map_entries(from_json(object_property_probabilities_json, '"MAP(VARCHAR, DOUBLE)"'))) AS VARCHAR), chr(0)) AS content
  FROM relation_assignments, r WHERE doc_id IS NOT NULL AND relation_id IS NOT NULL AND arrived_at IS NOT NULL AND delivery_id IS NOT NULL),
s AS (
  SELECT doc_id, relation_id, arg_max(content, (arrived_at, delivery_id)) FILTER (late) AS new, arg_max(content, (arrived_at, delivery_id)) FILTER (NOT late) AS old,
    arg_max(delivery_id, (arrived_at, delivery_id)) FILTER (late) AS delivery_id, arg_max(selection_method, (arrived_at, delivery_id)) FILTER (late) AS selection_method,
    arg_max(object_property_probabilities_json, (arrived_at, delivery_id)) FILTER (late) AS object_property_probabilities_json
  FROM d GROUP BY doc_id, relation_id)"""
_MENTION_CONTENT = [
    "cluster_id", "subject", "mention_index_in_cluster", "mention_text", "mention_start", "mention_end", "sentence_index", "mention_render_rule", "mention_render_was_changed", "original_context_text", "rendered_context_text", "context_text",
    "normalized_context_text", "chunk_index", "elapsed_seconds_at_completion", *(f"{t}_{p}_probability" for t in TRAITS for p in POLES), *(f"ocean_weight_{w}_probability" for w in WEIGHTS),
]

ORACLES = {
    "p7_found": f"{_RELATIONS} SELECT doc_id, relation_id FROM s WHERE new IS NOT NULL AND (old IS NULL OR old <> new)",
    "p7_relation_changes": f"{_RELATIONS} SELECT doc_id, relation_id, CASE WHEN old IS NULL THEN 'added' ELSE 'changed' END AS kind, delivery_id, selection_method, object_property_probabilities_json FROM s WHERE new IS NOT NULL AND (old IS NULL OR old <> new)",
    "p7_mention_changes": f"""
WITH r AS (SELECT max(read_up_to) AS upto FROM run_log WHERE stage = 'trait_evidence' AND lower(trim(run_status)) = 'success'),
d AS (SELECT doc_id, mention_id, arrived_at > coalesce(upto, TIMESTAMP '0001-01-01') AS late, arrived_at, chunk_index, to_json(struct_pack({', '.join(f'{c} := {c}' for c in _MENTION_CONTENT)})) AS content FROM trait_evidence, r WHERE doc_id IS NOT NULL AND mention_id IS NOT NULL AND arrived_at IS NOT NULL AND chunk_index IS NOT NULL),
s AS (SELECT doc_id, mention_id, arg_max(content, (arrived_at, chunk_index)) FILTER (late) AS new, arg_max(content, (arrived_at, chunk_index)) FILTER (NOT late) AS old FROM d GROUP BY doc_id, mention_id)
SELECT doc_id, mention_id, CASE WHEN old IS NULL THEN 'added' ELSE 'changed' END AS kind FROM s WHERE new IS NOT NULL AND (old IS NULL OR old <> new)""",
}
