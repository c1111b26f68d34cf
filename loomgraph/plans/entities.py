"""Queries of anchors and entity resolution over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import anchors as A
from loomgraph.operators import exports as E
from loomgraph.operators import mentions as M
from loomgraph.operators import resolution as R
from loomgraph.plans import rounded, rounded_sql
from loomgraph.plans import text as TX
from loomgraph.plans.documents import _EVIDENCE, _PIECES, _evidence
from loomgraph.runtime import cut, table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Scored mentions as local mentions: a chunk's cluster is a local cluster, its subject the name."""
    spec = table(spark, folder, "chunks").groupBy("doc_id", "chunk_index").agg(F.min(F.struct("core_start", "core_end")).alias("c"))
    rows = _evidence(spark, folder).join(spec, ["doc_id", "chunk_index"], "left")
    start, end = F.col("mention_start"), F.col("mention_end")
    zone = F.when(end <= F.col("c.core_start"), "left_overlap").when(start >= F.col("c.core_end"), "right_overlap").otherwise("core")
    return rows.select("doc_id", X.local_cluster_uid(F.format_string("chunk_%03d", "chunk_index"), "cluster_id").alias("uid"), F.col("subject").alias("name"), start.alias("start"), end.alias("end"), F.col("mention_text").alias("text"), zone.alias("zone"), "chunk_index")


def _name_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Capitalized runs in the recorded chunks as local mentions; what stands in an overlap stands in two chunks."""
    rows = M.recorded_name_mentions(table(spark, folder, "documents"), table(spark, folder, "chunks"))
    return rows.select("doc_id", F.col("local_cluster_uid").alias("uid"), "name", F.col("global_start").alias("start"), F.col("global_end").alias("end"), "text", "zone", "chunk_index")


def name_mentions_recorded(spark: SparkSession, folder: str) -> DataFrame:
    return _name_rows(spark, folder)


def anchor_bank(spark: SparkSession, folder: str) -> DataFrame:
    clusters = table(spark, folder, "global_clusters").select("doc_id", F.concat_ws(":", "doc_id", "global_cluster_uid").alias("uid"), "canonical_name", "n_mentions").distinct()
    return A.anchor_bank(clusters, 0.95, 2, uid="uid")


def anchor_bank_by_document(spark: SparkSession, folder: str) -> DataFrame:
    clusters = table(spark, folder, "global_clusters").select("doc_id", F.col("global_cluster_uid").alias("uid"), "canonical_name", "n_mentions").distinct()
    return A.anchor_bank(clusters, 0.5, 2, uid="uid", by="doc_id")


def anchor_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The best foreign anchor of every mention, null where none matches."""
    mentions = table(spark, folder, "mentions_dropped").select("doc_id", "row_index", "mention_text", "cluster_canonical_name").distinct()
    return A.foreign_anchor_hits(mentions, table(spark, folder, "selected_anchors")).select("doc_id", "row_index", "mention_key", "hit.*")


def er_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return R.component_sets(_rows(spark, folder))


def er_stitching(spark: SparkSession, folder: str) -> DataFrame:
    return R.stitching_edges(cut(_name_rows(spark, folder), "names"))


def er_adjacent_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return R.adjacent_overlap_edges(cut(_name_rows(spark, folder), "names"))


def er_overlap_coefficient(spark: SparkSession, folder: str) -> DataFrame:
    return R.coefficient_edges(cut(_name_rows(spark, folder), "names"))


def er_same_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return R.anchor_classes(_rows(spark, folder))


def er_head_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Head-alias pairs among the names of kept clusters."""
    clusters = table(spark, folder, "global_clusters").select("doc_id", F.col("global_cluster_uid").alias("uid"), F.explode(F.split("canonical_names", r"\|")).alias("name")).distinct()
    rows = clusters.select("doc_id", F.concat_ws("/", "uid", "name").alias("uid"), "name", F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end"), F.col("name").alias("text"), F.lit("core").alias("zone"), F.lit(0).cast("bigint").alias("chunk_index"))
    return R.head_alias_edges(rows)


def er_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return R.resolve(_rows(spark, folder), "greedy")


def er_components(spark: SparkSession, folder: str) -> DataFrame:
    return R.resolve(_rows(spark, folder), "components")


def _by_anchor(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, folder)
    members = rows.select("doc_id", "uid").distinct().join(R.anchor_classes(rows).select("doc_id", "uid", "representative"), ["doc_id", "uid"], "left").select("doc_id", "uid", F.coalesce("representative", "uid").alias("component"))
    return members, rows


def er_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of equal anchors, numbered in document order."""
    return R.number_entities(*_by_anchor(spark, folder))


def er_names(spark: SparkSession, folder: str) -> DataFrame:
    return R.representative_names(*_by_anchor(spark, folder))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return E.resolved_clusters(*_by_anchor(spark, folder))


def export_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The exchanged table of kept clusters, entities being clusters of equal anchors."""
    return E.kept_clusters(E.marked_by_salience(_resolved(spark, folder))).drop("component")


def export_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The audit table of the clusters the salience policy rejects."""
    return E.rejected_clusters(E.marked_by_salience(_resolved(spark, folder), 0.5, None), 0.5)


def er_non_singletons(spark: SparkSession, folder: str) -> DataFrame:
    return E.non_singletons(_resolved(spark, folder)).select("doc_id", "global_cluster_uid", "n_local_clusters", "n_mentions", "canonical_name", "local_cluster_uids")


def er_relevant_texts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each relevant mention text stands in a local cluster."""
    return R.relevant_text_counts(_rows(spark, folder))


def er_salience(spark: SparkSession, folder: str) -> DataFrame:
    """The salience split of all clusters of a document."""
    kept = table(spark, folder, "global_clusters").select("doc_id", F.col("global_cluster_uid").alias("uid"), "n_mentions")
    rejected = table(spark, folder, "rejected_global_clusters").select("doc_id", F.col("would_be_global_cluster_uid").alias("uid"), "n_mentions")
    sizes = kept.union(rejected).where("n_mentions is not null").groupBy("doc_id", "uid").agg(F.max("n_mentions").alias("n_mentions"))
    return R.salience_split(sizes, order=("uid",))


QUERIES = {f.__name__: f for f in (name_mentions_recorded, anchor_bank, anchor_bank_by_document, anchor_hits, er_evidence, er_stitching, er_adjacent_overlap, er_overlap_coefficient, er_same_anchor, er_head_alias, er_greedy, er_components, er_numbered, er_names, er_non_singletons, er_relevant_texts, er_salience, export_clusters, export_rejected)}

_KEY = TX.sql_key("canonical_name")
_CANDIDATE = f"(k <> '' AND k NOT IN ({TX._list(X.ANCHOR_PRONOUNS)}) AND k NOT IN ({TX._list(X.GENERIC_ANCHORS)}) AND NOT regexp_matches(k, '^[0-9 ]+$') AND NOT (k NOT LIKE '% %' AND length(k) <= 2))"


def _bank(uid: str, by: str, q: float) -> str:
    part = "doc_id, " if by else ""
    over = "PARTITION BY doc_id" if by else ""
    return f"""
WITH c AS (SELECT DISTINCT doc_id, {uid} AS uid, canonical_name, n_mentions, {_KEY} AS k FROM global_clusters),
g AS (SELECT {part}k AS anchor_key, arg_min(canonical_name, uid) AS display_name, CAST(sum(coalesce(n_mentions, 0)) AS BIGINT) AS n_mentions, array_to_string(list_sort(list(DISTINCT uid)), '|') AS source_cluster_uids FROM c WHERE {_CANDIDATE} GROUP BY {part}k HAVING sum(coalesce(n_mentions, 0)) >= 2),
q AS (SELECT *, quantile_cont(n_mentions, {q}) OVER ({over}) AS cut FROM g)
SELECT {part}anchor_key, display_name, n_mentions, source_cluster_uids FROM q WHERE n_mentions >= cut"""


_ROWS = f"""
{_EVIDENCE}, spec AS (SELECT doc_id, chunk_index, min(core_start) AS core_start, arg_min(core_end, (core_start, core_end)) AS core_end FROM chunks GROUP BY doc_id, chunk_index),
r AS (SELECT ev.doc_id, printf('chunk_%03d::cluster_%03d', ev.chunk_index, cluster_id) AS uid, subject AS name, mention_start AS start, mention_end AS "end", ev.chunk_index, {TX.sql_normalize('mention_text')} AS t, {TX.sql_content('mention_text')} AS c,
    CASE WHEN mention_end <= core_start THEN 'left_overlap' WHEN mention_start >= core_end THEN 'right_overlap' ELSE 'core' END AS zone
  FROM ev LEFT JOIN spec ON ev.doc_id = spec.doc_id AND ev.chunk_index = spec.chunk_index),"""
_SETS = f"""
e AS (SELECT *, start || ':' || "end" || ':' || t AS key, (t NOT IN ({TX._list(X.PRONOUNS)}) AND len(c) > 0) AS relevant, zone IN ('left_overlap', 'right_overlap') AS overlap FROM r),
sets AS (SELECT doc_id, uid, max(name) AS name, count(*) AS n_mentions, min(chunk_index) AS chunk_min, max(chunk_index) AS chunk_max, min(start) AS first_start, count(DISTINCT key) AS n_keys, count(DISTINCT key) FILTER (relevant) AS n_relevant,
    count(DISTINCT key) FILTER (overlap) AS n_overlap, count(DISTINCT key) FILTER (overlap AND relevant) AS n_overlap_relevant FROM e GROUP BY doc_id, uid),
named AS (SELECT *, CASE WHEN regexp_matches(name, '(^|[^A-Za-z])[A-Z]') AND {TX.sql_normalize('name')} NOT IN ({TX._list(X.PRONOUNS)}) THEN {TX.sql_normalize('name')} END AS anchor, {TX.sql_content('name')} AS nc FROM sets)"""
_NAME_ROWS = rf"""{_PIECES},
c AS (SELECT DISTINCT doc_id, chunk_id, chunk_index, global_start, global_end, core_start, core_end FROM chunks),
ct AS (SELECT c.*, t.token_id - global_start AS li, t.text FROM c JOIN toks t ON c.doc_id = t.doc_id AND t.token_id >= global_start AND t.token_id < global_end),
w AS (SELECT *, regexp_replace(text, '^[^\p{{L}}\p{{N}}]+|([''’]s)?[^\p{{L}}\p{{N}}]+$|[''’]s$', '', 'g') AS word, coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc_id, chunk_id ORDER BY li), '[^\p{{L}}\p{{N}}]$'), true) AS eb FROM ct),
n AS (SELECT *, regexp_matches(word, '^\p{{Lu}}\p{{L}}+') AND {TX.sql_normalize('word')} NOT IN ({TX._list(X.PRONOUNS)}) AS nm FROM w),
u AS (SELECT *, sum(CASE WHEN NOT nm OR eb THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chunk_id ORDER BY li) AS run FROM n),
g AS (SELECT doc_id, chunk_id, chunk_index, global_start, core_start, core_end, run, min(li) AS ls, max(li) + 1 AS le, string_agg(word, ' ' ORDER BY li) AS text, bool_or(eb) AS initial FROM u WHERE nm GROUP BY ALL),
k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, chunk_id ORDER BY lower(text)) - 1 AS cluster FROM g WHERE NOT initial OR le - ls > 1),
o AS (SELECT doc_id, chunk_id || printf('::cluster_%03d', cluster) AS uid, ls + global_start AS start, le + global_start AS "end", text, chunk_index, core_start, core_end FROM k),
q AS (SELECT *, max(text) OVER (PARTITION BY doc_id, uid) AS name, CASE WHEN start >= core_start AND "end" <= core_end THEN 'core' WHEN "end" <= core_start THEN 'left_overlap' WHEN start >= core_end THEN 'right_overlap' ELSE 'cross_zone' END AS zone FROM o),
r AS (SELECT doc_id, uid, name, start, "end", chunk_index, {TX.sql_normalize('text')} AS t, {TX.sql_content('text')} AS c, zone, text FROM q),{_SETS}"""
_ROWS += _SETS


def _pairs(condition: str, by: str = "") -> str:
    extra = f", {by} AS b" if by else ", '' AS b"
    return f"keys AS (SELECT DISTINCT doc_id, key{extra}, uid FROM e WHERE {condition}), pairs AS (SELECT x.doc_id, x.uid AS left_uid, y.uid AS right_uid, count(*) AS shared FROM keys x JOIN keys y ON x.doc_id = y.doc_id AND x.key = y.key AND x.b = y.b AND x.uid < y.uid GROUP BY x.doc_id, x.uid, y.uid)"


ORACLES = {
    "anchor_bank": _bank("doc_id || ':' || global_cluster_uid", "", 0.95),
    "anchor_bank_by_document": _bank("global_cluster_uid", "doc_id", 0.5),
    "er_evidence": f"WITH {_ROWS} SELECT doc_id, uid, name, n_mentions, chunk_min, chunk_max, first_start, n_keys, n_relevant, n_overlap, n_overlap_relevant, anchor, CASE WHEN len(nc) > 0 THEN {TX.sql_singular('nc[-1]')} ELSE '' END AS head FROM named",
    "er_stitching": f"WITH {_NAME_ROWS}, {_pairs('overlap AND ' + TX.sql_normalize('name') + chr(32) + '<> ' + chr(39) * 2, TX.sql_normalize('name'))} SELECT doc_id, left_uid, right_uid, shared AS shared_overlap_mention_count FROM pairs",
    "er_adjacent_overlap": f"""WITH {_NAME_ROWS}, {_pairs('overlap AND relevant')}
SELECT p.doc_id, left_uid, right_uid, shared, shared / least(a.n_overlap_relevant, b.n_overlap_relevant) AS overlap_coefficient FROM pairs p JOIN sets a ON p.doc_id = a.doc_id AND left_uid = a.uid JOIN sets b ON p.doc_id = b.doc_id AND right_uid = b.uid
WHERE (a.chunk_max + 1 = b.chunk_min OR b.chunk_max + 1 = a.chunk_min) AND shared >= 2 AND shared / least(a.n_overlap_relevant, b.n_overlap_relevant) >= 0.8""",
    "er_overlap_coefficient": f"""WITH {_NAME_ROWS}, {_pairs('relevant')}
SELECT p.doc_id, left_uid, right_uid, shared, shared / least(a.n_relevant, b.n_relevant) AS overlap_coefficient FROM pairs p JOIN sets a ON p.doc_id = a.doc_id AND left_uid = a.uid JOIN sets b ON p.doc_id = b.doc_id AND right_uid = b.uid WHERE shared >= 2 AND shared / least(a.n_relevant, b.n_relevant) >= 0.75""",
    "er_same_anchor": f"WITH {_ROWS} SELECT doc_id, uid, anchor, representative, n - 1 AS n_linked FROM (SELECT doc_id, uid, anchor, min(uid) OVER w AS representative, count(*) OVER w AS n FROM named WHERE anchor IS NOT NULL WINDOW w AS (PARTITION BY doc_id, anchor)) WHERE n > 1",
    "er_head_alias": f"""
WITH n AS (SELECT DISTINCT doc_id, unnest(string_split(canonical_names, '|')) AS name FROM global_clusters),
c AS (SELECT DISTINCT doc_id, {TX.sql_content('name')} AS c FROM n),
h AS (SELECT DISTINCT doc_id, array_to_string(c, ' ') AS phrase, {TX.sql_singular('c[-1]')} AS head, list_distinct(list_transform(c, lambda w: {TX.sql_singular('w')})) AS s FROM c WHERE len(c) > 0),
p AS (SELECT a.doc_id, a.phrase AS left_phrase, b.phrase AS right_phrase, a.head, len(list_intersect(a.s, b.s)) AS k, len(a.s) AS na, len(b.s) AS nb FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.head = b.head AND a.phrase < b.phrase WHERE {TX.sql_singular('a.head')} NOT IN ({TX._list(X.GENERIC_HEADS)}))
SELECT doc_id, left_phrase, right_phrase, k / (na + nb - k) AS score, head FROM p WHERE k = na OR k = nb OR k / (na + nb - k) >= 0.5""",
    "er_numbered": f"""
WITH {_ROWS}, m AS (SELECT doc_id, uid, CASE WHEN anchor IS NOT NULL THEN min(uid) OVER (PARTITION BY doc_id, anchor) ELSE uid END AS component FROM named),
g AS (SELECT r.doc_id, component, count(*) AS n_mentions, count(DISTINCT r.uid) AS n_local_clusters, min(chunk_index) AS chunk_min, max(chunk_index) AS chunk_max, min((chunk_index, start)) AS f, arg_min(start, (chunk_index, start)) AS first_start FROM r JOIN m ON r.doc_id = m.doc_id AND r.uid = m.uid GROUP BY r.doc_id, component)
SELECT doc_id, component, printf('global_cluster_%06d', row_number() OVER (PARTITION BY doc_id ORDER BY f, component) - 1) AS global_cluster_uid, n_mentions, n_local_clusters, chunk_min, chunk_max, first_start FROM g""",
    "er_salience": """
WITH s AS (SELECT doc_id, uid, max(n_mentions) AS n_mentions FROM (SELECT doc_id, global_cluster_uid AS uid, n_mentions FROM global_clusters UNION ALL SELECT doc_id, would_be_global_cluster_uid, n_mentions FROM rejected_global_clusters) WHERE n_mentions IS NOT NULL GROUP BY doc_id, uid),
c AS (SELECT *, CAST(ceil(quantile_cont(CAST(n_mentions AS DOUBLE), 0.95) OVER (PARTITION BY doc_id)) AS BIGINT) AS cutoff, row_number() OVER (PARTITION BY doc_id ORDER BY n_mentions DESC, uid) AS r FROM s),
p AS (SELECT *, count(*) FILTER (n_mentions >= cutoff) OVER (PARTITION BY doc_id) AS passing FROM c)
SELECT doc_id, uid, n_mentions, cutoff, CASE WHEN passing < 10 THEN r <= 10 ELSE n_mentions >= cutoff END AS kept FROM p""",
}

_NUMBERED = f"""{_ROWS},
m AS (SELECT doc_id, uid, CASE WHEN anchor IS NOT NULL THEN min(uid) OVER (PARTITION BY doc_id, anchor) ELSE uid END AS component FROM named),
g AS (SELECT r.doc_id, component, count(*) AS n_mentions, count(DISTINCT r.uid) AS n_local_clusters, min(chunk_index) AS chunk_min, max(chunk_index) AS chunk_max, min((chunk_index, start)) AS f, arg_min(start, (chunk_index, start)) AS first_start FROM r JOIN m ON r.doc_id = m.doc_id AND r.uid = m.uid GROUP BY r.doc_id, component),
ids AS (SELECT *, printf('global_cluster_%06d', row_number() OVER (PARTITION BY doc_id ORDER BY f, component) - 1) AS global_cluster_uid FROM g),
own AS (SELECT doc_id, uid, max(name) AS name, min((chunk_index, start, uid)) AS f FROM r WHERE name IS NOT NULL GROUP BY doc_id, uid),
cand AS (SELECT m.doc_id, component, name, count(*) AS n, min(f) AS f FROM own JOIN m ON own.doc_id = m.doc_id AND own.uid = m.uid GROUP BY m.doc_id, component, name),
nm AS (SELECT doc_id, component, name AS canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, component ORDER BY n DESC, f, name) AS k FROM cand) WHERE k = 1),
st AS (SELECT m.doc_id, component, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), '|'), '') AS canonical_names, array_to_string(list_sort(list(DISTINCT m.uid)), '|') AS local_cluster_uids FROM m JOIN r ON m.doc_id = r.doc_id AND m.uid = r.uid GROUP BY m.doc_id, component),
res AS (SELECT ids.*, canonical_name, canonical_names, local_cluster_uids FROM ids JOIN st ON ids.doc_id = st.doc_id AND ids.component = st.component LEFT JOIN nm ON ids.doc_id = nm.doc_id AND ids.component = nm.component)"""


def _split(percentile: float, least: int | None) -> str:
    kept = f"CASE WHEN passing < {least} THEN k <= {least} ELSE n_mentions >= cutoff END" if least else "n_mentions >= cutoff"
    return f"""{_NUMBERED},
c AS (SELECT *, CAST(ceil(quantile_cont(CAST(n_mentions AS DOUBLE), {percentile}) OVER (PARTITION BY doc_id)) AS BIGINT) AS cutoff, row_number() OVER (PARTITION BY doc_id ORDER BY n_mentions DESC, chunk_min, first_start, component) AS k FROM res),
s AS (SELECT *, count(*) FILTER (n_mentions >= cutoff) OVER (PARTITION BY doc_id) AS passing FROM c), split AS (SELECT *, {kept} AS kept FROM s)"""


ORACLES |= {
    "name_mentions_recorded": f"WITH {_NAME_ROWS} SELECT doc_id, uid, name, start, \"end\", text, zone, chunk_index FROM r",
    "er_names": f"WITH {_NUMBERED} SELECT doc_id, component, canonical_name FROM nm",
    "er_non_singletons": f"WITH {_NUMBERED} SELECT doc_id, global_cluster_uid, n_local_clusters, n_mentions, canonical_name, local_cluster_uids FROM res WHERE n_local_clusters >= 2",
    "er_relevant_texts": f"WITH {_ROWS} SELECT doc_id, uid, t AS text_key, count(*) AS n FROM e WHERE relevant GROUP BY doc_id, uid, t",
    "export_clusters": f"WITH {_split(0.95, 10)} SELECT doc_id, printf('global_cluster_%06d', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_min, first_start, component) - 1) AS global_cluster_uid, n_local_clusters, n_mentions, canonical_name, canonical_names, local_cluster_uids, chunk_min, chunk_max FROM split WHERE kept",
    "export_rejected": f"""WITH {_split(0.5, None)} SELECT doc_id, printf('rejected_global_cluster_%06d', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_min, first_start, component) - 1) AS rejected_global_cluster_uid, global_cluster_uid AS would_be_global_cluster_uid, component AS merge_component_uid,
  '{E.REASON}' AS rejection_reason, CAST(0.5 AS DOUBLE) AS salience_percentile, cutoff AS salience_cutoff, n_local_clusters, n_mentions, canonical_name, canonical_names, local_cluster_uids, chunk_min, chunk_max FROM split WHERE NOT kept""",
}

for _name, _column in (("er_adjacent_overlap", "overlap_coefficient"), ("er_overlap_coefficient", "overlap_coefficient"), ("er_head_alias", "score")):
    QUERIES[_name] = rounded(QUERIES[_name])
    ORACLES[_name] = rounded_sql(ORACLES[_name], _column)
