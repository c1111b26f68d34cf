"""SQL of the training-data queries that SQL can express over the whole tables."""

_SIZES = """
sizes AS (
  SELECT doc_id, uid, max(n_mentions) AS x FROM (
    SELECT doc_id, global_cluster_uid AS uid, n_mentions FROM global_clusters
    UNION ALL SELECT doc_id, would_be_global_cluster_uid, n_mentions FROM rejected_global_clusters)
  WHERE doc_id IS NOT NULL AND uid IS NOT NULL AND n_mentions IS NOT NULL GROUP BY doc_id, uid),
shares AS (
  SELECT d.doc_id, CAST(round(100 - 100 * coalesce(p, 0.95)) AS BIGINT) AS keep
  FROM (SELECT DISTINCT doc_id FROM sizes) d
  LEFT JOIN (SELECT doc_id, max(salience_percentile) AS p FROM rejected_global_clusters GROUP BY doc_id) r ON d.doc_id = r.doc_id),
totals AS (SELECT doc_id, count(*) AS n_all FROM sizes GROUP BY doc_id),
steps AS (
  SELECT v.doc_id, v.x, (SELECT count(*) FROM sizes s WHERE s.doc_id = v.doc_id AND s.x >= v.x) AS n_kept
  FROM (SELECT DISTINCT doc_id, x FROM sizes) v),
best AS (
  SELECT s.doc_id, max(s.x) AS cutoff, min(s.n_kept) AS n_kept, min(t.n_all) AS n_all
  FROM steps s JOIN totals t ON s.doc_id = t.doc_id JOIN shares k ON s.doc_id = k.doc_id
  WHERE 100 * s.n_kept >= k.keep * t.n_all GROUP BY s.doc_id)
"""

_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))"

_KEYS = r"""
WITH texts AS (
  SELECT DISTINCT doc_id, cluster_id, mention_id, regexp_replace(lower(context_text), '[^\p{L}\p{N}]+', '', 'g') AS k
  FROM trait_evidence WHERE mention_id IS NOT NULL AND context_text IS NOT NULL),
lines AS (SELECT line_id, trim(line_text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM mention_lines WHERE line_text IS NOT NULL),
fields AS (
  SELECT line_id, trim(f) AS f, json_extract_string(t, '$."' || f || '"') AS v
  FROM (SELECT line_id, t, unnest(json_keys(t)) AS f FROM lines WHERE t LIKE '{%')
  UNION ALL
  SELECT line_id, trim(regexp_extract(p, '^([^=]*)=', 1)), regexp_replace(p, '^[^=]*=', '')
  FROM (SELECT line_id, unnest(string_split(t, chr(9))) AS p FROM lines WHERE t NOT LIKE '{%') WHERE trim(p) <> ''),
keys AS (
  SELECT line_id, string_agg(f || chr(31) || coalesce(regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g'), ''), chr(30) ORDER BY f) AS k FROM fields GROUP BY line_id)"""

_WORDS = r"regexp_extract_all(regexp_replace(lower(nfc_normalize(regexp_replace(regexp_replace({x}, '([\p{L}\p{N}])[-‐‑\x{AD}][ \t]*\r?\n[ \t]*([\p{L}\p{N}])', '\1\2', 'g'), '[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'))), 'ß', 'ss', 'g'), '[\p{L}\p{N}]+')"

ORACLES = {
    "p1_found": f"""
WITH RECURSIVE pairs AS (
  SELECT doc_id, {_TRIM.format('left_component_uid')} AS a, {_TRIM.format('right_component_uid')} AS b FROM merge_edges),
lists AS (
  SELECT doc_id, row_number() OVER () AS l, local_cluster_uids FROM global_clusters),
members AS (
  SELECT doc_id, l, {_TRIM.format('m')} AS m FROM (SELECT doc_id, l, unnest(string_split(local_cluster_uids, '|')) AS m FROM lists)),
usable AS (SELECT doc_id, l, m FROM members WHERE m <> ''),
edges AS (
  SELECT DISTINCT doc_id, a, b FROM pairs WHERE doc_id IS NOT NULL AND a <> '' AND b <> ''
  UNION SELECT doc_id, min(m) OVER (PARTITION BY doc_id, l), m FROM usable WHERE doc_id IS NOT NULL),
sides AS (SELECT doc_id, a, b FROM edges UNION SELECT doc_id, b, a FROM edges),
reach AS (
  SELECT doc_id, a AS v, a AS r FROM sides
  UNION SELECT reach.doc_id, sides.b, reach.r FROM reach JOIN sides ON reach.doc_id = sides.doc_id AND reach.v = sides.a)
SELECT doc_id, v AS component_uid, min(r) AS group_uid FROM reach GROUP BY doc_id, v""",
    "p2_found": "SELECT DISTINCT doc_id, chunk_id FROM chunks WHERE global_end - global_start > 300 AND doc_id IS NOT NULL AND chunk_id IS NOT NULL",
    "p3_sample": """
WITH r AS (SELECT max(read_up_to) AS upto FROM run_log WHERE stage = 'trait_evidence' AND lower(trim(run_status)) = 'success'),
f AS (
  SELECT mention_id, CASE WHEN bool_or(coalesce(arrived_at <= upto, false)) THEN 0 ELSE 1 END AS batch, min(cluster_id) FILTER (arrived_at <= upto) AS c0, min(cluster_id) AS c1
  FROM trait_evidence, r WHERE mention_id IS NOT NULL GROUP BY mention_id)
SELECT mention_id, cluster_id, number FROM (
  SELECT mention_id, CASE WHEN batch = 0 THEN c0 ELSE c1 END AS cluster_id, CAST(CAST('0x' || substr(md5('sample-1:' || batch || ':' || mention_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS number FROM f)
WHERE number < 0.1""",
    "p2_chunk_cover": """
SELECT doc_id, chunk_id, max(global_end - global_start) AS n_covered, arg_max(global_start, (global_end - global_start, global_start)) AS first_token, arg_max(global_end, (global_end - global_start, global_start)) AS end_token, 0 AS n_gaps, 0 AS n_over_limit, 0 AS n_odd
FROM chunks WHERE global_end - global_start > 300 AND doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY doc_id, chunk_id""",
    "p2_document_cover": r"""
SELECT doc_id, n AS n_covered, 0 AS first_token, n AS end_token, 0 AS n_gaps, 0 AS n_over_limit, 0 AS n_odd FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 300""",
    "p2_document_overlaps": r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n, sentence_starts FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, n, list_sort(list_distinct(list_concat([0, n], list_filter(sentence_starts, lambda x: x > 0 AND x < n)))) AS b FROM d WHERE n > 300)
SELECT doc_id, true AS is_cut, 0 AS n_inside_sentences FROM b WHERE list_max(list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i])) <= 300""",
    "p5_found": f"""{_KEYS},
found AS (
  SELECT 'trait_evidence' AS found_in, min(mention_id) OVER (PARTITION BY doc_id, cluster_id, k) AS first_id, mention_id AS copy_id FROM texts
  UNION ALL SELECT 'mention_lines', min(line_id) OVER (PARTITION BY k), line_id FROM keys)
SELECT found_in, first_id, copy_id FROM found WHERE copy_id <> first_id""",
    "p5_collapsed": f"""{_KEYS}
SELECT 'trait_evidence' AS found_in, min(mention_id) AS first_id, count(DISTINCT mention_id) AS n_copies FROM texts GROUP BY doc_id, cluster_id, k
UNION ALL SELECT 'mention_lines', min(line_id), count(DISTINCT line_id) FROM keys GROUP BY k""",
    "p8_found": f"""
WITH items AS (SELECT item_id, {_WORDS.replace('{x}', 'item_text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL),
phrases AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items WHERE len(w) >= 12)),
docs AS (SELECT doc_id, {_WORDS.replace('{x}', 'text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
runs AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM runs JOIN phrases ON runs.p = phrases.p""",
    "p6_found": f"WITH {_SIZES} SELECT doc_id, cutoff, n_kept FROM best",
    "p6_cutoffs": f"WITH {_SIZES} SELECT doc_id, cutoff, n_kept, n_all FROM best",
}
