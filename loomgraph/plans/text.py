"""Queries of the scalar text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.matching import with_lexical_match, word_match
from loomgraph.plans import rounded, rounded_sql
from loomgraph.runtime import spread, table

WS = X.BLANK


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mentions_dropped").groupBy("row_index").agg(F.max("mention_text").alias("t"), F.max("cluster_canonical_name").alias("name"))


def text_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned documents."""
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", X.clean_text("text").alias("clean_text"))


def text_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized text, canonical key and its words."""
    return _mentions(spark, folder).select(
        "row_index", X.normalize("t").alias("normalized"), X.none_if_nan("t").alias("not_nan"), X.canonical_key("t").alias("canonical_key"), F.size(X.tokens_of(X.canonical_key("t"))).alias("n_tokens"),
    )


def text_content(spark: SparkSession, folder: str) -> DataFrame:
    """Content words, phrase, word set, head and the tests built on them."""
    return _mentions(spark, folder).select(
        "row_index", F.array_join(X.content_tokens("t"), "|").alias("content"), X.entity_phrase("t").alias("phrase"), F.array_join(F.array_sort(X.token_set("t")), "|").alias("word_set"), X.head_word("t").alias("head"),
        X.is_generic_head(X.head_word("t")).alias("generic_head"), X.is_generic_nominal("t").alias("generic"), X.is_pronoun("t").alias("pronoun"), X.is_proper_name("t").alias("proper"), X.is_relevant_mention("t").alias("relevant"),
    )


def text_anchor_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster names that may serve as anchors."""
    keys = table(spark, folder, "global_clusters").select(X.canonical_key("canonical_name").alias("anchor_key")).distinct()
    return keys.withColumn("candidate", X.is_anchor_candidate("anchor_key"))


def text_word_match(spark: SparkSession, folder: str) -> DataFrame:
    """Equality or word containment of each mention's key and its recorded anchor."""
    pairs = table(spark, folder, "mentions_dropped").where("matched_anchor_key is not null").select("row_index", X.canonical_key("mention_text").alias("k"), F.col("matched_anchor_key").alias("a")).distinct()
    return pairs.select("row_index", "k", "a", F.inline(F.array(word_match(F.col("k"), F.col("a")))))


def text_lexical_match(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the character ratio where words do not decide."""
    pairs = table(spark, folder, "mentions_dropped").where("matched_anchor_key is not null").select("row_index", X.canonical_key("mention_text").alias("k"), F.col("matched_anchor_key").alias("a")).distinct()
    return with_lexical_match(pairs, "k", "a", 0.60).select("row_index", "k", "a", "match.matched", "match.score", "match.method")


def text_surface_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Head-alias similarity of a mention and its cluster's name."""
    return _mentions(spark, folder).where("name is not null and t is not null").select("row_index", F.inline(F.array(X.surface_similarity("t", "name", 0.5))))


def text_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts freed of tokenization blanks."""
    return table(spark, folder, "trait_evidence").select("mention_id", X.context_key("context_text").alias("context_key")).distinct()


def text_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """Replacement and rule of every mention, and whether rendering changes it."""
    rows = table(spark, folder, "trait_evidence").select("mention_id", "mention_text", "subject").distinct()
    return rows.select("mention_id", "mention_text", "subject", F.inline(F.array(X.rendered_mention("mention_text", "subject")))).withColumn("changed", X.context_key("mention_text") != X.context_key("replacement"))


def text_iri_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Local names, namespaces and readable labels of the properties that occur in relations."""
    keys = F.explode(F.map_keys(F.from_json("object_property_probabilities_json", "map<string,double>")))
    return table(spark, folder, "relation_assignments").select(keys.alias("iri")).distinct().select(
        "iri", X.local_name("iri").alias("local_name"), X.iri_namespace("iri").alias("namespace"), X.short_iri("iri").alias("short"), X.human_label("iri").alias("label"), X.identifier_key("iri").alias("identifier"),
    )


def text_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted identifiers and what can be read back from them."""
    rel = table(spark, folder, "relation_assignments").select("doc_id", "relation_id", "source_mention_id", "predicate_token_i", "target_mention_id").distinct()
    return rel.select("doc_id", "relation_id", X.relation_id("source_mention_id", "predicate_token_i", "target_mention_id").alias("made_id"), X.short_id("relation_id").alias("short_id"), X.global_cluster_uid("source_mention_id").alias("uid"), X.cluster_number(X.global_cluster_uid("source_mention_id")).alias("number"))


def text_display(spark: SparkSession, folder: str) -> DataFrame:
    """Display texts of clusters: names as IRIs, file names, short forms and counts."""
    c = table(spark, folder, "global_clusters").select("doc_id", "global_cluster_uid", "canonical_name", "n_mentions").distinct()
    return c.select(
        "doc_id", "global_cluster_uid", X.iri_local("canonical_name").alias("iri_local"), X.safe_name("canonical_name").alias("file_name"), X.truncate("canonical_name", 12).alias("short_name"),
        X.literal_text(F.col("n_mentions") / 4).alias("quarter"), X.possessive("canonical_name").alias("owner"), X.clean_canonical("canonical_name").alias("clean"), X.label_key("canonical_name").alias("label_key"),
    )


QUERIES = {f.__name__: f for f in (text_clean, text_keys, text_content, text_anchor_candidates, text_word_match, text_lexical_match, text_surface_similarity, text_contexts, text_rendering, text_iri_labels, text_ids, text_display)}


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sql_normalize(x: str) -> str:
    return f"lower({sql_squeeze(f'coalesce({x}, chr(32))')})"


def sql_context_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({sql_squeeze(x)}, ' ([,.;:!?])', '\\1', 'g'), '(?i) (''s|''re|''ve|''ll|''d|''m|n''t)\\b', '\\1', 'g'), '{WS}*—{WS}*', '—', 'g'))"


def sql_key(x: str) -> str:
    t = f"translate(lower({sql_strip(f'coalesce({x}, chr(32))')}), '’‘`', '''''''')"
    t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])([a-z0-9]+)''s\\b', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '^((the|a|an){WS}+)+', '')"
    return f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'))"


def sql_content(x: str) -> str:
    return f"list_filter(regexp_extract_all({sql_normalize(x)}, '[a-z0-9]+'), lambda w: w NOT IN ({_list(X.DETERMINERS)}))"


def sql_singular(w: str) -> str:
    return f"(CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {w}[:-4] || 'y' WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN {w}[:-2] ELSE {w} END)"


_MENTIONS = "m AS (SELECT row_index, max(mention_text) AS t, max(cluster_canonical_name) AS name FROM mentions_dropped GROUP BY row_index)"


def _content_of(x: str, p: str) -> str:
    return f"{sql_content(x)} AS {p}c, list_distinct(list_transform({sql_content(x)}, lambda w: {sql_singular('w')})) AS {p}s, {sql_normalize(x)} AS {p}n"


_HEAD = "CASE WHEN len({p}c) > 0 THEN " + sql_singular("{p}c[-1]") + " ELSE '' END"


def _head(p: str) -> str:
    return _HEAD.replace("{p}", p)


_GENERIC_HEAD = f"({{h}} = '' OR {sql_singular('{h}')} IN ({_list(X.GENERIC_HEADS)}))"

_CLEAN = "translate(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(65279), ''), '’‘“”', '''''\"\"')"

ORACLES = {
    "text_clean": f"""
WITH a AS (SELECT doc_id, regexp_replace({_CLEAN}, '(?m)^[ \\t]*[0-9]+[ \\t]*$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(t, chr(10) || chr(10)), lambda p: length({sql_strip('p')}) > 0), lambda p: {sql_strip(f"regexp_replace(p, '{WS}*\\n{WS}*', ' ', 'g')")}), chr(10) || chr(10)) AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(?im)^\\s*chapter\\s+(?:[ivxlcdm]+|[0-9]+)\\b[^\\n]*\\n*', '', 'g') AS t FROM b)
SELECT doc_id, {sql_strip("regexp_replace(t, '[ \\t]+', ' ', 'g')")} AS clean_text FROM c""",
    "text_keys": f"""
WITH {_MENTIONS}
SELECT row_index, {sql_normalize('t')} AS normalized, CASE WHEN lower(t) <> 'nan' THEN t END AS not_nan, {sql_key('t')} AS canonical_key,
  len(list_filter(string_split({sql_key('t')}, ' '), lambda w: w <> '')) AS n_tokens FROM m""",
    "text_content": f"""
WITH {_MENTIONS}, x AS (SELECT row_index, t, {_content_of('t', 'x')} FROM m), y AS (SELECT *, {_head('x')} AS head FROM x)
SELECT row_index, array_to_string(xc, '|') AS content, array_to_string(xc, ' ') AS phrase, array_to_string(list_sort(xs), '|') AS word_set, head,
  {_GENERIC_HEAD.replace('{h}', 'head')} AS generic_head,
  (xn = '' OR xn IN ({_list(X.GENERIC_PHRASES)}) OR {_GENERIC_HEAD.replace('{h}', 'head')}) AS generic,
  xn IN ({_list(X.PRONOUNS)}) AS pronoun,
  coalesce(regexp_matches(t, '(^|[^A-Za-z])[A-Z]') AND xn NOT IN ({_list(X.PRONOUNS)}), false) AS proper,
  (xn NOT IN ({_list(X.PRONOUNS)}) AND len(xc) > 0) AS relevant FROM y""",
    "text_anchor_candidates": f"""
SELECT k AS anchor_key, (k <> '' AND k NOT IN ({_list(X.ANCHOR_PRONOUNS)}) AND k NOT IN ({_list(X.GENERIC_ANCHORS)}) AND NOT regexp_matches(k, '^[0-9 ]+$') AND NOT (k NOT LIKE '% %' AND length(k) <= 2)) AS candidate
FROM (SELECT DISTINCT {sql_key('canonical_name')} AS k FROM global_clusters)""",
    "text_word_match": f"""
WITH p AS (SELECT DISTINCT row_index, {sql_key('mention_text')} AS k, matched_anchor_key AS a FROM mentions_dropped WHERE matched_anchor_key IS NOT NULL),
w AS (SELECT *, list_distinct(list_filter(string_split(k, ' '), lambda x: x <> '')) AS tk, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS ta FROM p),
s AS (SELECT *, len(list_intersect(tk, ta)) AS both_, len(tk) AS nk, len(ta) AS na FROM w)
SELECT row_index, k, a, (k <> '' AND a <> '' AND (k = a OR both_ = nk OR both_ = na)) AS matched,
  CASE WHEN k = '' OR a = '' THEN 0.0 WHEN k = a THEN 1.0 WHEN both_ = nk OR both_ = na THEN both_ / (nk + na - both_) ELSE 0.0 END AS score,
  CASE WHEN k = '' OR a = '' THEN 'none' WHEN k = a THEN 'exact' WHEN both_ = nk OR both_ = na THEN 'token_subset' ELSE 'none' END AS method FROM s""",
    "text_surface_similarity": f"""
WITH {_MENTIONS}, x AS (SELECT row_index, {_content_of('t', 'l')}, {_content_of('name', 'r')} FROM m WHERE t IS NOT NULL AND name IS NOT NULL),
y AS (SELECT *, {_head('l')} AS lh, {_head('r')} AS rh, len(list_intersect(ls, rs)) AS common FROM x),
z AS (SELECT *, CASE WHEN len(ls) = 0 OR len(rs) = 0 THEN 0.0 ELSE common / (len(ls) + len(rs) - common) END AS j, (lh = rh AND lh <> '' AND NOT {_GENERIC_HEAD.replace('{h}', 'lh')}) AS same FROM y)
SELECT row_index,
  CASE WHEN len(lc) = 0 OR len(rc) = 0 THEN false WHEN lc = rc THEN true WHEN NOT same THEN false ELSE (common = len(ls) OR common = len(rs) OR j >= 0.5) END AS is_match,
  CASE WHEN len(lc) = 0 OR len(rc) = 0 THEN 0.0 WHEN lc = rc THEN 1.0 WHEN NOT same THEN 0.0 ELSE j END AS score,
  CASE WHEN len(lc) = 0 OR len(rc) = 0 THEN '' WHEN lc = rc THEN lh WHEN NOT same THEN (CASE WHEN lh = rh THEN lh ELSE '' END) ELSE lh END AS head FROM z""",
    "text_contexts": f"""
SELECT DISTINCT mention_id, trim(regexp_replace(regexp_replace(regexp_replace({sql_squeeze('context_text')}, ' ([,.;:!?])', '\\1', 'g'), '(?i) (''s|''re|''ve|''ll|''d|''m|n''t)\\b', '\\1', 'g'), '{WS}*—{WS}*', '—', 'g')) AS context_key FROM trait_evidence""",
    "text_iri_labels": """
WITH k AS (SELECT DISTINCT unnest(json_keys(object_property_probabilities_json)) AS iri FROM relation_assignments)
SELECT iri, split_part(iri, '#', -1) AS local_name, regexp_extract(iri, '^(.*[#/])[^#/]*$', 1) AS namespace, split_part(iri, '#', -1) AS short,
  array_to_string(list_transform(string_split(regexp_replace(split_part(iri, '#', -1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: CASE WHEN upper(w) = w THEN w ELSE upper(w[1]) || w[2:] END), ' ') AS label,
  lower(regexp_replace(split_part(iri, '#', -1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS identifier FROM k""",
    "text_ids": """
SELECT DISTINCT doc_id, relation_id, 'rel_' || source_mention_id || '_' || predicate_token_i || '_' || target_mention_id AS made_id, substr(sha1(relation_id), 1, 16) AS short_id,
  'global_cluster_' || lpad(CAST(source_mention_id AS VARCHAR), CAST(greatest(6, length(CAST(source_mention_id AS VARCHAR))) AS INTEGER), '0') AS uid, source_mention_id AS number FROM relation_assignments""",
    "text_display": f"""
WITH c AS (SELECT DISTINCT doc_id, global_cluster_uid, canonical_name AS n, n_mentions FROM global_clusters),
d AS (SELECT *, regexp_replace(regexp_replace(strip_accents({sql_strip('n')}), '\\s+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS i, {sql_squeeze('n')} AS q, printf('%.2f', n_mentions / 4) AS f FROM c)
SELECT doc_id, global_cluster_uid, CASE WHEN regexp_matches(i, '^[0-9]') THEN 'entity_' || i ELSE i END AS iri_local,
  coalesce(nullif(regexp_replace(regexp_replace({sql_strip('n')}, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS file_name,
  CASE WHEN length(q) > 12 THEN rtrim(q[1:11]) || '…' ELSE q END AS short_name, regexp_replace(regexp_replace(f, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS quarter,
  CASE WHEN n LIKE '%''' THEN n WHEN n LIKE '%s' THEN n || '''' ELSE n || '''s' END AS owner,
  (length({sql_strip('n')}) > 0 AND NOT regexp_matches(n, '[\\n"“”.!?;:]') AND len(string_split(q, ' ')) <= 8) AS clean, lower(q) AS label_key FROM d""",
}

_FIRST = f"low IN ({_list(X.FIRST_SECOND_PERSON)})"
_PROPER = "(low = lower(nk) OR len(list_filter(regexp_split_to_array(clean, '" + WS + "+'), lambda w: regexp_matches(w, '^\\p{Lu}') AND lower(w) <> 'i')) > 0)"
_NOMINAL = f"(low NOT IN ({_list(X.KEPT_NOMINALS)}) AND starts_with(low, 'the ') AND len(string_split(low, ' ')) <= 4)"


def _rendered(cases: list[str], otherwise: str) -> str:
    tests = [_FIRST, _PROPER, f"low IN ({_list(X.SUBJECT_PRONOUNS)})", f"low IN ({_list(X.OBJECT_PRONOUNS)})", f"low IN ({_list(X.POSSESSIVE_PRONOUNS)})", f"low IN ({_list(X.REFLEXIVE_PRONOUNS)})", _NOMINAL]
    return "CASE " + " ".join(f"WHEN coalesce({t}, false) THEN {c}" for t, c in zip(tests, cases)) + f" ELSE {otherwise} END"


ORACLES["text_rendering"] = f"""
WITH m AS (SELECT DISTINCT mention_id, mention_text, subject FROM trait_evidence),
n AS (SELECT *, {sql_context_key('mention_text')} AS clean, coalesce(nullif({sql_strip('subject')}, ''), 'the character') AS name FROM m),
k AS (SELECT *, lower(clean) AS low, {sql_context_key('name')} AS nk, CASE WHEN ends_with(name, chr(39)) THEN name WHEN ends_with(name, 's') THEN name || chr(39) ELSE name || chr(39) || 's' END AS owner FROM n),
r AS (SELECT *, {_rendered(['clean', 'name', 'name', 'name', 'owner', 'clean', 'name'], 'clean')} AS replacement,
  {_rendered(["'first_second_person_keep_original'", "'proper_name_to_canonical'", "'third_person_subject_pronoun_to_canonical'", "'third_person_object_pronoun_to_canonical'", "'third_person_possessive_pronoun_to_canonical_possessive'", "'third_person_reflexive_keep_original'", "'simple_nominal_to_canonical'"], "'ambiguous_or_unsupported_keep_original'")} AS rule FROM k)
SELECT mention_id, mention_text, subject, replacement, rule, clean <> {sql_context_key('replacement')} AS changed FROM r"""

for _name in ("text_word_match", "text_surface_similarity"):
    QUERIES[_name] = rounded(QUERIES[_name])
    ORACLES[_name] = rounded_sql(ORACLES[_name], "score")
