"""Mentions, their zones, sentences and contexts; joins of spans."""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.probability import cluster_seed
from loomgraph.operators.chunks import covering_ranges
from loomgraph.operators.tokens import per_document, starts_within, with_spans, words_of
from loomgraph.runtime import running_counts

NAME_RUN = r"(?<![\p{L}\p{N}'’-])\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)*"


def zone_of(start: Column, end: Column, core_start: Column, core_end: Column) -> Column:
    """Where a span lies in its chunk: core, left_overlap, right_overlap, or cross_zone."""
    return F.when((start >= core_start) & (end <= core_end), "core").when(end <= core_start, "left_overlap").when(start >= core_end, "right_overlap").otherwise("cross_zone")


def local_mention_rows(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Provider spans as local mentions with global offsets, zones and formatted ids.

    ``extracted``: (doc_id, chunk_id, local_cluster_id, local_start, local_end, text[, head_local_i]).
    Mentions are numbered within their cluster by place; clusters without mentions do not occur.
    """
    head = F.col("head_local_i") if "head_local_i" in extracted.columns else F.lit(None).cast("bigint")
    order = Window.partitionBy("doc_id", "chunk_id", "local_cluster_id").orderBy("local_start", "local_end", "text")
    spec = chunks.dropDuplicates(["doc_id", "chunk_id"]).select("doc_id", "chunk_id", "chunk_index", "global_start", "core_start", "core_end")
    return _placed_rows(extracted.withColumn("head_local_i", head).join(spec.withColumnRenamed("global_start", "base"), ["doc_id", "chunk_id"]).withColumn("local_mention_id", (F.row_number().over(order) - 1).cast("bigint")))


def _placed_rows(rows: DataFrame, *more: str) -> DataFrame:
    """Numbered mentions of chunks (with ``base`` and core) with global offsets, zones and formatted ids."""
    start, end = F.col("local_start") + F.col("base"), F.col("local_end") + F.col("base")
    rows = rows.withColumn("global_start", start).withColumn("global_end", end).withColumn("zone", zone_of(start, end, F.col("core_start"), F.col("core_end"))).withColumn("local_cluster_uid", X.local_cluster_uid("chunk_id", "local_cluster_id"))
    return rows.select(
        "doc_id", X.local_mention_uid("local_cluster_uid", "local_mention_id").alias("local_mention_uid"), "local_cluster_uid", "chunk_id", "chunk_index", F.col("local_cluster_id").cast("bigint").alias("local_cluster_id"), "local_mention_id",
        "local_start", "local_end", "global_start", "global_end", "text", "head_local_i", (F.col("head_local_i") + F.col("base")).alias("head_global_i"), "zone", X.overlap_span_key("zone", "global_start", "global_end", "text").alias("overlap_exact_span_key"), *more,
    )


def name_mentions(chunk_token_table: DataFrame) -> DataFrame:
    """A rule-based stand-in for a coreference model: runs of capitalized words within a chunk, equal runs as one cluster.

    It finds names only, no pronouns or nominals, and makes no claim to a model's quality; runs may be
    of any length. Same columns as a model provider: (doc_id, chunk_id, local_cluster_id, local_start,
    local_end, text, head_local_i).
    """
    w = Window.partitionBy("doc_id", "chunk_id").orderBy("local_i")
    word = F.regexp_replace("text", r"^[^\p{L}\p{N}]+|(['’]s)?[^\p{L}\p{N}]+$|['’]s$", "")
    rows = chunk_token_table.withColumn("word", word).withColumn("name", F.col("word").rlike(r"^\p{Lu}\p{L}+") & ~X.normalize("word").isin(X.PRONOUNS))
    rows = rows.withColumn("ends_before", F.coalesce(F.lag("text").over(w).rlike(r"[^\p{L}\p{N}]$"), F.lit(True)))
    rows = rows.withColumn("run", F.sum((~F.col("name") | F.col("ends_before")).cast("int")).over(w)).where("name")
    runs = rows.groupBy("doc_id", "chunk_id", "run").agg(F.min("local_i").alias("local_start"), (F.max("local_i") + 1).alias("local_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_i", "word"))), lambda x: x["word"]), " ").alias("text"), F.max("ends_before").alias("initial"))
    kept = runs.where("not initial or local_end - local_start > 1").drop("run", "initial")
    return kept.withColumn("local_cluster_id", (F.dense_rank().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.lower("text"))) - 1).cast("bigint")).withColumn("head_local_i", F.col("local_end") - 1)


_ENDS = re.compile(r"\A[\W_]+|(?:['’]s)?[\W_]+\Z|['’]s\Z")
_BLANKS = re.compile(X.BLANK + "+", re.ASCII)


@lru_cache(200_000)
def _name_word(token: str) -> tuple[str, bool, bool]:
    """(word, whether it may be part of a name, whether a run ends behind the token), as in :func:`name_mentions`."""
    word = _ENDS.sub("", token)
    name = len(word) > 1 and unicodedata.category(word[0]) == "Lu" and word[1].isalpha() and _BLANKS.sub(" ", word).strip(" ").lower() not in X.PRONOUNS
    return word, name, not token[-1].isalnum()


def name_runs(facts: list[tuple[str, bool, bool]]) -> list[tuple[int, int, str]]:
    """(start, end, text) of the capitalized runs in a chunk's words; a lone word that begins a stretch is none."""
    out, run, first, initial, ended = [], [], 0, True, True
    for k, (word, name, ends) in enumerate([*facts, ("", False, True)]):
        if run and (not name or ended):
            if len(run) > 1 or not initial:
                out.append((first, first + len(run), " ".join(run)))
            run = []
        if name:
            if not run:
                first, initial = k, ended
            run.append(word)
        ended = ends
    return out


_NAMED = "doc_id bigint, chunk_id string, chunk_index bigint, base bigint, core_start bigint, core_end bigint, local_cluster_id bigint, local_mention_id bigint, local_start bigint, local_end bigint, text string, name string"


def _named_mentions(doc: int, words: list[str], chunks: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of ``_NAMED`` of a document's chunks (id, index, start and end, core start and end)."""
    facts = [_name_word(w) for w in words]
    for chunk, index, start, stop, core_start, core_end in chunks:
        left = max(start, 0)
        groups: dict[str, list] = {}
        for a, b, text in name_runs(facts[left:max(stop, 0)]):
            groups.setdefault(text.lower(), []).append((a + left - start, b + left - start, text))
        for cluster, key in enumerate(sorted(groups)):
            name = max(text for *_, text in groups[key])
            for number, (a, b, text) in enumerate(sorted(groups[key])):
                yield doc, chunk, index, start, core_start, core_end, cluster, number, a, b, text, name


def _described(rows: DataFrame) -> DataFrame:
    return _placed_rows(rows.withColumn("head_local_i", F.col("local_end") - 1), "name")


def planned_name_mentions(documents: DataFrame, limit: int = 8000, overlap: int = 80, prefix: str = "chunk") -> DataFrame:
    """:func:`name_mentions` over the chunks of ``plan_chunks`` as local mentions, document by document (doc_id, text, sentence_starts) without a shuffle.

    Also with ``name``, the greatest text of the local cluster.
    """

    def found(doc: int, text: str | None, begins: list | None) -> Iterator[tuple]:
        words = words_of(text)
        ranges = covering_ranges(starts_within(begins, len(words)), len(words), limit, overlap)
        yield from _named_mentions(doc, words, ((f"{prefix}_{k:03d}", k, *r[:4]) for k, r in enumerate(ranges)))

    return _described(per_document(documents.select("doc_id", "text", "sentence_starts"), found, _NAMED))


def recorded_name_mentions(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same over a chunk table; of several spans under one chunk id the first counts."""

    def found(doc: int, text: str, spans: list[dict]) -> Iterator[tuple]:
        first = {}
        for s in spans:
            if s["chunk_id"] is not None and s["global_start"] is not None and s["global_end"] is not None:
                first.setdefault(s["chunk_id"], tuple(s.values()))
        yield from _named_mentions(doc, words_of(text), iter(first.values()))

    spans = chunks.select("doc_id", "chunk_id", "chunk_index", "global_start", "global_end", "core_start", "core_end")
    return _described(per_document(with_spans(documents.select("doc_id", "text"), spans), found, _NAMED))


def canonical_names(mentions: DataFrame, *key: str) -> DataFrame:
    """(key, canonical_name, n_mentions): the text with the best score of cleanness, frequency and length."""
    counted = mentions.groupBy(*key, "text").agg(F.count(F.lit(1)).alias("n"))
    words = F.size(F.split(X.squeeze("text"), " "))
    score = F.when(X.clean_canonical("text"), 100).otherwise(0) + F.when(X.is_pronoun("text"), -200).otherwise(50) + 20 * F.col("n") - 3 * F.abs(words - 2) - F.greatest(F.length("text") - 40, F.lit(0))
    return counted.withColumn("score", score).groupBy(*key).agg(F.max_by("text", F.struct("score", "text")).alias("canonical_name"), F.sum("n").alias("n_mentions"))


def sentence_of_spans(spans: DataFrame, sentences: DataFrame, bucket: int = 64) -> DataFrame:
    """Spans (doc_id, span_id, start, end) with the first sentence that contains them; null where none does.

    A containment join by document and token bucket: each sentence names the buckets it covers, a
    span looks in the bucket of its start.
    """
    slots = sentences.where("end > start").select("doc_id", "sentence_index", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.explode(F.expr(f"sequence(start div {bucket}, (end - 1) div {bucket})")).alias("slot"))
    asked = spans.withColumn("slot", F.expr(f"start div {bucket}"))
    found = asked.join(slots, ["doc_id", "slot"]).where("s_start <= start and end <= s_end").groupBy("doc_id", "span_id").agg(F.min("sentence_index").alias("sentence_index"))
    return spans.join(found, ["doc_id", "span_id"], "left")


def mention_contexts(mentions: DataFrame, tokens: DataFrame, sentences: DataFrame, before: int = 0, after: int = 0, mark: bool = False) -> DataFrame:
    """(doc_id, mention_id, sentence_index, context_text, rendered_context_text, rule, was_changed).

    ``mentions``: (doc_id, mention_id, start, end, text, subject) over compact token numbers;
    ``sentences`` over the same. A window of whole sentences around each mention, once as it stands
    (with ``[[ ]]`` around the mention where ``mark``) and once with the mention rendered. A mention
    that no sentence contains has no row.
    """
    placed = sentence_of_spans(mentions.withColumnRenamed("mention_id", "span_id"), sentences).where("sentence_index is not null").withColumnRenamed("span_id", "mention_id")
    first = sentences.select("doc_id", (F.col("sentence_index") + before).alias("sentence_index"), F.col("start").alias("from_id"))
    final = sentences.select("doc_id", (F.col("sentence_index") - after).alias("sentence_index"), F.col("end").alias("to_id"))
    edges = sentences.groupBy("doc_id").agg(F.min("start").alias("doc_start"), F.max("end").alias("doc_end"))
    window = placed.join(first, ["doc_id", "sentence_index"], "left").join(final, ["doc_id", "sentence_index"], "left").join(edges, "doc_id").withColumn("from_id", F.coalesce("from_id", "doc_start")).withColumn("to_id", F.coalesce("to_id", "doc_end"))
    words = tokens.where("token_id is not null").select("doc_id", "token_id", F.col("text").alias("word"))
    near = window.select("doc_id", "mention_id", "sentence_index", "start", "end", "text", "subject", F.explode(F.expr("sequence(from_id, to_id - 1)")).alias("token_id")).join(words, ["doc_id", "token_id"])
    packed = near.groupBy("doc_id", "mention_id", "sentence_index", "start", "end", "text", "subject").agg(F.array_sort(F.collect_list(F.struct("token_id", "word"))).alias("w"))
    part = lambda cond: F.array_join(F.transform(F.filter("w", cond), lambda x: x["word"]), " ")
    left, target, right = part(lambda x: x["token_id"] < F.col("start")), part(lambda x: (x["token_id"] >= F.col("start")) & (x["token_id"] < F.col("end"))), part(lambda x: x["token_id"] >= F.col("end"))
    following = F.get(F.transform(F.filter("w", lambda x: x["token_id"] >= F.col("end")), lambda x: x["word"]), 0)
    return _rendered_contexts(packed.withColumn("_l", left).withColumn("_t", target).withColumn("_r", right).withColumn("_f", following), mark)


def _rendered_contexts(rows: DataFrame, mark: bool) -> DataFrame:
    rows = rows.withColumn("_m", X.rendered_mention("text", "subject", F.col("_f")))
    shown = F.concat(F.lit("[["), F.col("_t"), F.lit("]]")) if mark else F.col("_t")
    return rows.select(
        "doc_id", "mention_id", "sentence_index", X.context_key(F.concat_ws(" ", "_l", shown, "_r")).alias("context_text"), X.context_key(F.concat_ws(" ", "_l", "_m.replacement", "_r")).alias("rendered_context_text"),
        F.col("_m.rule").alias("mention_render_rule"), (X.context_key("_t") != X.context_key("_m.replacement")).alias("mention_render_was_changed"),
    )


def _window_of(starts: list[int], size: int, start: int | None, end: int | None, before: int, after: int) -> tuple[int, int, int] | None:
    """(sentence, first and last end of the window) of the first sentence that contains a span."""
    ends = [*starts[1:], size]
    k = bisect_left(ends, end) if start is not None and end is not None else len(ends)
    return (k, starts[max(0, k - before)], ends[min(len(ends) - 1, k + after)]) if k < len(ends) and starts[k] <= start else None


def document_contexts(mentions: DataFrame, documents: DataFrame, before: int = 0, after: int = 0, mark: bool = False) -> DataFrame:
    """The same as :func:`mention_contexts` from whole documents (doc_id, text, sentence_starts); equal mentions have one row."""

    def windows(doc: int, text: str, begins: list | None, asked: list[dict]) -> Iterator[tuple]:
        words = words_of(text)
        starts = starts_within(begins, len(words))
        for m in asked:
            found = _window_of(starts, len(words), m["start"], m["end"], before, after)
            if found:
                k, a, b = found
                left, right = min(max(m["start"], a), b), min(max(m["end"], a), b)
                yield doc, m["mention_id"], k, m["text"], m["subject"], " ".join(words[a:left]), " ".join(words[left:right]), " ".join(words[right:b]), words[right] if right < b else None

    asked = mentions.select("doc_id", F.col("mention_id").cast("string").alias("mention_id"), "start", "end", "text", "subject")
    rows = per_document(with_spans(documents.select("doc_id", "text", "sentence_starts"), asked), windows, "doc_id bigint, mention_id string, sentence_index bigint, text string, subject string, _l string, _t string, _r string, _f string", 5_000)
    return _rendered_contexts(rows.withColumn("mention_id", F.col("mention_id").cast(mentions.schema["mention_id"].dataType)), mark)


def sample_mentions(mentions: DataFrame, n: int, seed: int = 0, cluster: str = "cluster_id", ident: str = "mention_id", group: tuple[str, ...] = ()) -> DataFrame:
    """``n`` mentions of each cluster, the same on every run: smallest seeded hashes first (all, where a cluster has fewer).

    A rank window per cluster; only identifiers and hashes travel. For the Mersenne-Twister draw of a
    driver-side program see :func:`sample_mentions_twister`.
    """
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*group, cluster, ident))), 256)
    order = Window.partitionBy(*group, cluster).orderBy("drawn", ident)
    return mentions.withColumn("drawn", drawn).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k", "drawn")


def sample_mentions_twister(mentions: DataFrame, n: int, seed: int, group: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(group, cluster_id, mention_id) drawn without replacement by a Mersenne Twister seeded with the cluster's hash.

    One cluster's identifiers are handled in one task; raises where a cluster has fewer than ``n``.
    """
    schema = mentions.select(*group, "cluster_id", "mention_id").schema

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mention_id").reset_index(drop=True)
        if len(rows) < n:
            raise ValueError(f"cluster {rows['cluster_id'][0]} has {len(rows)} mentions, {n} asked")
        picked = sorted(random.Random(int(rows["_s"][0])).sample(range(len(rows)), n))
        return rows.loc[picked, [*group, "cluster_id", "mention_id"]]

    return mentions.select(*group, "cluster_id", "mention_id").distinct().withColumn("_s", cluster_seed(seed, F.col("cluster_id"))).groupBy(*group, "cluster_id").applyInPandas(draw, schema)


def dedup_against_text(mentions: DataFrame, documents_text: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, start, end, text, head_token_i): one row per cluster and span whose text stands in the document.

    ``documents_text``: (doc_id, start, end, span_text) of the spans asked. A span is kept if any of
    its rows has the document's text; the first head inside the span (by ordinal) stays.
    """
    inside = F.when((F.col("head_token_i") >= F.col("start")) & (F.col("head_token_i") < F.col("end")), F.struct("ordinal", "head_token_i"))
    joined = mentions.join(documents_text.dropDuplicates(["doc_id", "start", "end"]), ["doc_id", "start", "end"], "left")
    grouped = joined.groupBy("doc_id", "cluster_id", "start", "end").agg(F.max(F.col("text") == F.col("span_text")).alias("ok"), F.first("span_text", True).alias("text"), F.min(inside).alias("h"))
    return grouped.where("ok").select("doc_id", "cluster_id", "start", "end", "text", F.col("h.head_token_i").alias("head_token_i"))


def number_mentions(mentions: DataFrame) -> DataFrame:
    """Dense mention ids per document by place, cluster and text; a document of any size is numbered in parts."""
    order = [F.col(c) for c in ("start", "end", "cluster_id", "text")]
    return running_counts(mentions, ["doc_id"], order, name="numbered").withColumn("mention_id", F.col("_upto") - 1).drop("_upto")


def build_clusters(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, canonical_name, mention_ids): clusters with mentions, ids by place."""
    packed = mentions.groupBy("doc_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "mention_id"))), lambda x: x["mention_id"]).alias("mention_ids"))
    return names.join(packed, ["doc_id", "cluster_id"]).select("doc_id", "cluster_id", "canonical_name", "mention_ids")


def spans_in_several_clusters(mentions: DataFrame) -> DataFrame:
    """(doc_id, start, end, cluster_ids) of spans that more than one cluster claims."""
    return mentions.groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids")).where("size(cluster_ids) > 1")


def token_index(mentions: DataFrame) -> DataFrame:
    """(doc_id, token_i, mention_id, cluster_id): every token a mention covers."""
    return mentions.where("end > start").select("doc_id", F.explode(F.expr("sequence(start, end - 1)")).alias("token_i"), "mention_id", "cluster_id")


def name_index(clusters: DataFrame) -> DataFrame:
    """(doc_id, name_key, cluster_id): the greatest cluster id where several share a folded name."""
    return clusters.groupBy("doc_id", X.label_key("canonical_name").alias("name_key")).agg(F.max("cluster_id").alias("cluster_id"))


def mentions_at_tokens(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, token_i, mention_id, cluster_id): mentions headed by the token, or else those that cover it."""
    heads = mentions.where("head_token_i is not null").select("doc_id", F.col("head_token_i").alias("token_i"), "mention_id", "cluster_id", F.lit(0).alias("rank"))
    cover = token_index(mentions).withColumn("rank", F.lit(1))
    hits = tokens.select("doc_id", "token_i").distinct().join(heads.union(cover), ["doc_id", "token_i"])
    best = Window.partitionBy("doc_id", "token_i")
    return hits.withColumn("_b", F.min("rank").over(best)).where("rank = _b").select("doc_id", "token_i", "mention_id", "cluster_id").distinct()
