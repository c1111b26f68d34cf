"""Sentence-aligned chunks with overlap: planning, materializing, checking."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.tokens import per_document, starts_within, with_spans, words_of

SPECS = "array<struct<global_start:bigint,global_end:bigint,core_start:bigint,core_end:bigint,sentence_start:bigint,sentence_end:bigint>>"


def core_ranges(starts: list[int], size: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Sentence ranges of the cores: each the largest whose span with ``overlap`` sentences on both sides fits.

    Raises where one sentence with its overlap does not fit.
    """
    bounds = [*starts, size]
    last = len(starts)
    out, at = [], 0
    while at < last:
        left = bounds[max(0, at - overlap)]
        end = at
        while end < last and bounds[min(last, end + 1 + overlap)] - left <= limit:
            end += 1
        if end == at:
            raise ValueError(f"sentence {at} with its overlap exceeds {limit} tokens")
        out.append((at, end))
        at = end
    return out


def shrunk_overlap(start: int, end: int, before: list[int], after: list[int], limit: int) -> tuple[int, int]:
    """The span around a core: the sentences that start ``before`` it and end ``after`` it, nearest first and both sides in turn, while they fit."""
    before, after = list(before), list(after)
    while before or after:
        if before:
            if end - before[-1] <= limit:
                start = before.pop()
            else:
                before = []
        if after:
            if after[0] - start <= limit:
                end = after.pop(0)
            else:
                after = []
    return start, end


def covering_ranges(starts: list[int], size: int, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Chunks (global start and end, core start and end, sentence range of the core) within the limit whose cores cover every token.

    The chunks of ``core_ranges`` where it has a plan. Else a sentence that does not fit with its
    whole overlap is a core by itself with as much of the overlap as fits; one that exceeds the limit
    is cut into the fewest even parts, and the sentences before and after it are planned without it.
    """
    bounds = [*starts, size]
    long = [i for i in range(len(starts)) if bounds[i + 1] - bounds[i] > limit]
    out = []
    first = 0
    for stop in [*long, len(starts)]:
        at = first
        while at < stop:
            left, end = bounds[max(first, at - overlap)], at
            while end < stop and bounds[min(stop, end + 1 + overlap)] - left <= limit:
                end += 1
            right = bounds[min(stop, end + overlap)]
            if end == at:
                end = at + 1
                left, right = shrunk_overlap(bounds[at], bounds[end], bounds[max(first, at - overlap):at], bounds[end + 1:min(stop, end + overlap) + 1], limit)
            out.append((left, right, bounds[at], bounds[end], at, end))
            at = end
        if stop < len(starts):
            start, length = bounds[stop], bounds[stop + 1] - bounds[stop]
            parts = -(-length // limit)
            cuts = [start + k * length // parts for k in range(parts + 1)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                before = bounds[max(0, stop - overlap):stop] if k == 0 else []
                after = bounds[stop + 2:min(len(starts), stop + 1 + overlap) + 1] if k == parts - 1 else []
                out.append((*shrunk_overlap(a, b, before, after, limit), a, b, stop, stop + 1))
        first = stop + 1
    return out


def plan_chunks(sentences: DataFrame, limit: int = 8000, overlap: int = 80, prefix: str = "chunk", strict: bool = False) -> DataFrame:
    """The chunk plan (13 columns after doc_id) of a sentence table (doc_id, sentence_index, start, end).

    One small state machine per document over its sentence offsets; documents are the parallel unit.
    A sentence that does not fit with its overlap has less of it, and one that exceeds the limit is
    cut into several chunks that name the same sentence; where ``strict``, either raises. A document
    without sentences has no chunks.
    """
    per = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_index", "start", "end"))).alias("s"))
    starts, ends = F.transform("s", lambda x: x["start"]), F.transform("s", lambda x: x["end"])

    @F.pandas_udf(SPECS)
    def ranges(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("global_start", "global_end", "core_start", "core_end", "sentence_start", "sentence_end")
        for begin, size in parts:
            out = []
            for b, n in zip(begin, size):
                offsets = [int(x) for x in b]
                if strict:
                    core_ranges(offsets, int(n), limit, overlap)
                out.append([dict(zip(names, x)) for x in covering_ranges(offsets, int(n), limit, overlap)])
            yield pd.Series(out)

    rows = per.select("doc_id", F.posexplode(ranges(starts, F.element_at(ends, -1))).alias("chunk_index", "r"))
    return rows.select("doc_id", F.format_string(prefix + "_%03d", F.col("chunk_index")).alias("chunk_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "r.*").select(
        "doc_id", "chunk_id", "chunk_index", "global_start", "global_end", "core_start", "core_end", F.col("global_start").alias("left_overlap_start"), F.col("core_start").alias("left_overlap_end"),
        F.col("core_end").alias("right_overlap_start"), F.col("global_end").alias("right_overlap_end"), (F.col("global_end") - F.col("global_start")).alias("n_tokens"), "sentence_start", "sentence_end",
    )


def plan_violations(chunks: DataFrame, sizes: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, chunk_id, rule) for every broken rule of a plan; ``sizes``: (doc_id, n_doc_tokens).

    Rules: spans ordered, overlaps next to the core, size as stated, size within the limit, cores in
    one line from 0 to the document's end.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    seen = chunks.dropDuplicates(["doc_id", "chunk_id"]).join(sizes, "doc_id", "left").withColumn("before", F.lag("core_end").over(order)).withColumn("after", F.lead("core_start").over(order))
    rules = {
        "span_order": "not (global_start <= core_start and core_start < core_end and core_end <= global_end)",
        "overlap_edges": "left_overlap_start <> global_start or left_overlap_end <> core_start or right_overlap_start <> core_end or right_overlap_end <> global_end",
        "stated_size": "n_tokens is null or n_tokens <> global_end - global_start",
        "core_gap": "coalesce(before, 0) <> core_start",
        "core_end": "after is null and core_end <> n_doc_tokens",
        "outside": "global_start < 0 or global_end > n_doc_tokens",
    }
    if limit is not None:
        rules["too_long"] = f"global_end - global_start > {int(limit)}"
    broken = F.filter(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return seen.select("doc_id", "chunk_id", F.explode(broken).alias("rule"))


def chunk_tokens(tokens: DataFrame, chunks: DataFrame, bucket: int = 256) -> DataFrame:
    """Tokens of every chunk with their place in it and in the core: local = global - global_start.

    The range join runs as an equi-join on document and token bucket: a chunk names the few buckets
    its span touches, a token lies in one, so no pair outside a bucket is ever compared.
    """
    spans = chunks.select(
        "doc_id", "chunk_id", "chunk_index", "global_start", "global_end", "core_start", "core_end",
        F.explode(F.expr(f"case when global_end > global_start then sequence(global_start div {bucket}, (global_end - 1) div {bucket}) else array() end")).alias("slot"),
    )
    words = tokens.where("token_id is not null").withColumn("slot", F.expr(f"token_id div {bucket}"))
    return words.join(spans, ["doc_id", "slot"]).where("token_id >= global_start and token_id < global_end").select(
        "doc_id", "chunk_id", "chunk_index", (F.col("token_id") - F.col("global_start")).alias("local_i"), "token_id", "text", ((F.col("token_id") >= F.col("core_start")) & (F.col("token_id") < F.col("core_end"))).alias("in_core"),
    )


def model_input(chunk_token_table: DataFrame, sentence_of: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, sentence_index, words, token_ids): a chunk's words by sentence, with the way back."""
    rows = chunk_token_table.join(sentence_of.select("doc_id", "token_id", "sentence_id"), ["doc_id", "token_id"])
    packed = rows.groupBy("doc_id", "chunk_id", F.col("sentence_id").alias("sentence_index")).agg(F.array_sort(F.collect_list(F.struct("token_id", "text"))).alias("w"))
    return packed.select("doc_id", "chunk_id", "sentence_index", F.transform("w", lambda x: x["text"]).alias("words"), F.transform("w", lambda x: x["token_id"]).alias("token_ids"))


# The same from whole documents.


def planned_input(documents: DataFrame, limit: int = 8000, overlap: int = 80, prefix: str = "chunk") -> DataFrame:
    """The :func:`model_input` of the plan of :func:`plan_chunks`, made document by document (doc_id, text, sentence_starts) without a shuffle."""

    def sentences_of(doc: int, text: str | None, begins: list | None) -> Iterator[tuple]:
        words = words_of(text)
        starts = starts_within(begins, len(words))
        bounds = [*starts, len(words)]
        for k, (left, right, *_) in enumerate(covering_ranges(starts, len(words), limit, overlap)):
            at = bisect_right(starts, left) - 1
            while at < len(starts) and starts[at] < right:
                a, b = max(left, bounds[at]), min(right, bounds[at + 1])
                yield doc, f"{prefix}_{k:03d}", at, words[a:b], list(range(a, b))
                at += 1

    return per_document(documents.select("doc_id", "text", "sentence_starts"), sentences_of, "doc_id bigint, chunk_id string, sentence_index bigint, words array<string>, token_ids array<bigint>", 5_000)


def input_cover(model_input_table: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, first_token, last_token): the tokens that stand in any chunk's input, each counted once.

    A sentence's ascending numbers travel as the run they form, or one by one where they form none.
    """
    ids = F.col("token_ids")
    first, last = F.get(ids, 0), F.element_at(ids, -1)
    run = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    runs = F.when(last - first + 1 == F.size(ids), F.array(run(first, last + 1))).otherwise(F.transform(ids, lambda t: run(t, t + 1)))
    packed = model_input_table.where("size(token_ids) > 0").select("doc_id", F.explode(runs).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_set("r")).alias("r"))
    step = lambda held, r: F.struct((held["n"] + F.greatest(r["b"] - F.greatest(r["a"], held["upto"]), F.lit(0))).alias("n"), F.greatest(held["upto"], r["b"]).alias("upto"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.get("r", 0)["a"].alias("upto"))
    return packed.select("doc_id", F.get("r", 0)["a"].alias("first_token"), F.aggregate("r", start, step).alias("s")).select("doc_id", F.col("s.n").alias("n_tokens"), "first_token", (F.col("s.upto") - 1).alias("last_token"))


def token_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, n, n_core, first_word) of the chunks that hold a token of their document (doc_id, text)."""

    def counts(doc: int, text: str, spans: list[dict]) -> Iterator[tuple]:
        words = words_of(text)
        for s in spans:
            if s["global_start"] is None or s["global_end"] is None:
                continue
            a, b = max(s["global_start"], 0), min(s["global_end"], len(words))
            if a < b:
                core = 0 if s["core_start"] is None or s["core_end"] is None else max(0, min(b, s["core_end"]) - max(a, s["core_start"]))
                yield doc, s["chunk_id"], b - a, core, a, words[a]

    spans = chunks.select("doc_id", "chunk_id", "global_start", "global_end", "core_start", "core_end")
    rows = per_document(with_spans(documents.select("doc_id", "text"), spans), counts, "doc_id bigint, chunk_id string, n bigint, n_core bigint, first bigint, first_word string")
    return rows.groupBy("doc_id", "chunk_id").agg(F.sum("n").alias("n"), F.sum("n_core").alias("n_core"), F.min_by("first_word", "first").alias("first_word"))
