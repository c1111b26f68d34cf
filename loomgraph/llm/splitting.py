"""Cutting oversized items at natural boundaries (problem 2).

Balanced targets: the fewest pieces that can hold the item give equally spaced targets, each target
snaps to the strongest boundary near it (a paragraph start before a sentence start, the nearer
first), and a piece is added whenever a piece with its overlap breaks the limit. Where that does not
serve every piece, each stretch of sentences within the limit is cut at sentence starts so that the
least overlap is lacking, and a sentence longer than the limit is cut on its own at the end of a
clause, or else at the target token itself.

Offsets count whitespace-separated tokens, half-open. The cores of an item's pieces cover it once;
the overlap reaches back and forth over whole sentences, as many of the wanted number as fit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<piece:int,core_start:bigint,core_end:bigint,left_overlap_start:bigint,right_overlap_end:bigint,sentence_aligned:boolean>>"
MARKS = "n_tokens bigint, paragraphs array<bigint>, clauses array<bigint>"

PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
CLAUSE_END = re.compile(r"[,;:)\]—–]['\"”’»)]*$")


def text_marks(text: str | None, sentence_starts, longest: int) -> tuple[int, list[int], list[int]]:
    """Tokens of a text, token offsets of its paragraph starts, and of clause starts inside sentences longer than ``longest``."""
    if not text or text.isspace():
        return 0, [], []
    paragraphs, at = [], 0
    for part in PARAGRAPH.split(text):
        size = len(part.split())
        if size:
            paragraphs.append(at)
            at += size
    clauses: list[int] = []
    starts = [0, *(int(s) for s in (sentence_starts if sentence_starts is not None else []) if 0 < s < at), at]
    if max(b - a for a, b in zip(starts, starts[1:])) > longest:
        tokens = text.split()
        for a, b in zip(starts, starts[1:]):
            if b - a > longest:
                clauses.extend(i + 1 for i in range(a, b - 1) if CLAUSE_END.search(tokens[i]))
    return at, paragraphs, clauses


@lru_cache
def _orders(wanted: int) -> list[tuple[int, int]]:
    """Sentences back and forth, the most first, then the most even."""
    return sorted(((x, y) for x in range(wanted + 1) for y in range(wanted + 1)), key=lambda n: (-sum(n), abs(n[0] - n[1]), -n[0]))


def _overlap(start: int, end: int, lo: int, hi: int, sentences: list[int], limit: int, wanted: int) -> tuple[int, int, int, int]:
    """The overlap around a core and the sentences it has back and forth (an end of the item counts as reached)."""
    left = bisect_left(sentences, start)
    right = bisect_right(sentences, end)
    for back, forth in _orders(wanted):
        a = max(lo, sentences[max(0, left - back)]) if back and left else start
        b = end if not forth or end >= hi else (min(hi, sentences[right + forth - 1]) if right + forth - 1 < len(sentences) else hi)
        if b - a <= limit:
            return a, b, back, forth
    return start, end, 0, 0


def cut_points(lo: int, hi: int, sentences: list[int], paragraphs: set[int], clauses: list[int], limit: int, pieces: int, first_limit: int | None = None, last_limit: int | None = None) -> list[int] | None:
    """Core bounds for ``pieces`` balanced targets, or None where a core cannot stay within the limit (the outer ones within their own)."""
    head, tail = first_limit or limit, last_limit or limit
    size, bounds = (hi - lo) / pieces, [lo]
    near = max(1, int(size / 4))
    for k in range(1, pieces):
        target, last = lo + round(k * size), bounds[-1]
        first, final = max(last + 1, hi - tail - (pieces - k - 1) * limit), min(last + (head if k == 1 else limit), hi - 1)
        if first > final:
            return None
        target = min(max(target, first), final)
        best = None
        for options, strength in ((sentences, 1), (clauses, 0)):
            a, b = bisect_left(options, first), bisect_right(options, final)
            if a < b:
                inside = options[max(a, bisect_left(options, target - near)):min(b, bisect_right(options, target + near))]
                if strength and inside:
                    best = max(inside, key=lambda x: (x in paragraphs, -abs(x - target), -x))
                else:
                    at = bisect_left(options, target, a, b)
                    best = min(options[max(a, at - 1):min(b, at + 1)], key=lambda x: (abs(x - target), x))
                break
        bounds.append(best if best is not None else target)
    bounds.append(hi)
    return bounds if all(0 < b - a <= limit for a, b in zip(bounds, bounds[1:])) else None


def _sentence_cuts(first: int, last: int, bounds: list[int], tops: set[int], limit: int, wanted: int) -> list[int]:
    """Core bounds of the sentences first..last, none of which exceeds the limit: all at sentence starts.

    A core lacks what its overlap has less than its outermost sentence alone could have. The fewest
    tokens with the least lacking come first, then the fewest pieces; among those the balanced
    targets where they reach both, else the most even sizes.
    """
    n = len(bounds) - 1
    before = {i: [bounds[max(0, i - k)] for k in range(wanted + 1)] for i in range(first, last + 1)}
    after = {j: [bounds[min(n, j + k)] for k in range(wanted + 1)] for j in range(first, last + 1)}
    back_of = {i: max(k for k in range(wanted + 1) if bounds[i + 1] - before[i][k] <= limit) for i in range(first, last)}
    forth_of = {j: max(k for k in range(wanted + 1) if after[j][k] - bounds[j - 1] <= limit) for j in range(first + 1, last + 1)}
    orders = _orders(wanted)

    def lacking(i: int, j: int) -> int:
        x, y = before[i], after[j]
        if y[forth_of[j]] - x[back_of[i]] <= limit:
            return 0
        back, forth = next(o for o in orders if y[o[1]] - x[o[0]] <= limit)
        return (max(0, back_of[i] - back) + max(0, forth_of[j] - forth)) * (bounds[j] - bounds[i])

    best: dict[int, tuple[tuple[int, int, int], int]] = {first: ((0, 0, 0), first)}
    for j in range(first + 1, last + 1):
        ways = []
        for i in range(j - 1, first - 1, -1):
            size = bounds[j] - bounds[i]
            if size > limit:
                break
            lack, pieces, square = best[i][0]
            ways.append(((lack + lacking(i, j), pieces + 1, square + size * size), i))
        best[j] = min(ways)
    lack, pieces, _ = best[last][0]
    place = {x: i for i, x in enumerate(bounds)}
    made = cut_points(bounds[first], bounds[last], bounds[first + 1:last], tops, [], limit, pieces)
    if made and all(x in place for x in made) and sum(lacking(place[a], place[b]) for a, b in zip(made, made[1:])) == lack:
        return made
    out, at = [bounds[last]], last
    while at > first:
        at = best[at][1]
        out.append(bounds[at])
    return out[::-1]


def _inner_cuts(index: int, bounds: list[int], breaks: list[int], limit: int, wanted: int) -> list[int]:
    """Core bounds inside a sentence that exceeds the limit: its outer cores leave room for the sentences around it."""
    start, end = bounds[index], bounds[index + 1]
    head = limit - max(x for n in range(wanted + 1) if (x := start - bounds[max(0, index - n)]) < limit)
    tail = limit - max(x for n in range(wanted + 1) if (x := bounds[min(len(bounds) - 1, index + 1 + n)] - end) < limit)
    inside = [c for c in breaks if start < c < end]
    known = {start, end, *inside}
    fewest = 2 + max(0, -(-(end - start - head - tail) // limit))
    # filling cores up to clauses takes less than twice the fewest pieces wherever clauses are within reach
    plans = [made for count in range(fewest, 2 * fewest + 1) if (made := cut_points(start, end, [], set(), inside, limit, count, head, tail))]
    return min(plans, key=lambda made: (sum(x not in known for x in made), len(made)))


def split_item(lo: int, hi: int, sentence_starts, paragraphs, clauses, limit: int = 300, wanted: int = 2) -> list[tuple[int, int, int, int, bool]]:
    """Pieces (core start, core end, left overlap start, right overlap end, core starts a sentence) of the tokens lo..hi.

    An empty span gives no piece, one within the limit gives one piece without overlap. Where balanced
    targets do not give every core a sentence start and its full overlap, the stretches before, inside
    and after each sentence longer than the limit are planned on their own, so that such a sentence
    costs no other piece its start or overlap.
    """
    if hi <= lo:
        return []
    if hi - lo <= limit:
        return [(lo, hi, lo, hi, True)]
    sentences = sorted({int(s) for s in sentence_starts if lo < s < hi} | {lo})
    known = set(sentences)
    breaks = sorted({int(c) for c in clauses if lo < c < hi})
    tops = {int(p) for p in paragraphs if lo < p < hi}
    inner = sentences[1:]

    def pieces_of(cuts: list[int]) -> tuple[list[tuple[int, int, int, int, bool]], bool]:
        out, whole = [], True
        for a, b in zip(cuts, cuts[1:]):
            left, right, back, forth = _overlap(a, b, lo, hi, sentences, limit, wanted)
            out.append((a, b, left, right, a in known))
            whole &= a in known and back == forth == wanted
        return out, whole

    bounds = [*sentences, hi]
    fewest = -(-(hi - lo) // limit)
    if max(b - a for a, b in zip(bounds, bounds[1:])) <= limit:
        for count in range(fewest, 2 * fewest + 3):
            cuts = cut_points(lo, hi, inner, tops, breaks, limit, count)
            if cuts:
                out, whole = pieces_of(cuts)
                if whole:
                    return out
    cuts, at = [lo], 0
    while at < len(sentences):
        if bounds[at + 1] - bounds[at] > limit:
            cuts += _inner_cuts(at, bounds, breaks, limit, wanted)[1:]
            at += 1
            continue
        end = at
        while end < len(sentences) and bounds[end + 1] - bounds[end] <= limit:
            end += 1
        cuts += _sentence_cuts(at, end, bounds, tops, limit, wanted)[1:]
        at = end
    return pieces_of(cuts)[0]


def document_marks(documents: DataFrame, limit: int = 300) -> DataFrame:
    """documents with a ``marks`` struct (n_tokens, paragraphs, clauses); the text itself goes no further."""

    @F.pandas_udf(MARKS)
    def marks(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, starts in parts:
            yield pd.DataFrame([text_marks(t, s, limit) for t, s in zip(text, starts)], columns=["n_tokens", "paragraphs", "clauses"])

    return documents.select("doc_id", "sentence_starts", marks("text", "sentence_starts").alias("marks"))


def pieces_column(lo: Column, hi: Column, sentence_starts: Column, paragraphs: Column, clauses: Column, limit: int = 300, overlap: int = 2) -> Column:
    """The pieces of each span as an array of structs; null offsets give an empty array."""

    @F.pandas_udf(PIECES)
    def pieces(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("piece", "core_start", "core_end", "left_overlap_start", "right_overlap_end", "sentence_aligned")
        for columns in parts:
            out = []
            for a, b, s, p, c in zip(*columns):
                if a is None or b is None or np.isnan(a) or np.isnan(b):
                    out.append([])
                    continue
                made = split_item(int(a), int(b), *(x if x is not None else [] for x in (s, p, c)), limit, overlap)
                out.append([dict(zip(names, (i, *x))) for i, x in enumerate(made)])
            yield pd.Series(out)

    return pieces(lo, hi, sentence_starts, paragraphs, clauses)


def _between(values: Column, lo: Column, hi: Column) -> Column:
    return F.filter(values, lambda x: (x > lo) & (x < hi))


def split_chunks(chunks: DataFrame, documents: DataFrame, limit: int = 300, overlap: int = 2) -> DataFrame:
    """(doc_id, chunk_id, span, pieces) of each chunk whose span exceeds ``limit``, once.

    The recorded token count is not trusted, only the span. Of rows that repeat a chunk the widest
    span counts. A chunk of an unknown or empty document is cut without boundaries; chunks with a
    null document, id or offset are ignored.
    """
    large = (
        chunks.select("doc_id", "chunk_id", "global_start", "global_end")
        .where((F.col("global_end") - F.col("global_start") > limit) & F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull())
        .groupBy("doc_id", "chunk_id").agg(F.max(F.struct(F.expr("global_end - global_start").alias("span"), "global_start", "global_end")).alias("c")).select("doc_id", "chunk_id", "c.*")
    )
    marked = document_marks(documents.select("doc_id", "text", "sentence_starts"), limit).where("marks.n_tokens > 0 or size(sentence_starts) > 0")
    lo, hi = F.col("global_start"), F.col("global_end")
    return large.join(marked, "doc_id", "left").select(
        "doc_id", "chunk_id", "span",
        pieces_column(lo, hi, *(_between(F.coalesce(F.col(c), F.array().cast("array<bigint>")), lo, hi) for c in ("sentence_starts", "marks.paragraphs", "marks.clauses")), limit, overlap).alias("pieces"),
    )


def split_documents(documents: DataFrame, limit: int = 300, overlap: int = 2) -> DataFrame:
    """(doc_id, span, pieces) of each document whose text has more than ``limit`` tokens.

    A null or blank text has no tokens and gives no row; missing sentence starts leave paragraph
    ends out and cuts fall on the balanced targets.
    """
    marked = document_marks(documents.select("doc_id", "text", "sentence_starts"), limit).where(f"marks.n_tokens > {int(limit)}")
    empty = F.array().cast("array<bigint>")
    return marked.select(
        "doc_id", F.col("marks.n_tokens").alias("span"),
        pieces_column(F.lit(0).cast("bigint"), F.col("marks.n_tokens"), F.coalesce("sentence_starts", empty), F.col("marks.paragraphs"), F.col("marks.clauses"), limit, overlap).alias("pieces"),
    )
