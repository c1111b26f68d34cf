"""Tokens, sentences and paragraphs as tables keyed by document.

The provider here splits at blanks; a linguistic provider may be put in its place as long as it
delivers the same columns (``pos``, ``dep``, ``head_i`` and ``lemma`` are null in this one).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import evaluated_once, partitions_for

TOKENS = "doc_id bigint, token_i bigint, token_id bigint, text string, char_start bigint, char_end bigint, byte_start bigint, byte_end bigint, paragraph_id bigint, is_space boolean"
_PIECES = re.compile(r"\S+|\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def split_tokens(text: str) -> Iterator[tuple]:
    """(token_i, token_id, text, char and byte offsets, paragraph, is_space) of a text.

    A single blank or line end between words is no token; longer gaps are one blank token, which
    counts in token_i but not in token_id. The paragraph number rises at each gap with an empty line.
    """
    i = k = paragraph = byte = 0
    seen = False
    for m in _PIECES.finditer(text):
        piece = m.group()
        size = len(piece) if piece.isascii() else len(piece.encode())
        space = piece[0].isspace()
        if space and seen and _PARAGRAPH.search(piece):
            paragraph += 1
        if not space or len(piece) > 1:
            yield i, (None if space else k), piece, m.start(), m.end(), byte, byte + size, paragraph, space
            i += 1
            k += not space
        seen |= not space
        byte += size


def tokenize(documents: DataFrame, text: str = "text", starts: str | None = None) -> DataFrame:
    """The token table of documents (doc_id, text): no shuffle, a row's tokens come from its own partition.

    With ``starts`` (an array of token offsets per document) tokens also carry sentence_id and
    token_id_in_sentence, null for blank tokens. Null texts have no tokens; other columns are ignored.
    """
    schema = TOKENS + (", sentence_id bigint, token_id_in_sentence bigint" if starts else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.int64()]

    def placed(rows: Iterator[tuple], begins: list | None) -> Iterator[tuple]:
        bounds = sorted({s for s in begins or () if s is not None and s > 0})
        sentence, base = 0, 0
        for row in rows:
            if row[1] is None:
                yield (*row, None, None)
                continue
            while sentence < len(bounds) and bounds[sentence] <= row[1]:
                base = bounds[sentence]
                sentence += 1
            yield (*row, sentence, row[1] - base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            held: list[tuple] = []
            for k, (i, t) in enumerate(zip(*columns[:2])):
                rows = split_tokens(t or "")
                held.extend((i, *row) for row in (placed(rows, columns[2][k]) if starts else rows))
                if len(held) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return documents.select("doc_id", F.col(text).alias("text"), *([F.col(starts).alias("starts")] if starts else [])).mapInArrow(work, schema)


def sentences(documents: DataFrame, starts: str = "sentence_starts") -> DataFrame:
    """(doc_id, sentence_index, start, end) over compact token numbers; the last ends with the text.

    Starts outside the text and repeated starts are dropped; a text with tokens but no starts is one sentence.
    """
    size = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    clean = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.filter(F.coalesce(F.col(starts), F.array().cast("array<bigint>")), lambda s: (s > 0) & (s < F.col("n"))))))
    sized = evaluated_once(documents.where(F.col("text").isNotNull()).select("doc_id", "text", starts), "n", size.cast("bigint"))
    rows = evaluated_once(sized.where("n > 0").select("doc_id", starts, "n"), "s", clean).select("doc_id", "n", "s")
    return rows.select("doc_id", "n", F.posexplode("s").alias("sentence_index", "start"), "s").select(
        "doc_id", F.col("sentence_index").cast("bigint").alias("sentence_index"), "start", F.coalesce(F.get("s", F.col("sentence_index") + 1), F.col("n")).alias("end"),
    )


# Work on whole documents: only its result leaves the task, never a row per token.

_WORD = re.compile(r"\S+", re.ASCII)
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}


def words_of(text: str | None) -> list[str]:
    """The words of a text by token_id, divided at the blanks at which :func:`sentences` counts them."""
    return _WORD.findall(text or "")


def starts_within(begins: list[int | None] | None, size: int) -> list[int]:
    """The sentence starts of a text of ``size`` words, as :func:`sentences` has them."""
    return sorted({0, *(s for s in begins or () if s is not None and 0 < s < size)}) if size else []


def per_document(documents: DataFrame, work: Callable[..., Iterator[tuple]], schema: str, size: int = 20_000) -> DataFrame:
    """The rows that ``work`` makes of the columns of each document, ``size`` of them at a time; no shuffle."""
    names, types = zip(*(c.split() for c in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (row for document in zip(*(c.to_pylist() for c in batch.columns)) for row in work(*document))
            while held := list(islice(made, size)):
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*held), types)], names=list(names))

    return documents.mapInArrow(run, schema)


def with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents (doc_id first) with ``spans``, the array of the distinct rows of the span table (doc_id, ..) that lie in them; those without any are left out.

    A merge join, as the size of neither side is known beforehand: the optimizer takes documents for as
    small as their files, and would send them to the driver.
    """
    columns = [c for c in spans.columns if c != "doc_id"]
    packed = spans.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("spans"))
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, partitions_for(documents))
    return documents.where("text is not null").repartition(parts, "doc_id").join(packed.hint("merge"), "doc_id")


def with_sentences(tokens: DataFrame, sentence_table: DataFrame) -> DataFrame:
    """Tokens with sentence_id and token_id_in_sentence; blank tokens keep both null.

    Sentence starts are marked by an equi-join and spread by a running maximum within the document,
    so no range join is needed.
    """
    begun = sentence_table.select("doc_id", F.col("start").alias("token_id"), F.col("sentence_index").alias("begins"), F.col("start").alias("from_id"))
    run = Window.partitionBy("doc_id").orderBy("token_i")
    step = tokens.join(begun, ["doc_id", "token_id"], "left")
    return step.select(
        *[tokens[c] for c in tokens.columns], F.max("begins").over(run).alias("s"), F.max("from_id").over(run).alias("f"),
    ).select(*tokens.columns, F.when(~F.col("is_space"), F.col("s")).alias("sentence_id"), F.when(~F.col("is_space"), F.col("token_id") - F.col("f")).alias("token_id_in_sentence"))


def head_ids(tokens: DataFrame) -> DataFrame:
    """(doc_id, token_i, syntactic_head_id): the head's compact number, the token's own where the head is blank or missing."""
    heads = tokens.select("doc_id", F.col("token_i").alias("head_i"), F.col("token_id").alias("head_token_id"))
    return tokens.where("not is_space").join(heads, ["doc_id", "head_i"], "left").select("doc_id", "token_i", F.coalesce("head_token_id", "token_id").alias("syntactic_head_id"))


def span_token_ranges(spans: DataFrame, tokens: DataFrame, inclusive: bool = False) -> DataFrame:
    """(doc_id, span_id, token_start, token_end) of token_i spans [start, end): compact numbers of the words inside.

    Spans without a word have no row (the caller treats that as an error).
    """
    inside = spans.select("doc_id", "span_id", F.explode(F.expr("case when end > start then sequence(start, end - 1) else array() end")).alias("token_i"))
    words = tokens.where("not is_space").select("doc_id", "token_i", "token_id")
    return inside.join(words, ["doc_id", "token_i"]).groupBy("doc_id", "span_id").agg(F.min("token_id").alias("token_start"), (F.max("token_id") + (0 if inclusive else 1)).alias("token_end"))


def document_span_ranges(documents: DataFrame, spans: DataFrame, inclusive: bool = False) -> DataFrame:
    """The same as :func:`span_token_ranges` from the documents' texts (doc_id, text) instead of their tokens."""

    def ranges(doc: int, text: str, asked: list[dict]) -> Iterator[tuple]:
        places, before, wide = [], 0, 0
        for k, m in enumerate(_WORD.finditer(text)):
            wide += m.start() - before > 1
            places.append(k + wide)
            before = m.end()
        for span in asked:
            if span["start"] is not None and span["end"] is not None and span["end"] > span["start"]:
                first, stop = bisect_left(places, span["start"]), bisect_left(places, span["end"])
                if stop > first:
                    yield doc, span["span_id"], first, stop - 1 if inclusive else stop

    found = per_document(with_spans(documents.select("doc_id", "text"), spans.select("doc_id", F.col("span_id").cast("string"), "start", "end")), ranges, "doc_id bigint, span_id string, token_start bigint, token_end bigint")
    return found.groupBy("doc_id", F.col("span_id").cast(spans.schema["span_id"].dataType).alias("span_id")).agg(F.min("token_start").alias("token_start"), F.max("token_end").alias("token_end"))


def token_export(tokens: DataFrame) -> DataFrame:
    """The 18 export columns; lemma falls back to the text, recognizer columns are blank where absent."""
    have = set(tokens.columns)

    def pick(name: str, default):
        return (F.col(name) if name in have else default).alias(name)

    blank = F.lit("")
    return tokens.where("not is_space").select(
        "doc_id", "paragraph_id", pick("sentence_id", F.lit(None).cast("bigint")), pick("token_id_in_sentence", F.lit(None).cast("bigint")), "token_id", "text",
        F.coalesce(F.nullif(F.col("lemma") if "lemma" in have else blank, blank), F.col("text")).alias("lemma"), "char_start", "char_end", "byte_start", "byte_end",
        pick("pos", blank), pick("fine_pos", blank), pick("dependency_relation", blank), pick("syntactic_head_id", F.col("token_id")), pick("ent_iob", blank), pick("ent_type", blank), pick("in_quote", F.lit(False)), pick("event", F.lit("O")),
    )


# Fixed values of the rule-based syntax below.
PREPOSITIONS = ["to", "in", "on", "at", "by", "with", "from", "for", "of", "into", "over", "under", "through", "against"]
PARTICLES = ["up", "out", "off", "down", "away", "back"]
PASSIVE = ["was", "were", "been", "be", "is", "are"]


def rule_syntax(tokens: DataFrame) -> DataFrame:
    """(doc_id, token_i, head_i, text, lemma, pos, dep, sentence_id): a stand-in for a syntax provider.

    Lower-case words in -ed are verbs; a capitalized word is the subject of the next verb of its
    sentence, or else an object of the last one, through a preposition right before it; particles,
    negations and forms of *be* hang on the verb they stand next to. It makes no claim to a parser's
    quality. ``tokens`` carry sentence_id; a sentence is the unit of work.
    """
    bare = F.regexp_replace("text", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    rows = tokens.where("token_id is not null").select("doc_id", "sentence_id", F.col("token_id").alias("token_i"), bare.alias("text")).withColumn("lemma", F.lower("text"))
    rows = rows.withColumn("verb", F.when(F.col("text").rlike("^[a-z]{2,}ed$"), F.col("token_i"))).withColumn("prep", F.col("lemma").isin(PREPOSITIONS))
    line = Window.partitionBy("doc_id", "sentence_id").orderBy("token_i")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    ahead = line.rowsBetween(1, Window.unboundedFollowing)
    near = rows.withColumn("last", F.last("verb", True).over(past)).withColumn("next", F.first("verb", True).over(ahead)).withColumn("after_prep", F.coalesce(F.lag("prep").over(line), F.lit(False)))
    here = F.col("token_i")
    name = F.col("text").rlike(r"^\p{Lu}\p{L}+")
    dep = (
        F.when(F.col("verb").isNotNull(), "ROOT").when((F.col("lemma") == "not") & (F.col("next") == here + 1), "neg").when(F.col("lemma").isin(PASSIVE) & (F.col("next") == here + 1), "auxpass").when(F.col("lemma").isin(PARTICLES) & (F.col("last") == here - 1), "prt")
        .when(F.col("prep") & F.col("last").isNotNull(), "prep").when(name & F.col("next").isNotNull(), "nsubj").when(name & F.col("last").isNotNull(), F.when(F.col("after_prep"), "pobj").otherwise("dobj"))
    )
    tagged = near.withColumn("dep", F.coalesce(dep, F.lit("")))
    head = F.when(F.col("dep").isin("neg", "auxpass", "nsubj"), F.col("next")).when(F.col("dep").isin("prt", "prep", "dobj"), F.col("last")).when(F.col("dep") == "pobj", here - 1).otherwise(here)
    return tagged.select("doc_id", "token_i", head.alias("head_i"), "text", "lemma", F.when(F.col("verb").isNotNull(), "VERB").when(name, "PROPN").otherwise("X").alias("pos"), "dep", "sentence_id")
