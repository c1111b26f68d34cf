"""Mixing sources to target shares of the total size (problem 9).

Each record gets a hash; the tokens of each source are summed by the leading bits of the hash. The
cumulated sums are nested budgets: every record under the boundary bucket is in, every record over
it is out, and only the boundary bucket is split again by the next bits. At the end one threshold
per source remains and the selection is a filter behind a join with one row per source; nothing is
sorted, and the sums of the buckets (at most 1,024 a source and round) never leave the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.runtime import bounded_rows, cut, cut_to, drop_path

BITS, ROUNDS = 10, 5
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64 << 20
#: Fixed value: the pre-split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(source: Column) -> Column:
    """A source's name in one spelling: no case, blanks, hyphens and underscores alike."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def token_counts(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text under a public byte-pair vocabulary; null counts 0.

    The vocabulary is read once, on the driver, and sent out; a file over ``MAX_VOCABULARY`` bytes is
    refused.
    """
    with open(f"{folder}/{vocabulary}", "rb") as file:
        raw = file.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} has more than {MAX_VOCABULARY} bytes")
    shared = SparkSession.active().sparkContext.broadcast(raw)

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("records", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sized_records(documents: DataFrame, seed: int = 9, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, h) of the documents that have tokens and a source; h has 50 bits."""
    return documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length(F.trim("text")) > 0)).select(
        "doc_id", source_key(F.col("source")).alias("source"), token_counts(F.col("text"), folder).alias("n_tokens"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - BITS * ROUNDS).alias("h"),
    )


def thresholds(records: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, bound): the largest hash bound whose records below it hold at most the source's budget.

    ``budgets``: (source, budget), one row per source. Each round sums the tokens of the boundary
    bucket's parts and keeps, per source, the part in which the budget runs out. A part that is a
    single record is taken where that comes nearer to the budget; records that share all their bits
    stay out together.
    """
    state, path = budgets.select("source", F.lit(0).cast("bigint").alias("bound"), F.col("budget").cast("bigint").alias("left"), F.lit(False).alias("closed")), None
    for level in range(ROUNDS):
        width = BITS * (ROUNDS - 1 - level)
        inside = F.shiftright("h", width + BITS) == F.shiftright("bound", width + BITS)
        parts = records.join(state.where("not closed"), "source").where(inside).groupBy("source", F.shiftright("h", width).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("b"))
        cumulated = parts.withColumn("before", upto - F.col("t")).join(state.select("source", "left"), "source")
        edge = cumulated.where(F.col("before") + F.col("t") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("b", "t", "n", "before"), "b").alias("e"))
        room = F.col("left") - F.col("e.before")
        single = F.col("e.n") == 1
        start = F.shiftleft("e.b", width)
        whole = F.shiftleft(F.shiftright("bound", width + BITS) + 1, width + BITS)
        after = state.join(edge, "source", "left").select(
            "source",
            F.when(F.col("closed"), F.col("bound")).when(F.col("e").isNull(), whole).otherwise(start + F.when(single & (F.col("e.t") - room < room), 1 << width).otherwise(0)).alias("bound"),
            F.coalesce(room, F.col("left")).alias("left"), (F.col("closed") | F.col("e").isNull() | single).alias("closed"),
        )
        before, (state, path) = path, cut_to(after, "bounds")
        if before:
            drop_path(records.sparkSession, before)
    return state.select("source", "bound")


class Mixture:
    """The plan of one mixture: whole repeats and a hash bound for each source.

    ``targets``: (source, target_share, max_repeats), a small table (its size is checked). The total
    is the largest that no source's repeat cap stands against; sources without a positive target or
    without records contribute nothing, and the rest keep their shares relative to each other.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 9, folder: str = TOKENIZERS, max_sources: int = 10_000):
        spark = documents.sparkSession
        self.records = cut(sized_records(documents, seed, folder), "sizes")
        rows = bounded_rows(targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")), max_sources, "mix_targets")
        self.targets = spark.createDataFrame([(r["source"], float(r["share"]), int(r["cap"])) for r in sorted(rows)], "source string, share double, cap bigint")
        held = self.targets.join(self.records.groupBy("source").agg(F.sum("n_tokens").alias("held")), "source", "left").select("source", "share", "cap", F.coalesce("held", F.lit(0)).alias("held"))
        self.held = cut(held, "held")
        usable = self.held.where("held > 0")
        total = usable.agg(F.min(F.col("held") * F.col("cap") / F.col("share")).alias("total"))
        need = F.least(F.col("share") * F.col("total"), F.col("held") * F.col("cap"))
        times = F.floor((need + 1e-6) / F.col("held")).cast("bigint")
        plan = cut(usable.crossJoin(F.broadcast(total)).select("source", times.alias("repeats"), F.floor(need - times * F.col("held")).cast("bigint").alias("budget")), "mix-plan")
        self.plan = plan.join(thresholds(self.records, plan), "source").select("source", "repeats", "bound")  # a row a source: max_sources at most

    def selection(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies) of every record used at least once."""
        copies = (F.col("repeats") + (F.col("h") < F.col("bound")).cast("int")).cast("int")
        return self.records.join(F.broadcast(self.plan), "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, tokens_held, tokens_used, actual_share, max_copies) for every target source."""
        used = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("max_copies"))
        whole = used.agg(F.sum("tokens_used").alias("whole"))
        return self.held.join(used, "source", "left").crossJoin(F.broadcast(whole)).select(
            "source", F.col("share").alias("target_share"), F.col("held").alias("tokens_held"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            (F.coalesce("tokens_used", F.lit(0)) / F.col("whole")).alias("actual_share"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
        )
