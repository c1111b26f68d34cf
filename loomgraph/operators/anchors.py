"""Anchor bank and the filter that drops mentions naming somebody else's anchor."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.runtime import bounded_rows


def checked_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A left join that keeps the rows of ``left`` as they are; a key standing twice in ``right`` raises while the rows are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    unique = right.withColumn("_n", n)
    text = F.concat_ws(", ", *(F.col(k).cast("string") for k in key))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{', '.join(key)} not unique: "), text))).otherwise(F.lit(None).cast("string"))
    joined = left.join(unique.withColumn("_e", once).drop("_n"), key, "left")
    return joined.where("_e is null").drop("_e")


def generic_keys(path: str | None = None) -> list[str]:
    """Labels that never serve as anchors: the fixed ones and, where given, those of a file with one a line."""
    extra = [line.strip().lower() for line in Path(path).read_text("utf-8").splitlines() if line.strip()] if path else []
    return sorted({*X.GENERIC_ANCHORS, *extra})


def mention_counts(clusters: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Clusters with ``n``: the stated count where it is a number, else the mentions counted, else 0."""
    if "n_mentions" in clusters.columns:
        return clusters.withColumn("n", F.coalesce(F.expr("try_cast(n_mentions as bigint)"), F.lit(0).cast("bigint")))
    counted = mentions.groupBy("local_cluster_uid").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(counted, "local_cluster_uid", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def anchor_bank(clusters: DataFrame, percentile: float = 0.95, least: int = 2, uid: str = "local_cluster_uid", name: str = "canonical_name", by: str | None = None, generic: list[str] | None = None) -> DataFrame:
    """(anchor_key, display_name, n_mentions, source_cluster_uids): frequent names fit as anchors.

    Names are grouped by their canonical key; keys with at least ``least`` mentions whose count reaches
    the quantile of those counts are kept. ``by`` makes one bank per value (a document, say). The first
    display name is the one of the least uid; uids are sorted and pipe-joined.
    """
    keys = [by] if by else []
    named = mention_counts(clusters).withColumn("anchor_key", X.canonical_key(name)).where(X.is_anchor_candidate("anchor_key", generic))
    grouped = named.groupBy(*keys, "anchor_key").agg(F.min_by(name, uid).alias("display_name"), F.sum("n").alias("n_mentions"), F.array_join(F.array_sort(F.collect_set(uid)), "|").alias("source_cluster_uids")).where(F.col("n_mentions") >= least)
    if by:
        cut = grouped.groupBy(by).agg(F.percentile("n_mentions", percentile).alias("cut"))
        kept = grouped.join(cut, by)
    else:
        kept = grouped.crossJoin(F.broadcast(grouped.agg(F.percentile("n_mentions", percentile).alias("cut"))))
    return kept.where("n_mentions >= cut").drop("cut")


def pairs_of(key: str) -> list[tuple[str, int]]:
    """Neighbouring characters, each with how often the same pair came before."""
    seen: dict[str, int] = {}
    out = []
    for a, b in zip(key, key[1:]):
        seen[a + b] = seen.get(a + b, 0) + 1
        out.append((a + b, seen[a + b]))
    return out


class AnchorScan:
    """Matches keys against a bank of anchors by indexes of words and of neighbouring characters.

    A ratio r over T characters in all means that at least rT/2 of them match, in at most
    T - rT + 1 blocks, so at least T(1.5r - 1) - 1 pairs of neighbours are shared; only anchors that
    share so many are compared. Where that bound is no more than zero, lengths alone decide.
    """

    def __init__(self, anchors: list[tuple[str, str, int]], foreign: float, family: float, least: int):
        self.anchors, self.foreign, self.family, self.least = anchors, foreign, family, least
        self.words = [frozenset(k.split()) for k, _, _ in anchors]
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for i, words in enumerate(self.words):
            for w in words:
                self.by_word[w].append(i)
        self.lengths = np.array([len(k) for k, _, _ in anchors], np.int64)
        places: dict[tuple[str, int], list[int]] = defaultdict(list)
        for i, (k, _, _) in enumerate(anchors):
            for p in pairs_of(k):
                places[p].append(i)
        self.by_pair = {p: np.array(v, np.int64) for p, v in places.items()}

    def candidates(self, key: str, threshold: float) -> np.ndarray:
        """Anchors whose ratio to the key can reach the threshold."""
        total = self.lengths + len(key)
        fit = (self.lengths >= self.least) & (2 * np.minimum(self.lengths, len(key)) >= threshold * total)
        bound = total * (1.5 * threshold - 1) - 1
        hits = [self.by_pair[p] for p in pairs_of(key) if p in self.by_pair]
        shared = np.bincount(np.concatenate(hits), minlength=len(self.anchors)) if hits else np.zeros(len(self.anchors), np.int64)
        return np.flatnonzero(fit & (shared >= bound - 1e-9))

    def match(self, key: str, threshold: float) -> dict[int, tuple[float, str]]:
        """Anchors the key matches, with score and method."""
        if not key:
            return {}
        words = frozenset(key.split())
        out: dict[int, tuple[float, str]] = {}
        for i in {i for w in words for i in self.by_word.get(w, ())}:
            anchor = self.words[i]
            if key == self.anchors[i][0]:
                out[i] = (1.0, "exact")
            elif words <= anchor or anchor <= words:
                out[i] = (len(words & anchor) / len(words | anchor), "token_subset")
        if len(key) >= self.least and self.anchors:
            for i in self.candidates(key, threshold).tolist():
                if i not in out and (score := SequenceMatcher(None, key, self.anchors[i][0]).ratio()) >= threshold:
                    out[i] = (score, "fuzzy")
        return out

    def best_foreign(self, key: str | None, own: str | None) -> tuple | None:
        """(anchor name, key, n, score, method) of the best anchor outside the mention's own family; the earliest on ties."""
        hits = self.match(key or "", self.foreign)
        if not hits:
            return None
        family = self.match(own or "", self.family)
        best = None
        for i in sorted(hits):
            if i not in family and (best is None or hits[i][0] > best[1][0]):
                best = (i, hits[i])
        if best is None:
            return None
        key, display, n = self.anchors[best[0]]
        return display, key, n, best[1][0], best[1][1]


HIT = "struct<matched_anchor:string,matched_anchor_key:string,matched_anchor_n_mentions:bigint,match_score:double,match_method:string>"


def foreign_anchor_hits(mentions: DataFrame, anchors: DataFrame, text: str = "mention_text", own: str = "cluster_canonical_name", foreign: float = 0.86, family: float = 0.90, least: int = 5, max_anchors: int = 100_000) -> DataFrame:
    """Mentions with their key and ``hit`` (null where no foreign anchor matches; pronouns have none).

    The bank is a reference table whose size is checked; each distinct pair of keys is scanned once,
    in Arrow batches, so no pair of mention and anchor ever becomes a row.
    """
    rows = bounded_rows(anchors.select("anchor_key", "display_name", "n_mentions"), max_anchors, "the anchor bank")
    bank = sorted(((r[0], r[1], int(r[2] or 0)) for r in rows if r[0]), key=lambda a: (-a[2], a[0]))
    shared = mentions.sparkSession.sparkContext.broadcast(bank)

    @F.pandas_udf(HIT)
    def scan(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scanner = AnchorScan(shared.value, foreign, family, least)
        names = ["matched_anchor", "matched_anchor_key", "matched_anchor_n_mentions", "match_score", "match_method"]
        for keys, owns in parts:
            found = [scanner.best_foreign(k, o) or (None, None, None, None, None) for k, o in zip(keys, owns)]
            yield pd.DataFrame(found, columns=names).astype({"matched_anchor_n_mentions": "Int64", "match_score": "float64"})

    keyed = mentions.withColumn("mention_key", X.canonical_key(text)).withColumn("own_key", X.canonical_key(own))
    pairs = keyed.where(~F.col("mention_key").isin(X.ANCHOR_PRONOUNS) & (F.col("mention_key") != "")).select("mention_key", "own_key").distinct().withColumn("hit", scan("mention_key", "own_key"))
    return keyed.join(pairs, ["mention_key", "own_key"], "left").withColumn("hit", F.when(F.col("hit.matched_anchor_key").isNotNull(), F.col("hit")))


def filter_mentions(mentions: DataFrame, anchors: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): mentions without a foreign hit, and the audit rows of the others."""
    scanned = foreign_anchor_hits(mentions, anchors, **how)
    return scanned.where("hit is null").drop("hit", "own_key", "mention_key"), scanned.where("hit is not null").select("*", "hit.*").drop("hit", "own_key")
