"""Pairwise matches to groups by low-diameter decomposition (problem 1).

Every level draws for each vertex an exponentially distributed head start, unbounded as the method
asks. A cluster grows from its center one link a time unit, beginning earlier the larger the head start;
a vertex belongs to the cluster that reaches it first. Clusters then contract to super-vertices, links
inside a cluster vanish, and the next level works on what is left. The rate of the head starts halves from
level to level: at the rate b a link is cut with a chance below b, so each level leaves a smaller share
of links than the one before and may grow further on a graph that has shrunk by more, and a handful of
levels suffice even on long chains. The per-level maps are composed from the last level back to the first.

Links never leave their scope, so a scope is decomposed where it lies: links are shuffled once, by scope,
and each task decomposes the scopes it gets (:func:`decompose`, on arrays). A scope with more than
``piece_links`` links is cut into pieces of at most about that many by a hash of the link, so no task gets
more however hot the scope is; each piece contracts to one link per vertex, and these go on to levels that
are spread over the cluster (:func:`link_groups_distributed`).

There, growth is computed as earliest arrivals: arrivals travel several links within one job, and only
those that moved at a job's last link travel on in the next one. Between two links of a job nothing but
the earliest offer for each vertex is shuffled (a partial minimum before the shuffle). A vertex with more
than ``max_degree`` links is cut into parts that are tied to it by links of their own and keep at most
that many. Head starts come from a hash of vertex and level: a task that is run again draws the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.runtime import cut_to, drop_path

BLANKS = r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$"
#: Links that arrivals travel in the first and in each further growth job of a level.
FIRST_REACH, REACH = 4, 8
#: Levels composed in one job.
COMPOSED = 4
PART = "\u0001"


def clean_uid(value: Column) -> Column:
    """A uid without surrounding blanks; null when nothing is left."""
    trimmed = F.regexp_replace(value, BLANKS, "")
    return F.when(F.length(trimmed) > 0, trimmed)


def edges_of_pairs(pairs: DataFrame, left: str = "left_component_uid", right: str = "right_component_uid", scope: str = "doc_id") -> DataFrame:
    """(scope, a, b) of the usable pairs: both sides non-blank, scope known; self-pairs are kept."""
    return (
        pairs.select(F.col(scope).alias("scope"), clean_uid(F.col(left)).alias("a"), clean_uid(F.col(right)).alias("b"))
        .where("scope is not null and a is not null and b is not null")
    )


def edges_of_lists(lists: DataFrame, members: str = "local_cluster_uids", scope: str = "doc_id", separator: str = "|") -> DataFrame:
    """(scope, a, b) linking the first usable member of each list with every member, itself included."""
    parts = F.filter(F.transform(F.split(F.col(members), f"\\{separator}"), clean_uid), lambda x: x.isNotNull())
    return (
        lists.select(F.col(scope).alias("scope"), F.array_distinct(parts).alias("m"))
        .where("scope is not null and size(m) > 0")
        .select("scope", F.element_at("m", 1).alias("a"), F.explode("m").alias("b"))
    )


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level").distinct()


def _counted(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, str, int]:
    """``df`` written to the shared folder, and the number of rows with ``condition``, counted while writing."""
    seen = Observation()
    out, path = cut_to(df.observe(seen, F.count_if(condition).alias("n")), name)
    return out, path, int(seen.get["n"])


def _both_ways(live: DataFrame) -> DataFrame:
    return live.select("scope", F.col("a").alias("u"), F.col("b").alias("w"), "level").union(live.select("scope", F.col("b").alias("u"), F.col("a").alias("w"), "level"))


def split_hubs(live: DataFrame, max_degree: int) -> DataFrame:
    """``live`` with each vertex of more than ``max_degree`` links cut into parts linked to it.

    A link moves to the part its other end hashes to. Parts are vertices like any other; as each hangs
    on its own vertex they change no group.
    """
    hubs = _both_ways(live).groupBy("scope", "u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_degree).select("scope", "u", F.ceil(F.col("n") / max_degree).cast("int").alias("parts"))
    side = lambda s: hubs.select("scope", F.col("u").alias(s), F.col("parts").alias(f"parts_{s}"))
    part = lambda s, other: F.when(F.col(f"parts_{s}").isNotNull(), F.concat(F.col(s), F.lit(PART), F.pmod(F.xxhash64(other), F.col(f"parts_{s}")).cast("string"))).otherwise(F.col(s))
    moved = live.join(side("a"), ["scope", "a"], "left").join(side("b"), ["scope", "b"], "left").select("scope", part("a", "b").alias("a"), part("b", "a").alias("b"), "level")
    tied = hubs.crossJoin(F.broadcast(live.select("level").limit(1))).select("scope", F.col("u").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.concat("u", F.lit(PART), k.cast("string")))).alias("b"), "level")
    return _ordered(moved.union(tied))


def grow(live: DataFrame, beta: float) -> tuple[DataFrame, str]:
    """One low-diameter decomposition: (scope, v, center) for every vertex of ``live`` (scope, a, b, level), with its path.

    Level and length travel as columns, not as literals, so all levels and steps run the same
    generated code.
    """
    spark = live.sparkSession
    both = _both_ways(live)
    vertices = both.groupBy("scope", "u").agg(F.max("level").alias("level"))
    links = both.select("scope", "u", "w", F.lit(1.0).alias("length")).union(vertices.select("scope", "u", F.col("u").alias("w"), F.lit(0.0)))
    uniform = (F.xxhash64("scope", "u", "level").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    state = vertices.select("scope", F.col("u").alias("v"), F.struct((F.log(uniform) * F.pow(F.lit(2.0), "level") / F.lit(beta)).alias("at"), F.col("u").alias("center"), F.lit(0).alias("hops")).alias("got"))
    moving, path, reach = state, None, FIRST_REACH
    while True:
        offers = moving.select("scope", "v", F.struct("got.at", "got.center", F.lit(0).alias("hops")).alias("got"))
        for _ in range(reach):
            here = offers.select("scope", F.col("v").alias("u"), "got")
            step = F.struct((F.col("got.at") + F.col("length")).alias("at"), F.col("got.center").alias("center"), (F.col("got.hops") + F.col("length").cast("int")).alias("hops"))
            offers = links.join(here, ["scope", "u"]).groupBy("scope", F.col("w").alias("v")).agg(F.min(step).alias("got"))
        if path is None:
            after = offers  # every vertex has offered itself
        else:
            better = F.col("offer.at") < F.col("got.at")
            after = state.join(offers.withColumnRenamed("got", "offer"), ["scope", "v"], "left").select("scope", "v", F.when(better, F.col("offer")).otherwise(F.struct("got.at", "got.center", F.lit(0).alias("hops"))).alias("got"))
        before = path
        state, path, open_rows = _counted(after, "grow", F.col("got.hops") == reach)
        if before:
            drop_path(spark, before)
        if not open_rows:
            return state.select("scope", "v", F.col("got.center").alias("center")), path
        moving, reach = state.where(F.col("got.hops") == reach), REACH


def decompose(a: np.ndarray, b: np.ndarray, n: int, beta: float = 0.5, seed: int = 0) -> np.ndarray:
    """The group of each of the vertices 0..n-1 under the links a-b, as the number of some vertex in it."""
    composed = np.arange(n)
    rate, level = beta, 0
    while True:
        apart = a != b
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        if not len(low):
            return composed
        code = np.unique(low * np.int64(n) + high)
        a, b = code // n, code % n
        live, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[:len(a)], ends[len(a):]
        source, target = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.argsort(target, kind="stable")
        source = source[order]
        starts = np.flatnonzero(np.diff(target[order], prepend=-1))  # every live vertex has a link
        at = -np.random.default_rng([seed, level]).exponential(1 / rate, len(live))
        center = np.arange(len(live))
        while True:
            offer = at[source] + 1
            best = np.minimum.reduceat(offer, starts)
            moved = best < at
            if not moved.any():
                break
            first = offer == np.repeat(best, np.diff(starts, append=len(offer)))
            reached = np.minimum.reduceat(np.where(first, center[source], len(live)), starts)
            at, center = np.where(moved, best, at), np.where(moved, reached, center)
        step = np.arange(n)
        step[live] = live[center]
        composed = step[composed]
        a, b = step[a], step[b]
        rate, level = rate / 2, level + 1


LOCAL = "scope {scope}, v string, root string, whole boolean"
#: Links decomposed together in one go of a task, small scopes side by side.
TOGETHER = 1_000_000


def _pieces(edges: DataFrame, piece_links: int) -> DataFrame:
    """Links with the piece of their scope they fall into and the number of pieces it has."""
    sizes = edges.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece_links).select("scope", F.ceil(F.col("n") / piece_links).cast("int").alias("pieces"))
    cut = edges.join(sizes, "scope", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    return cut.withColumn("piece", F.pmod(F.xxhash64("a", "b"), F.col("pieces")).cast("int"))


def decomposed_scopes(edges: DataFrame, beta: float, piece_links: int) -> DataFrame:
    """(scope, v, root, whole): each vertex with the smallest one it is linked to inside its piece; ``whole`` where that is all of its scope."""
    scope = dict(edges.dtypes)["scope"]
    kind = edges.schema["scope"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        held: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pa.RecordBatch:
            place, places = pd.factorize(pd.MultiIndex.from_frame(rows[["scope", "piece"]])) if len(rows) else (np.zeros(0, np.int64), [])
            words, names = pd.factorize(pd.concat([rows["a"], rows["b"]], ignore_index=True), sort=True)
            both = np.concatenate([place, place]).astype(np.int64) * len(names) + words
            ids, ends = np.unique(both, return_inverse=True)
            root = decompose(ends[:len(rows)], ends[len(rows):], len(ids), beta)
            order = np.argsort(root, kind="stable")  # ids of a place ascend with the names
            heads = np.flatnonzero(np.diff(root[order], prepend=-1)) if len(ids) else np.zeros(0, np.int64)
            least = np.empty(len(ids), np.int64)
            least[order] = np.repeat(ids[order[heads]], np.diff(heads, append=len(ids)))
            first = np.unique(place, return_index=True)[1]
            at = ids // max(len(names), 1)
            scopes, whole = rows["scope"].to_numpy()[first][at], (rows["pieces"].to_numpy() == 1)[first][at]
            name = np.asarray(names, dtype=object)
            return pa.RecordBatch.from_arrays([pa.array(scopes.tolist(), to_arrow_type(kind)), pa.array(name[ids % max(len(names), 1)], pa.string()), pa.array(name[least % max(len(names), 1)], pa.string()), pa.array(whole, pa.bool_())], names=["scope", "v", "root", "whole"])

        count = 0
        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            held.append(rows)
            count += len(rows)
            if count >= TOGETHER:  # all but the piece that may go on
                rows = pd.concat(held, ignore_index=True)
                last = (rows["scope"] == rows["scope"].iloc[-1]) & (rows["piece"] == rows["piece"].iloc[-1])
                if not last.all():
                    yield flush(rows[~last].reset_index(drop=True))
                held = [rows[last].reset_index(drop=True)]
                count = len(held[0])
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    placed = _pieces(edges, piece_links).select("scope", "a", "b", "piece", "pieces").repartition("scope", "piece").sortWithinPartitions("scope", "piece")
    return placed.mapInArrow(work, LOCAL.format(scope=scope))


def link_groups(edges: DataFrame, beta: float = 0.5, piece_links: int = 2_000_000, max_degree: int = 100_000) -> DataFrame:
    """(scope, member, group) with the smallest member (by code point) naming each group.

    ``edges``: (scope, a, b), in any direction, repeated, self-edges allowed. Every vertex that
    stands in an edge comes out once. An empty input gives an empty result.
    """
    local, _, parted = _counted(decomposed_scopes(edges, beta, piece_links), "decomposed", ~F.col("whole"))
    done = local.where("whole").select("scope", F.col("v").alias("member"), F.col("root").alias("group"))
    if not parted:
        return done
    return done.union(link_groups_distributed(local.where("not whole").select("scope", F.col("v").alias("a"), F.col("root").alias("b")), beta, max_degree))


def link_groups_distributed(edges: DataFrame, beta: float = 0.5, max_degree: int = 100_000, max_levels: int = 200) -> DataFrame:
    """The same with every level spread over the cluster, for scopes of any size."""
    spark = edges.sparkSession
    members = edges.select("scope", F.explode(F.array("a", "b")).alias("v")).distinct()
    every = F.lit(True)
    live, path, n = _counted(_ordered(edges.withColumn("level", F.lit(0))), "links", every)
    maps: list[tuple[DataFrame, str]] = []
    while n:
        if len(maps) == max_levels:
            raise RuntimeError(f"{n} links are left after {max_levels} levels")
        if n > max_degree:  # else no vertex can have more links
            before = path
            live, path, n = _counted(split_hubs(live, max_degree), "links", every)
            drop_path(spark, before)
        step, step_path = grow(live, beta)
        maps.append((step, step_path))
        a, b = (step.select("scope", F.col("v").alias(x), F.col("center").alias(f"c{x}")) for x in "ab")
        before = path
        live, path, n = _counted(_ordered(live.join(a, ["scope", "a"]).join(b, ["scope", "b"]).select("scope", F.col("ca").alias("a"), F.col("cb").alias("b"), (F.col("level") + 1).alias("level"))), "links", every)
        drop_path(spark, before)
    drop_path(spark, path)
    if not maps:
        return members.select("scope", F.col("v").alias("member"), F.col("v").alias("group"))
    whole, passed = maps.pop()
    paths = [passed]
    while maps:
        for _ in range(min(COMPOSED, len(maps))):
            upper = whole.select("scope", F.col("v").alias("center"), F.col("center").alias("root"))
            lower, passed = maps.pop()
            paths.append(passed)
            whole = lower.join(upper, ["scope", "center"], "left").select("scope", "v", F.coalesce("root", "center").alias("center"))
        whole, passed = cut_to(whole, "composed")
        for p in paths:
            drop_path(spark, p)
        paths = [passed]
    rooted = members.join(whole, ["scope", "v"], "left").select("scope", "v", F.coalesce("center", "v").alias("root"))
    least = rooted.groupBy("scope", "root").agg(F.min("v").alias("group"))
    return rooted.join(least, ["scope", "root"]).select("scope", F.col("v").alias("member"), "group")
