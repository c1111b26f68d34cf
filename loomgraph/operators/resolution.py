"""Entity resolution across chunks: sieves, vetoes and merging of local clusters.

Evidence is blocked by key: clusters meet only where they share a mention, a name or a head word.
The sieves over the untouched clusters are plain equi-joins. Merging is sequential by nature (every
merge changes the evidence of the next), but a merge can only ever reach clusters that are linked
through shared keys, so the sequential part runs per *block*, a connected component of shared keys,
not per document; blocks are independent and run in parallel.

Input rows, one per mention: (doc_id, uid, name, start, end, text, zone, chunk_index), ``uid`` being
the local cluster and ``name`` its canonical name (null where it has none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.connectivity import components
from loomgraph.runtime import running_counts

OVERLAP = ["left_overlap", "right_overlap"]
SIEVES = ("exactMention_stitching", "adjacent_overlap_exact_mention_without_canonical_equality", "exact_mention_overlap_coefficient", "same_clean_proper_name_anchor", "canonical_head_alias_match")


def mention_evidence(rows: DataFrame) -> DataFrame:
    """Rows with their mention key and what it may be used for."""
    text = X.normalize("text")
    return rows.withColumn("key", F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), text)).withColumn("relevant", X.is_relevant_mention("text")).withColumn("overlap", F.coalesce(F.col("zone").isin(OVERLAP), F.lit(False)))


def component_sets(rows: DataFrame) -> DataFrame:
    """Per local cluster its names, anchors, heads and key counts, and its place in document order."""
    e = mention_evidence(rows)
    chosen = lambda cond: F.size(F.collect_set(F.when(F.expr(cond), F.col("key"))))
    return e.groupBy("doc_id", "uid").agg(
        F.max("name").alias("name"), F.count(F.lit(1)).alias("n_mentions"), F.min("chunk_index").alias("chunk_min"), F.max("chunk_index").alias("chunk_max"), F.min("start").alias("first_start"),
        chosen("true").alias("n_keys"), chosen("relevant").alias("n_relevant"), chosen("overlap").alias("n_overlap"), chosen("overlap and relevant").alias("n_overlap_relevant"),
    ).withColumn("anchor", F.when(X.is_proper_name("name"), X.normalize("name"))).withColumn("head", X.head_word("name"))


def _clusters_by_key(evidence: DataFrame, condition: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, uids): for every key satisfying ``condition`` (and ``by`` columns) its clusters, sorted. One shuffle of the keys serves all that is read from it."""
    keys = evidence.where(condition).where(" and ".join(f"{c} is not null" for c in ("doc_id", *by)))
    return keys.groupBy("doc_id", "key", *by).agg(F.array_sort(F.collect_set("uid")).alias("uids")).select("doc_id", "uids")


def _pairs_of(clusters: DataFrame) -> DataFrame:
    left = clusters.where("size(uids) > 1").select("doc_id", "uids", F.posexplode("uids").alias("p", "left_uid"))
    return left.select("doc_id", "left_uid", F.explode(F.expr("slice(uids, p + 2, size(uids))")).alias("right_uid")).groupBy("doc_id", "left_uid", "right_uid").agg(F.count(F.lit(1)).alias("shared"))


def _sizes_of(clusters: DataFrame, name: str) -> DataFrame:
    """(doc_id, uid, name): the number of keys of each cluster."""
    return clusters.select("doc_id", F.explode("uids").alias("uid")).groupBy("doc_id", "uid").agg(F.count(F.lit(1)).alias(name))


def shared_key_pairs(evidence: DataFrame, condition: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, left_uid, right_uid, shared): clusters that share keys satisfying ``condition`` (and equal ``by`` columns)."""
    return _pairs_of(_clusters_by_key(evidence, condition, by))


def relevant_text_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, uid, text_key, n): how often each relevant mention text stands in a local cluster."""
    return mention_evidence(rows).where("relevant").groupBy("doc_id", "uid", X.normalize("text").alias("text_key")).agg(F.count(F.lit(1)).alias("n"))


def _sided(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    """A side of a merge join: the files of mentions are far smaller than what is made of them, so the optimizer's sizes are no guide."""
    return sets.select("doc_id", F.col("uid").alias(f"{side}_uid"), *(F.col(c).alias(f"{side}_{c}") for c in columns)).hint("merge")


def stitching_edges(rows: DataFrame) -> DataFrame:
    """First sieve: the same canonical name and a shared mention in an overlap."""
    e = mention_evidence(rows).withColumn("n", X.normalize("name")).where("n <> ''")
    return shared_key_pairs(e, "overlap", ("n",)).select("doc_id", "left_uid", "right_uid", F.col("shared").alias("shared_overlap_mention_count"))


def adjacent_overlap_edges(rows: DataFrame, least: int = 2, threshold: float = 0.80) -> DataFrame:
    """Second sieve: neighbouring chunks whose overlap mentions mostly agree, whatever the names."""
    clusters = _clusters_by_key(mention_evidence(rows), "overlap and relevant")
    pairs = _pairs_of(clusters).where(f"shared >= {int(least)}")
    places = rows.groupBy("doc_id", "uid").agg(F.min("chunk_index").alias("chunk_min"), F.max("chunk_index").alias("chunk_max"))
    sets = places.join(_sizes_of(clusters, "n_overlap_relevant").hint("merge"), ["doc_id", "uid"])
    cols = ("chunk_min", "chunk_max", "n_overlap_relevant")
    both = pairs.join(_sided(sets, "left", *cols), ["doc_id", "left_uid"]).join(_sided(sets, "right", *cols), ["doc_id", "right_uid"])
    return both.where("left_chunk_max + 1 = right_chunk_min or right_chunk_max + 1 = left_chunk_min").withColumn("overlap_coefficient", F.col("shared") / F.least("left_n_overlap_relevant", "right_n_overlap_relevant")).where(F.col("overlap_coefficient") >= threshold).select("doc_id", "left_uid", "right_uid", "shared", "overlap_coefficient")


def coefficient_edges(rows: DataFrame, least: int = 2, threshold: float = 0.75) -> DataFrame:
    """Third sieve: most of the smaller cluster's nominal mentions are the other's too."""
    clusters = _clusters_by_key(mention_evidence(rows), "relevant")
    pairs, sets = _pairs_of(clusters).where(f"shared >= {int(least)}"), _sizes_of(clusters, "n_relevant")
    both = pairs.join(_sided(sets, "left", "n_relevant"), ["doc_id", "left_uid"]).join(_sided(sets, "right", "n_relevant"), ["doc_id", "right_uid"])
    return both.withColumn("overlap_coefficient", F.col("shared") / F.least("left_n_relevant", "right_n_relevant")).where(F.col("overlap_coefficient") >= threshold).select("doc_id", "left_uid", "right_uid", "shared", "overlap_coefficient")


def anchor_classes(rows: DataFrame) -> DataFrame:
    """Fourth sieve as classes: (doc_id, uid, anchor, representative, n_linked) of clusters with one equal proper name."""
    w = Window.partitionBy("doc_id", "anchor")
    return component_sets(rows).where("anchor is not null").select("doc_id", "uid", "anchor", F.min("uid").over(w).alias("representative"), (F.count(F.lit(1)).over(w) - 1).alias("n_linked")).where("n_linked > 0")


def head_alias_edges(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fifth sieve between phrases: (doc_id, left_phrase, right_phrase, score, head), each phrase standing for all clusters so named.

    Clusters of one phrase are one class (they match with score 1), so pairs are formed between the
    distinct phrases of a head only.
    """
    phrases = component_sets(rows).select("doc_id", "head", X.entity_phrase("name").alias("phrase")).where("phrase <> ''").where(~X.is_generic_head(F.col("head"))).distinct()
    pairs = phrases.withColumnRenamed("phrase", "left_phrase").join(phrases.withColumnRenamed("phrase", "right_phrase"), ["doc_id", "head"]).where("left_phrase < right_phrase")
    return pairs.withColumn("s", X.surface_similarity("left_phrase", "right_phrase", threshold)).where("s.is_match").select("doc_id", "left_phrase", "right_phrase", "s.score", "head")


def blocks(rows: DataFrame) -> DataFrame:
    """(doc_id, uid, block): clusters that any chain of shared keys, anchors or heads connects."""
    e = mention_evidence(rows)
    sets = component_sets(rows)
    keys = (
        e.where("relevant or overlap").select("doc_id", "uid", F.concat(F.lit("m:"), "key").alias("k"))
        .union(sets.where("anchor is not null").select("doc_id", "uid", F.concat(F.lit("a:"), "anchor")))
        .union(sets.where("head <> ''").select("doc_id", "uid", F.concat(F.lit("h:"), "head")))
    ).distinct()
    first = keys.groupBy("doc_id", "k").agg(F.min("uid").alias("b"))
    linked = components(keys.join(first, ["doc_id", "k"]).select("doc_id", F.col("uid").alias("a"), "b").distinct())
    return sets.select("doc_id", "uid").join(linked.withColumnRenamed("v", "uid"), ["doc_id", "uid"], "left").select("doc_id", "uid", F.coalesce("root", "uid").alias("block"))


# The kernel of one block works on the same definitions as the columns above, on Python values.

_WORDS = re.compile(r"[a-z0-9]+")


def _plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _singular(w: str) -> str:
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


class Phrase:
    """What the comparisons need to know of one phrase, computed once."""

    _known: dict[str, Phrase] = {}
    _likeness: dict[tuple[str, str], float] = {}

    def __init__(self, text: str):
        self.plain = _plain(text)
        self.words = [w for w in _WORDS.findall(self.plain) if w not in X.DETERMINERS]
        self.phrase = " ".join(self.words)
        self.head = _singular(self.words[-1]) if self.words else ""
        self.set = {_singular(w) for w in self.words}
        self.generic_head = not self.head or _singular(self.head) in X.GENERIC_HEADS
        self.generic = not self.plain or self.plain in X.GENERIC_PHRASES or self.generic_head
        pronoun = self.plain in X.PRONOUNS
        self.relevant = bool(self.words) and not pronoun
        self.proper = bool(re.search(r"(^|[^A-Za-z])[A-Z]", text or "")) and not pronoun
        specific = any(_singular(w) not in X.GENERIC_HEADS for w in self.words[:-1])
        self.strong = bool(self.words) and self.phrase not in X.PRONOUNS and self.phrase not in X.GENERIC_PHRASES and (not self.generic_head or specific)

    @classmethod
    def of(cls, text: str | None) -> Phrase:
        text = text or ""
        found = cls._known.get(text)
        if found is None:
            if len(cls._known) > 200_000:
                cls._known.clear()
                cls._likeness.clear()
            found = cls._known[text] = cls(text)
        return found

    def likeness(self, other: Phrase) -> tuple[float, bool]:
        """(score, contained) where the phrases are equal or share a specific head; (-1, False) otherwise."""
        if not self.phrase or not other.phrase:
            return -1.0, False
        if self.phrase == other.phrase:
            return 1.0, True
        if self.head != other.head or self.generic_head:
            return -1.0, False
        return len(self.set & other.set) / len(self.set | other.set), self.set <= other.set or other.set <= self.set

    def matches(self, other: Phrase, threshold: float) -> bool:
        score, contained = self.likeness(other)
        return contained or score >= threshold


class Group:
    """One component while it grows."""

    def __init__(self, uid: str):
        self.uid, self.members = uid, [uid]
        self.names: Counter[str] = Counter()  # in order of first appearance
        self.anchors: set[str] = set()
        self.keys: set = set()
        self.relevant: set = set()
        self.overlap: set = set()
        self.chunks: set[int] = set()
        self.texts: set[str] = set()
        self.first = (10**12, 10**12)

    def order(self) -> tuple:
        return (*self.first, self.uid)

    def absorb(self, other: Group) -> None:
        self.members += other.members
        self.names.update(other.names)
        for mine, theirs in ((self.anchors, other.anchors), (self.keys, other.keys), (self.relevant, other.relevant), (self.overlap, other.overlap), (self.chunks, other.chunks), (self.texts, other.texts)):
            mine |= theirs
        self.first = min(self.first, other.first)

    def strong(self) -> set[str]:
        return {p.phrase for p in map(Phrase.of, self.names) if p.strong}

    def dominant(self) -> str | None:
        return next((p.phrase for p in (Phrase.of(n) for n, _ in self.names.most_common()) if p.strong), None)


def _edge(sieve: int, a: Group, b: Group) -> tuple | None:
    """(strength, whether vetoes that allow strong overlap pass) of an accepted pair, else None."""
    if sieve == 0:
        shared, names = len(a.overlap & b.overlap), len(a.names.keys() & b.names.keys())
        return ((shared, names, 0), True) if shared and names else None
    if sieve in (1, 2):
        if sieve == 1 and not (a.chunks and b.chunks and (max(a.chunks) + 1 == min(b.chunks) or max(b.chunks) + 1 == min(a.chunks))):
            return None
        ka, kb = (a.overlap & a.relevant, b.overlap & b.relevant) if sieve == 1 else (a.relevant, b.relevant)
        shared, small = len(ka & kb), min(len(ka), len(kb))
        if shared < 2 or shared / small < (0.80 if sieve == 1 else 0.75):
            return None
        return (shared / small, shared, small), sieve == 1 or (shared / small >= 0.95 and shared >= 3)
    if sieve == 3:
        return ((1.0, 0, 0), False) if len(a.anchors) == 1 and a.anchors == b.anchors else None
    best, accepted = 0.0, False
    for x in map(Phrase.of, a.names):
        for y in map(Phrase.of, b.names):
            score, contained = x.likeness(y)
            best = max(best, score)
            accepted |= contained or score >= 0.50
    return ((best, 0, 0), False) if accepted else None


def _alike(x: str, y: str) -> bool:
    return Phrase.of(x).matches(Phrase.of(y), 0.67)


def _families(anchors: set[str]) -> int:
    groups: list[list[str]] = []
    for anchor in sorted(anchors):
        home = next((g for g in groups if any(_alike(anchor, x) for x in g)), None)
        if home is None:
            groups.append([anchor])
        else:
            home.append(anchor)
    return len(groups)


def _holds(group: Group, phrase: str) -> bool:
    return any(_alike(n, phrase) for n in group.names) or any(_alike(t, phrase) for t in group.texts)


def vetoed(a: Group, b: Group, strong_overlap: bool) -> str | None:
    """The first rule that forbids a merge, None where it may go on."""
    sa, sb = a.strong(), b.strong()
    agree = any(_alike(x, y) for x in sa for y in sb)
    if not strong_overlap:
        da, db = a.dominant(), b.dominant()
        if da and db and not _alike(da, db):
            return "dominant_anchors"
        if sa and sb and not agree:
            return "disjoint_anchors"
    shared = {k[2] for k in a.relevant & b.relevant}
    if not agree and shared and all(Phrase.of(t).generic for t in shared):
        return "generic_evidence"
    if not strong_overlap:
        da, db = a.dominant(), b.dominant()
        if da and db and not _alike(da, db) and _holds(a, db) != _holds(b, da):
            return "one_sided_evidence"
        families = _families(sa | sb)
        if families > 2 and families > max(_families(sa), _families(sb)):
            return "too_many_identities"
    return None


def _block_keys(sieve: int, g: Group) -> set:
    if sieve == 0:
        return {(n, k) for n in g.names for k in g.overlap}
    if sieve in (1, 2):
        return g.overlap & g.relevant if sieve == 1 else g.relevant
    if sieve == 3:
        return g.anchors
    return {p.head for p in map(Phrase.of, g.names) if not p.generic_head}


def _allowed(sieve: int, a: Group, b: Group, veto: bool) -> tuple | None:
    """The strength of a pair that may merge, None otherwise."""
    edge = _edge(sieve, a, b)
    return None if edge is None or (veto and vetoed(a, b, edge[1])) else edge[0]


class _Index:
    """The groups of a block by the keys a sieve compares them on, kept up to date while they merge."""

    def __init__(self, sieve: int, groups: dict[str, Group]):
        self.sieve, self.groups = sieve, groups
        self.keys = {u: _block_keys(sieve, g) for u, g in groups.items()}
        self.at: dict = {}
        for u, ks in self.keys.items():
            for k in ks:
                self.at.setdefault(k, set()).add(u)

    def near(self, u: str) -> set[str]:
        return set().union(*(self.at[k] for k in self.keys[u])) - {u}

    def merge(self, x: str, y: str) -> None:
        """``y`` becomes part of ``x``."""
        self.groups[x].absorb(self.groups.pop(y))
        for k in self.keys.pop(y):
            self.at[k].discard(y)
        keys = _block_keys(self.sieve, self.groups[x])
        for k in self.keys[x] - keys:
            self.at[k].discard(x)
        for k in keys - self.keys[x]:
            self.at.setdefault(k, set()).add(x)
        self.keys[x] = keys


def _ordered(groups: dict[str, Group], x: str, y: str) -> tuple[str, str]:
    return (x, y) if groups[x].order() < groups[y].order() else (y, x)


def _greedy_by_evidence(groups: dict[str, Group], sieve: int, veto: bool) -> None:
    """Merge the strongest allowed pair of groups that share evidence until none is left.

    Allowed pairs wait in a heap; a merge judges only the pairs of the merged group anew, and what
    the heap holds of older states is passed over.
    """
    index, state = _Index(sieve, groups), dict.fromkeys(groups, 0)
    heap: list[tuple] = []

    def offer(u: str, v: str) -> None:
        x, y = _ordered(groups, u, v)
        s = _allowed(sieve, groups[x], groups[y], veto)
        if s:
            heappush(heap, (-s[0], -s[1], -s[2], groups[x].order(), groups[y].order(), x, y, state[x], state[y]))

    for u in list(groups):
        for v in index.near(u):
            if u < v:
                offer(u, v)
    while heap:
        *_, x, y, sx, sy = heappop(heap)
        if state.get(x) != sx or state.get(y) != sy:
            continue
        index.merge(x, y)
        del state[y]
        state[x] += 1
        for v in index.near(x):
            offer(x, v)


def _name_strength(a: frozenset, b: frozenset) -> float | None:
    """How alike two sets of names are at best, None where no two of them match."""
    best, accepted = 0.0, False
    for x in map(Phrase.of, a):
        for y in map(Phrase.of, b):
            score, contained = x.likeness(y)
            best = max(best, score)
            accepted |= contained or score >= 0.50
    return best if accepted else None


class _Classes:
    """Groups by what alone decides a pair's strength in the last two sieves: their anchors, or their names."""

    def __init__(self, sieve: int, groups: dict[str, Group]):
        self.sieve, self.groups = sieve, groups
        self.of = {u: self.label(g) for u, g in groups.items()}
        self.members: dict[frozenset, set[str]] = {}
        for u, c in self.of.items():
            self.members.setdefault(c, set()).add(u)
        self.heads: dict[str, set[frozenset]] = {}
        self.known: dict[tuple, float | None] = {}
        for c in self.members:
            self._note(c)

    def label(self, g: Group) -> frozenset:
        return frozenset(g.anchors if self.sieve == 3 else g.names)

    def _note(self, c: frozenset) -> None:
        if self.sieve == 4:
            for p in map(Phrase.of, c):
                if not p.generic_head:
                    self.heads.setdefault(p.head, set()).add(c)

    def matching(self, c: frozenset) -> list[tuple[frozenset, float]]:
        """The classes a class may merge with, itself included, and how strongly."""
        if self.sieve == 3:
            return [(c, 1.0)] if len(c) == 1 else []
        near = set().union(*(self.heads[p.head] for p in map(Phrase.of, c) if not p.generic_head)) if c else set()
        out = []
        for d in near:
            pair = (c, d)
            if pair not in self.known:
                self.known[pair] = self.known[d, c] = _name_strength(c, d)
            if self.known[pair] is not None:
                out.append((d, self.known[pair]))
        return out

    def merge(self, x: str, y: str) -> bool:
        """``y`` becomes part of ``x``; whether that moves ``x`` to another class."""
        self.groups[x].absorb(self.groups.pop(y))
        self.members[self.of.pop(y)].discard(y)
        before, after = self.of[x], self.label(self.groups[x])
        if before == after:
            return False
        self.members[before].discard(x)
        if after not in self.members:
            self.members[after] = set()
            self._note(after)
        self.members[after].add(x)
        self.of[x] = after
        return True

    def sorted(self, *classes: frozenset) -> list[str]:
        return sorted(set().union(*(self.members[c] for c in classes)), key=lambda u: self.groups[u].order())


def _pairs_between(rows: list[str], of: dict[str, frozenset], a: frozenset, b: frozenset) -> Iterator[tuple[str, str]]:
    """Pairs of groups of two classes (or of one), in document order, as long as both are alive and in their class."""
    for i, x in enumerate(rows):
        for y in rows[i + 1:]:
            c, d = of.get(x), of.get(y)
            if c is None or c not in (a, b):
                break
            if (c, d) in ((a, b), (b, a)):
                yield x, y


def _greedy_by_class(groups: dict[str, Group], sieve: int, veto: bool) -> None:
    """The same where classes decide the strength: pairs are drawn lazily, class by class, the strongest and earliest first.

    As long as no veto stands against it, a class of any size costs one look per member; vetoed pairs
    are looked at again when one of their groups has changed.
    """
    classes = _Classes(sieve, groups)
    heap: list[tuple] = []
    refused: dict[str, set[str]] = {}
    tick = count()

    def follow(s: float, pairs: Iterator[tuple[str, str]]) -> None:
        for x, y in pairs:
            if x in groups and y in groups:
                heappush(heap, (-s, groups[x].order(), groups[y].order(), next(tick), x, y, classes.of[x], classes.of[y], pairs))
                return

    def one(u: str, v: str) -> None:
        s = dict(classes.matching(classes.of[u])).get(classes.of[v])
        if s is not None:
            follow(s, iter([_ordered(groups, u, v)]))

    def against(x: str, rows: list[str]) -> Iterator[tuple[str, str]]:
        for y in rows:
            if x not in groups:
                return
            if y in groups and y != x:
                yield _ordered(groups, x, y)

    done = set()
    for c in list(classes.members):
        for d, s in classes.matching(c):
            if (d, c) not in done:
                done.add((c, d))
                follow(s, _pairs_between(classes.sorted(c, d), classes.of, c, d))
    while heap:
        s, _, _, _, x, y, cx, cy, rest = heappop(heap)
        if classes.of.get(x) == cx and classes.of.get(y) == cy:
            if veto and vetoed(groups[x], groups[y], False):
                refused.setdefault(x, set()).add(y)
                refused.setdefault(y, set()).add(x)
            else:
                moved = classes.merge(x, y)
                again = (refused.pop(x, set()) | refused.pop(y, set())) & groups.keys() - {x}
                if moved:
                    for d, strength in classes.matching(classes.of[x]):
                        follow(strength, against(x, classes.sorted(d)))
                else:
                    for v in again:
                        one(x, v)
        follow(-s, rest)


def _merge_components(groups: dict[str, Group], sieve: int, veto: bool) -> None:
    """Merge every connected component of the allowed pairs at once, into its first group, until none is left.

    Pairs of groups that are connected already in a round need no look, so a class of any size
    costs one look per member as long as no veto stands against it.
    """
    refused: set[tuple[str, str]] = set()
    while True:
        root = {u: u for u in groups}

        def find(u: str) -> str:
            while root[u] != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        def look(pairs: Iterator[tuple[str, str]]) -> None:
            for x, y in pairs:
                a, b = find(x), find(y)
                if a != b and (x, y) not in refused:
                    if _allowed(sieve, groups[x], groups[y], veto):
                        a, b = _ordered(groups, a, b)
                        root[b] = a
                    else:
                        refused.add((x, y))

        if sieve < 3:
            index = _Index(sieve, groups)
            for u in list(groups):
                look(_ordered(groups, u, v) for v in index.near(u) if u < v)
        else:
            classes = _Classes(sieve, groups)
            done = set()
            for c in list(classes.members):
                for d, _ in classes.matching(c):
                    if (d, c) not in done:
                        done.add((c, d))
                        look(_pairs_between(classes.sorted(c, d), classes.of, c, d))
        merged = [u for u in sorted(groups, key=lambda u: groups[u].order()) if find(u) != u]
        if not merged:
            return
        touched = set()
        for u in merged:
            groups[find(u)].absorb(groups[u])
            touched |= {u, find(u)}
        for u in merged:
            del groups[u]
        refused = {p for p in refused if not touched & set(p)}


def merge_block(groups: dict[str, Group], strategy: str, veto: bool) -> dict[str, Group]:
    """Run the five sieves in order, each to its fixed point.

    ``greedy`` merges the strongest allowed pair and looks again; ``components`` merges every connected
    component of the allowed pairs at once and looks again. Only pairs whose ends changed are judged anew.
    """
    for sieve in range(5):
        if strategy == "components":
            _merge_components(groups, sieve, veto)
        elif sieve < 3:
            _greedy_by_evidence(groups, sieve, veto)
        else:
            _greedy_by_class(groups, sieve, veto)
    return groups


def _run_block(rows: list[tuple], strategy: str, veto: bool) -> list[tuple[int, str, str]]:
    """(doc_id, uid, component) of one block's mentions (doc_id, block, chunk_index, start, end, uid, name, text, zone)."""
    groups: dict[str, Group] = {}
    for _, _, chunk, start, end, uid, name, text, zone in rows:
        g = groups.get(uid)
        if g is None:
            g = groups[uid] = Group(uid)
            if name and name.strip():
                g.names[_plain(name)] += 1
                if Phrase.of(name).proper:
                    g.anchors.add(_plain(name))
        key = (start, end, _plain(text))
        p = Phrase.of(text)
        g.keys.add(key)
        if p.relevant:
            g.relevant.add(key)
            g.texts.add(key[2])
        if zone in OVERLAP:
            g.overlap.add(key)
        g.chunks.add(chunk)
        g.first = min(g.first, (chunk, start))
    merged = merge_block(groups, strategy, veto) if len(groups) > 1 else groups
    return [(rows[0][0], u, g.uid) for g in merged.values() for u in g.members]


def resolve(rows: DataFrame, strategy: str = "greedy", veto: bool = True) -> DataFrame:
    """(doc_id, uid, component): every local cluster with the first cluster (in document order) of its entity.

    Rows with a null document, cluster or offset are ignored; a null name gives no name evidence.
    """
    if strategy not in ("greedy", "components"):
        raise ValueError(f"unknown strategy {strategy}")
    usable = rows.where("doc_id is not null and uid is not null and start is not null and end is not null and chunk_index is not null").select("doc_id", "uid", "name", "start", "end", "text", "zone", "chunk_index")
    columns = ["doc_id", "block", "chunk_index", "start", "end", "uid", "name", "text", "zone"]
    grouped = usable.join(blocks(usable), ["doc_id", "uid"]).select(*columns).repartition("doc_id", "block").sortWithinPartitions(*columns[:6])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive one after the other; only one is held."""
        held: list[tuple] = []
        done: list[tuple] = []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "uid", "component"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    done += _run_block(held, strategy, veto)
                    held = []
                held.append(row)
            if len(done) > 20_000:
                yield packed()
                done = []
        if held:
            done += _run_block(held, strategy, veto)
        if done:
            yield packed()

    return grouped.mapInArrow(work, "doc_id bigint, uid string, component string")


def number_entities(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, component, global_cluster_uid, n_mentions, n_local_clusters, chunk_min, chunk_max, first_start): uids in document order."""
    joined = members.join(rows, ["doc_id", "uid"])
    per = joined.groupBy("doc_id", "component").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("uid").alias("n_local_clusters"), F.min("chunk_index").alias("chunk_min"), F.max("chunk_index").alias("chunk_max"), F.min(F.struct("chunk_index", "start")).alias("f"))
    ranked = running_counts(per, ["doc_id"], [F.col("f.chunk_index").asc_nulls_last(), F.col("f.start").asc_nulls_last(), F.col("component")], name="entities")
    return ranked.select("doc_id", "component", X.global_cluster_uid(F.col("_upto") - 1).alias("global_cluster_uid"), "n_mentions", "n_local_clusters", "chunk_min", "chunk_max", F.col("f.start").alias("first_start"))


def representative_names(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, component, canonical_name): the most frequent name of the local clusters, the earliest winning ties."""
    named = members.join(rows.where("name is not null").groupBy("doc_id", "uid").agg(F.max("name").alias("name"), F.min(F.struct("chunk_index", "start", "uid")).alias("f")), ["doc_id", "uid"])
    counted = named.groupBy("doc_id", "component", "name").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"))
    best = Window.partitionBy("doc_id", "component").orderBy(F.col("n").desc(), "f", "name")
    return counted.withColumn("k", F.row_number().over(best)).where("k = 1").select("doc_id", "component", F.col("name").alias("canonical_name"))


def salience_split(entities: DataFrame, size: str = "n_mentions", percentile: float = 0.95, least_kept: int | None = 10, least_mentions: int | None = None, order: tuple[str, ...] = ("chunk_min", "first_start", "component")) -> DataFrame:
    """Entities with ``cutoff`` and ``kept``: large enough, or the ``least_kept`` largest where too few are.

    The cutoff is the ceiling of the linearly interpolated quantile of the document's sizes, computed
    by one aggregation; ranks only decide the fallback, in document order on ties (``order`` must tell
    entities apart), and are counted in parts, so a document of any size does not meet in one task.
    """
    limit = F.ceil(F.percentile(F.col(size).cast("double"), percentile))
    if least_mentions is not None:
        limit = F.greatest(limit, F.lit(least_mentions))
    cut = entities.groupBy("doc_id").agg(limit.cast("bigint").alias("cutoff"), F.count(F.lit(1)).alias("n_all"))
    ranked = running_counts(entities, ["doc_id"], [F.col(size).desc(), *map(F.col, order)], name="salience")
    rows = ranked.withColumnRenamed("_upto", "_r").join(cut, "doc_id")
    kept = F.col(size) >= F.col("cutoff")
    if least_kept is not None:
        passing = rows.groupBy("doc_id").agg(F.count_if(kept).alias("_passing"))
        rows = rows.join(passing, "doc_id")
        kept = F.when(F.col("_passing") < least_kept, F.col("_r") <= least_kept).otherwise(kept)
    return rows.withColumn("kept", kept).drop("_r", "n_all", "_passing")
