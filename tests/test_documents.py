import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import anchors as A
from loomgraph.operators import chunks as C
from loomgraph.operators import connectivity as K
from loomgraph.operators import mentions as M
from loomgraph.operators import resolution as R
from loomgraph.operators import tokens as T


def docs(spark, texts, starts=None):
    return spark.createDataFrame([(i, t, (starts or {}).get(i)) for i, t in enumerate(texts)], "doc_id bigint, text string, sentence_starts array<bigint>")


def test_tokens_round_trip(spark):
    texts = ["One two.\n\nThrée  four\tfive", None, "", "   ", "x", "a" * 100_000]
    got = {}
    for r in T.tokenize(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {0, 3, 4, 5}
    for i, items in got.items():
        raw = texts[i].encode()
        for r in items:
            assert texts[i][r["char_start"]:r["char_end"]] == r["text"] and raw[r["byte_start"]:r["byte_end"]].decode() == r["text"]
    words = [(r["token_i"], r["token_id"], r["text"], r["paragraph_id"]) for r in got[0] if not r["is_space"]]
    assert words == [(0, 0, "One", 0), (1, 1, "two.", 0), (3, 2, "Thrée", 1), (5, 3, "four", 1), (6, 4, "five", 1)]


def test_sentences_edges(spark, rows):
    d = docs(spark, ["a b c d", "a b", None, ""], {0: [0, 2, 2, 9, -1], 1: None})
    assert rows(T.sentences(d)) == [(0, 0, 0, 2), (0, 1, 2, 4), (1, 0, 0, 2)]
    s = T.with_sentences(T.tokenize(d), T.sentences(d)).where("doc_id = 0").orderBy("token_i").select("sentence_id", "token_id_in_sentence")
    assert [tuple(r) for r in s.collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40), st.integers(0, 3), st.integers(20, 90))
def test_core_ranges_are_greedy_and_cover(lengths, overlap, limit):
    starts = [sum(lengths[:i]) for i in range(len(lengths))]
    size = sum(lengths)
    bounds = [*starts, size]
    n = len(lengths)

    def span(a, b):
        return bounds[min(n, b + overlap)] - bounds[max(0, a - overlap)]

    if any(span(i, i + 1) > limit for i in range(n)):
        try:
            made = C.core_ranges(starts, size, limit, overlap)
        except ValueError:
            return
    else:
        made = C.core_ranges(starts, size, limit, overlap)
    assert made[0][0] == 0 and made[-1][1] == n and all(x[1] == y[0] for x, y in zip(made, made[1:]))
    for a, b in made:
        assert span(a, b) <= limit and (b == n or span(a, b + 1) > limit)


def test_plan_holds_its_rules(spark):
    r = random.Random(3)
    texts, starts = [], {}
    for i in range(12):
        lengths = [r.randint(1, 15) for _ in range(r.randint(1, 60))]
        texts.append(" ".join(f"w{k}" for k in range(sum(lengths))))
        starts[i] = [sum(lengths[:k]) for k in range(len(lengths))]
    d = docs(spark, texts, starts)
    s = T.sentences(d)
    plan = C.plan_chunks(s, 100, 1)
    assert C.plan_violations(plan, s.groupBy("doc_id").agg(F.max("end").alias("n_doc_tokens")), 100).count() == 0
    covered = C.chunk_tokens(T.tokenize(d), plan, bucket=16).where("in_core").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token_id").alias("d"))
    assert {r["doc_id"]: (r["n"], r["d"]) for r in covered.collect()} == {i: (len(t.split()),) * 2 for i, t in enumerate(texts)}
    with pytest.raises(Exception, match="exceeds"):
        C.plan_chunks(s, 5, 1, strict=True).collect()
    assert C.plan_chunks(s.limit(0), 100, 1).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.integers(0, 4), st.integers(5, 90))
def test_covering_ranges_are_the_plan_or_fit_as_much_as_they_can(lengths, overlap, limit):
    starts, size = [sum(lengths[:k]) for k in range(len(lengths))], sum(lengths)
    made = C.covering_ranges(starts, size, limit, overlap)
    assert made[0][2] == 0 and made[-1][3] == size and all(x[3] == y[2] for x, y in zip(made, made[1:]))
    assert all(a <= c < d <= b and b - a <= limit for a, b, c, d, _, _ in made)
    bounds = [*starts, size]
    assert all(a in {*starts, c} and b in {*bounds, d} and bounds[i] <= c and d <= bounds[j] for a, b, c, d, i, j in made)
    try:
        plain = C.core_ranges(starts, size, limit, overlap)
    except ValueError:
        return
    assert [x[4:] for x in made] == plain
    assert [x[:4] for x in made] == [(bounds[max(0, a - overlap)], bounds[min(len(starts), b + overlap)], bounds[a], bounds[b]) for a, b in plain]


def test_documents_with_oversized_sentences_are_planned_whole(spark):
    lengths = {0: [10] * 8 + [250] + [10] * 8, 1: [30, 60, 30, 5], 2: [10] * 5}
    d = docs(spark, [" ".join(f"w{k}" for k in range(sum(x))) for x in lengths.values()], {i: [sum(x[:k]) for k in range(len(x))] for i, x in lengths.items()})
    s = T.sentences(d)
    plan = C.plan_chunks(s, 100, 2)
    assert C.plan_violations(plan, s.groupBy("doc_id").agg(F.max("end").alias("n_doc_tokens")), 100).count() == 0
    got = {i: [(r["core_start"], r["core_end"], r["global_start"], r["global_end"], r["sentence_start"], r["sentence_end"]) for r in plan.where(F.col("doc_id") == i).orderBy("chunk_index").collect()] for i in lengths}
    assert got[0] == [(0, 80, 0, 80, 0, 8), (80, 163, 70, 163, 8, 9), (163, 246, 163, 246, 8, 9), (246, 330, 246, 340, 8, 9), (330, 410, 330, 410, 9, 17)]
    assert got[1] == [(0, 30, 0, 90, 0, 1), (30, 90, 0, 90, 1, 2), (90, 120, 30, 125, 2, 3), (120, 125, 30, 125, 3, 4)]
    assert got[2] == [(0, 50, 0, 50, 0, 5)]


def test_contexts(spark):
    d = docs(spark, ["Ann sat down. Then she took her hat , and left. End."], {0: [0, 3, 11]})
    mentions = spark.createDataFrame([(0, 1, 4, 5, "she", "Ann"), (0, 2, 6, 7, "her", "Ann"), (0, 3, 2, 4, "down. Then", "Ann")], "doc_id bigint, mention_id bigint, start bigint, end bigint, text string, subject string")
    got = {r["mention_id"]: r for r in M.mention_contexts(mentions, T.tokenize(d), T.sentences(d), mark=True).collect()}
    assert set(got) == {1, 2}
    assert got[1]["context_text"] == "Then [[she]] took her hat, and left." and got[1]["rendered_context_text"] == "Then Ann took her hat, and left."
    assert got[2]["rendered_context_text"] == "Then she took Ann's hat, and left." and got[2]["mention_render_was_changed"]


def test_zones_and_samples(spark, rows):
    z = spark.createDataFrame([(0, 2), (8, 12), (2, 4), (12, 14), (1, 3)], "s int, e int").select(M.zone_of(F.col("s"), F.col("e"), F.lit(2), F.lit(10)))
    assert [r[0] for r in z.collect()] == ["left_overlap", "cross_zone", "core", "right_overlap", "cross_zone"]
    m = spark.createDataFrame([(1, c, i) for c in range(3) for i in range(10 * c, 10 * c + 4 + c)], "doc_id bigint, cluster_id bigint, mention_id bigint")
    a = rows(M.sample_mentions(m, 3, 5, group=("doc_id",)).select("cluster_id", "mention_id"))
    assert a == rows(M.sample_mentions(m.repartition(7), 3, 5, group=("doc_id",)).select("cluster_id", "mention_id")) and len(a) == 9
    t = rows(M.sample_mentions_twister(m, 2, 5))
    assert t == rows(M.sample_mentions_twister(m.repartition(3), 2, 5)) and len(t) == 6


def test_components_match_search(spark):
    r = random.Random(1)
    edges = [(d, f"v{r.randint(0, 60):02}", f"v{r.randint(0, 60):02}") for d in (1, 2) for _ in range(45)] + [(3, f"c{i:03}", f"c{i + 1:03}") for i in range(80)]
    got = {(x["doc_id"], x["v"]): x["root"] for x in K.components(spark.createDataFrame(edges, "doc_id bigint, a string, b string")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for d, a, b in edges:
        x, y = sorted((find((d, a)), find((d, b))))
        parent[y] = x
    assert got == {k: find(k)[1] for k in list(parent)}


def mention(uid, name, start, text, zone="core", chunk=0):
    return (1, uid, name, start, start + len(text.split()), text, zone, chunk)


SCHEMA = "doc_id bigint, uid string, name string, start bigint, end bigint, text string, zone string, chunk_index bigint"


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["uid"])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("strategy", ["greedy", "components"])
def test_resolution_sieves_and_vetoes(spark, strategy):
    rows = [
        mention("a", "Dorothy", 10, "Dorothy", "right_overlap", 0), mention("b", "Dorothy", 10, "Dorothy", "left_overlap", 1),  # stitched
        mention("c", "Toto", 50, "Toto", "core", 1), mention("d", "Toto", 90, "Toto", "core", 2),  # equal single anchor
        mention("e", "the old witch", 120, "the old witch", "core", 2), mention("f", "the witch", 140, "the witch", "core", 3),  # head alias
        mention("g", "the man", 150, "the man", "core", 3), mention("h", "a man", 160, "a man", "core", 4),  # generic head: apart
        mention("i", None, 170, "he", "core", 4),
    ]
    got = groups(R.resolve(spark.createDataFrame(rows, SCHEMA), strategy))
    assert got == [["a", "b"], ["c", "d"], ["e", "f"], ["g"], ["h"], ["i"]]
    assert R.resolve(spark.createDataFrame([], SCHEMA), strategy).count() == 0


def test_veto_keeps_rivals_apart(spark):
    rows = [mention(u, n, s, t) for u, n in (("a", "Lord Canterville"), ("b", "Mrs Otis")) for s, t in ((5, "the family"), (9, "the house"))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert groups(R.resolve(df)) == [["a"], ["b"]]
    assert groups(R.resolve(df, veto=False)) == [["a", "b"]]


def test_pairs_of_the_sieves(spark, rows):
    data = [mention("a", "Ann", 1, "Ann", "right_overlap", 0), mention("a", "Ann", 4, "the hall", "right_overlap", 0), mention("b", "Eve", 1, "Ann", "left_overlap", 1), mention("b", "Eve", 4, "the hall", "left_overlap", 1), mention("c", "Ann", 1, "Ann", "left_overlap", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(R.stitching_edges(df)) == [(1, "a", "c", 1)]
    assert rows(R.adjacent_overlap_edges(df)) == [(1, "a", "b", 2, 1.0)]
    assert rows(R.coefficient_edges(df)) == [(1, "a", "b", 2, 1.0)]
    assert rows(R.anchor_classes(df).select("uid", "anchor", "n_linked")) == [("a", "ann", 1), ("c", "ann", 1)]


def test_anchor_filter(spark, golden):
    anchors = spark.createDataFrame([("lord canterville", "Lord Canterville", 40), ("mr otis", "Mr. Otis", 30), ("ghost", "the ghost", 30)], "anchor_key string, display_name string, n_mentions bigint")
    mentions = spark.createDataFrame([(1, "Lady Canterville", "Lady Canterville"), (2, "he", "Mr. Otis"), (3, "Mr. Otis", "Mr. Otis"), (4, "the family ghost", "Virginia"), (5, None, None), (6, "", "x")], "i int, mention_text string, cluster_canonical_name string")
    kept, dropped = A.filter_mentions(mentions, anchors)
    assert {r["i"]: (r["matched_anchor_key"], r["match_method"], round(r["match_score"], 4)) for r in dropped.collect()} == {1: ("lord canterville", "fuzzy", 0.875), 4: ("ghost", "token_subset", 0.5)}
    assert sorted(r["i"] for r in kept.collect()) == [2, 3, 5, 6]
    assert A.filter_mentions(mentions, anchors.limit(0))[0].count() == 6
