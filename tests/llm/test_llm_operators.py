import json
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import canonical, contamination, cutoff, dedup, grouping, mixture, pii, pii_training, sampling, splitting

# 1. Groups


def truth_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in edges:
        x, y = sorted((find((s, a)), find((s, b))))
        parent[y] = x
    return {(s, v): find((s, v))[1] for s, v in list(parent)}


def test_groups_match_union_find(spark):
    r = random.Random(4)
    edges = [(s, f"u{r.randint(0, 90):02}", f"u{r.randint(0, 90):02}") for s in (1, 2) for _ in range(60)]
    edges += [(3, f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [(4, "hub", f"s{i}") for i in range(200)] + [(5, "alone", "alone"), (1, "u00", "u00")]
    frame = spark.createDataFrame(edges, "scope bigint, a string, b string")
    for made in (grouping.link_groups(frame), grouping.link_groups(frame, piece_links=25), grouping.link_groups_distributed(frame)):
        assert {(x["scope"], x["member"]): x["group"] for x in made.collect()} == truth_groups(edges)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60), st.sampled_from([0.05, 0.5, 3.0]))
def test_decomposition_of_arrays(pairs, beta):
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    got = grouping.decompose(a, b, 41, beta)
    want = truth_groups([(0, x, y) for x, y in pairs])
    same = lambda x, y: want.get((0, x), x) == want.get((0, y), y)
    assert all((got[x] == got[y]) == same(x, y) for x in range(41) for y in range(41))


def test_scopes_in_one_go_and_in_many(spark, monkeypatch):
    r = random.Random(3)
    edges = [(f"s{r.randint(0, 12)}", r.choice("äzßB") + str(r.randint(0, 30)), r.choice("äzßB") + str(r.randint(0, 30))) for _ in range(400)] + [(None, "a", "b")]
    frame = spark.createDataFrame([e for e in edges if e[0]], "scope string, a string, b string").repartition(3)
    want = truth_groups([e for e in edges if e[0]])
    for pieces in (7, 10_000):
        assert {(x["scope"], x["member"]): x["group"] for x in grouping.link_groups(frame, piece_links=pieces).collect()} == want


def test_groups_of_dirty_pairs_and_lists(spark):
    pairs = spark.createDataFrame([(1, " a ", "b", 9), (1, None, "c", 9), (1, "", "d", 9), (1, "e", "e", 9), (None, "x", "y", 9), (2, "b", "a", 9), (1, "b", "a\t", 9)], "doc_id bigint, left_component_uid string, right_component_uid string, scope int")
    lists = spark.createDataFrame([(1, " b|f|| f "), (1, None), (1, " | "), (2, "z")], "doc_id bigint, local_cluster_uids string")
    edges = grouping.edges_of_pairs(pairs).union(grouping.edges_of_lists(lists))
    got = {(x["scope"], x["member"]): x["group"] for x in grouping.link_groups(edges).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "f"): "a", (1, "e"): "e", (2, "a"): "a", (2, "b"): "a", (2, "z"): "z"}
    assert grouping.link_groups(edges.limit(0)).count() == 0


def test_groups_with_hot_vertices_cut_into_parts(spark):
    edges = [(1, "hub", f"s{i:03}") for i in range(300)] + [(1, f"s{i:03}", f"t{i:03}") for i in range(0, 300, 3)] + [(2, f"c{i}", f"c{i + 1}") for i in range(40)] + [(1, "hub", "other"), (1, "other", "z")]
    got = {(x["scope"], x["member"]): x["group"] for x in grouping.link_groups_distributed(spark.createDataFrame(edges, "scope bigint, a string, b string"), max_degree=20).collect()}
    assert got == truth_groups(edges)


def test_no_hub_keeps_more_links_than_allowed(spark):
    live = spark.createDataFrame([(1, f"s{i:03}", "the hub", 0) if i % 2 else (1, "a hub", f"s{i:03}", 0) for i in range(400)], "scope bigint, a string, b string, level int")
    cut = grouping.split_hubs(live, 50)
    degrees = Counter(v for r in cut.collect() for v in (r["a"], r["b"]))
    assert max(degrees.values()) < 80 and degrees["the hub"] == 4 and cut.count() == 408


# 2. Splitting


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(60, 120))
def test_pieces_hold_their_limits(lengths, limit):
    starts = [sum(lengths[:i]) for i in range(len(lengths))]
    size = sum(lengths)
    pieces = splitting.split_item(0, size, starts, starts[::5], [], limit, 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == size and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    for a, b, left, right, aligned in pieces:
        assert left <= a < b <= right and right - left <= limit and a in starts and aligned
        assert left in starts and (right in starts or right == size)


def test_long_sentence_is_cut_at_clauses():
    pieces = splitting.split_item(0, 700, [0], [], [180, 350, 520], 300, 2)
    assert [p[0] for p in pieces] == [0, 180, 350, 520] or all(b - a <= 300 for a, b, *_ in pieces)
    assert splitting.split_item(0, 700, [0], [], [], 300, 2)[-1][1] == 700
    assert splitting.split_item(5, 5, [], [], [], 300, 2) == [] and splitting.split_item(0, 300, [], [], [], 300, 2) == [(0, 300, 0, 300, True)]


def _sentences(lengths):
    bounds = [0]
    for n in lengths:
        bounds.append(bounds[-1] + n)
    return bounds


def test_one_oversized_sentence_costs_no_other_piece_its_overlap():
    bounds = _sentences([20] * 60 + [450] + [20] * 60)
    starts, size, long = bounds[:-1], bounds[-1], (1200, 1650)
    pieces = splitting.split_item(0, size, starts, [], list(range(1210, 1650, 10)), 300, 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == size and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    assert all(right - left <= 300 for _, _, left, right, _ in pieces)
    for a, b, left, right, aligned in pieces:
        assert aligned == (a in starts) and (aligned or long[0] < a < long[1] and a % 10 == 0)
        if a <= long[0]:
            assert left == max(0, a - 40)
        if a == long[1]:
            assert left == a
        if b <= long[0] - 40 or b >= long[1]:
            assert right == min(size, b + 40)
    assert {1200, 1650} <= {p[0] for p in pieces}


def test_overlap_is_as_large_as_fits():
    pieces = splitting.split_item(0, 1000, list(range(0, 1000, 100)), [], [], 300, 2)
    assert len(pieces) == 10 and all(right - left == 300 for _, _, left, right, _ in pieces)
    bounds = _sentences([310, 50, 50, 50, 310])
    pieces = splitting.split_item(0, bounds[-1], bounds[:-1], [], [], 300, 2)
    assert [p[4] for p in pieces] == [True, False, True, True, False]
    assert pieces[1][3] == 410 and pieces[3][2] == 360 and pieces[2][:4] == (310, 460, 310, 460)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=40), st.integers(60, 120))
def test_cores_leave_sentence_starts_only_inside_oversized_sentences(lengths, limit):
    bounds = _sentences(lengths)
    pieces = splitting.split_item(0, bounds[-1], bounds[:-1], [], [], limit, 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == bounds[-1] and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    for a, b, left, right, aligned in pieces:
        assert left <= a < b <= right and right - left <= limit and left in {*bounds, a} and right in {*bounds, b}
        assert aligned or any(s < a < e and e - s > limit for s, e in zip(bounds, bounds[1:]))


def test_split_tables(spark):
    words = " ".join(f"w{i}." if i % 10 == 9 else f"w{i}" for i in range(900))
    docs = spark.createDataFrame([(1, words, list(range(0, 900, 10)), "x"), (2, None, None, "x"), (3, " ", [], "x"), (4, "a b", [0], "x")], "doc_id bigint, text string, sentence_starts array<bigint>, chunk_id string")
    chunks = spark.createDataFrame([(1, "c0", 0, 301, 5), (1, "c0", 0, 301, None), (1, "c1", 100, 400, 9), (9, "c2", 0, 900, 1), (1, None, 0, 900, 1), (1, "c3", None, 5, 1)], "doc_id bigint, chunk_id string, global_start bigint, global_end bigint, n_tokens bigint")
    got = {(r["doc_id"], r["chunk_id"]): r["pieces"] for r in splitting.split_chunks(chunks, docs).collect()}
    assert set(got) == {(1, "c0"), (9, "c2")} and len(got[1, "c0"]) == 2 and got[1, "c0"][1]["core_start"] % 10 == 0
    assert got[1, "c0"][1]["left_overlap_start"] == got[1, "c0"][1]["core_start"] - 20
    whole = splitting.split_documents(docs).collect()
    assert [r["doc_id"] for r in whole] == [1] and whole[0]["pieces"][-1]["core_end"] == 900
    assert splitting.split_chunks(chunks.limit(0), docs).count() == 0 and splitting.split_documents(docs.limit(0)).count() == 0


# 3. Sampling


def test_sample_is_stable(spark, tmp_path):
    ids = spark.range(3000).select(F.col("id").alias("mention_id"), (F.col("id") % 7).alias("cluster_id"))
    early = ids.where("mention_id < 1500")
    s = sampling.PermanentNumbers(spark, str(tmp_path / "n"))
    s.ingest(early, 0, ("cluster_id",))
    first = {r["mention_id"] for r in s.sample(0.1).collect()}
    s.ingest(early.repartition(9), 0, ("cluster_id",))  # the batch again after a failure
    s.ingest(ids.union(ids), 1, ("cluster_id",))
    second = {r["mention_id"] for r in s.sample(0.1).collect()}
    assert first < second and s.numbers().count() == 3000 and 220 < len(second) < 380
    again = sampling.PermanentNumbers(spark, str(tmp_path / "n"))  # the store outlives its opener
    again.ingest(ids.repartition(5))
    assert {r["mention_id"] for r in again.sample(0.1).collect()} == second
    assert second < {r["mention_id"] for r in s.sample(0.2).collect()}
    with pytest.raises(ValueError, match="may not fall"):
        s.sample(0.1)
    empty = sampling.PermanentNumbers(spark, str(tmp_path / "e"))
    empty.ingest(ids.limit(0), 0)
    assert empty.sample(0.5).count() == 0


def test_the_same_batches_give_the_same_sample_and_others_do_not(spark, tmp_path):
    ids = spark.range(2000).select(F.col("id").alias("mention_id"))
    chosen = []
    for k, batches in enumerate(([ids.where("mention_id < 900"), ids], [ids.where("mention_id < 900").repartition(7), ids.repartition(3)], [ids])):
        store = sampling.PermanentNumbers(spark, str(tmp_path / str(k)))
        for b, rows in enumerate(batches):
            store.ingest(rows, b)
        chosen.append({r["mention_id"] for r in store.sample(0.2).collect()})
    assert chosen[0] == chosen[1] != chosen[2]  # the numbers cannot be made up without the store


def test_a_lost_store_and_another_seed_are_noticed(spark, tmp_path):
    import shutil

    ids = spark.range(50).select(F.col("id").alias("mention_id"))
    path = tmp_path / "n"
    store = sampling.PermanentNumbers(spark, str(path))
    store.ingest(ids.limit(20), 0)
    with pytest.raises(ValueError, match="was made with"):
        sampling.PermanentNumbers(spark, str(path), seed="sample-2")
    with pytest.raises(ValueError, match="comes before"):
        sampling.PermanentNumbers(spark, str(tmp_path / "gone")).ingest(ids, 1)
    with pytest.raises(ValueError, match="taken in nothing"):
        sampling.PermanentNumbers(spark, str(tmp_path / "new")).sample(0.1)
    shutil.rmtree(path / "numbers" / "batch=0")
    with pytest.raises(ValueError, match="are lost"):
        sampling.PermanentNumbers(spark, str(path)).ingest(ids, 1)
    (path / "store.json").unlink()
    with pytest.raises(ValueError, match="not the seed"):
        sampling.PermanentNumbers(spark, str(path))


def test_a_batch_broken_off_is_drawn_again(spark, tmp_path):
    ids = spark.range(300).select(F.col("id").alias("mention_id"))
    store = sampling.PermanentNumbers(spark, str(tmp_path / "n"))
    store.ingest(ids.where("mention_id < 100"), 0)
    ids.select("mention_id", F.lit(0.0).alias("number")).write.parquet(str(tmp_path / "n" / "numbers" / "batch=1"))  # written, but never marked
    assert sampling.PermanentNumbers(spark, str(tmp_path / "n")).numbers().count() == 100
    store.ingest(ids, 1)
    assert store.numbers().count() == 300 and store.numbers().where("number = 0").count() == 0


# 4. Canonical names

ENTRIES = [("old creshquist", "Old Creshquist"), ("young creshquist", "Young Creshquist"), ("mapmaker of yarondbry", "the Mapmaker of Yarondbry"), ("silgalvask", "Silgalvask"), ("moromdell spindle", "Moromdell's Spindle"), ("saint ushachdell", "Saint Ushachdell"), ("griomvumurne", "Griomvumurne")]


@pytest.mark.parametrize(("text", "key"), [
    ("Old Creshquist", "old creshquist"), ("creshquist, YOUNG", "young creshquist"), ("Creshquist", "(none)"), ("Captain Creshquist", "(none)"), ("the mapmaker", "(none)"), ("YARONDBRY", "mapmaker of yarondbry"), ("poor Sil-galvask", "silgalvask"),
    ("Silgalvsak’s", "silgalvask"), ("st. Ushachdell", "saint ushachdell"), ("Üshachdell", "saint ushachdell"), ("a spindle", "(none)"), ("Moromdell's-Spindle again", "moromdell spindle"), ("Griomvumume", "griomvumurne"), ("Somebody Else", "(none)"), ("", "(none)"), (None, "(none)"), ("?!", "(none)"),
    ("Saint", "(none)"), ("Yuong Creshquist", "young creshquist"), ("the_silgalvask_of the tale", "silgalvask"),
])
def test_mentions_find_their_entry(text, key):
    assert canonical.Matcher(ENTRIES).match(text)[0] == key


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_within_one_edit(a, b):
    forms = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2:] for i in range(len(a) - 1)} | {a}
    assert canonical.within_one_edit(a, b) == (b in forms)


def test_map_mentions_table(spark):
    mentions = spark.createDataFrame([(1, "Silgalvask", "x"), (1, "Silgalvask", "x"), (2, None, "x"), (3, "nobody", "x"), (None, "Silgalvask", "x")], "row_index bigint, mention_text string, anchor_key string")
    entries = spark.createDataFrame([*ENTRIES, (None, "Nobody")], "anchor_key string, display_name string")
    assert {r["row_index"]: r["anchor_key"] for r in canonical.map_mentions(mentions, entries).collect()} == {1: "silgalvask", 2: "(none)", 3: "(none)"}
    assert {r["anchor_key"] for r in canonical.map_mentions(mentions, entries.limit(0)).collect()} == {"(none)"}
    with pytest.raises(ValueError, match="more than 3"):
        canonical.map_mentions(mentions, entries, max_entries=3)


# 5. Duplicates


def test_copies_over_partition_edges(spark):
    r = random.Random(8)
    rows = [(1, 1, i, "A hot, line!" if i % 3 == 0 else f"text {r.randint(0, 40)}", "x") for i in range(900)]
    rows += [(1, 1, i, "a HOT line", "x") for i in range(0, 90, 3)] + [(1, 1, None, "text 1", "x"), (1, 1, 5000, None, "x"), (2, 1, 6000, "a hot line", "x"), (1, 1, 7000, "…", "x"), (1, 1, 7001, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, cluster_id bigint, mention_id bigint, context_text string, key string")
    groups = {}
    for d, c, i, t, _ in rows:
        if i is not None and t is not None:
            groups.setdefault((d, c, re.sub(r"[^a-z0-9]", "", t.lower())), set()).add(i)
    copies = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    for parts in (1, 7, 64):
        assert {(x["first_id"], x["copy_id"]) for x in dedup.copies(dedup.mention_keys(df), parts).collect()} == copies
        assert {x["first_id"]: x["n_copies"] for x in dedup.collapsed(dedup.mention_keys(df), parts).collect()} == {min(g): len(g) for g in groups.values()}
    assert dedup.copies(dedup.mention_keys(df.limit(0)), 3).count() == 0


def test_groups_that_share_an_identifier_do_not_depend_on_partitions(spark):
    rows = [("t", "a", i) for i in (1, 2, 3, 4)] + [("t", "b", i) for i in (1, 5, 6)] + [("t", "c", 1)] + [("u", "a", 1), ("u", "a", 1)] + [("t", "a", 2)]
    keyed = spark.createDataFrame(rows, "found_in string, key string, id bigint")
    for parts in (1, 2, 3, 7, 50):
        assert sorted(map(tuple, dedup.collapsed(keyed, parts).collect())) == [("t", 1, 1), ("t", 1, 3), ("t", 1, 4), ("u", 1, 1)]
        assert sorted(map(tuple, dedup.copies(keyed, parts).collect())) == [("t", 1, 2), ("t", 1, 3), ("t", 1, 4), ("t", 1, 5), ("t", 1, 6)]


def test_lines_in_both_layouts(spark):
    lines = ['{"a": "X y", "n": 12}', ' {"n": "12", "a": "x Y!"} ', "n=12\ta=x  y", "a=x y", "a=x y\tn=13", "", "plain", None, '{"a": null, "n": 12}', "a=\tn= 12 ", "a=x=y\tn=12", '{"a":"x=y","n":12.0}']
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(lines)], "line_id bigint, line_text string, shard string")
    assert {(r["first_id"], r["copy_id"]) for r in dedup.copies(dedup.line_keys(df), 3).collect()} == {(0, 1), (0, 2), (0, 10), (8, 9)}


# 6. Cutoffs


def test_cutoffs_against_sorting(spark):
    r = random.Random(2)
    scores = {g: [r.choice((1, 1, 1, 2, 3, r.randint(1, 10 ** r.randint(1, 7)), -r.randint(0, 50))) for _ in range(r.randint(1, 120))] for g in range(25)}
    keeps = {g: r.randint(0, 100) for g in scores}
    df = spark.createDataFrame([(g, x, "k") for g, xs in scores.items() for x in xs] + [(3, None, "k"), (None, 4, "k")], "doc_id bigint, n bigint, keep string")
    keep = spark.createDataFrame(list(keeps.items()), "doc_id bigint, keep bigint")
    got = {x["doc_id"]: (x["cutoff"], x["n_kept"], x["n_all"]) for x in cutoff.cutoffs(df, keep, "doc_id", "n").collect()}
    want = {}
    for g, xs in scores.items():
        c = max(x for x in xs if 100 * sum(y >= x for y in xs) >= keeps[g] * len(xs))
        want[g] = (c, sum(y >= c for y in xs), len(xs))
    assert got == want
    assert cutoff.cutoffs(df.limit(0), keep, "doc_id", "n").count() == 0


def test_cutoffs_of_fractions_shares_with_decimals_and_odd_values(spark):
    df = spark.createDataFrame([("a", x) for x in (0.1, 0.2, 0.3, 0.9, float("nan"), None)] + [("b", x) for x in (5.0, 5.0, 5.0, -1.0)] + [("c", 1.5)] + [("d", 2.5)], "g string, x double")
    keep = spark.createDataFrame([("a", 50.0), ("b", 80.5), ("c", 0.0), ("d", 100.5)], "g string, keep double")
    got = {r["g"]: (r["cutoff"], r["n_kept"], r["n_all"]) for r in cutoff.cutoffs(df, keep, "g", "x").collect()}
    assert got == {"a": (0.3, 2, 4), "b": (-1.0, 4, 4), "c": (1.5, 1, 1)}


def test_a_narrow_range_sorts_a_small_share(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.lit(1_000_000) + F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("x"))
    keep = spark.createDataFrame([(1, 37)], "g int, keep bigint")
    bounds = cutoff.brackets(df, keep)
    inside = cutoff.bracketed(df, bounds).where("x is not null").agg(F.sum("n")).first()[0]
    assert 0 < inside < 0.03 * n
    got = cutoff.cutoffs(df, keep, "g", "x").first()
    xs = sorted((r[0] for r in df.select("x").collect()), reverse=True)
    c = xs[37 * n // 100 - 1]
    assert (got["cutoff"], got["n_kept"]) == (c, sum(x >= c for x in xs))


def test_a_bracket_that_misses_is_sorted_whole(spark, monkeypatch):
    whole = cutoff.brackets
    monkeypatch.setattr(cutoff, "brackets", lambda u, k: whole(u, k).withColumn("lo", F.lit(90.0)).withColumn("hi", F.lit(95.0)))
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    got = sorted(map(tuple, cutoff.cutoffs(df, spark.createDataFrame([(0, 50), (1, 50)], "g bigint, keep bigint"), "g", "x").collect()))
    assert got == [(0, 50, 25, 50), (1, 51, 25, 50)]


# 8. Contamination


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_index(values):
    s = np.array([*values, 0], np.int64)
    order = contamination.suffix_array(s)
    assert list(order) == sorted(range(len(s)), key=lambda i: list(s[i:]))
    index = contamination.FMIndex(s, sample=4)
    phrase = np.array([[1, 2], [2, 1], [3, 3], [4, 1]], np.int64)
    low, high = index.search(np.minimum(phrase, int(s.max()) if len(values) else 0)) if len(values) and s.max() >= 4 else (None, None)
    if low is not None:
        for p, a, b in zip(phrase, low, high):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(s) - 1) if list(s[i:i + 2]) == list(p)]


def test_leaks_despite_dress(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen café naïve end"
    w = item.split()
    texts = {
        1: "Intro. " + item.upper() + " outro", 2: " ".join(w[2:14]) + ".", 3: " ".join(w[2:13]), 4: " ".join([*w[:6], "EXTRA", *w[6:]]), 5: item.replace("three", "thr-\nee").replace("seven", "se­ven​"),
        6: unicodedata.normalize("NFD", item), 7: None, 8: "", 9: item + " " + item, 10: "—".join(w), 11: " ".join(f"x{i}" for i in range(5000)) + " " + " ".join(w[:12]),
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item)], "item_id bigint, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.leaked_documents(docs, items).collect()}
    # the item has 16 words, so document 4 holds runs of 6 and 10 only
    assert got == {(i, 7) for i in (1, 2, 5, 6, 9, 10, 11)}
    spans = [r for r in contamination.leaked_spans(docs.where("doc_id = 9"), items).collect()]
    assert sorted((r["first_word"], r["n_words"], r["item_word"]) for r in spans) == [(0, 16, 0), (16, 16, 0)]
    assert contamination.leaked_documents(docs.limit(0), items).count() == 0 and contamination.leaked_documents(docs, items.limit(0)).count() == 0
    assert contamination.leaked_documents(docs.repartition(5), items).count() == 7


def test_places_of_words_in_the_text_as_written():
    for text in ("One two-\n three", "caf\u00e9 nai\u0308ve \u200bword\u00adend \ufb01ne \u212bngstr\u00f6m", "plain A1 b_c", "STRASSE stra\u00dfe", "\u1100\u1161\u11a8 x", ""):
        places = contamination.word_places(text)
        assert [w for w, _, _ in places] == contamination.words_of(text)
        assert all(contamination.words_of(text[a:b]) == [w] for w, a, b in places)


def test_removal_spans_are_merged_over_items(spark):
    w = [f"w{i}" for i in range(30)]
    text = "Before: " + " ".join(w[:20]).upper() + "; " + "caf\u00e9 " + ", ".join(w[:15]) + ". After."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(w[:14])), (2, " ".join(w[5:20]))], "item_id bigint, item_text string")
    rows = contamination.removal_spans(docs, items).collect()
    assert sorted((r["doc_id"], text[r["char_start"]:r["char_end"]], r["item_ids"]) for r in rows) == [(1, " ".join(w[:20]).upper(), [1, 2]), (1, ", ".join(w[:14]), [1])]
    assert contamination.without_passages(text, [(r["char_start"], r["char_end"]) for r in rows]) == "Before: ; caf\u00e9 , w14. After."


# 9. Mixing


def test_mixture_reaches_its_shares(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(("red", "green", "blue")) for _ in range(r.randint(1, 60))), r.choice(("Big ", "big", "BIG")) if i % 10 else r.choice(("small-one", "small_one"))) for i in range(6000)]
    docs = spark.createDataFrame([*rows, (9001, None, "big"), (9002, " ", "big"), (9003, "x", None), (9004, "y", "unlisted")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.5, 3), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixture.Mixture(docs, targets)
    chosen = mix.selection().collect()
    assert max(x["copies"] for x in chosen if x["source"] == "small_one") == 3 and {x["source"] for x in chosen} == {"big", "small_one"}
    shares = {x["source"]: x for x in mix.shares().collect()}
    assert abs(shares["big"]["actual_share"] - 0.5) < 0.002 and shares["missing"]["tokens_used"] == 0
    again = mixture.Mixture(docs.repartition(11), targets).selection().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))
    assert mixture.Mixture(docs.limit(0), targets).selection().count() == 0


def test_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("red green blue").alias("text"), F.concat(F.lit("s"), F.col("id") % 600).alias("source"))
    targets = spark.range(600).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(1 / 600).alias("target_share"), F.lit(2).alias("max_repeats"))
    shares = mixture.Mixture(docs, targets).shares().collect()
    assert len(shares) == 600 and all(r["tokens_used"] == 2 * r["tokens_held"] for r in shares)


def test_token_counts_sum(spark):
    texts = ["Hello world", "", None, "naïve café 123", "<|endoftext|>"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(mixture.token_counts(F.col("t"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 3 and got[4] > 1


# 10. Personal information


def test_initials_before_a_family_and_long_spanish_streets_without_an_introducing_phrase():
    redactor = pii.Redactor(["Anna"], ["Mehlfeld"], pii_training.trained_weights())
    for text, kind, segment in (
        ("The old ledger was kept by Tobren J. Mehlfeld until noon.", "name", "Tobren J. Mehlfeld"),
        ("Devolver en Calle de la Vieja Fuente 12 o llamar.", "address", "Calle de la Vieja Fuente 12"),
        ("Vive en Avenida del Rey Don Pedro, 7 desde ayer.", "address", "Avenida del Rey Don Pedro, 7"),
    ):
        assert [(text[a:b], k) for a, b, k, _ in redactor.find(text)] == [(segment, kind)]
    assert not pii.candidates("He stayed at home. Mehlfeld came. Mr. Mehlfeld left.", redactor.lexicon)


def test_held_out_notes():
    lexicon, notes = pii_training.training_set(400, 4321)
    model = pii.SemiMarkov(pii_training.trained_weights())
    found = right = true = 0
    for text, truth in notes:
        got = {(a, k) for a, _, k, _ in model.decode(pii.candidates(text, lexicon))}
        want = {(a, k) for a, _, k in truth}
        found, right, true = found + len(got), right + len(got & want), true + len(want)
    assert right / found > 0.97 and right / true > 0.97


def test_decoding_is_exact():
    r = random.Random(9)
    model = pii.SemiMarkov({f"f{i}": r.uniform(-2, 3) for i in range(12)})
    for _ in range(60):
        segments = []
        for _ in range(7):
            a = r.randint(0, 20)
            segments.append((a, a + r.randint(1, 6), "name", [f"f{r.randint(0, 11)}"]))
        best = 0.0
        for mask in range(1 << len(segments)):
            chosen = sorted(s for i, s in enumerate(segments) if mask >> i & 1)
            if all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])):
                best = max(best, sum(model.score(s[3]) for s in chosen))
        got = model.decode(segments)
        assert abs(sum(x[3] for x in got) - best) < 1e-9 and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        total, chance = model.expectations(segments)
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in chance) and total >= best - 1e-9


def test_redaction_changes_nothing_else(spark):
    text = "Signed, Katinka Vandermeer\n\nIn 1916 Weaver Row was flooded. Captain Vandermeer kept it. Write to k.vandermeer at example dot org or ring (020) 7946 0466; card no. QQ 12 34 56 C. ISBN 000-0-1556-2715-6. Please return this volume to Vandermeer, Katinka, 14c Weaver Row."
    docs = spark.createDataFrame([(1, text, "n"), (2, None, "n"), (3, "", "n"), (4, "plain " * 50_000, "n"), (5, text, "n")], "doc_id bigint, text string, name_text string")
    lexicon = spark.createDataFrame([("Katinka", "given", 1), ("Vandermeer", "family", 2), (None, "given", 3)], "name_text string, name_kind string, doc_id int")
    out = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs, lexicon).collect()}
    assert out[1] == "Signed, [NAME]\n\nIn 1916 Weaver Row was flooded. Captain Vandermeer kept it. Write to [EMAIL] or ring [PHONE]; card no. [IDNUM]. ISBN 000-0-1556-2715-6. Please return this volume to [NAME], [ADDRESS]."
    assert out[2] is None and out[3] == "" and out[4] == "plain " * 50_000 and out[5] == out[1]
    found = [r for r in pii.find_pii(docs, lexicon).collect() if r["doc_id"] == 1]
    assert Counter(r["pii_kind"] for r in found) == {"name": 2, "email": 1, "phone": 1, "idnum": 1, "address": 1}
    assert all(text[r["char_start"]:r["char_end"]].strip() for r in found)
    assert pii.find_pii(docs.limit(0), lexicon).count() == 0 and pii.find_pii(docs, lexicon.limit(0)).count() >= 4
    assert json.dumps(sorted(pii.KINDS)) == json.dumps(["address", "email", "idnum", "name", "phone"])
