"""Merging of blocks against a plain loop over all pairs, and exports of what it makes."""

import random
import time

import pytest

from loomgraph.operators import exports as E
from loomgraph.operators import resolution as R


def plain_merge(groups, veto):
    """The greedy definition as it reads: judge every pair, merge the strongest, begin again."""
    for sieve in range(5):
        while True:
            best = None
            for x in groups:
                for y in groups:
                    if groups[x].order() < groups[y].order() and R._block_keys(sieve, groups[x]) & R._block_keys(sieve, groups[y]):
                        s = R._allowed(sieve, groups[x], groups[y], veto)
                        if s:
                            best = min(best or (1, ), (-s[0], -s[1], -s[2], groups[x].order(), groups[y].order(), x, y)) if best else (-s[0], -s[1], -s[2], groups[x].order(), groups[y].order(), x, y)
            if not best:
                break
            *_, x, y = best
            groups[x].absorb(groups.pop(y))
    return groups


def plain_components(groups, veto):
    for sieve in range(5):
        while True:
            parent = {u: u for u in groups}
            find = lambda u: u if parent[u] == u else find(parent[u])  # noqa: E731, B023
            for x in groups:
                for y in groups:
                    if groups[x].order() < groups[y].order() and R._block_keys(sieve, groups[x]) & R._block_keys(sieve, groups[y]) and R._allowed(sieve, groups[x], groups[y], veto):
                        a, b = sorted((find(x), find(y)), key=lambda u: groups[u].order())
                        parent[b] = a
            merged = [u for u in sorted(groups, key=lambda u: groups[u].order()) if find(u) != u]
            if not merged:
                break
            homes = {u: find(u) for u in merged}
            for u in merged:
                groups[homes[u]].absorb(groups[u])
            for u in merged:
                del groups[u]
    return groups


NAMES = ["King Arlo", "old King Arlo", "the young king", "Queen Bera", "Bera", "Captain Hale", "Hale", "the captain", "Doctor Hale", "the man", "he", None, "Arlo", "the old king", "King Osric"]
TEXTS = ["he", "the king", "Arlo", "the captain", "Bera", "the man", "old Arlo", "Hale"]


def block(r, n):
    rows = []
    for k in range(n):
        name, chunk = r.choice(NAMES), r.randint(0, 3)
        for _ in range(r.randint(1, 4)):
            start = r.randint(0, 12)
            rows.append((1, "b", chunk, start, start + 2, f"u{k:03}", name, r.choice(TEXTS), r.choice(("core", "left_overlap", "right_overlap"))))
    return sorted(rows, key=lambda x: x[2:6])


@pytest.mark.parametrize("veto", [True, False])
def test_merging_matches_its_definition(veto, monkeypatch):
    made = {}

    def run(rows, how):
        def merge(groups, strategy, v):
            return how(groups, v)

        monkeypatch.setattr(R, "merge_block", merge)
        out = sorted(R._run_block(rows, "greedy", veto))
        monkeypatch.undo()
        return out

    for seed in range(40):
        rows = block(random.Random(seed), 14)
        assert sorted(R._run_block(rows, "greedy", veto)) == run(rows, plain_merge), seed
        assert sorted(R._run_block(rows, "components", veto)) == run(rows, plain_components), seed
    assert not made


def test_a_block_of_ten_thousand_clusters_of_one_name():
    rows = [(1, "b", k // 50, k, k + 1, f"u{k:05}", "King Arlo" if k % 3 else "old King Arlo", "the king", "core") for k in range(10_000)]
    began = time.time()
    out = R._run_block(rows, "greedy", True)
    assert len({c for _, _, c in out}) == 1 and len(out) == 10_000 and time.time() - began < 60


def test_kernel_agrees_with_the_columns(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions import text as X

    texts = [t for t in [*NAMES, *TEXTS, "", " The  Ladies ", "A man's cities", "Somebody", "ÉLAN vital", "the others", "classes", "x y z"] if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.entity_phrase("t").alias("phrase"), X.head_word("t").alias("head"), X.is_generic_nominal("t").alias("generic"), X.is_relevant_mention("t").alias("relevant"), X.is_proper_name("t").alias("proper"), F.array_sort(X.token_set("t")).alias("words"))
    for r in df.collect():
        p = R.Phrase(r["t"])
        assert (p.phrase, p.head, p.generic, p.relevant, p.proper, sorted(p.set)) == (r["phrase"], r["head"], r["generic"], r["relevant"], r["proper"], r["words"]), r["t"]


def test_merge_in_one_call_and_from_files(spark, tmp_path):
    clusters = spark.createDataFrame([("c0::a", "King Arlo"), ("c1::a", "King Arlo"), ("c1::b", "Queen Bera")], "local_cluster_uid string, canonical_name string")
    mention = lambda uid, k, chunk, start, text, zone: (f"{uid}::m{k}", uid, f"c{chunk}", chunk, 0, k, start, start + 2, start, start + 2, text, None, None, zone, "")
    mentions = spark.createDataFrame([mention("c0::a", 0, 0, 3, "King Arlo", "core"), mention("c0::a", 1, 0, 9, "the king", "right_overlap"), mention("c1::a", 0, 1, 9, "the king", "left_overlap"), mention("c1::b", 0, 1, 20, "Bera", "core")], E.MENTION_CSV)
    from loomgraph.sources import files as FS

    FS.write_csv(clusters, str(tmp_path / "clusters"))
    FS.write_csv(mentions, str(tmp_path / "mentions"))
    made = E.merge_from_csv(spark, str(tmp_path / "clusters"), str(tmp_path / "mentions"), doc_id=7, percentile=0.5, least_kept=None)
    kept = made["clusters"].collect()
    assert [(r["global_cluster_uid"], r["n_local_clusters"], r["n_mentions"], r["canonical_name"], r["local_cluster_uids"]) for r in kept] == [("global_cluster_000000", 2, 3, "King Arlo", "c0::a|c1::a")]
    lost = made["rejected"].collect()
    assert [(r["rejected_global_cluster_uid"], r["would_be_global_cluster_uid"], r["rejection_reason"]) for r in lost] == [("rejected_global_cluster_000000", "global_cluster_000001", E.REASON)]
    assert made["mentions"].count() == 3
    E.export_resolution(made, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "global_mentions")).columns == ["doc_id", *E.MENTION_COLUMNS]
    assert E.non_singletons(made["clusters"]).count() == 1
    counts = E.local_table_counts(clusters.selectExpr("7L as doc_id", "*"), mentions.selectExpr("7L as doc_id", "*"), mentions.selectExpr("7L as doc_id", "chunk_id")).first()
    assert tuple(counts) == (7, 2, 3, 4, 2, 2)
