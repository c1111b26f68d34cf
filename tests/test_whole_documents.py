"""Operators that work on whole documents: the results of those over tokens, and no token table on its way to the driver."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators import chunks as C
from loomgraph.operators import mentions as M
from loomgraph.operators import relations as L
from loomgraph.operators import resolution as R
from loomgraph.operators import tokens as T

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "Ann Lee met Bob. Bob's  friend, Ann Lee, left (Paris).\n\nIn Rome Ann saw X. No Name Here", None, "", "  \n ", "  Éva Nagy walked to New York and Éva Nagy was helped by Old Tom",
    "one", " ".join(f"w{i}" for i in range(57)), "Mary O'Neil asked Jean-Luc Picard. He helped Mary O'Neil not.",
]
STARTS = {0: [0, 4, 4, 10, 99, -1], 4: [5, 2], 6: [3, 40], 7: []}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, STARTS.get(i)) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, sentence_starts array<bigint>")


def sends_tokens(spark, name):
    """Whether a query's plan would send what it makes of documents to the driver, as the optimizer takes documents for as small as their files."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return "BroadcastExchange" in entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_model_cover_sends_no_tokens(spark):
    assert not sends_tokens(spark, "chunk_model_cover")


def test_model_cover_counts_each_token_once(spark, docs, rows):
    table = spark.createDataFrame([(1, [3, 4, 5]), (1, [4, 5, 6]), (1, [9]), (2, [7, 9, 12]), (2, [9, 10]), (3, []), (3, None)], "doc_id bigint, token_ids array<bigint>")
    assert rows(C.input_cover(table).select("doc_id", "n_tokens", "first_token", "last_token")) == [(1, 5, 3, 9), (2, 4, 7, 12)]
    sizes = [(i, len(T.words_of(t)), 0, len(T.words_of(t)) - 1) for i, t in enumerate(TEXTS) if T.words_of(t)]
    assert rows(C.input_cover(C.planned_input(docs, 10, 1)).select("doc_id", "n_tokens", "first_token", "last_token")) == sizes


def test_planned_input_is_that_of_the_plan(spark, docs, rows):
    assert not sends_tokens(spark, "chunk_model_input")
    tokens = T.tokenize(docs, starts="sentence_starts")
    for limit, overlap in ((10, 1), (6, 2), (400, 2)):
        old = C.model_input(C.chunk_tokens(tokens, C.plan_chunks(T.sentences(docs), limit, overlap)), tokens)
        assert rows(C.planned_input(docs, limit, overlap)) == rows(old)


def test_token_counts_of_odd_chunks(spark, docs, rows):
    assert not sends_tokens(spark, "chunk_token_counts")
    spans = [(0, "a", 0, 5, 1, 4), (0, "a", 0, 5, 1, 4), (0, "b", 15, 99, 15, 99), (0, "c", 30, 40, 30, 40), (0, "d", -3, 2, 0, 1), (0, "e", 4, 4, 4, 4), (0, "f", None, 5, 0, 5), (0, "g", 2, 6, None, None), (1, "a", 0, 5, 0, 5), (9, "a", 0, 5, 0, 5), (None, "a", 0, 5, 0, 5), (0, "h", 2, 4, 2, 4), (0, "h", 3, 6, 3, 6)]
    chunks = spark.createDataFrame(spans, "doc_id bigint, chunk_id string, global_start bigint, global_end bigint, core_start bigint, core_end bigint")
    assert rows(C.token_counts(docs, chunks)) == [(0, "a", 5, 3, "Ann"), (0, "b", 3, 3, "No"), (0, "d", 2, 1, "Ann"), (0, "g", 4, 0, "met"), (0, "h", 5, 5, "met")]


def test_span_ranges_of_documents(spark, docs, rows):
    assert not sends_tokens(spark, "tok_span_ranges")
    asked = [(0, 1, 3, 7), (0, 2, 4, 5), (0, 3, 5, 5), (0, 4, 6, 2), (0, 5, 18, 90), (0, 6, None, 3), (0, 7, -4, 2), (0, 7, 8, 9), (4, 1, 0, 1), (4, 2, 0, 3), (3, 1, 0, 5), (1, 1, 0, 5), (9, 1, 0, 5), (0, None, 0, 1)]
    spans = spark.createDataFrame(asked, "doc_id bigint, span_id bigint, start bigint, end bigint")
    got = rows(T.document_span_ranges(docs, spans))
    assert got == rows(T.span_token_ranges(spans.where("start is not null"), T.tokenize(docs))) and len(got) == 6
    assert rows(T.document_span_ranges(docs, spans, True)) == [(*r[:3], r[3] - 1) for r in got]


@pytest.fixture
def recorded(spark, docs):
    """Chunks of the texts with wide overlaps, one of them repeated."""
    plan = C.plan_chunks(T.sentences(docs), 9, 1).select("doc_id", "chunk_id", "chunk_index", "global_start", "global_end", "core_start", "core_end")
    return plan.union(plan.where("doc_id = 0")).union(spark.createDataFrame([(0, "odd", 90, 15, 99, 16, 20), (1, "odd", 0, 0, 5, 0, 5), (9, "odd", 0, 0, 5, 0, 5)], plan.schema))


def test_adjacent_overlaps_send_no_tokens(spark):
    assert not sends_tokens(spark, "er_adjacent_overlap")


def test_only_adjacent_chunks_overlap(spark, rows):
    shared = [(1, "a", 0, "right_overlap"), (1, "b", 1, "left_overlap"), (1, "c", 2, "left_overlap"), (1, "d", 1, "core")]
    df = spark.createDataFrame([(doc, uid, uid, k, k + 1, f"Name{k}", zone, chunk) for doc, uid, chunk, zone in shared for k in (1, 2)] + [(1, "b", "b", 3, 4, "he", "left_overlap", 1)], "doc_id bigint, uid string, name string, start bigint, end bigint, text string, zone string, chunk_index bigint")
    assert rows(R.adjacent_overlap_edges(df)) == [(1, "a", "b", 2, 1.0), (1, "b", "c", 2, 1.0)]


def test_overlap_coefficients_send_no_tokens(spark):
    assert not sends_tokens(spark, "er_overlap_coefficient")


def test_pairs_of_shared_keys(spark, rows):
    data = [(1, "c", 1), (1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "b", 2), (1, "a", 2), (1, "d", 3), (2, "a", 1), (None, "a", 1), (None, "b", 1)]
    df = spark.createDataFrame([(doc, uid, "N", k, k + 1, f"Name{k}", "core", 0) for doc, uid, k in data], "doc_id bigint, uid string, name string, start bigint, end bigint, text string, zone string, chunk_index bigint")
    assert rows(R.shared_key_pairs(R.mention_evidence(df), "relevant")) == [(1, "a", "b", 2), (1, "a", "c", 1), (1, "b", "c", 1)]
    assert rows(R.coefficient_edges(df)) == [(1, "a", "b", 2, 1.0)]


def test_stitching_sends_no_tokens(spark):
    assert not sends_tokens(spark, "er_stitching")


def test_recorded_names_are_those_of_the_tokens(spark, docs, recorded, rows):
    assert not sends_tokens(spark, "name_mentions_recorded")
    got = M.recorded_name_mentions(docs, recorded)
    once = recorded.dropDuplicates(["doc_id", "chunk_id"])
    old = M.local_mention_rows(M.name_mentions(C.chunk_tokens(T.tokenize(docs), once)), once)
    assert rows(got.select(old.columns)) == rows(old) and old.count() > 10
    names = {r["local_cluster_uid"]: r["name"] for r in got.where("doc_id = 0").collect()}
    assert names == {r[0]: r[1] for r in old.where("doc_id = 0").groupBy("local_cluster_uid").agg(F.max("text")).collect()}


def test_planned_names_are_those_of_the_tokens(spark, docs, rows):
    assert not sends_tokens(spark, "name_mentions")
    for limit, overlap in ((9, 1), (400, 2)):
        plan = C.plan_chunks(T.sentences(docs), limit, overlap)
        old = M.local_mention_rows(M.name_mentions(C.chunk_tokens(T.tokenize(docs), plan)), plan)
        assert rows(M.planned_name_mentions(docs, limit, overlap).select(old.columns)) == rows(old) and old.count() > 5


SPANS = "doc_id bigint, mention_id bigint, start bigint, end bigint, text string, subject string"
MENTIONS = [(0, 1, 0, 2, "Ann Lee", "Ann"), (0, 2, 3, 5, "Bob. Bob's", "Bob"), (0, 3, 17, 18, "Here", None), (0, 4, 17, 19, "Here", "x"), (0, 5, 6, 8, None, "Ann"), (4, 1, 5, 7, "York and", "York"), (5, 1, 0, 1, "one", "he"), (1, 1, 0, 1, "a", "b"), (9, 1, 0, 1, "a", "b"), (7, 1, 5, 6, "He", "Jean-Luc"), (0, 6, None, 3, "a", "b")]


def test_windows_of_one_mention_with_several_texts(spark, docs, rows):
    assert not sends_tokens(spark, "mention_windows")
    asked = spark.createDataFrame([(5, 1, 0, 1, None, None), (5, 1, 0, 1, None, None), (7, 1, 5, 6, None, None)], SPANS)
    assert rows(M.document_contexts(asked, docs, 1, 1, True).select("doc_id", "mention_id", "sentence_index", "context_text")) == [(5, 1, 0, "[[one]]"), (7, 1, 0, "Mary O'Neil asked Jean-Luc Picard. [[He]] helped Mary O'Neil not.")]


def test_contexts_are_those_of_the_tokens(spark, docs, rows):
    assert not sends_tokens(spark, "mention_contexts")
    asked = spark.createDataFrame(MENTIONS, SPANS)
    for before, after, mark in ((0, 0, False), (1, 1, True), (2, 0, True)):
        old = M.mention_contexts(asked.where("start is not null"), T.tokenize(docs), T.sentences(docs), before, after, mark)
        assert rows(M.document_contexts(asked, docs, before, after, mark)) == rows(old) and old.count() == 6


def test_rule_candidates_are_those_of_the_syntax(spark, rows):
    plan = entry.queries()["syntax_candidates"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString() if os.path.isdir(FOLDER) else "MapInArrow"
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # it was 18 passes over the texts and joins of their tokens
    r, words = random.Random(4), ["Ann", "Bob", "ann", "In", "Not", "not", "Was", "was", "Up", "up", "to", "(To", "helped", "walked.", "Walked", "the", "-", "Éva,", "X", "Off", "with", "É9"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(1500)] + [None, "", "Ann was helped up by Bob. Bob"]
    docs = spark.createDataFrame([(i, t, r.choice([None, [3], [0, 5, 8, 99]])) for i, t in enumerate(texts)], "doc_id bigint, text string, sentence_starts array<bigint>")
    syntax = T.rule_syntax(T.tokenize(docs, starts="sentence_starts")).localCheckpoint()
    here = F.col("token_i")
    names = syntax.where("pos = 'PROPN'").select("doc_id", here.alias("mention_id"), F.xxhash64("lemma").alias("cluster_id"), here.alias("start"), (here + 1).alias("end"), here.alias("head_token_i"))
    got = L.rule_candidates(docs)
    assert rows(got) == rows(L.relation_candidates(syntax, names).select(got.columns)) and got.count() > 100
