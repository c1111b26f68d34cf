from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.change_capture import ChangeCapture, last_success
from loomgraph.plans import incremental
from loomgraph.runtime import numbered, read_text, running_counts, write_text_atomic
from loomgraph.sources import files as FS
from loomgraph.sources import store as ST
from loomgraph.streaming import arrivals

T0 = datetime(2025, 1, 1)
LOG = "k bigint, v string, p string, delivery_id bigint, arrived_at timestamp"


def delivery(k, v, n, hours, p='{"a": 0.5, "b": 5e-1}'):
    return (k, v, p, n, T0 + timedelta(hours=hours))


def pick(df, rows, *more):
    return rows(df.select("k", "kind", *more))


def test_capture_takes_changes_once(spark, tmp_path, rows):
    make = lambda: ChangeCapture(spark, str(tmp_path / "log"), ["k"], as_map=("p",), partitions=4)
    frame = lambda *data: spark.createDataFrame(list(data), LOG)
    make().ingest(frame(delivery(1, "x", 1, 1), delivery(2, "y", 2, 2), delivery(3, None, 3, 3)))
    assert pick(make().run(), rows) == [(1, "added"), (2, "added"), (3, "added")]
    make().ingest(frame(delivery(1, "x", 4, 5, '{"b":0.50,"a":0.5}'), delivery(2, "z", 5, 5), delivery(2, "y", 6, 6), delivery(4, "w", 7, 6), (5, "v", "{}", None, T0), (None, "v", "{}", 8, T0)))
    assert pick(make().run(), rows) == [(4, "added")]
    assert make().run() is None
    make().ingest(frame(delivery(1, "other", 9, 0), delivery(6, "first", 10, 0), delivery(2, "y", 11, 0), delivery(4, "w2", 12, 9)))
    assert pick(make().run(), rows) == [(1, "late"), (4, "changed"), (6, "added")]  # arrived before what was committed, but taken in after it
    make().ingest(frame(delivery(1, "x", 13, 10)))
    assert pick(make().run(), rows) == []  # the late delivery did not become the last known one
    assert make().sink().count() == 7


def test_a_run_reads_its_range_only(spark, tmp_path):
    c = ChangeCapture(spark, str(tmp_path / "log"), ["k"])
    c.ingest(spark.createDataFrame([delivery(i, "x", i, 1) for i in range(500)], LOG))
    c.run()
    c.ingest(spark.createDataFrame([delivery(i, "z", 1000 + i, 2) for i in range(7)], LOG))
    _, plan = c.plan()
    assert plan["segments"] == [1] and c.range_of(plan).count() == 7
    files = {f.rsplit("/log/", 1)[1].split("/")[0] for f in c.range_of(plan).inputFiles()}
    assert files == {"1"}
    assert "row" not in c.state(1).columns and c.run().count() == 7


STEPS = ["base", "begun", "log", "segment", "plan", "latest", "batch", "commit", "state", "merged"]


@pytest.mark.parametrize("broken", STEPS)
def test_a_crash_after_any_write_loses_and_repeats_nothing(spark, tmp_path, rows, broken):
    frame = lambda *data: spark.createDataFrame(list(data), LOG)
    history = frame(delivery(1, "a", 1, 1), delivery(2, "a", 2, 1))
    arrived = frame(delivery(1, "b", 3, 2), delivery(3, "a", 4, 2), delivery(2, "a", 6, 3))
    crashed = []

    def fall(step):
        if step == broken and not crashed:
            crashed.append(step)
            raise RuntimeError("crash")

    make = lambda: ChangeCapture(spark, str(tmp_path / "log"), ["k"], partitions=4, merge_every=1, after_step=fall)

    def insist(work):
        try:
            return work()
        except RuntimeError:
            return work()

    try:
        make().begin_with(history)
    except RuntimeError:
        if broken == "base":
            make().begin_with(history)
    insist(lambda: make().ingest(arrived))
    insist(lambda: make().run())
    c = make()
    assert crashed == [broken]
    assert rows(c.sink().select("k", "row.v", "kind")) == [(1, "b", "changed"), (3, "a", "added")]
    c.ingest(frame(delivery(1, "b", 7, 4), delivery(3, "a", 8, 4), delivery(2, "z", 9, 4)))
    assert rows(c.run().select("k", "kind")) == [(2, "changed")]


def test_merged_state_is_what_was_known(spark, tmp_path, rows):
    c = ChangeCapture(spark, str(tmp_path / "log"), ["k"], merge_every=2)
    for go in range(5):
        c.ingest(spark.createDataFrame([delivery(k, f"v{go // (k + 1)}", 10 * go + k, go) for k in range(4)], LOG))
        assert rows(c.run().select("k")) == [(k,) for k in range(4) if go % (k + 1) == 0]
    assert c._numbers("merged") == [1, 3] and rows(c.state(4).select("k")) == [(k,) for k in range(4)]


def test_files_are_taken_in_once_whenever_they_come(spark, tmp_path, rows):
    c = ChangeCapture(spark, str(tmp_path / "log"), ["k"])
    source = str(tmp_path / "in")
    read = lambda files: spark.read.schema(LOG).parquet(*files)
    assert c.ingest_files(source, read) is None
    spark.createDataFrame([delivery(1, "a", 1, 5)], LOG).write.parquet(source)
    assert c.ingest_files(source, read) == 0 and c.ingest_files(source, read) is None
    spark.createDataFrame([delivery(2, "a", 2, 1)], LOG).write.mode("append").parquet(source)
    assert c.ingest_files(source, read) == 1 and pick(c.run(), rows) == [(1, "added"), (2, "added")]


def test_capture_of_ties_and_empty_tables(spark, tmp_path, rows):
    empty = ChangeCapture(spark, str(tmp_path / "e"), ["k"])
    assert empty.run() is None and empty.sink() is None
    empty.ingest(spark.createDataFrame([], LOG))
    assert empty.run().count() == 0
    c = ChangeCapture(spark, str(tmp_path / "t"), ["k"])
    c.begin_with(spark.createDataFrame([], LOG))
    c.ingest(spark.createDataFrame([delivery(1, "a", 1, 1), delivery(1, "b", 2, 1), delivery(1, "b", 2, 1)], LOG))
    assert rows(c.run().select("k", "row.v", "kind")) == [(1, "b", "added")]
    with pytest.raises(ValueError, match="begun"):
        c.begin_with(spark.createDataFrame([], LOG))


def test_a_small_file_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "f" / "0.json")
    write_text_atomic(spark, path, "old")
    write_text_atomic(spark, path, "new")
    assert read_text(spark, path) == "new" and numbered(spark, str(tmp_path / "f")) == [0]
    with pytest.raises(Exception, match="AlreadyExists"):
        write_text_atomic(spark, path, "third", once=True)
    assert read_text(spark, path) == "new"


def test_running_counts_over_partitions(spark, rows):
    df = spark.createDataFrame([("a" if i % 3 else None, i, "x") for i in range(60)], "g string, x int, _note string")
    for parts in (1, 5, 40):
        got = rows(running_counts(df, ["g"], [F.col("x")], partitions=parts).select("g", "x", "_upto"))
        want = {g: sorted(i for i in range(60) if (i % 3 != 0) == (g == "a")) for g in ("a", None)}
        assert got == sorted(((g, x, k + 1) for g, xs in want.items() for k, x in enumerate(xs)), key=lambda r: (r[0] is not None, r[1]))
    assert running_counts(df.limit(0), ["g"], [F.col("x")]).count() == 0


def test_mention_moved_to_another_chunk_is_a_change(spark, tmp_path, rows):
    evidence = [(1, 1, 0, "a", T0), (1, 1, 3, "a", T0 + timedelta(2)), (1, 2, 0, "b", T0), (1, 2, 0, "b", T0 + timedelta(2)), (1, 3, 4, "c", T0 + timedelta(2))]
    spark.createDataFrame(evidence, "doc_id bigint, mention_id bigint, chunk_index bigint, mention_text string, arrived_at timestamp").write.parquet(f"{tmp_path}/trait_evidence.parquet")
    spark.createDataFrame([("trait_evidence", "success", T0 + timedelta(1))], "stage string, run_status string, read_up_to timestamp").write.parquet(f"{tmp_path}/run_log.parquet")
    assert rows(incremental.p7_mention_changes(spark, str(tmp_path))) == [(1, 1, "changed"), (1, 3, "added")]


def test_last_success(spark):
    log = spark.createDataFrame([("s", "success", T0), ("s", " Success ", T0 + timedelta(1)), ("s", "failed", T0 + timedelta(2)), ("t", "success", T0 + timedelta(3))], "stage string, run_status string, read_up_to timestamp")
    assert last_success(log, "s") == T0 + timedelta(1) and last_success(log, "none") is None


def test_stage_store_resumes_and_checks(spark, tmp_path):
    path = str(tmp_path / "store")
    plan = spark.createDataFrame([("a",), ("b",), ("empty",)], "part string")
    data = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "part string, x int")
    store = ST.StageStore(spark, path, {"v": 1})
    first = plan.where("part = 'a'")
    store.commit("s", data.where("part = 'a'"), first, ["part"])
    again = ST.StageStore(spark, path, {"v": 1})
    rest = again.remaining("s", plan, ["part"])
    assert sorted(r[0] for r in rest.collect()) == ["b", "empty"]
    with pytest.raises(ValueError, match="missing"):
        again.finalize("s", plan, ["part"])
    again.commit("s", data.where("part <> 'a'"), rest, ["part"])
    assert again.finalize("s", plan, ["part"]).count() == 3
    assert sorted(r[0] for r in again.remaining("s", plan, ["part"], force=first).collect()) == ["a"]
    again.read("s").where("part = 'b'").limit(1).withColumn("x", F.lit(99)).write.mode("append").partitionBy("part").parquet(f"{path}/s/data")
    with pytest.raises(ValueError, match="corrupt"):
        again.finalize("s", plan, ["part"])
    with pytest.raises(ValueError, match="another configuration"):
        ST.StageStore(spark, path, {"v": 2})
    calls = []
    for _ in range(2):
        assert again.read_or_build("t", lambda: calls.append(1) or data).count() == 3
    assert len(calls) == 1


def test_cache_scores_misses_only(spark):
    rows = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "cache_key string")
    cache = spark.createDataFrame([("k1", "old", 1.0), ("k1", "new", 2.0)], "cache_key string, payload_json string, created_at_unix double")
    whole, new = ST.score_with_cache(rows, cache, "cache_key", lambda d: d.select("cache_key", F.lit("made").alias("payload_json")))
    assert {tuple(r) for r in whole.collect()} == {("k1", "new"), ("k2", "made")} and new.count() == 1


def test_csv_jsonl_and_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nline'), (2, None)], "id bigint, t string")
    FS.write_csv(df, str(tmp_path / "c"), ["id", "t", "absent"])
    back = FS.read_csv(spark, str(tmp_path / "c"), "id bigint, t string, absent string")
    assert {tuple(r) for r in back.collect()} == {(1, 'a "quoted", text\nline', None), (2, None, None)}
    with pytest.raises(Exception, match="header|CSV"):
        FS.read_csv(spark, str(tmp_path / "c"), "id bigint, other string, absent string").collect()
    FS.write_jsonl(df, str(tmp_path / "j"))
    assert {tuple(r) for r in FS.read_jsonl(spark, str(tmp_path / "j"), "id bigint, t string").collect()} == {tuple(r) for r in df.collect()}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"id": 1}\n\n[1]\n')
    with pytest.raises(Exception, match="not an object"):
        FS.read_jsonl(spark, str(tmp_path / "bad"), "id bigint").collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "u.txt").write_bytes("día".encode())
    (tmp_path / "t" / "l.txt").write_bytes("día".encode("latin-1"))
    assert [r["text"] for r in FS.read_texts(spark, str(tmp_path / "t")).collect()] == ["día", "día"]
    FS.write_zip_tables({"df": df}, {"n": 2}, str(tmp_path / "z.zip"))
    assert FS.read_zip_tables(spark, str(tmp_path / "z.zip"), {"df": "id bigint, t string"})["df"].count() == 2


def test_turtle_round_trip(spark, tmp_path, rows):
    text = """@prefix : <http://e/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @base <http://e/> .
    :A a owl:Class ; owl:equivalentClass [ owl:onProperty :p ; owl:someValuesFrom :B ] , :C . # note
    <x> :p "two\\nlines \\"q\\"" , "5.0"^^<http://t/d> , 4 , true , "hi"@en ; :list ( :A :B ) ."""
    triples = FS.parse_turtle(text)
    assert ("http://e/o#A", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2002/07/owl#Class", "iri", None) in triples
    assert ("http://e/x", "http://e/o#p", 'two\nlines "q"', "literal", None) in triples and ("http://e/x", "http://e/o#p", "5.0", "literal", "http://t/d") in triples
    assert sum(t[1].endswith("first") for t in triples) == 2
    df = spark.createDataFrame(triples, "s string, p string, o string, o_kind string, datatype string")
    FS.write_ntriples(df.coalesce(1), str(tmp_path / "nt"))
    part = next((tmp_path / "nt").glob("part-*"))
    back = spark.createDataFrame(FS.parse_turtle(part.read_text()), df.schema)
    assert rows(back) == rows(df)
    assert FS.rdf_format("a/b.TTL") == "turtle"
    with pytest.raises(ValueError):
        FS.rdf_format("x.png")


def test_streaming_intake(spark, tmp_path):
    schema = "doc_id bigint, text string"
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "a b"), (2, "c")], schema).write.parquet(source)
    arrivals.run_intake(spark, source, schema, target, check)
    spark.createDataFrame([(2, "c"), (3, "d e f")], schema).write.mode("append").parquet(source)
    arrivals.run_intake(spark, source, schema, target, check)
    assert sorted(r[0] for r in spark.read.parquet(f"{target}/documents").select("doc_id").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{target}/tokens").count() == 6
