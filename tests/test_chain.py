"""Providers, evidence records, layers, exchange formats, the command line: what ties the operators together."""

import json
import random
import sys
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.operators import anchors as A
from loomgraph.operators import exports as E
from loomgraph.operators import mentions as M
from loomgraph.operators import ontology as O
from loomgraph.operators import providers as PR
from loomgraph.operators import relations as L
from loomgraph.operators import scoring as S
from loomgraph.operators import tokens as T
from loomgraph.operators.layer import AnnotationLayer, with_profiles
from loomgraph.plans.profiles import PROFILES, runtime_profile
from loomgraph.runtime import checked_broadcast
from loomgraph.sources import files as FS
from loomgraph.sources import store as ST

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


@dataclass(frozen=True)
class Counting:
    """A scorer that fails on large batches, to see that batches are bounded."""

    key: str = "counting"

    def load(self):
        def score(premises, hypotheses):
            assert len(premises) <= 3
            return np.array([float(len(p) - len(h)) for p, h in zip(premises, hypotheses)])

        return score


@dataclass(frozen=True)
class Heads:
    """A coreference stand-in: equal words as clusters, with the texts and both kinds of ends."""

    key: str = "heads"

    def load(self):
        def predict(sentences):
            words = [w for s in sentences for w in s]
            places = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            same = {w: at for w, at in places.items() if len(at) > 1}
            return {"clusters_token_offsets": [[{"start": i, "end": i} if k % 2 else (i, i + 1) for k, i in enumerate(at)] for at in same.values()], "clusters_token_text": [[w] * len(at) for w, at in same.items()]}

        return predict


def test_logits_in_bounded_batches(spark):
    df = spark.createDataFrame([("abc", "a"), (None, "ab"), ("abc", "a"), ("xxxxxx", None)] * 5, "p string, h string")
    got = df.select("p", "h", PR.entailment_logit(F.col("p"), F.col("h"), Counting(), 3).alias("l"), PR.entailment_logits(F.col("p"), F.array("h", F.lit("zz")), Counting(), 3).alias("ls")).collect()
    assert all(r["l"] == len(r["p"] or "") - len(r["h"] or "") and r["ls"] == [r["l"], len(r["p"] or "") - 2] for r in got)
    assert df.limit(0).select(PR.entailment_logit(F.col("p"), F.col("h"), Counting())).count() == 0


def test_provider_and_columns_give_the_same_scores(spark):
    rows = spark.createDataFrame([(1, "Ada", "Ada shows high openness, and low neuroticism"), (2, None, "nothing is said"), (3, "Bo", None)], "mention_id bigint, subject string, context_text string")
    columns = {r["mention_id"]: r for r in S.score_tasks(rows).collect()}
    for r in S.score_tasks_by_model(rows, PR.SharedWords(), 4).collect():
        assert all(abs(r[c] - columns[r["mention_id"]][c]) < 1e-9 for c in r.asDict())


def test_models_are_loaded_once_and_labels_found():
    loads = []

    @dataclass(frozen=True)
    class Once:
        key: str

        def load(self):
            loads.append(self.key)
            return self.key

    PR._LOADED.clear()
    for k in ("a", "b", "a", "c", "d", "a", "e", "b"):
        assert PR.loaded(Once(k)) == k
    assert loads == ["a", "b", "c", "d", "e", "b"]
    assert PR.entailment_index(["contradiction", "neutral", "ENTAILMENT"]) == 2 and PR.entailment_index({0: "not_entailment", 1: "entailment"}) == 1
    with pytest.raises(ValueError, match="no single"):
        PR.entailment_index(["yes", "no"])


def test_offsets_of_models():
    assert PR.offset_clusters({"clusters_token_offsets": [[(1, 2), {"start_token": 4, "end_token": 5}], (7, 9)]}) == [[(1, 2), (4, 5)], [(7, 9)]]
    with pytest.raises(ValueError, match="no pair"):
        PR.offset_clusters({"clusters_token_offsets": [[(1, 2, 3)]]})
    with pytest.raises(KeyError):
        PR.offset_clusters({})
    words, sentences = ["The", "cat", "sat", ".", "A", "dog"], [0, 0, 0, 0, 1, 1]
    assert PR.placed_span(0, 2, words, sentences, "The cat") == (0, 2)
    assert PR.placed_span(0, 1, words, sentences, "The cat") == (0, 2)
    assert PR.placed_span(2, 4, words, sentences) == (2, 4) and PR.placed_span(3, 4, words, sentences) == (3, 4)
    assert PR.placed_span(4, 6, words, sentences) == (4, 6) and PR.placed_span(6, 6, words, sentences) is None and PR.placed_span(-1, 2, words, sentences) is None
    assert PR.placed_span(2, 5, words, sentences) is None and PR.placed_span(2, 5, words, sentences, within_sentence=False) == (2, 6)


def test_coreference_provider(spark, rows):
    df = spark.createDataFrame([(1, "c0", 0, ["Ann", "met", "Bo", "."]), (1, "c0", 1, ["Bo", "saw", "Ann"]), (2, "c0", 0, ["x"])], "doc_id bigint, chunk_id string, sentence_index bigint, words array<string>")
    assert rows(PR.coreference_mentions(df, Heads())) == [(1, "c0", 0, 0, 1, "Ann", 0), (1, "c0", 0, 6, 7, "Ann", 6), (1, "c0", 1, 2, 3, "Bo", 2), (1, "c0", 1, 4, 5, "Bo", 4)]


def test_evidence_records_are_checked(spark, rows):
    triples = O.default_triples(spark)
    classes = O.class_table(triples)
    edges = O.subclass_table(triples, classes)
    mentions = spark.createDataFrame([(1, 5, 7, 0, 2, "a place", "Ada", "Ada is a place"), (1, 6, 7, 3, 4, "it", None, "it is an object")], "doc_id bigint, mention_id bigint, cluster_id bigint, mention_start bigint, mention_end bigint, mention_text string, subject string, context_text string")
    table = mentions.selectExpr("doc_id", "mention_id", "cluster_id", "mention_start as start", "mention_end as end", "mention_text as text")
    evidence = S.typing_evidence(mentions, classes, edges, 4)
    assert S.evidence_errors(evidence, table, classes, edges).count() == 0 and S.completed_typing(evidence).count() == 2
    base = O.DEFAULT_BASE
    step = lambda *e: [dict(zip(("parent_class_iri", "child_class_iri", "edge_kind", "edge_weight"), e))]
    paths = [("ok", step(base + "Event", None, "stay", 0.5)), ("weight", step(base + "Event", None, "stay", 1.5)), ("kind", step(base + "Event", None, "jump", 0.5)), ("root_parent", step(base + "Event", base + "NarrativeEntity", "root", 0.5)), ("root_child", step(S.ROOT, base + "Event", "root", 0.5)), ("stay_child", step(base + "Event", base + "Event", "stay", 0.5)), ("unknown_parent", step("x", None, "stay", 0.5)), ("unknown_child", step(base + "Event", "x", "child", 0.5)), ("no_edge", step(base + "Event", base + "Place", "child", 0.5))]
    df = spark.createDataFrame([(1, k, p) for k, (_, p) in enumerate(paths)], f"doc_id bigint, mention_id bigint, selected_path {S.PATH}")
    assert {r["mention_id"]: r["error"] for r in S.path_errors(df, classes, edges).collect()} == {k: e for k, (e, _) in enumerate(paths) if e != "ok"}
    broken = evidence.withColumn("schema_version", F.lit(1)).withColumn("mention_weight_raw", F.lit(None).cast("struct<high:double,medium:double,low:double>")).withColumn("mention_text", F.lit("other"))
    assert {r["error"] for r in S.evidence_errors(broken, table, classes, edges).collect()} == {"version", "weight_missing", "text"} and S.completed_typing(broken).count() == 0


def test_layer_guards_its_tables(spark, tmp_path, rows):
    one = spark.createDataFrame([(1, 2)], "doc_id bigint, cluster_id bigint")
    layer = AnnotationLayer(spark, str(tmp_path / "l"))
    with pytest.raises(ValueError, match="not attached"):
        layer.attach("entities", {"clusters": one})
    layer.attach("tokens", {"tokens": one})
    layer.attach("entities", {"clusters": one, "mentions": one.union(one)})
    with pytest.raises(ValueError, match="attached already"):
        layer.attach("entities", {"clusters": one})
    assert rows(AnnotationLayer(spark, str(tmp_path / "l")).summary()) == [("entities", "ready", "clusters", 1), ("entities", "ready", "mentions", 2), ("tokens", "ready", "tokens", 1)]
    layer.attach("tokens", {"tokens": one.union(one)}, overwrite=True)
    with pytest.raises(ValueError, match="stale"):
        layer.table("entities", "clusters")
    layer.mark("entities", "ready")
    assert layer.table("entities", "mentions").count() == 2
    with pytest.raises(KeyError):
        layer.attach("other", {})
    profiles = spark.createDataFrame([(1, 2, "x")], "doc_id bigint, cluster_id bigint, class_iri string")
    once = with_profiles(one.union(spark.createDataFrame([(1, 3)], one.schema)), profiles)
    assert rows(once) == [(1, 2, "x"), (1, 3, None)]
    with pytest.raises(ValueError, match="already"):
        with_profiles(once, profiles)
    assert rows(with_profiles(once, profiles, overwrite=True)) == rows(once)


RDF_FORMS = {
    "a.ttl": '@prefix : <http://e/#> . :a a :C ; :p "v" , :b . :b :q 4 .',
    "a.trig": '@prefix : <http://e/#> . :g { :a a :C ; :p "v" , :b } GRAPH :h { :b :q 4 . }',
    "a.nq": '<http://e/#a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/#C> <http://e/#g> .\n<http://e/#a> <http://e/#p> "v" <http://e/#g> .\n<http://e/#a> <http://e/#p> <http://e/#b> .\n\n# note\n<http://e/#b> <http://e/#q> "4"^^<http://www.w3.org/2001/XMLSchema#integer> <http://e/#g> .',
    "a.rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/#" xml:base="http://e/"><e:C rdf:about="#a" e:p="v"><e:p><rdf:Description rdf:ID="b"><e:q rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">4</e:q></rdf:Description></e:p></e:C></rdf:RDF>',
    "a.jsonld": '{"@context": {"e": "http://e/#", "p": "e:p", "C": "e:C", "@base": "http://e/"}, "@graph": [{"@id": "e:a", "@type": "C", "p": ["v", {"@id": "e:b", "e:q": 4}]}]}',
}


@pytest.mark.parametrize("name", sorted(RDF_FORMS))
def test_every_rdf_format_reads_alike(spark, tmp_path, name):
    path = tmp_path / name
    path.write_text(RDF_FORMS[name])
    got = {tuple(r) for r in FS.read_rdf(spark, str(path)).collect()}
    integer = "http://www.w3.org/2001/XMLSchema#integer"
    assert got == {("http://e/#a", O.TYPE, "http://e/#C", "iri", None), ("http://e/#a", "http://e/#p", "v", "literal", None), ("http://e/#a", "http://e/#p", "http://e/#b", "iri", None), ("http://e/#b", "http://e/#q", "4", "literal", integer)}


def test_rdf_corners():
    collection = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/#"><rdf:Description rdf:nodeID="n"><e:l rdf:parseType="Collection"><rdf:Description rdf:about="http://e/x"/></e:l><e:r rdf:parseType="Resource"><e:s>t</e:s></e:r><e:o rdf:resource="http://e/y"/></rdf:Description></rdf:RDF>'
    assert len(FS.parse_rdf_xml(collection)) == 6
    assert FS.parse_jsonld('{"@context": {"l": {"@id": "http://e/l", "@container": "@list"}}, "@id": "http://e/a", "l": [1, true]}')[-1][1] == "http://e/l"
    with pytest.raises(ValueError, match="not in the text"):
        FS.parse_jsonld('{"@context": "http://e/context"}')
    with pytest.raises(ValueError, match="no quad"):
        FS.parse_nquads("nonsense")


def test_ontology_in_one_object(spark, tmp_path, rows):
    path = tmp_path / "o.ttl"
    path.write_text(O.DEFAULT.read_text("utf-8"))
    onto = O.Ontology.load(spark, str(path))
    base = O.DEFAULT_BASE
    assert onto.classes.count() == 21 and onto.errors().count() == 0 and onto.routes_by_pair().count() > 10
    why = {r["iri"]: tuple(r)[1:] for r in O.explain_pair(onto.routes, onto.properties, onto.closed, base + "Character", base + "Site").collect()}
    assert why[base + "travelsTo"] == (True, True, True) and why[base + "fears"] == (True, False, False) and why[base + "occursAt"] == (False, True, False)
    typed = onto.with_data_properties(base + "AgentiveEntity", {"hasOceanOpenness": "double"})
    assert rows(O.data_property_table(typed.triples, typed.closed).where(F.col("class") == base + "Character").select(F.size("direct"), F.size("inherited"))) == [(0, 1)]
    who = spark.createDataFrame([(1, 1, base + "Character"), (1, 2, base + "Tool")], "doc_id bigint, cluster_id bigint, class_iri string")
    assert rows(O.clusters_to_score(who, typed.data_properties(), [O.trait_property_iri(base + "AgentiveEntity", "openness")]).select("cluster_id")) == [(1,)]
    entities = who.withColumn("canonical_name", F.concat(F.lit("N"), F.col("cluster_id").cast("string")))
    fact = spark.createDataFrame([(1, 1, base + "usesObject", 2)], "doc_id bigint, source_cluster_id bigint, object_property_iri string, target_cluster_id bigint")
    assert onto.populated(entities, fact, base, []).count() == onto.triples.count() + 7
    with pytest.raises(ValueError, match="unknown entities"):
        onto.populated(entities.where("cluster_id = 1"), fact, base, [])


def test_assertion_lookups(spark, rows):
    facts = spark.createDataFrame([(1, 1, "p", 2, "a1"), (1, 1, "q", 3, "a2"), (2, 1, "p", 2, "a3")], "doc_id bigint, source_cluster_id bigint, object_property_iri string, target_cluster_id bigint, cluster_assertion_id string")
    assert rows(L.assertion_index(facts, "source")) == [(1, "1", ["a1", "a2"]), (2, "1", ["a3"])]
    assert rows(L.assertions_of(facts, source=1, iri="p", doc_id=1).select("cluster_assertion_id")) == [("a1",)]
    assert rows(L.assertions_of(facts, target=3).select("cluster_assertion_id")) == [("a2",)]
    found = spark.createDataFrame([(1, "r1"), (1, "r2")], "doc_id bigint, relation_id string")
    assert rows(L.unassigned(found, found.limit(1)).select("doc_id")) == [(1,)]
    assert rows(L.relation_summary(found, found.limit(1), facts)) == [(1, 2, 1, 2, 1, 2, 2), (2, 0, 0, 1, 1, 1, 1)]


def test_stage_is_bound_to_its_plan_and_redoes_what_is_broken(spark, tmp_path, rows):
    store = ST.StageStore(spark, str(tmp_path / "s"), {"v": 1})
    plan = spark.createDataFrame([("a",), ("b",)], "part string")
    data = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "part string, x int")
    store.begin("s", plan, ["part"])
    store.begin("s", plan.repartition(3), ["part"])
    with pytest.raises(ValueError, match="another plan"):
        store.begin("s", plan.limit(1), ["part"])
    store.commit("s", data, plan, ["part"])
    assert rows(store.remaining("s", plan, ["part"])) == []
    data.where("x = 2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{tmp_path}/s/s/data")
    assert rows(store.remaining("s", plan, ["part"])) == [("b",)] and rows(store.remaining("s", plan, ["part"], verify=False)) == []
    assert [f["part"] for f in store.failures("s")] == ["('b',)"]
    store.commit("s", data.where("part = 'b'"), plan.where("part = 'b'"), ["part"])
    assert store.finalize("s", plan, ["part"]).count() == 3
    stray = ST.StageStore(spark, str(tmp_path / "t"), {"v": 1})
    data.write.partitionBy("part").parquet(f"{tmp_path}/t/s/data")
    with pytest.raises(ValueError, match="no manifest"):
        stray.begin("s", plan, ["part"])


def test_anchor_index_finds_what_a_full_comparison_finds():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(3, 9)))
    bank = [(" ".join(word() for _ in range(r.randint(1, 2))), "d", 1) for _ in range(200)]
    scan = A.AnchorScan(bank, 0.86, 0.90, 5)
    for _ in range(300):
        key = list(r.choice(bank)[0])
        for _ in range(r.randint(0, 2)):
            key[r.randrange(len(key))] = r.choice("abcde ")
        key = " ".join("".join(key).split())
        for threshold in (0.86, 0.9, 0.6):
            fuzzy = {i for i, (score, how) in scan.match(key, threshold).items() if how == "fuzzy"}
            words = {i for i in range(len(bank)) if set(key.split()) <= set(bank[i][0].split()) or set(bank[i][0].split()) <= set(key.split())}
            full = {i for i, (k, _, _) in enumerate(bank) if len(key) >= 5 and len(k) >= 5 and SequenceMatcher(None, key, k).ratio() >= threshold}
            assert fuzzy == full - words


def test_contexts_of_windows(spark, rows):
    docs = spark.createDataFrame([(1, "Ann came . She left early . Bo stayed here . End", [0, 3, 7, 11])], "doc_id bigint, text string, sentence_starts array<bigint>")
    mentions = spark.createDataFrame([(1, 1, 3, 4, "She", "Ann"), (1, 2, 0, 1, "Ann", "Ann"), (1, 3, 11, 12, "End", None), (1, 4, 2, 5, "x", "Ann"), (2, 5, 0, 1, "x", "x")], "doc_id bigint, mention_id bigint, start bigint, end bigint, text string, subject string")
    for tokens in (T.tokenize(docs), T.tokenize(docs, starts="sentence_starts")):
        got = {r["mention_id"]: r for r in M.mention_contexts(mentions, tokens, T.sentences(docs), before=1, after=0, mark=True).collect()}
        assert {k: r["context_text"] for k, r in got.items()} == {1: "Ann came. [[She]] left early.", 2: "[[Ann]] came.", 3: "Bo stayed here. [[End]]"}
        assert got[1]["rendered_context_text"] == "Ann came. Ann left early." and got[1]["mention_render_was_changed"] and not got[2]["mention_render_was_changed"]
    assert M.mention_contexts(mentions.limit(0), T.tokenize(docs), T.sentences(docs)).count() == 0


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello world.")
    assert cli.main(["tokens", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "tsv")], spark).count() == 2
    clusters = spark.createDataFrame([("c1", "King Arlo"), ("c2", "Queen Bera")], "local_cluster_uid string, canonical_name string")
    mentions = spark.createDataFrame([("m1", "c1", "King Arlo"), ("m2", "c1", "he"), ("m3", "c2", "Queen Bera"), ("m4", "c2", "King Arlo"), ("m5", "c2", "Bera")], "local_mention_uid string, local_cluster_uid string, text string")
    FS.write_csv(clusters, str(tmp_path / "c"))
    FS.write_csv(mentions, str(tmp_path / "m"))
    made = cli.main(["filter-mentions", "--mentions", str(tmp_path / "m"), "--clusters", str(tmp_path / "c"), "--output", str(tmp_path / "f"), "--anchor-percentile", "0"], spark)
    assert [r["local_mention_uid"] for r in made["dropped"].collect()] == ["m4"] and tuple(made["counts"].first()) == (1, 4)
    assert spark.read.option("header", True).csv(str(tmp_path / "f" / "selected_anchors")).columns == E.ANCHOR_COLUMNS
    monkeypatch.delenv("CUDA_VISIBLE_DEVICES", raising=False)
    assert cli.main(["profile"], spark) == PROFILES["local_cpu"] and runtime_profile(spark, "local_cuda").chunk_limit == 6000
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_joins_that_check_their_key(spark, rows):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "k int, w string")
    assert rows(A.checked_join(left, right.where("k < 3"), ["k"])) == [(None, "z", None), (1, "x", "a"), (2, "y", None)]
    with pytest.raises(Exception, match="k not unique: 3"):
        A.checked_join(left.union(spark.createDataFrame([(3, "q")], left.schema)), right, ["k"]).collect()
    with pytest.raises(ValueError, match="more than 2"):
        checked_broadcast(right, 2, "a table")


def test_metadata_of_texts(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in E.corpus_metadata(docs, {"offsets": "tokens"}).collect()}
    assert got[1]["n_chars"] == 3 and len(got[1]["text_sha256"]) == 64 and got[2]["text_sha256"] is None and json.dumps(got[1]["contract"]) == '{"offsets": "tokens"}'


def test_routed_records_and_rule_syntax(spark, rows):
    docs = spark.createDataFrame([(1, "Ann was not . Ann walked away to Bo . Then Bo was helped by Ann .", [0, 4, 9])], "doc_id bigint, text string, sentence_starts array<bigint>")
    syntax = T.rule_syntax(T.tokenize(docs, starts="sentence_starts"))
    assert rows(L.predicates(syntax).select("label", "is_passive")) == [("helped", True), ("walked_away", False)]
    names = syntax.where("pos = 'PROPN'").select("doc_id", F.col("token_i").alias("mention_id"), F.xxhash64("lemma").alias("cluster_id"), F.col("token_i").alias("start"), (F.col("token_i") + 1).alias("end"), F.col("token_i").alias("head_token_i"))
    assert rows(L.relation_candidates(syntax, names).select("predicate_label")) == [("helped_by",), ("helped_by",), ("walked_away_to",)]
    routed = spark.createDataFrame([(1, "r", [("i", "l", "d")])], "doc_id bigint, relation_id string, properties array<struct<iri:string,label:string,description:string>>")
    assert json.loads(L.routed_records(routed).first()["record"]) == {"relation_id": "r", "candidate_properties": [{"iri": "i", "label": "l", "description": "d"}]}
