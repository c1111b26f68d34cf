import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ontology as O
from loomgraph.operators import relations as L
from loomgraph.operators import resolution as R
from loomgraph.operators import scoring as S
from loomgraph.plans import knowledge

BASE = "https://example.org/narrative#"


def block(text, kind):
    return text.split(f"```{kind}\n", 1)[1].split("```", 1)[0]


def test_trait_profile_golden(spark, golden):
    table = [[float(x) for x in r] for r in csv.reader(io.StringIO(block(golden("X1"), "csv")))]
    names = [f"{t}_{p}_probability" for t in S.TRAITS for p in S.POLES] + [f"ocean_weight_{w}_probability" for w in S.WEIGHTS]
    evidence = spark.createDataFrame([(1, 4, int(r[0]), *r[1:]) for r in table], "doc_id bigint, cluster_id bigint, mention_id bigint, " + ", ".join(f"{n} double" for n in names))
    got = S.trait_profiles(evidence, 2, exact=True).first()
    assert [got[t] for t in S.TRAITS] == [54.92, 50.18, 34.25, 52.14, 4.88]
    assert got["n_mentions_scored"] == 13


def test_unscored_rows_and_empty_clusters(spark):
    names = [f"{t}_{p}_probability" for t in S.TRAITS for p in S.POLES] + [f"ocean_weight_{w}_probability" for w in S.WEIGHTS]
    schema = "doc_id bigint, cluster_id bigint, mention_id bigint, " + ", ".join(f"{n} double" for n in names)
    full = [0.2, 0.2, 0.6] * 5 + [0.0, 0.0, 1.0]
    rows = [(1, 1, 1, *full), (1, 1, 2, *full[:-1], None), (1, 2, 3, *[None] * 18)]
    got = S.trait_profiles(spark.createDataFrame(rows, schema), 2).collect()
    assert [(r["cluster_id"], r["openness"], r["n_mentions_scored"]) for r in got] == [(1, 50.0, 1)]
    assert S.trait_profiles(spark.createDataFrame([], schema), 2).collect() == []


def test_typing_descent_golden(spark, golden):
    records = [json.loads(x) for x in block(golden("X2"), "json").strip().splitlines()]
    paths = [(1, 8, r["w"]["high"] + 0.5 * r["w"]["medium"], [(p, c or S.STAY, k, w) for p, c, k, w in r["path"]]) for r in records]
    evidence = spark.createDataFrame(paths, "doc_id bigint, cluster_id bigint, weight double, path array<struct<parent string, child string, edge_kind string, edge_weight double>>")
    edges = [(p, i, c) for i, (c, p) in enumerate(sorted(knowledge._PARENTS))] + [(p, 1_000_000, S.STAY) for p in sorted({p for _, p in knowledge._PARENTS})]
    options = spark.createDataFrame(edges, "parent string, ordinal int, child string")
    roots = spark.createDataFrame([("NarrativeEntity",)], "iri string")
    scores = S.edge_scores(evidence)
    at_root = {r["child"]: round(r["score"] / 1, 4) for r in scores.where("parent = 'NarrativeEntity'").collect()}
    assert at_root["AgentiveEntity"] > at_root["Object"] > at_root[S.STAY]
    got = S.descend(scores, options, roots, 4).first()
    assert got["class_iri"] == "AgentiveEntity"


def test_relation_aggregation_golden(spark, golden):
    records = [json.loads(x) for x in block(golden("X3"), "json").strip().splitlines()]
    rows = [(1, r["relation_id"], r["s"], r["t"], json.dumps({BASE + k: v for k, v in r["p"].items()})) for r in records]
    df = spark.createDataFrame(rows, "doc_id bigint, relation_id string, source_cluster_id bigint, target_cluster_id bigint, object_property_probabilities_json string")
    assert L.assertions(df).collect() == []
    got = L.assertions(df, 2, 0.60).collect()
    assert [r["cluster_assertion_id"] for r in got] == ["assertion_2_usesObject_1"]
    assert got[0]["support_relation_ids"] == ["rel_139_1829_138", "rel_272_3327_273"]
    winners = {r["relation_id"]: r["property"] for r in L.exploded(df).where("is_winner").collect()}
    assert winners["rel_205_2600_206"] == BASE + "createsObject"


def test_salience_golden(spark):
    kept = [20, 19, 210, 14, 13, 4, 5, 8, 6, 20]
    rejected = [4] + [2] * 7 + [1] * 31
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(kept + rejected)], "doc_id bigint, uid int, n_mentions bigint")
    got = R.salience_split(df, order=("uid",)).collect()
    assert {r["cutoff"] for r in got} == {20}
    assert sorted(r["uid"] for r in got if r["kept"]) == list(range(10))
    assert sum(r["kept"] for r in R.salience_split(df, least_kept=None, order=("uid",)).collect()) == 3


@pytest.fixture(scope="module")
def onto(spark):
    triples = O.default_triples(spark, BASE)
    classes = O.class_table(triples)
    edges = O.subclass_table(triples, classes)
    closed = O.closure(classes, edges)
    return triples, classes, edges, closed, O.property_table(triples, closed)


def test_routes_golden(onto):
    _, _, _, closed, props = onto
    routes = {}
    for r in O.route_table(props, closed).collect():
        routes.setdefault((r["source_class"][len(BASE):], r["target_class"][len(BASE):]), set()).add(r["iri"][len(BASE):])
    assert routes["Character", "Artifact"] == {"createsObject", "destroysObject", "possessesObject", "usesObject"}
    assert routes["Tool", "Settlement"] == {"locatedIn"}
    assert routes["Character", "Settlement"] == {"leavesPlace", "locatedIn", "rulesOver", "travelsTo"}
    assert ("Place", "Event") not in routes


def test_graph_checks(spark, onto):
    _, classes, edges, closed, _ = onto
    assert O.graph_errors(classes, edges).count() == 0
    assert [r["iri"] for r in O.roots(classes, edges).collect()] == [BASE + "NarrativeEntity"]
    loop = edges.union(spark.createDataFrame([(BASE + "Tool", BASE + "NarrativeEntity")], edges.schema))
    with pytest.raises(ValueError, match="cycle|cyclic"):
        O.closure(classes, loop)
    assert O.closure(classes.limit(0), edges.limit(0)).count() == 0
    narrow = spark.createDataFrame([("p", BASE + "Place"), ("p", BASE + "Site"), ("q", O.THING), ("q", BASE + "Tool"), ("r", O.THING)], "k string, class string")
    assert sorted(tuple(r) for r in O.most_specific(narrow, closed, "k").collect()) == [("p", BASE + "Site"), ("q", BASE + "Tool"), ("r", O.THING)]


def test_restrictions_and_division(spark, onto):
    _, classes, edges, closed, _ = onto
    t, owl = O.TYPE, O.OWL
    rows = [(BASE + "hasO", t, owl + "DatatypeProperty"), (BASE + "hasC", t, owl + "DatatypeProperty"), (BASE + "AgentiveEntity", O.RDFS + "subClassOf", "_:r1"), ("_:r1", owl + "intersectionOf", "_:l1"), ("_:l1", O.RDF + "first", "_:r2"), ("_:r2", owl + "onProperty", BASE + "hasO"), (BASE + "hasC", O.RDFS + "domain", BASE + "Character")]
    triples = spark.createDataFrame([(*r, "iri", None) for r in rows], O.TRIPLES)
    have = O.class_data_properties(triples, closed)
    assert {(r["class"][len(BASE):], r["property"][len(BASE):], r["inherited"]) for r in have.collect()} >= {("AgentiveEntity", "hasO", False), ("Character", "hasO", True), ("Character", "hasC", False)}
    assert [r[0] for r in O.classes_with_all(have, [BASE + "hasO", BASE + "hasC"]).collect()] == [BASE + "Character"]


def test_routing_reasons(spark, onto):
    _, _, _, closed, props = onto
    routes = O.routes_by_pair(O.route_table(props, closed), props)
    candidates = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 2, 3), (1, "c", 1, 9)], "doc_id bigint, relation_id string, source_cluster_id bigint, target_cluster_id bigint")
    typing = spark.createDataFrame([(1, 1, BASE + "Character"), (1, 2, BASE + "Place"), (1, 3, BASE + "RitualEvent")], "doc_id bigint, cluster_id bigint, class_iri string")
    kept, dropped = L.route_candidates(candidates, typing, routes)
    assert [r["relation_id"] for r in kept.collect()] == ["a"]
    assert {r["relation_id"]: r["reason"] for r in dropped.collect()} == {"b": "no property from Place to RitualEvent", "c": "target cluster has no class"}
    texts = kept.withColumn("premise", F.lit("Context: he travels to the town"))
    got = L.assign_properties(texts).first()
    assert abs(sum(got["probabilities"].values()) - 1) < 1e-9 and got["selection_method"] == "nli_grouped_softmax"


def test_syntax_candidates(spark):
    # "Ann did not give up the old key to Bo": give <- Ann (nsubj), not (neg), up (prt), key (dobj), to (prep) <- Bo (pobj)
    tokens = [(0, 3, "Ann", "Ann", "PROPN", "nsubj"), (1, 3, "did", "do", "AUX", "aux"), (2, 3, "not", "not", "PART", "neg"), (3, 3, "give", "give", "VERB", "ROOT"), (4, 3, "up", "up", "ADP", "prt"), (5, 7, "the", "the", "DET", "det"), (6, 7, "old", "old", "ADJ", "amod"), (7, 3, "key", "key", "NOUN", "dobj"), (8, 3, "to", "to", "ADP", "prep"), (9, 8, "Bo", "Bo", "PROPN", "pobj")]
    tok = spark.createDataFrame([(1, i, h, t, lemma, p, d, 0) for i, h, t, lemma, p, d in tokens], "doc_id bigint, token_i bigint, head_i bigint, text string, lemma string, pos string, dep string, sentence_id bigint")
    mentions = spark.createDataFrame([(1, 0, 0, 0, 1, 0), (1, 1, 1, 5, 8, 7), (1, 2, 2, 9, 10, None), (1, 3, 0, 0, 1, 0)], "doc_id bigint, mention_id bigint, cluster_id bigint, start bigint, end bigint, head_token_i bigint")
    got = {(r["source_mention_id"], r["target_mention_id"]): r for r in L.relation_candidates(tok, mentions).collect()}
    assert set(got) == {(0, 1), (0, 2), (3, 1), (3, 2)}
    assert got[0, 1]["predicate_label"] == "give_up" and got[0, 2]["predicate_label"] == "give_up_to"
    assert got[0, 2]["predicate_start"] == 3 and got[0, 2]["predicate_end"] == 9 and got[0, 1]["is_negated"] and not got[0, 1]["is_passive"]
    assert got[0, 1]["relation_id"] == "rel_0_3_1"
