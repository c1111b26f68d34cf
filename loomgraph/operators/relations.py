"""Relations: candidates from syntax, routing, assignment, and cluster-level assertions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import probability as P
from loomgraph.functions import text as X
from loomgraph.operators.mentions import mentions_at_tokens
from loomgraph.operators.scoring import overlap_logit
from loomgraph.operators.tokens import PARTICLES, PASSIVE, PREPOSITIONS, per_document, starts_within, words_of
from loomgraph.runtime import checked_broadcast

#: Pairs of classes a routing table may have.
MAX_ROUTES = 1_000_000

# Dependency labels.
SUBJECTS = ["nsubj", "nsubjpass", "csubj", "csubjpass"]
PASSIVE_SUBJECTS = ["nsubjpass", "csubjpass"]
OBJECTS = ["dobj", "obj", "iobj", "dative", "attr", "oprd"]
PREPOSITION_OBJECTS = ["pobj", "pcomp"]


def predicates(tokens: DataFrame) -> DataFrame:
    """Verbal predicates with lemma label, particles, span, passive and negation; one pass over the children.

    ``tokens``: (doc_id, token_i, head_i, text, lemma, pos, dep, sentence_id) of a syntax provider.
    """
    verbs = tokens.where((F.col("pos") == "VERB") | ((F.col("pos") == "AUX") & F.col("dep").isin("ROOT", "cop"))).select("doc_id", F.col("token_i").alias("predicate_i"), "sentence_id", F.lower(F.coalesce(F.nullif("lemma", F.lit("")), F.col("text"))).alias("base"))
    child = tokens.where("token_i <> head_i").select("doc_id", F.col("head_i").alias("predicate_i"), "token_i", "text", "dep")
    facts = child.groupBy("doc_id", "predicate_i").agg(
        F.array_sort(F.collect_list(F.when(F.col("dep") == "prt", F.struct("token_i", F.lower("text").alias("w"))))).alias("particles"),
        F.max(F.col("dep").isin("auxpass", *PASSIVE_SUBJECTS)).alias("is_passive"), F.max(F.col("dep") == "neg").alias("is_negated"),
    )
    none = F.array().cast("array<struct<token_i:bigint,w:string>>")
    return verbs.join(facts, ["doc_id", "predicate_i"], "left").withColumn("particles", F.coalesce("particles", none)).select(
        "doc_id", "predicate_i", "sentence_id", F.concat_ws("_", "base", F.transform("particles", lambda p: p["w"])).alias("label"), F.coalesce("is_passive", F.lit(False)).alias("is_passive"), F.coalesce("is_negated", F.lit(False)).alias("is_negated"),
        F.least(F.col("predicate_i"), F.coalesce(F.array_min(F.transform("particles", lambda p: p["token_i"])), F.col("predicate_i"))).alias("predicate_start"),
        (F.greatest(F.col("predicate_i"), F.coalesce(F.array_max(F.transform("particles", lambda p: p["token_i"])), F.col("predicate_i"))) + 1).alias("predicate_end"),
    )


def arguments(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subjects, objects) of heads: (doc_id, predicate_i, token_i[, dep, prep_i, prep]) with objects of prepositions included."""
    child = tokens.where("token_i <> head_i")
    subjects = child.where(F.col("dep").isin(SUBJECTS)).select("doc_id", F.col("head_i").alias("predicate_i"), "token_i")
    none = (F.lit(None).cast("bigint").alias("prep_i"), F.lit(None).cast("string").alias("prep"))
    direct = child.where(F.col("dep").isin(OBJECTS)).select("doc_id", F.col("head_i").alias("predicate_i"), "token_i", "dep", *none)
    prep = child.where(F.col("dep") == "prep").select("doc_id", F.col("token_i").alias("prep_i"), F.col("head_i").alias("predicate_i"), F.lower(F.coalesce(F.nullif("lemma", F.lit("")), F.col("text"))).alias("prep"))
    inner = child.where(F.col("dep").isin(PREPOSITION_OBJECTS)).select("doc_id", F.col("head_i").alias("prep_i"), "token_i", "dep")
    return subjects, direct.union(inner.join(prep, ["doc_id", "prep_i"]).select("doc_id", "predicate_i", "token_i", "dep", "prep_i", "prep"))


def relation_candidates(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """Predicates whose subject and object are mentions of different clusters, one row per pair of mentions."""
    subjects, objects = arguments(tokens)
    at = mentions_at_tokens(subjects.select("doc_id", "token_i").union(objects.select("doc_id", "token_i")), mentions)
    source = subjects.join(at, ["doc_id", "token_i"]).select("doc_id", "predicate_i", F.col("mention_id").alias("source_mention_id"), F.col("cluster_id").alias("source_cluster_id"))
    target = objects.join(at, ["doc_id", "token_i"]).select("doc_id", "predicate_i", "dep", "prep_i", "prep", F.col("mention_id").alias("target_mention_id"), F.col("cluster_id").alias("target_cluster_id"))
    pairs = predicates(tokens).join(source, ["doc_id", "predicate_i"]).join(target, ["doc_id", "predicate_i"]).where("source_cluster_id <> target_cluster_id")
    return pairs.select(
        "doc_id", X.relation_id("source_mention_id", "predicate_i", "target_mention_id").alias("relation_id"), "source_mention_id", F.col("predicate_i").alias("predicate_token_i"),
        F.least("predicate_start", F.coalesce("prep_i", "predicate_start")).alias("predicate_start"), F.greatest("predicate_end", F.coalesce(F.col("prep_i") + 1, F.col("predicate_end"))).alias("predicate_end"), "target_mention_id", "source_cluster_id", "target_cluster_id",
        F.concat_ws("_", "label", "prep").alias("predicate_label"), F.col("dep").alias("object_dep"), "is_passive", "is_negated", "sentence_id",
    ).distinct()


_EDGES = re.compile(r"\A[\W_]+|[\W_]+\Z")
_VERB = re.compile(r"[a-z]{2,}ed")


@lru_cache(200_000)
def _word_facts(token: str) -> tuple[str, bool, bool]:
    """(lemma, whether a verb, whether a name) of a token under ``tokens.rule_syntax``."""
    word = _EDGES.sub("", token)
    return word.lower(), bool(_VERB.fullmatch(word)), len(word) > 1 and unicodedata.category(word[0]) == "Lu" and word[1].isalpha()


def sentence_candidates(facts: list[tuple[str, bool, bool]]) -> Iterator[tuple]:
    """(source, predicate, predicate's start and end, target, label, dep, passive, negated) of one sentence, its words counted from 0.

    Under the rule-based syntax all objects hang on the last verb of their sentence, so no other has candidates.
    """
    verbs = [k for k, (_, verb, _) in enumerate(facts) if verb]
    if not verbs:
        return
    at, after = verbs[-1], verbs[-2] + 1 if len(verbs) > 1 else 0
    lemma = [f[0] for f in facts]
    held = len(verbs) > 1  # a preposition behind a verb hangs on it
    before = lemma[at - 1] if at > after else ""
    particle = at + 1 < len(facts) and lemma[at + 1] in PARTICLES
    subjects = [k for k in range(after, at) if facts[k][2] and not (k == at - 1 and (before == "not" or before in PASSIVE)) and not (held and (lemma[k] in PREPOSITIONS or k == after and lemma[k] in PARTICLES))]
    label = f"{lemma[at]}_{lemma[at + 1]}" if particle else lemma[at]
    for k in range(at + 1 + particle, len(facts)) if subjects else ():
        if not facts[k][2] or lemma[k] in PREPOSITIONS:
            continue
        prep = lemma[k - 1] if lemma[k - 1] in PREPOSITIONS else None
        start, end = (at, max(at + 1 + particle, k)) if prep else (at, at + 1 + particle)
        for s in subjects:
            if lemma[s] != lemma[k]:
                yield s, at, start, end, k, f"{label}_{prep}" if prep else label, "pobj" if prep else "dobj", before in PASSIVE, before == "not"


def rule_candidates(documents: DataFrame) -> DataFrame:
    """:func:`relation_candidates` under ``tokens.rule_syntax``, the names themselves being the mentions of a cluster for each lemma.

    Made sentence by sentence from whole documents (doc_id, text, sentence_starts): heads never leave a
    sentence, so only candidates leave the task.
    """

    def found(doc: int, text: str | None, begins: list | None) -> Iterator[tuple]:
        facts = [_word_facts(w) for w in words_of(text)]
        starts = starts_within(begins, len(facts))
        for a, b in zip(starts, [*starts[1:], len(facts)]):
            for s, p, first, end, o, *rest in sentence_candidates(facts[a:b]):
                yield doc, a + s, a + p, a + first, a + end, a + o, *rest

    schema = "doc_id bigint, source_mention_id bigint, predicate_token_i bigint, predicate_start bigint, predicate_end bigint, target_mention_id bigint, predicate_label string, object_dep string, is_passive boolean, is_negated boolean"
    rows = per_document(documents.select("doc_id", "text", "sentence_starts"), found, schema)
    return rows.select("doc_id", X.relation_id("source_mention_id", "predicate_token_i", "target_mention_id").alias("relation_id"), *rows.columns[1:]).distinct()


def route_candidates(candidates: DataFrame, typing: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, discarded): candidates with the properties their clusters' classes allow, and those with a reason instead.

    ``typing``: (doc_id, cluster_id, class_iri); ``routes``: (source_class, target_class, properties), a
    table as small as the ontology.
    """
    side = lambda s: typing.select("doc_id", F.col("cluster_id").alias(f"{s}_cluster_id"), F.col("class_iri").alias(f"{s}_class"))
    typed = candidates.join(side("source"), ["doc_id", "source_cluster_id"], "left").join(side("target"), ["doc_id", "target_cluster_id"], "left")
    routed = typed.join(checked_broadcast(routes, MAX_ROUTES, "the routes"), ["source_class", "target_class"], "left")
    reason = F.when(F.col("source_class").isNull(), "source cluster has no class").when(F.col("target_class").isNull(), "target cluster has no class").when(F.coalesce(F.size("properties"), F.lit(0)) <= 0, F.concat(F.lit("no property from "), X.short_iri("source_class"), F.lit(" to "), X.short_iri("target_class")))
    marked = routed.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").drop("properties")


def premise(sentence: Column, source: Column, predicate: Column, target: Column) -> Column:
    return F.concat(F.lit("Context: "), sentence, F.lit("\n\nExtracted relation:\n"), source, F.lit(" -- "), predicate, F.lit(" -- "), target, F.lit("."))


def assign_properties(routed: DataFrame, logit=overlap_logit) -> DataFrame:
    """(doc_id, relation_id, probabilities, selection_method): a softmax over each relation's candidate properties.

    ``routed``: (doc_id, relation_id, premise, properties array<struct<iri, label, description>>). One
    candidate is certain without scoring; the candidates of a relation never leave its row.
    """
    texts = F.transform("properties", lambda p: F.coalesce(F.nullif(p["description"], F.lit("")), F.nullif(p["label"], F.lit("")), X.human_label(p["iri"])))
    scores = P.softmax_array(F.transform(texts, lambda t: logit(F.col("premise"), t)))
    single = F.size("properties") == 1
    return routed.where("size(properties) > 0").select(
        "doc_id", "relation_id", F.map_from_arrays(F.transform("properties", lambda p: p["iri"]), F.when(single, F.array(F.lit(1.0))).otherwise(scores)).alias("probabilities"),
        F.when(single, "single_candidate_router").otherwise("nli_grouped_softmax").alias("selection_method"),
    )


def probabilities_of(column: str = "object_property_probabilities_json", logits: str | None = None) -> Column:
    """The map of a JSON cell; where it is missing, the softmax of legacy logits."""
    p = F.from_json(column, "map<string,double>")
    return F.coalesce(p, P.softmax_map(F.from_json(logits, "map<string,double>"))) if logits else p


def latest_relations(assignments: DataFrame) -> DataFrame:
    """The last delivery of each relation, by arrival and number."""
    rest = [c for c in assignments.columns if c not in ("doc_id", "relation_id")]
    return assignments.groupBy("doc_id", "relation_id").agg(F.max_by(F.struct(*rest), F.struct("arrived_at", "delivery_id")).alias("_r")).select("doc_id", "relation_id", "_r.*")


def exploded(assignments: DataFrame, probabilities: Column | None = None) -> DataFrame:
    """One row per relation and property: (.., ordinal, property, p, is_winner); the first written wins a tie."""
    rows = assignments.withColumn("_m", probabilities if probabilities is not None else probabilities_of())
    return rows.withColumn("_w", P.first_best_key(F.col("_m"))).select("doc_id", "relation_id", "source_cluster_id", "target_cluster_id", "_w", F.posexplode(F.map_entries("_m")).alias("ordinal", "_e")).select(
        "doc_id", "relation_id", "source_cluster_id", "target_cluster_id", "ordinal", F.col("_e.key").alias("property"), F.col("_e.value").alias("p"), (F.col("_e.key") == F.col("_w")).alias("is_winner"),
    )


def assertions(assignments: DataFrame, least_support: int = 2, least_score: float = 0.75, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(.., source_cluster_id, object_property_iri, target_cluster_id, support_relation_ids, aggregated_score) by Noisy-OR.

    All probabilities of a property count towards the score, only the relations whose winner it is
    towards the support. Partial sums are formed before the shuffle.
    """
    grouped = exploded(assignments).groupBy(*by, "source_cluster_id", "target_cluster_id", F.col("property").alias("object_property_iri")).agg(
        P.noisy_or(F.col("p")).alias("aggregated_score"), F.array_sort(F.collect_list(F.when(F.col("is_winner"), F.col("relation_id")))).alias("support_relation_ids"),
    )
    kept = grouped.where((F.size("support_relation_ids") >= least_support) & (F.col("aggregated_score") >= least_score))
    return kept.withColumn("cluster_assertion_id", X.assertion_id("source_cluster_id", "object_property_iri", "target_cluster_id")).withColumn("aggregation_method", F.lit("noisy-or"))


def assertions_by_sum(assignments: DataFrame, least_support: int = 1, least_score: float = 0.0, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The older aggregation: one property per pair of clusters, the largest sum; all relations of the pair support it."""
    keys = [*by, "source_cluster_id", "target_cluster_id"]
    sums = exploded(assignments).groupBy(*keys, "property").agg(F.sum("p").alias("s"), F.min(F.struct("relation_id", "ordinal")).alias("first"))
    rank = Window.partitionBy(*keys).orderBy(F.col("s").desc(), "first")
    chosen = sums.withColumn("_k", F.row_number().over(rank)).where("_k = 1").select(*keys, F.col("property").alias("object_property_iri"), F.col("s").alias("aggregated_score"))
    support = assignments.groupBy(*keys).agg(F.array_sort(F.collect_list("relation_id")).alias("support_relation_ids"))
    return chosen.join(support, keys).where((F.size("support_relation_ids") >= least_support) & (F.col("aggregated_score") >= least_score))


def dangling_references(assertion_rows: DataFrame, clusters: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, key) of assertions whose clusters or supporting relations do not exist."""
    ends = assertion_rows.select("doc_id", F.explode(F.array("source_cluster_id", "target_cluster_id")).alias("cluster_id")).distinct()
    missing = ends.join(clusters.select("doc_id", "cluster_id").distinct(), ["doc_id", "cluster_id"], "left_anti").select(F.lit("cluster").alias("kind"), F.concat_ws(":", "doc_id", "cluster_id").alias("key"))
    support = assertion_rows.select("doc_id", F.explode("support_relation_ids").alias("relation_id")).distinct()
    lost = support.join(relations.select("doc_id", "relation_id").distinct(), ["doc_id", "relation_id"], "left_anti").select(F.lit("relation").alias("kind"), F.concat_ws(":", "doc_id", "relation_id").alias("key"))
    return missing.union(lost)


# Indexes of assertions and lookups


def assertion_index(assertion_rows: DataFrame, by: str) -> DataFrame:
    """(doc_id, key, assertion_ids): the assertions of each source cluster, target cluster or property, sorted."""
    column = {"source": "source_cluster_id", "target": "target_cluster_id", "property": "object_property_iri"}[by]
    return assertion_rows.groupBy("doc_id", F.col(column).cast("string").alias("key")).agg(F.array_sort(F.collect_set("cluster_assertion_id")).alias("assertion_ids"))


def assertions_of(assertion_rows: DataFrame, source: int | None = None, target: int | None = None, iri: str | None = None, doc_id: int | None = None) -> DataFrame:
    """The assertions that have every given source, target, property and document."""
    for column, value in (("source_cluster_id", source), ("target_cluster_id", target), ("object_property_iri", iri), ("doc_id", doc_id)):
        if value is not None:
            assertion_rows = assertion_rows.where(F.col(column) == value)
    return assertion_rows


def relation_summary(relations: DataFrame, assignments: DataFrame, assertion_rows: DataFrame) -> DataFrame:
    """(doc_id, n_relation_instances, n_relation_assignments, n_relation_assertions, n_source_cluster_indexes, n_target_cluster_indexes, n_property_indexes)."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count_distinct("relation_id").alias(name))
    a = assertion_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_relation_assertions"), F.count_distinct("source_cluster_id").alias("n_source_cluster_indexes"), F.count_distinct("target_cluster_id").alias("n_target_cluster_indexes"), F.count_distinct("object_property_iri").alias("n_property_indexes"))
    whole = count(relations, "n_relation_instances").join(count(assignments, "n_relation_assignments"), "doc_id", "full").join(a, "doc_id", "full")
    return whole.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in whole.columns if c != "doc_id"))


def unassigned(candidates: DataFrame, assignments: DataFrame) -> DataFrame:
    """Candidates without an assignment yet: what a resumed run has left to score."""
    return candidates.join(assignments.select("doc_id", "relation_id").distinct(), ["doc_id", "relation_id"], "left_anti")


def routed_records(routed: DataFrame) -> DataFrame:
    """(doc_id, record): routed candidates in the nested form of the exchanged JSON lines, their properties in order."""
    rest = [c for c in routed.columns if c not in ("doc_id", "properties")]
    return routed.select("doc_id", F.to_json(F.struct(*rest, F.transform("properties", lambda p: F.struct(p["iri"].alias("iri"), p["label"].alias("label"), p["description"].alias("description"))).alias("candidate_properties"))).alias("record"))
