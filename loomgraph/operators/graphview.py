"""A property graph for display, projected from triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.ontology import OWL, RDF, RDFS, SKOS, TYPE, first_literals

SCHEMA_SPACES = [RDF, RDFS, OWL]
#: Trait names by folded local name.
TRAIT_NAMES = {**{f"{p}{t}": t for t in ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism") for p in ("", "hasocean", "ocean", "has")}}


def trait_name(predicate: Column | str) -> Column:
    """The trait a predicate stands for, null for others."""
    folded = F.lower(F.regexp_replace(X.local_name(predicate), "[^A-Za-z0-9]", ""))
    return F.create_map(*[x for k, v in sorted(TRAIT_NAMES.items()) for x in (F.lit(k), F.lit(v))])[folded]


def is_schema_triple() -> Column:
    """Triples that describe classes and properties rather than individuals."""
    schema = F.lit(False)
    for space in SCHEMA_SPACES:
        schema = schema | F.col("p").startswith(space)
    return schema & ((F.col("p") != TYPE) | F.col("o").startswith(OWL) | F.col("o").startswith(RDFS) | F.col("o").startswith(RDF))


def resource_types(triples: DataFrame) -> DataFrame:
    """(id, classes): the classes of each individual, sorted, without the vocabulary's own."""
    own = triples.where((F.col("p") == TYPE) & ~F.col("o").startswith(OWL) & ~F.col("o").startswith(RDFS))
    return own.groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set("o")).alias("classes"))


def relation_edges(triples: DataFrame) -> DataFrame:
    """(source, target, predicates): all relations between two resources as one edge with sorted short names."""
    facts = triples.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE) & ~is_schema_triple())
    return facts.groupBy(F.col("s").alias("source"), F.col("o").alias("target")).agg(F.array_sort(F.collect_set(X.local_name("p"))).alias("predicates"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def literals(triples: DataFrame, keep: int = 4) -> tuple[DataFrame, DataFrame]:
    """((id, literal_properties), (id, ocean_traits)): the first ``keep`` sorted literals, and the traits' last values."""
    lit = triples.where((F.col("o_kind") == "literal") & ~is_schema_triple()).withColumn("trait", trait_name("p"))
    value = F.when(F.col("datatype").isNotNull(), X.literal_text("o")).otherwise(F.col("o"))
    plain = lit.where("trait is null").groupBy(F.col("s").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.struct(X.local_name("p").alias("k"), value.alias("v")))), 1, keep).alias("literal_properties"))
    traits = lit.where("trait is not null").groupBy(F.col("s").alias("id"), F.col("trait").alias("k")).agg(F.max(value).alias("v")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("ocean_traits"))
    return plain, traits


def project(triples: DataFrame, max_nodes: int | None = None, max_edges: int | None = None, hide: list[str] | None = None, focus: list[str] | None = None, isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for display.

    Hidden classes leave with their edges; with ``focus`` only edges that touch a focused class stay;
    ``max_nodes`` keeps the resources of highest degree (ties by id) and ``max_edges`` the first edges
    by ends. Nodes: (id, label, classes, degree, literal_properties, ocean_traits).
    """
    types = resource_types(triples)
    edges = relation_edges(triples)
    if hide:
        hidden = types.where(F.arrays_overlap("classes", F.array(*map(F.lit, hide)))).select("id")
        for end in ("source", "target"):
            edges = edges.join(hidden.withColumnRenamed("id", end), end, "left_anti")
        types = types.join(hidden, "id", "left_anti")
    if focus:
        chosen = types.where(F.arrays_overlap("classes", F.array(*map(F.lit, focus)))).select("id", F.lit(True).alias("f"))
        edges = edges.join(chosen.toDF("source", "fs"), "source", "left").join(chosen.toDF("target", "ft"), "target", "left").where("fs or ft").drop("fs", "ft")
    if max_nodes is not None:
        top = degrees(edges).orderBy(F.col("degree").desc(), "id").limit(max_nodes).select("id")
        for end in ("source", "target"):
            edges = edges.join(top.withColumnRenamed("id", end), end, "left_semi")
    if max_edges is not None:
        edges = edges.orderBy("source", "target").limit(max_edges)
    edges = edges.select("source", "target", "predicates")
    ids = degrees(edges)
    if isolated and not focus:
        ids = types.select("id").join(ids, "id", "full").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    plain, traits = literals(triples)
    label = first_literals(triples, [RDFS + "label", SKOS + "prefLabel"], "label").withColumnRenamed("iri", "id")
    nodes = ids.join(label, "id", "left").join(types, "id", "left").join(plain, "id", "left").join(traits, "id", "left")
    return nodes.select("id", F.coalesce("label", X.local_name("id")).alias("label"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), "degree", "literal_properties", "ocean_traits"), edges


def class_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("classes").alias("class_iri")).groupBy("class_iri").agg(F.count(F.lit(1)).alias("n"))


def palette(nodes: DataFrame, colours: int = 12) -> DataFrame:
    """(class_iri, colour): classes in order, colours in turn. The class list is as small as the ontology."""
    names = nodes.select(F.explode("classes").alias("class_iri")).distinct()
    return names.select("class_iri", ((F.dense_rank().over(Window.orderBy("class_iri")) - 1) % colours).alias("colour"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, line): the projected graph in the DOT language, ready for a text sink."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = lambda c: F.concat(F.lit("n"), X.short_id(c, 12))
    label = F.concat_ws("\\n", X.truncate("label", 40), X.local_name(F.get("classes", 0)), F.array_join(F.transform("ocean_traits", lambda t: F.concat(F.upper(F.substring(t["k"], 1, 1)), F.lit(" "), t["v"])), " "))
    node_lines = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), name(F.col("id")), F.lit(" [label="), quote(label), F.lit("];")).alias("line"))
    edge_lines = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), name(F.col("source")), F.lit(" -> "), name(F.col("target")), F.lit(" [label="), quote(F.array_join("predicates", ", ")), F.lit("];")).alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, "digraph kg {"), (3, "}")], "part int, line string")
    return node_lines.union(edge_lines).union(frame)
