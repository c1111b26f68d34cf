"""Ontology as tables: class graph, properties, closure, routing, population.

Everything here is as small as an ontology; what is collected is checked against a limit, and joins leave
it to adaptive execution, which knows the sizes, whether a side is sent out.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.runtime import bounded_rows, checked_broadcast

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DC = "http://purl.org/dc/elements/1.1/"
TYPE = RDF + "type"
THING = OWL + "Thing"
TRIPLES = "s string, p string, o string, o_kind string, datatype string"

DEFAULT = Path(__file__).resolve().parent.parent / "data" / "narrative.ttl"
DEFAULT_BASE = "https://example.org/narrative#"


def default_triples(spark: SparkSession, base: str = DEFAULT_BASE) -> DataFrame:
    """The default ontology, read from its Turtle file, with its terms in the namespace ``base``."""
    from loomgraph.sources.files import parse_turtle

    moved = lambda x: base + x[len(DEFAULT_BASE):] if x.startswith(DEFAULT_BASE) else x
    return spark.createDataFrame([(moved(s), moved(p), moved(o) if kind == "iri" else o, kind, datatype) for s, p, o, kind, datatype in parse_turtle(DEFAULT.read_text("utf-8"))], TRIPLES)


def first_literals(triples: DataFrame, predicates: list[str], name: str) -> DataFrame:
    """(iri, name): each subject's first non-empty literal, by the order of ``predicates``, then by text."""
    rank = F.array_position(F.array(*map(F.lit, predicates)), F.col("p"))
    return triples.where((rank > 0) & (F.length(F.trim("o")) > 0) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("iri")).agg(F.min_by("o", F.struct(rank.alias("r"), "o")).alias(name))


def class_table(triples: DataFrame) -> DataFrame:
    """(iri, local_name, label, human_readable_label, description) of the named classes."""
    classes = triples.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "Class", RDFS + "Class") & ~F.col("s").startswith("_:") & (F.col("s") != THING)).select(F.col("s").alias("iri")).distinct()
    labels = first_literals(triples, [RDFS + "label", SKOS + "prefLabel"], "label")
    notes = first_literals(triples, [RDFS + "comment", SKOS + "definition", DC + "description"], "description")
    rows = classes.join(labels, "iri", "left").join(notes, "iri", "left").withColumn("local_name", X.local_name("iri"))
    return rows.select("iri", "local_name", F.coalesce("label", "local_name").alias("label"), X.human_label(F.coalesce("label", "local_name")).alias("human_readable_label"), F.coalesce("description", F.lit("")).alias("description"))


def subclass_table(triples: DataFrame, classes: DataFrame) -> DataFrame:
    """(parent_iri, child_iri) between named classes."""
    edges = triples.where(F.col("p") == RDFS + "subClassOf").select(F.col("o").alias("parent_iri"), F.col("s").alias("child_iri")).where("parent_iri <> child_iri").distinct()
    named = classes.select("iri")
    return edges.join(named.withColumnRenamed("iri", "parent_iri"), "parent_iri", "left_semi").join(named.withColumnRenamed("iri", "child_iri"), "child_iri", "left_semi").select("parent_iri", "child_iri")


def closure(classes: DataFrame, edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(ancestor, descendant, depth): every class with itself (0) and all above it, at the least depth.

    Paths are doubled each round, so the rounds are logarithmic in the depth; a cycle raises.
    """
    spark = classes.sparkSession
    links = bounded_rows(edges.select("parent_iri", "child_iri"), 1_000_000, "the class graph")
    nodes = [r[0] for r in bounded_rows(classes.select("iri"), 1_000_000, "the classes")]
    parents: dict[str, set[str]] = {}
    for r in links:
        parents.setdefault(r[1], set()).add(r[0])
    rows = []
    for node in nodes:
        seen, level, depth = {node: 0}, {node}, 0
        while level:
            depth += 1
            if depth > max_depth:
                raise ValueError(f"deeper than {max_depth} or cyclic at {node}")
            level = {p for n in level for p in parents.get(n, ())}
            if node in level:
                raise ValueError(f"the class graph has a cycle through {node}")
            level -= seen.keys()
            seen.update(dict.fromkeys(level, depth))
        rows += [(a, node, d) for a, d in seen.items()]
    return spark.createDataFrame(rows, "ancestor string, descendant string, depth int")


def roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return classes.join(edges.select(F.col("child_iri").alias("iri")), "iri", "left_anti")


def leaves(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return classes.join(edges.select(F.col("parent_iri").alias("iri")), "iri", "left_anti")


def children(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent_iri, ordinal, child_iri): children by folded label."""
    named = edges.join(classes.select(F.col("iri").alias("child_iri"), X.label_key("human_readable_label").alias("k")), "child_iri")
    return named.select("parent_iri", F.row_number().over(Window.partitionBy("parent_iri").orderBy("k", "child_iri")).alias("ordinal"), "child_iri")


def descendants(closed: DataFrame) -> DataFrame:
    return closed.where("depth > 0").select(F.col("ancestor").alias("iri"), F.col("descendant").alias("descendant_iri"))


def graph_errors(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(iri, error): missing labels, folded labels shared by several classes, edges to unknown classes."""
    key = X.label_key("human_readable_label")
    blank = classes.where(key == "").select("iri", F.lit("no label").alias("error"))
    shared = classes.withColumn("k", key).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("n > 1 and k <> ''").select("iri", F.lit("label not unique").alias("error"))
    ends = edges.select(F.explode(F.array("parent_iri", "child_iri")).alias("iri")).distinct().join(classes.select("iri"), "iri", "left_anti").select("iri", F.lit("unknown class").alias("error"))
    return blank.union(shared).union(ends)


def tree_lines(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, depth, line): the class graph as an indented tree in label order; a class under two parents shows twice."""
    label = classes.select(F.col("iri"), F.col("human_readable_label").alias("label"))
    level = roots(classes, edges).select("iri", F.col("human_readable_label").alias("label")).select("iri", F.lower("label").alias("path"), F.lit(0).alias("depth"), "label")
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        if depth > 64:
            raise ValueError("the class graph is deeper than 64 levels or cyclic")
        step = edges.join(level.select(F.col("iri").alias("parent_iri"), "path"), "parent_iri").join(label.withColumnRenamed("iri", "child_iri"), "child_iri")
        level = step.select(F.col("child_iri").alias("iri"), F.concat_ws("/", "path", F.lower("label")).alias("path"), F.lit(depth).alias("depth"), "label")
        out = out.union(level)
    return out.select("path", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), "label").alias("line"))


def property_table(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """(iri, local_name, label, human_readable_label, description, domains, ranges): ends without what is implied by a narrower end."""
    props = triples.where((F.col("p") == TYPE) & (F.col("o") == OWL + "ObjectProperty")).select(F.col("s").alias("iri")).distinct()

    def ends(predicate: str, name: str) -> DataFrame:
        e = triples.where((F.col("p") == predicate) & (F.col("o_kind") == "iri") & ~F.col("o").startswith("_:")).select(F.col("s").alias("iri"), F.col("o").alias("class")).distinct()
        return most_specific(e, closed, "iri").groupBy("iri").agg(F.array_sort(F.collect_set("class")).alias(name))

    rows = props.join(first_literals(triples, [RDFS + "label"], "label"), "iri", "left").join(first_literals(triples, [RDFS + "comment", SKOS + "definition"], "description"), "iri", "left").join(ends(RDFS + "domain", "domains"), "iri", "left").join(ends(RDFS + "range", "ranges"), "iri", "left")
    empty = F.array().cast("array<string>")
    name = F.coalesce("label", X.local_name("iri"))
    return rows.select("iri", X.local_name("iri").alias("local_name"), name.alias("label"), X.human_label(name).alias("human_readable_label"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("domains", empty).alias("domains"), F.coalesce("ranges", empty).alias("ranges"))


def most_specific(rows: DataFrame, closed: DataFrame, key: str, column: str = "class") -> DataFrame:
    """Rows (key, class) without classes that are ancestors of another class of the same key; Thing only where alone."""
    above = closed.where("depth > 0").select(F.col("descendant").alias(column), F.col("ancestor").alias("_a"))
    implied = rows.join(checked_broadcast(above, 1_000_000, "the closure"), column).select(key, F.col("_a").alias(column)).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.join(implied, [key, column], "left_anti").withColumn("_n", n).where((F.col("_n") == 1) | (F.col(column) != THING)).drop("_n")


def undescribed_properties(properties: DataFrame) -> DataFrame:
    return properties.where("trim(description) = ''").select("iri")


def route_table(properties: DataFrame, closed: DataFrame) -> DataFrame:
    """(source_class, target_class, iri): the properties whose domain and range the classes fall under, materialized once."""
    domain = properties.where("size(domains) > 0 and size(ranges) > 0").select("iri", F.explode("domains").alias("d"), "ranges").select("iri", "d", F.explode("ranges").alias("r"))
    below = lambda name: closed.select(F.col("ancestor").alias(name[0]), F.col("descendant").alias(name))
    things = closed.select(F.col("descendant").alias("c")).distinct()
    source = below("d_class").union(things.select(F.lit(THING), "c"))
    target = below("r_class").union(things.select(F.lit(THING), "c"))
    return domain.join(source, "d").join(target, "r").select(F.col("d_class").alias("source_class"), F.col("r_class").alias("target_class"), "iri").distinct()


def routes_by_pair(routes: DataFrame, properties: DataFrame) -> DataFrame:
    """(source_class, target_class, properties): candidate structs by IRI."""
    spec = properties.select("iri", F.struct("iri", "local_name", "label", "human_readable_label", "description", "domains", "ranges").alias("p"))
    return routes.join(spec, "iri").groupBy("source_class", "target_class").agg(F.array_sort(F.collect_list(F.struct("iri", "p"))).alias("_p")).select("source_class", "target_class", F.transform("_p", lambda x: x["p"]).alias("properties"))


def alias_table(classes: DataFrame) -> DataFrame:
    """(alias, iri): IRI, local name, label and folded forms of each class; the greatest IRI where an alias is shared."""
    forms = F.array("iri", "local_name", "label", "human_readable_label", X.identifier_key("iri"), X.label_key("label"), X.label_key("human_readable_label"))
    return classes.select("iri", F.explode(F.array_distinct(forms)).alias("alias")).groupBy("alias").agg(F.max("iri").alias("iri"))


def class_data_properties(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """(class, property, inherited): data properties required of a class by restrictions (also inside intersections) or by domain, and of its ancestors."""
    restriction = triples.where(F.col("p") == OWL + "onProperty").select(F.col("s").alias("node"), F.col("o").alias("property"))
    data = triples.where((F.col("p") == TYPE) & (F.col("o") == OWL + "DatatypeProperty")).select(F.col("s").alias("property")).distinct()
    sub = triples.where(F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass")).select(F.col("s").alias("class"), F.col("o").alias("node"))
    member = triples.where(F.col("p").isin(OWL + "intersectionOf", RDF + "first", RDF + "rest")).select(F.col("s").alias("node"), F.col("o").alias("next"))
    parts: dict[str, list[str]] = {}
    for r in bounded_rows(member, 1_000_000, "class expressions"):
        parts.setdefault(r[0], []).append(r[1])
    held: set[tuple[str, str]] = set()
    for cls, node in (tuple(r) for r in bounded_rows(sub, 1_000_000, "class axioms")):
        open_nodes, seen = [node], set()
        while open_nodes:
            at = open_nodes.pop()
            if at not in seen:
                seen.add(at)
                open_nodes += parts.get(at, [])
        held |= {(cls, n) for n in seen}
    reach = triples.sparkSession.createDataFrame(sorted(held), "class string, node string")
    direct = reach.join(restriction, "node").select("class", "property").union(triples.where(F.col("p") == RDFS + "domain").select(F.col("o").alias("class"), F.col("s").alias("property"))).join(data, "property", "left_semi").distinct()
    return direct.join(closed, direct["class"] == closed["ancestor"]).groupBy(F.col("descendant").alias("class"), "property").agg((F.min("depth") > 0).alias("inherited"))


def classes_with_all(class_properties: DataFrame, wanted: list[str]) -> DataFrame:
    """Relational division: classes that have every wanted property."""
    return class_properties.where(F.col("property").isin(wanted)).groupBy("class").agg(F.count_distinct("property").alias("n")).where(F.col("n") == len(set(wanted))).select("class")


def data_property_triples(spark: SparkSession, class_iri: str, properties: dict[str, str]) -> DataFrame:
    """Schema triples that give a class data properties: (name: datatype)."""
    base = class_iri[: max(class_iri.rfind("#"), class_iri.rfind("/")) + 1]
    rows = []
    for name, datatype in properties.items():
        rows += [(base + name, TYPE, OWL + "DatatypeProperty", "iri", None), (base + name, RDFS + "domain", class_iri, "iri", None), (base + name, RDFS + "range", XSD + datatype, "iri", None)]
    return spark.createDataFrame(rows, TRIPLES)


def normalized_base(base: str) -> str:
    return base if base.endswith(("#", "/", ":")) else base + "#"


def _triple(s: Column, p: Column | str, o: Column, kind: str, datatype: str | None = None) -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"))


def entity_iri(base: str, name: Column | str) -> Column:
    return F.concat(F.lit(normalized_base(base)), X.iri_local(name))


def entity_triples(entities: DataFrame, base: str, traits: list[str]) -> DataFrame:
    """Declaration, label, class and trait values of each entity (doc_id, canonical_name, class_iri, traits), in one pass over the rows."""
    iri = entity_iri(base, "canonical_name")
    always = [_triple(iri, TYPE, F.lit(OWL + "NamedIndividual"), "iri"), _triple(iri, RDFS + "label", F.col("canonical_name"), "literal")]
    cls = F.when(F.col("class_iri").isNotNull(), _triple(iri, TYPE, F.col("class_iri"), "iri"))
    scores = [F.when(F.col(t).isNotNull() & ~F.isnan(t), _triple(iri, normalized_base(base) + "hasOcean" + t.capitalize(), F.col(t), "literal", XSD + "double")) for t in traits]
    return entities.select(F.explode(F.filter(F.array(*always, cls, *scores), lambda x: x.isNotNull())).alias("t")).select("t.*")


def relation_triples(assertions: DataFrame, entities: DataFrame, base: str) -> DataFrame:
    """One triple per assertion between entities that exist (callers check the others with an anti-join)."""
    side = lambda s: entities.select("doc_id", F.col("cluster_id").alias(f"{s}_cluster_id"), entity_iri(base, "canonical_name").alias(s))
    joined = assertions.join(side("source"), ["doc_id", "source_cluster_id"]).join(side("target"), ["doc_id", "target_cluster_id"])
    return joined.select(F.col("source").alias("s"), F.col("object_property_iri").alias("p"), F.col("target").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype")).distinct()


def duplicate_names(entities: DataFrame) -> DataFrame:
    """(doc_id, name_key, n): folded names that several entities of a document share."""
    return entities.groupBy("doc_id", X.label_key("canonical_name").alias("name_key")).agg(F.count_distinct("cluster_id").alias("n")).where("n > 1")


def trait_property_iri(class_iri: str, trait: str) -> str:
    """The data property of a trait, in the namespace of the class that has it."""
    return class_iri[: max(class_iri.rfind("#"), class_iri.rfind("/")) + 1] + "hasOcean" + trait.capitalize()


def data_property_table(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """(class, direct, inherited): the data properties a class requires itself and those of its ancestors, sorted."""
    rows = class_data_properties(triples, closed)
    side = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("property"))))
    return rows.groupBy("class").agg(side(~F.col("inherited")).alias("direct"), side(F.col("inherited")).alias("inherited"))


def explain_pair(routes: DataFrame, properties: DataFrame, closed: DataFrame, source: str, target: str) -> DataFrame:
    """(iri, domain_fits, range_fits, routed) for every property: why a pair of classes has it or not."""
    above = lambda c: closed.where(F.col("descendant") == c).select(F.col("ancestor").alias("c"))
    up = {name: [r[0] for r in bounded_rows(above(c), 10_000, "the ancestors of a class")] + [THING] for name, c in (("domains", source), ("ranges", target))}
    fits = lambda name: F.arrays_overlap(name, F.array(*map(F.lit, up[name])))
    routed = routes.where((F.col("source_class") == source) & (F.col("target_class") == target)).select("iri", F.lit(True).alias("routed"))
    return properties.select("iri", fits("domains").alias("domain_fits"), fits("ranges").alias("range_fits")).join(routed, "iri", "left").withColumn("routed", F.coalesce("routed", F.lit(False)))


def clusters_to_score(typing: DataFrame, class_properties: DataFrame, wanted: list[str]) -> DataFrame:
    """Typed clusters whose class has every wanted data property."""
    return typing.join(classes_with_all(class_properties, wanted).withColumnRenamed("class", "class_iri"), "class_iri", "left_semi")


class Ontology:
    """An ontology with what is derived from it: classes, edges, closure, properties, routes, aliases; population and saving."""

    def __init__(self, triples: DataFrame):
        self.triples = triples
        self.classes = class_table(triples).cache()
        self.edges = subclass_table(triples, self.classes).cache()
        self.closed = closure(self.classes, self.edges).cache()
        self.properties = property_table(triples, self.closed)
        self.routes = route_table(self.properties, self.closed)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ontology:
        from loomgraph.sources.files import read_rdf

        return cls(read_rdf(spark, path))

    def errors(self) -> DataFrame:
        return graph_errors(self.classes, self.edges)

    def routes_by_pair(self) -> DataFrame:
        return routes_by_pair(self.routes, self.properties)

    def aliases(self) -> DataFrame:
        return alias_table(self.classes)

    def data_properties(self) -> DataFrame:
        return class_data_properties(self.triples, self.closed)

    def with_data_properties(self, class_iri: str, properties: dict[str, str]) -> Ontology:
        return Ontology(self.triples.union(data_property_triples(self.triples.sparkSession, class_iri, properties)).distinct())

    def populated(self, entities: DataFrame, assertions: DataFrame, base: str, traits: list[str]) -> DataFrame:
        """Schema and individuals as triples; assertions about unknown entities raise."""
        ends = assertions.select("doc_id", F.explode(F.array("source_cluster_id", "target_cluster_id")).alias("cluster_id")).distinct()
        lost = ends.join(entities.select("doc_id", "cluster_id"), ["doc_id", "cluster_id"], "left_anti").limit(20).collect()
        if lost:
            raise ValueError(f"assertions about unknown entities: {[tuple(r) for r in lost]}")
        return self.triples.union(entity_triples(entities, base, traits)).union(relation_triples(assertions, entities, base)).distinct()
