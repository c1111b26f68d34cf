"""Readers and writers at the edge: texts, CSV, JSON lines, zipped tables, SQLite caches.

Tables inside the engine are Parquet; these formats are for exchange. Readers take explicit schemas
and fail on malformed rows instead of guessing.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not valid UTF-8."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for b in s:
                try:
                    out.append(None if b is None else bytes(b).decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(bytes(b).decode("latin-1"))
            yield pd.Series(out)

    return decode(content)


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text): one row per file; UTF-8 with Latin-1 as the way out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(F.col("content")).alias("text"))


def first_existing(*paths: str | Path) -> Path:
    """The first path that exists; an error names all of them."""
    for p in paths:
        if Path(p).exists():
            return Path(p)
    raise FileNotFoundError("none of " + ", ".join(map(str, paths)))


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """Rows of a CSV with exactly this header; empty cells are null, malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"').option("multiLine", True).option("sep", separator).option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, separator: str = ",", mode: str = "error") -> None:
    """Fixed columns in order; columns the table lacks are written empty, others are left out."""
    chosen = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in (columns or df.columns)]
    df.select(*chosen).na.fill("").write.mode(mode).option("header", True).option("sep", separator).option("escape", '"').option("emptyValue", "").csv(path)


def write_tsv(tokens: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(tokens, path, separator="\t", mode=mode)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines folder or file; blank lines are skipped, anything else that is no object fails."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    checked = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 60))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def require_version(df: DataFrame, version: int, column: str = "schema_version") -> DataFrame:
    """The rows, with an error raised for any other (or no) version."""
    wrong = F.raise_error(F.concat(F.lit(f"{column} must be {version}, not "), F.coalesce(F.col(column).cast("string"), F.lit("missing"))))
    return df.withColumn(column, F.when(F.col(column) == version, F.col(column)).otherwise(wrong.cast(dict(df.dtypes)[column])))


def read_zip_tables(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The CSV tables of one zip archive (an exchange format that fits on the driver)."""
    out = {}
    with zipfile.ZipFile(path) as archive:
        for name, schema in schemas.items():
            rows = list(csv.DictReader(io.TextIOWrapper(archive.open(f"{name}.csv"), "utf-8", newline="")))
            columns = [c.split()[0] for c in schema.split(",")]
            raw = spark.createDataFrame([tuple(r[c] or None for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
            out[name] = raw.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in (x.strip() for x in schema.split(","))))
    return out


def write_zip_tables(tables: dict[str, DataFrame], metadata: dict, path: str, max_rows: int = 1_000_000) -> None:
    """Tables and a metadata object in one zip; larger tables are refused, not cut."""
    from loomgraph.runtime import bounded_rows

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, df in tables.items():
            text = io.StringIO()
            out = csv.writer(text, lineterminator="\n")
            out.writerow(df.columns)
            out.writerows(["" if v is None else v for v in r] for r in bounded_rows(df, max_rows, name))
            archive.writestr(f"{name}.csv", text.getvalue())
        archive.writestr("metadata.json", json.dumps(metadata, sort_keys=True, indent=1))


def read_sqlite_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, payload_json, created_at_unix) of a score cache kept in SQLite."""
    with sqlite3.connect(path) as db:
        rows = db.execute("SELECT cache_key, payload_json, created_at_unix FROM probability_cache").fetchall()
    return spark.createDataFrame(rows, "cache_key string, payload_json string, created_at_unix double")


def read_folder_by_cluster(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines evidence of a folder, one cluster per file and one file per cluster, or an error."""
    rows = spark.read.schema(schema).json(path).withColumn("_file", F.input_file_name())
    per_file = rows.groupBy("_file").agg(F.count_distinct("cluster_id").alias("n")).where("n <> 1")
    per_cluster = rows.groupBy("cluster_id").agg(F.count_distinct("_file").alias("n")).where("n <> 1")
    bad = [f"{r[0]}: {r[1]} clusters" for r in per_file.limit(10).collect()] + [f"cluster {r[0]}: {r[1]} files" for r in per_cluster.limit(10).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    return rows.drop("_file")


_TERM = re.compile(r'"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<short>(?:[^"\\\n]|\\.)*)"|<(?P<iri>[^>]*)>|(?P<at>@prefix|@base|PREFIX|BASE)(?=\s)|(?P<punct>[;,.\[\](){}]|\^\^)|@(?P<lang>[A-Za-z-]+)|(?P<graph>GRAPH)(?=[\s{])|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+))|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:|a(?=\s)|true|false)|#[^\n]*|\s+', re.S)


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Triples (s, p, o, o_kind, datatype) of a Turtle, TriG or N-Triples text: prefixes, lists of objects and predicates, blank nodes, collections, literals."""
    rdf, xsd = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
    tokens, at = [], 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"cannot read Turtle at {text[at:at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    prefixes: dict[str, str] = {}
    base, out, blank, k = "", [], 0, 0
    unescape = lambda s: re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), s, flags=re.S)

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:g{blank}"

    def term(k: int):
        kind, value = tokens[k]
        if kind == "iri":
            return (value if re.match(r"[A-Za-z][\w+.-]*:", value) else base + value, "iri", None), k + 1
        if kind == "name":
            if value == "a":
                return (rdf + "type", "iri", None), k + 1
            if value in ("true", "false"):
                return (value, "literal", xsd + "boolean"), k + 1
            prefix, _, local = value.partition(":")
            return (prefixes[prefix] + local, "iri", None), k + 1
        if kind == "blank":
            return (value, "blank", None), k + 1
        if kind == "number":
            return (value, "literal", xsd + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")), k + 1
        if kind in ("long", "short"):
            value = unescape(value)
            if k + 1 < len(tokens) and tokens[k + 1][0] == "lang":
                return (value, "literal", None), k + 2
            if k + 1 < len(tokens) and tokens[k + 1] == ("punct", "^^"):
                (datatype, _, _), k = term(k + 2)
                return (value, "literal", datatype), k
            return (value, "literal", None), k + 1
        if value == "[":
            node = fresh()
            return (node, "blank", None), statements(node, k + 1, "]") + 1
        if value == "(":
            head = node = None
            k += 1
            while tokens[k] != ("punct", ")"):
                item, k = term(k)
                link = fresh()
                if node:
                    out.append((node, rdf + "rest", link, "blank", None))
                head, node = head or link, link
                out.append((node, rdf + "first", *item))
            if node:
                out.append((node, rdf + "rest", rdf + "nil", "iri", None))
            return ((head, "blank", None) if head else (rdf + "nil", "iri", None)), k + 1
        raise ValueError(f"unexpected {value!r} in Turtle")

    def statements(subject: str, k: int, end: str) -> int:
        while tokens[k] not in (("punct", end), ("punct", "}")):
            if tokens[k] == ("punct", ";"):
                k += 1
                continue
            (predicate, _, _), k = term(k)
            while True:
                o, k = term(k)
                out.append((subject, predicate, *o))
                if tokens[k] != ("punct", ","):
                    break
                k += 1
        return k

    while k < len(tokens):
        kind, value = tokens[k]
        if kind == "at":
            if value.lower().endswith("prefix"):
                prefixes[tokens[k + 1][1].rstrip(":")] = tokens[k + 2][1]
                k += 3
            else:
                base = tokens[k + 1][1]
                k += 2
            k += k < len(tokens) and tokens[k] == ("punct", ".")
            continue
        if (kind, value) in (("punct", "{"), ("punct", "}"), ("graph", "GRAPH")):
            k += 1
            continue
        (subject, _, _), k = term(k)
        if tokens[k] == ("punct", "{"):  # a graph's name
            k += 1
            continue
        k = statements(subject, k, ".")
        k += tokens[k] == ("punct", ".")
    return out


def parse_nquads(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Triples of an N-Quads text, whatever graph they belong to."""
    quad = re.compile(r'(?P<t>\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+(?:<[^>]*>|_:\S+?|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w-]+)?))(?:\s+(?:<[^>]*>|_:\S+?))?\s*\.\s*(?:#.*)?$')
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            m = quad.match(line)
            if not m:
                raise ValueError(f"line {number} is no quad: {line[:60]!r}")
            out += parse_turtle(m["t"] + " .")
    return out


def parse_rdf_xml(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Triples of an RDF/XML text: nodes and properties in any nesting, property attributes, parse types, datatypes, xml:base."""
    from xml.etree import ElementTree

    rdf, xml = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
    name = lambda tag: tag.replace("{", "").replace("}", "")
    out: list[tuple] = []
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def absolute(iri: str, base: str) -> str:
        from urllib.parse import urljoin

        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base.split("#")[0] + iri if iri.startswith("#") or not iri else urljoin(base, iri)

    def identity(e, base: str) -> str:
        if rdf + "about" in e.attrib:
            return absolute(e.attrib[rdf + "about"], base)
        if rdf + "ID" in e.attrib:
            return absolute("#" + e.attrib[rdf + "ID"], base)
        return "_:" + e.attrib[rdf + "nodeID"] if rdf + "nodeID" in e.attrib else fresh()

    kind = lambda node: "blank" if node.startswith("_:") else "iri"

    def node(e, base: str) -> str:
        base = e.attrib.get(xml + "base", base)
        subject = identity(e, base)
        if e.tag != rdf + "Description":
            out.append((subject, name(rdf) + "type", name(e.tag), "iri", None))
        for attribute, value in e.attrib.items():
            if not attribute.startswith((xml, rdf)) or attribute == rdf + "type":
                out.append((subject, name(attribute), value, "iri" if attribute == rdf + "type" else "literal", None))
        items = 0
        for p in e:
            items += p.tag == rdf + "li"
            prop(subject, p, f"{name(rdf)}_{items}" if p.tag == rdf + "li" else name(p.tag), base)
        return subject

    def prop(subject: str, e, predicate: str, base: str) -> None:
        base = e.attrib.get(xml + "base", base)
        parse = e.attrib.get(rdf + "parseType")
        if rdf + "resource" in e.attrib:
            out.append((subject, predicate, absolute(e.attrib[rdf + "resource"], base), "iri", None))
        elif rdf + "nodeID" in e.attrib:
            out.append((subject, predicate, "_:" + e.attrib[rdf + "nodeID"], "blank", None))
        elif parse == "Collection":
            links = [fresh() for _ in e] + [name(rdf) + "nil"]
            out.append((subject, predicate, links[0], kind(links[0]), None))
            for link, after, member in zip(links, links[1:], e):
                item = node(member, base)
                out.extend([(link, name(rdf) + "first", item, kind(item), None), (link, name(rdf) + "rest", after, kind(after), None)])
        elif parse == "Resource":
            inner = fresh()
            out.append((subject, predicate, inner, "blank", None))
            for p in e:
                prop(inner, p, name(p.tag), base)
        elif parse == "Literal":
            out.append((subject, predicate, (e.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in e), "literal", name(rdf) + "XMLLiteral"))
        elif len(e):
            inner = node(e[0], base)
            out.append((subject, predicate, inner, kind(inner), None))
        else:
            out.append((subject, predicate, e.text or "", "literal", e.attrib.get(rdf + "datatype")))

    root = ElementTree.fromstring(text)
    base = root.attrib.get(xml + "base", "")
    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, base)
    return out


def parse_jsonld(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Triples of a JSON-LD text with its context inside: terms, prefixes, typed terms, lists, nested nodes, graphs. Contexts by address are refused."""
    rdf, xsd = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
    out: list[tuple] = []
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:j{count}"

    def extended(context: dict, more) -> dict:
        for part in more if isinstance(more, list) else [more]:
            if isinstance(part, str):
                raise ValueError(f"the context at {part} is not in the text")
            context = {**context, **(part or {})}
        return context

    def iri(term: str, context: dict, vocabulary: bool = True) -> str:
        known = context.get(term) if vocabulary else None
        if known is not None:
            return iri(known["@id"] if isinstance(known, dict) else known, {k: v for k, v in context.items() if k != term})
        prefix, colon, local = term.partition(":")
        if colon and prefix in context and not local.startswith("//"):
            return iri(prefix, context) + local
        return term if colon else (context.get("@vocab") if vocabulary else context.get("@base", "")) + term if not colon and (not vocabulary or context.get("@vocab")) else term

    def value_of(v, how: str | None, context: dict) -> tuple:
        if isinstance(v, dict) and "@value" in v:
            plain = v["@value"]
            return (json.dumps(plain) if not isinstance(plain, str) else plain, "literal", iri(v["@type"], context) if "@type" in v else None)
        if isinstance(v, dict) and "@list" in v:
            links = [fresh() for _ in v["@list"]] + [rdf + "nil"]
            for link, after, member in zip(links, links[1:], v["@list"]):
                out.extend([(link, rdf + "first", *value_of(member, how, context)), (link, rdf + "rest", after, "iri" if after.endswith("nil") else "blank", None)])
            return links[0], "iri" if links[0].endswith("nil") else "blank", None
        if isinstance(v, dict):
            inner = node(v, context)
            return inner, "blank" if inner.startswith("_:") else "iri", None
        if how in ("@id", "@vocab") and isinstance(v, str):
            return iri(v, context, how == "@vocab"), "iri", None
        if isinstance(v, bool):
            return str(v).lower(), "literal", xsd + "boolean"
        if isinstance(v, (int, float)):
            return str(v), "literal", xsd + ("integer" if isinstance(v, int) else "double")
        return v, "literal", iri(how, context) if how else None

    def node(e: dict, context: dict) -> str:
        context = extended(context, e.get("@context"))
        subject = iri(e["@id"], context, False) if "@id" in e else fresh()
        for key, value in e.items():
            if key == "@type":
                out.extend((subject, rdf + "type", iri(t, context), "iri", None) for t in (value if isinstance(value, list) else [value]))
            elif key == "@graph":
                for inner in value:
                    node(inner, context)
            elif not key.startswith("@"):
                spec = context.get(key)
                how = spec.get("@type") if isinstance(spec, dict) else None
                lists = isinstance(spec, dict) and spec.get("@container") == "@list"
                for v in [{"@list": value}] if lists and not isinstance(value, dict) else value if isinstance(value, list) else [value]:
                    if v is not None:
                        out.append((subject, iri(key, context), *value_of(v, how, context)))
        return subject

    whole = json.loads(text)
    for e in whole if isinstance(whole, list) else [whole]:
        node(e, {})
    return out


PARSERS = {"turtle": parse_turtle, "nt": parse_turtle, "trig": parse_turtle, "nquads": parse_nquads, "xml": parse_rdf_xml, "json-ld": parse_jsonld}


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Triples of an ontology file (read on the driver) in the format its suffix stands for."""
    rows = PARSERS[rdf_format(path)](Path(path).read_text("utf-8"))
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string")


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a Turtle or N-Triples file (an ontology, read on the driver)."""
    return spark.createDataFrame(parse_turtle(Path(path).read_text("utf-8")), "s string, p string, o string, o_kind string, datatype string")


def rdf_format(path: str) -> str:
    """The RDF format a suffix stands for."""
    known = {".ttl": "turtle", ".nt": "nt", ".owl": "xml", ".rdf": "xml", ".xml": "xml", ".nq": "nquads", ".jsonld": "json-ld", ".trig": "trig"}
    suffix = Path(path).suffix.lower()
    if suffix not in known:
        raise ValueError(f"unknown RDF suffix {suffix}")
    return known[suffix]


def ntriple(s: str = "s", p: str = "p", o: str = "o", kind: str = "o_kind", datatype: str = "datatype") -> Column:
    """A triple as one N-Triples line (which is Turtle, too), for a text sink of any size."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    escaped = F.col(o)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), F.col(datatype), F.lit(">")), F.lit("")))
    return F.concat(node(s), F.lit(" <"), F.col(p), F.lit("> "), F.when(F.col(kind) == "literal", literal).otherwise(node(o)), F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    triples.select(ntriple().alias("value")).write.mode(mode).text(path)


def output_name(kind: str, cluster: Column, name: Column, amount: str = "all") -> Column:
    """A file name for one cluster's evidence."""
    return F.concat_ws("_", F.lit(kind), F.lit("cluster"), cluster.cast("string"), X.safe_name(name), F.lit(amount))
