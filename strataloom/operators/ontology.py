"""Ontologies: schemas made from them, integrity rules, and a deterministic extractor that follows one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

TYPES = {"string": S.StringType(), "integer": S.LongType(), "float": S.DoubleType(), "boolean": S.BooleanType(), "list[string]": S.ArrayType(S.StringType())}


@dataclass(frozen=True)
class Property:
    name: str
    kind: str = "string"
    required: bool = False
    values: tuple[str, ...] = ()
    default: object = None


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class Relation:
    name: str
    source: str
    target: str
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class Ontology:
    name: str
    version: int = 1
    nodes: tuple[NodeType, ...] = ()
    relations: tuple[Relation, ...] = field(default=())

    def problems(self) -> list[str]:
        """Every broken rule: a name, a version from 1, no node type twice, no relation to an unknown type."""
        names = [n.name for n in self.nodes]
        out = [] if self.name.strip() else ["the name is empty"]
        out += [] if self.version >= 1 else ["the version is below 1"]
        out += [f"node type {n} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
        return out + [f"relation {r.name} has the unknown end {e}" for r in self.relations for e in (r.source, r.target) if e not in names]


def struct_of(properties: tuple[Property, ...]) -> S.StructType:
    return S.StructType([S.StructField("id", S.StringType(), False), *[S.StructField(p.name, TYPES[p.kind], not p.required) for p in properties]])


def schema_of(ontology: Ontology) -> S.StructType:
    """The type of an extracted graph: a list for each node type, and one for each relation with both ends."""
    ends = [S.StructField("source_id", S.StringType()), S.StructField("target_id", S.StringType())]
    nodes = [S.StructField(n.name, S.ArrayType(struct_of(n.properties))) for n in ontology.nodes]
    return S.StructType([*nodes, *[S.StructField(r.name, S.ArrayType(S.StructType([*ends, *struct_of(r.properties).fields[1:]]))) for r in ontology.relations]])


def _valid(items, properties: tuple[Property, ...], schema: S.StructType):
    """The list with null in place of values that are not among those that their property allows."""
    allowed = {p.name: p.values for p in properties if p.values}
    if not allowed:
        return items
    return F.transform(items, lambda x: F.struct(*[(F.when(x[f.name].isin(*allowed[f.name]), x[f.name]) if f.name in allowed else x[f.name]).alias(f.name) for f in schema.fields]))


def parse_graphs(replies: DataFrame, ontology: Ontology) -> DataFrame:
    """(.., graph) from JSON replies: the outermost braces are read, values outside an enumeration become null; a reply
    that can't be read has a null graph."""
    schema = schema_of(ontology)
    a = replies.withColumn("graph", F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), schema))
    kinds = {k.name: k.properties for k in (*ontology.nodes, *ontology.relations)}
    fields = [_valid(F.col(f"graph.`{f.name}`"), kinds[f.name], f.dataType.elementType).alias(f.name) for f in schema.fields]
    return a.withColumn("graph", F.when(F.col("graph").isNotNull(), F.struct(*fields)))


_NODE = "array<struct<entity_id:string,label:string,properties:map<string,string>>>"
_EDGE = "array<struct<source_id:string,target_id:string,rel_type:string,properties:map<string,string>>>"


def _texts(x, schema: S.StructType, without: tuple[str, ...]):
    """A struct's filled fields as a map of strings; lists as JSON."""
    kept = [f for f in schema.fields if f.name not in without]
    text = lambda f: F.to_json(x[f.name]) if isinstance(f.dataType, S.ArrayType) else x[f.name].cast("string")
    entries = F.array(*[F.struct(F.lit(f.name).alias("key"), text(f).alias("value")) for f in kept]) if kept else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def graph_rows(graphs: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """(parent_id, entity_id, label, properties) and (parent_id, source_id, target_id, rel_type, properties) of parsed graphs.

    Ids are trimmed and in lower case, blank ones go, and so do relations whose ends the same graph doesn't hold.
    Properties are maps of strings of all filled fields; a node's ``name`` is its id where the graph gives none.
    """
    schema = {f.name: f.dataType.elementType for f in schema_of(ontology).fields}
    clean = lambda c: F.lower(F.trim(c))

    def lists(names: list[str], shape, kind: str):
        own = [F.coalesce(F.transform(F.col(f"graph.`{n}`"), shape(n)).cast(kind), F.array().cast(kind)) for n in names]
        return F.flatten(F.array(*own)) if own else F.array().cast(kind)

    def node(n: str):
        def one(x):
            own = _texts(x, schema[n], ("id",))
            named = F.when(F.map_contains_key(own, "name"), own).otherwise(F.map_concat(own, F.create_map(F.lit("name"), clean(x["id"]))))
            return F.struct(clean(x["id"]).alias("entity_id"), F.lit(n).alias("label"), named.alias("properties"))

        return one

    edge = lambda n: lambda x: F.struct(clean(x["source_id"]).alias("source_id"), clean(x["target_id"]).alias("target_id"), F.lit(n).alias("rel_type"), _texts(x, schema[n], ("source_id", "target_id")).alias("properties"))
    nodes = F.filter(lists([n.name for n in ontology.nodes], node, _NODE), lambda x: F.coalesce(x["entity_id"], F.lit("")) != "")
    a = graphs.select("parent_id", nodes.alias("nodes"), lists([r.name for r in ontology.relations], edge, _EDGE).alias("edges"))
    ids = F.transform("nodes", lambda x: x["entity_id"])
    whole = F.filter("edges", lambda e: F.array_contains(ids, e["source_id"]) & F.array_contains(ids, e["target_id"]))
    return a.select("parent_id", F.inline("nodes")), a.select("parent_id", F.inline(whole))


def extract_with(passages: DataFrame, ontology: Ontology, model) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges by a model, a column function from texts to JSON replies; passages whose reply can't be read are
    extracted by their wording."""
    graphs = parse_graphs(passages.withColumn("reply", model(F.col("text"))), ontology)
    n, e = graph_rows(graphs.filter("graph is not null"), ontology)
    n2, e2 = extract(graphs.filter("graph is null").select("parent_id", "text"), ontology)
    return n.unionByName(n2), e.unionByName(e2)


# What a required property holds in a graph found by wording.
SAMPLES = {"string": "Sample", "integer": "1", "float": "1.0", "boolean": "true", "list[string]": '["sample"]'}


def _as_text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _found(properties: tuple[Property, ...]):
    """A map of strings: required properties hold their default, first allowed value or a sample, others their default."""
    held = {}
    for p in properties:
        if p.default is not None:
            held[p.name] = _as_text(p.default)
        elif p.required:
            held[p.name] = p.values[0] if p.values else SAMPLES[p.kind]
    return F.create_map(*[F.lit(x) for kv in held.items() for x in kv]).cast("map<string,string>")


def extract(passages: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that the wording alone shows: a type whose name a text holds, a relation whose both types it holds.

    Passages are (parent_id, text). Columns are those of ``graph_rows``. A relation between types that the ontology
    doesn't have is never found. The ontology's types become columns of the plan, so there is no join.
    """
    low = F.lower(F.col("text"))
    has = lambda name: F.contains(low, F.lit(name.lower()))
    first = lambda name: F.lit(f"{name.lower()}-1")
    known = {n.name for n in ontology.nodes}
    node = lambda n: F.when(has(n.name), F.struct(first(n.name).alias("entity_id"), F.lit(n.name).alias("label"), _found(n.properties).alias("properties")))
    edge = lambda r: F.when(has(r.source) & has(r.target), F.struct(first(r.source).alias("source_id"), first(r.target).alias("target_id"), F.lit(r.name).alias("rel_type"), _found(r.properties).alias("properties")))
    nodes = F.array_compact(F.array(*[node(n) for n in ontology.nodes]).cast(_NODE))
    edges = F.array_compact(F.array(*[edge(r) for r in ontology.relations if {r.source, r.target} <= known]).cast(_EDGE))
    return passages.select("parent_id", F.inline(nodes)), passages.select("parent_id", F.inline(edges))


def quality(nodes: DataFrame, edges: DataFrame, node_types: list[str]) -> DataFrame:
    """(graph_id, integrity, adherence) in percent: edges whose ends exist (100 without edges), nodes of known types; an
    empty graph has 0 and 0."""
    ids = nodes.select("graph_id", F.col("entity_id").alias("id")).distinct()
    a = ids.select("graph_id", F.col("id").alias("source_id"), F.lit(1).alias("s"))
    b = ids.select("graph_id", F.col("id").alias("target_id"), F.lit(1).alias("t"))
    e = edges.join(a, ["graph_id", "source_id"], "left").join(b, ["graph_id", "target_id"], "left")
    e = e.groupBy("graph_id").agg((F.avg((F.col("s").isNotNull() & F.col("t").isNotNull()).cast("double")) * 100).alias("integrity"))
    n = nodes.groupBy("graph_id").agg((F.avg(F.col("label").isin(*node_types).cast("double")) * 100).alias("adherence"))
    return n.join(e, "graph_id", "full").select("graph_id", F.when(F.col("adherence").isNull(), 0.0).otherwise(F.coalesce("integrity", F.lit(100.0))).alias("integrity"), F.coalesce("adherence", F.lit(0.0)).alias("adherence"))


def usage(ontologies: DataFrame, bases: DataFrame) -> DataFrame:
    """(ontology_id, used_by, deletable): an ontology that a knowledge base uses may not be deleted."""
    n = bases.filter("ontology_id is not null").groupBy("ontology_id").agg(F.count("*").alias("used"))
    out = ontologies.select("ontology_id").join(n, "ontology_id", "left").select("ontology_id", F.coalesce("used", F.lit(0)).alias("used_by"))
    return out.withColumn("deletable", F.col("used_by") == 0)


def new_versions(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed templates whose (name, version) is not taken; names are compared exactly."""
    return proposed.join(existing.select("name", "version"), ["name", "version"], "left_anti")


def ends_by_type(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations (source_type, target_type, rel_type) with the first node of each type as ends."""
    first = nodes.groupBy("label").agg(F.min("entity_id").alias("id"))
    a, b = first.select(F.col("label").alias("source_type"), F.col("id").alias("source_id")), first.select(F.col("label").alias("target_type"), F.col("id").alias("target_id"))
    return relations.join(a, "source_type").join(b, "target_type").select("source_id", "target_id", "rel_type")
