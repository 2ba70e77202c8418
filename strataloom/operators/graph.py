"""The property graph as tables: merging nodes and edges, mentions, order edges, deletion, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last row of each key: an upsert's outcome. A struct's maximum is taken by partial aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last")).select(*keys, *[F.col(f"last.{c}") for c in columns])


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, for each property the last value set, by (age, seq); a property last set to null is gone."""
    values = rows.select(*keys, "age", "seq", F.explode_outer("properties").alias("key", "value"))
    last = values.groupBy(*keys, "key").agg(F.max_by("value", F.struct("age", "seq")).alias("value"))
    entry = F.when(F.col("key").isNotNull() & F.col("value").isNotNull(), F.struct("key", "value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("properties"))


def _aged(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    new = incoming.withColumn("age", F.lit(1))
    return new if existing is None else existing.withColumn("age", F.lit(0)).unionByName(new)


def merge_nodes(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """(label, entity_id, properties) after merging: for each property the last value set, by ``seq``.

    Both inputs have label, entity_id, properties (map of strings) and seq; existing rows come first. A node without
    properties has an empty map.
    """
    return _merged(_aged(existing, incoming), ["label", "entity_id"])


def merge_edges(existing: DataFrame | None, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, rel_type, properties): one edge for each two ends and type, its properties merged as nodes' are.

    Ends match nodes by id under any label; an incoming edge without both ends is left out.
    """
    ids = nodes.select("entity_id").distinct()
    whole = incoming.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    columns = ["source_id", "target_id", "rel_type", "properties", "seq"]
    return _merged(_aged(None if existing is None else existing.select(*columns), whole.select(*columns)), ["source_id", "target_id", "rel_type"])


def referential(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends were both extracted, ids compared trimmed and in lower case."""
    key = lambda c: F.lower(F.trim(c))
    ids = nodes.select(key(F.col("entity_id")).alias("key")).distinct()
    a = edges.join(ids, key(F.col("source_id")) == ids.key, "left_semi")
    return a.join(ids, key(F.col("target_id")) == ids.key, "left_semi")


def mention_rows(extracted: DataFrame) -> DataFrame:
    """(parent_id, entity_id) once each, of rows (parent_id, entity_ids)."""
    return extracted.select("parent_id", F.explode("entity_ids").alias("entity_id")).filter("trim(entity_id) <> ''").distinct()


def known_mentions(mentions: DataFrame, parents: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions whose both ends are there."""
    return mentions.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def structure_edges(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(source_id, rel_type, target_id): a document's ties to its parents, theirs to children, and parents' order."""
    edge = lambda df, a, kind, b: df.select(F.col(a).cast("string").alias("source_id"), F.lit(kind).alias("rel_type"), F.col(b).cast("string").alias("target_id"))
    ties = edge(parents, "document_id", "HAS_PARENT", "parent_id").unionByName(edge(children, "parent_id", "CONTAINS_CHILD", "child_id"))
    return ties.unionByName(edge(next_edges(parents), "parent_id", "NEXT", "next_id"))


def chunk_totals(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(document_id, total_parents, total_children, chunks_summary): the summary lists (parent_id, header_path,
    token_count) in order, as a document's event carries it."""
    p = parents.groupBy("document_id").agg(F.count("*").alias("total_parents"), F.sort_array(F.collect_list(F.struct("parent_index", "parent_id", "header_path", "token_count"))).alias("rows"))
    c = children.groupBy("document_id").agg(F.count("*").alias("total_children"))
    summary = F.transform("rows", lambda r: F.struct(r.parent_id.alias("parent_id"), r.header_path.alias("header_path"), r.token_count.alias("token_count")))
    return p.join(c, "document_id", "left").select("document_id", "total_parents", F.coalesce("total_children", F.lit(0)).alias("total_children"), summary.alias("chunks_summary"))


def chunk_dump(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(document_id, value): a document's parents and children as one JSON text."""
    rows = lambda df, order: df.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (order, "document_id")]))).alias("rows"))
    p, c = rows(parents, "parent_index").withColumnRenamed("rows", "parents"), rows(children, "chunk_index").withColumnRenamed("rows", "children")
    return p.join(c, "document_id", "left").select("document_id", F.to_json(F.struct("parents", "children")).alias("value"))


def next_edges(parents: DataFrame) -> DataFrame:
    """(document_id, parent_id, next_id) for each parent with a successor in its document."""
    order = Window.partitionBy("document_id").orderBy("parent_index", "parent_id")
    return parents.withColumn("next_id", F.lead("parent_id").over(order)).filter("next_id is not null").select("document_id", "parent_id", "next_id")


def structure_counts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(document_id, n_nodes, n_edges): document, parents and children; their ties and the order of parents."""
    p = parents.groupBy("document_id").agg(F.count("*").alias("p"))
    c = children.groupBy("document_id").agg(F.count("*").alias("c"))
    both = p.join(c, "document_id", "full").select("document_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c"))
    return both.select("document_id", (1 + F.col("p") + F.col("c")).alias("n_nodes"), (F.col("p") + F.col("c") + F.greatest(F.col("p") - 1, F.lit(0))).alias("n_edges"))


def without_document(documents: DataFrame, parents: DataFrame, children: DataFrame, mentions: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All derived rows of the documents in ``gone`` removed; entities that others share stay."""
    keep = lambda df: df.join(gone.select("document_id"), "document_id", "left_anti")
    dropped = parents.join(gone.select("document_id"), "document_id", "left_semi").select("parent_id")
    return {"documents": keep(documents), "parents": keep(parents), "children": keep(children), "mentions": mentions.join(dropped, "parent_id", "left_anti")}


def without_base(documents: DataFrame, parents: DataFrame, children: DataFrame, mentions: DataFrame, entities: DataFrame, relations: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """A knowledge base's whole graph removed, for each base of ``gone`` (kb_id): documents, entities and relations have
    kb_id, what is derived from documents goes with them."""
    keep = lambda df: df.join(gone.select("kb_id").distinct(), "kb_id", "left_anti")
    dropped = documents.join(gone.select("kb_id").distinct(), "kb_id", "left_semi").select("document_id")
    return without_document(documents, parents, children, mentions, dropped) | {"entities": keep(entities), "relations": keep(relations)}


def consolidate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs of a document's parts as one: nodes by id and type, edges by ends and type, the last written wins."""
    return latest(nodes, ["entity_id", "label"], "seq", ["properties"]), latest(edges, ["source_id", "target_id", "rel_type"], "seq", ["properties"])


def consolidate_inline(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for a document that is worked on as a whole: nodes by id alone, edges all as they are."""
    return latest(nodes, ["entity_id"], "seq", ["label", "properties"]), edges


def concat_graphs(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of two graphs, nothing merged."""
    return first.unionByName(second, allowMissingColumns=True)


def first_text(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def subgraph(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The first k entities, the answer to a query that is no statement."""
    return nodes.orderBy("entity_id", "label").limit(k)


def ask(spark, text: str, views: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """A SQL statement over the named tables, cut to k rows; any other text gives the first k rows of ``entities``.

    The session's temporary views of these names are as before afterwards."""
    if text.strip().upper().startswith(("SELECT", "WITH", "FROM")):
        before = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in views}
        try:
            for name, df in views.items():
                df.createOrReplaceTempView(name)
            return spark.sql(text).limit(k)  # names are resolved here, not when it runs
        finally:
            for name in views:
                before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)
    return subgraph(views["entities"], k)
