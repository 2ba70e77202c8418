"""Hybrid retrieval: nearest chunks, their parents, expansion through shared entities, fusion, evidence cut.

All inputs are DataFrames; a query vector is a list of numbers. Every order has an id as its last key, so results
don't depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from strataloom import storage
from strataloom.functions import text as T
from strataloom.functions import vectors
from strataloom.operators import comention, vector_index

EXPANSION = 0.7
SHARED_BONUS = 0.05
MOST_SHARED = 5
MOST_NEIGHBOURS = comention.MOST_NEIGHBOURS
MOST_TRIPLES = 5
#: What marks a trimmed passage, and the fewest tokens that make a trimmed passage worth keeping.
SUFFIX = "... [truncado pelo orçamento]"
USEFUL_TOKENS = 50


@dataclass(frozen=True)
class Filters:
    """What a seed must fulfil, each bound inclusive; a null field never passes a bound."""

    document_id: object = None
    source_types: tuple[str, ...] = ()
    time_from: float | None = None
    time_to: float | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        if self.document_id is not None:
            c &= F.col("document_id") == self.document_id
        if self.source_types:
            c &= F.col("source_type").isin(*self.source_types)
        if self.time_from is not None:
            c &= F.col("ingested_at") >= self.time_from
        if self.time_to is not None:
            c &= F.col("ingested_at") <= self.time_to
        return c


def candidate_count(top_k: int) -> int:
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be from 1 to 20")
    return max(4 * top_k, 50)


def nearest(children: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k children (child_id, parent_id, embedding) of the greatest cosine similarity, as (child_id, parent_id, score).

    Each task keeps its own k best, so only those meet.
    """
    scored = children.select("child_id", "parent_id", vectors.cosine_to(F.col("embedding"), vector).alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), "child_id").limit(k)


def pinned(few: DataFrame, most: int) -> DataFrame:
    """The rows of a result that a limit bounds, ``most`` at the outside, as literal rows.

    The scan that found them runs once, however many branches build on it, and every join on them is a broadcast.
    """
    rows = few.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return few.sparkSession.createDataFrame(rows, few.schema)


def seeds(found: DataFrame, parents: DataFrame, filters: Filters = Filters(), by: list[str] | None = None) -> DataFrame:
    """Parents of the found children that pass the filters, with their best child's score.

    Filters come after the nearest neighbours were cut, so a narrow one may leave fewer than asked for.
    ``by``: columns of separate queries.
    """
    return found.join(parents, "parent_id").filter(filters.condition()).groupBy(*(by or []), "parent_id").agg(F.max("score").alias("seed_score"))


def neighbours(seeds_: DataFrame, mentions: DataFrame, most: int = MOST_NEIGHBOURS, few: bool = False) -> DataFrame:
    """(parent_id, neighbour_id, seed_score, shared): for each seed, the parents that share most entities with it.

    Starts from the seeds: only mentions of the entities that they mention go on, and only those are made distinct.
    ``few``: the seeds are bounded, so they and their entities are broadcast, and the mentions are only scanned.
    """
    hint = F.broadcast if few else lambda df: df
    own = seeds_.select("parent_id", "seed_score").join(mentions.select("parent_id", "entity_id"), "parent_id") if not few else mentions.select("parent_id", "entity_id").join(hint(seeds_.select("parent_id", "seed_score")), "parent_id")
    own = own.select("parent_id", "seed_score", "entity_id").distinct()
    others = mentions.select(F.col("parent_id").alias("neighbour_id"), "entity_id").join(hint(own.select("entity_id").distinct()), "entity_id", "left_semi").distinct()
    pairs = others.join(hint(own), "entity_id").filter("neighbour_id <> parent_id").groupBy("parent_id", "seed_score", "neighbour_id").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("parent_id").orderBy(F.desc("shared"), "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).drop("rank")


def fuse(seeds_: DataFrame, neighbours_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(parent_id, base_score, shared, is_seed, fused_score); the maxima are taken independently. ``by``: as for seeds."""
    keys = by or []
    a = seeds_.select(*keys, "parent_id", F.col("seed_score").alias("base_score"), F.lit(0).cast("long").alias("shared"), F.lit(True).alias("is_seed"))
    b = neighbours_.select(*keys, F.col("neighbour_id").alias("parent_id"), (F.col("seed_score") * EXPANSION).alias("base_score"), "shared", F.lit(False).alias("is_seed"))
    c = a.unionByName(b).groupBy(*keys, "parent_id").agg(F.max("base_score").alias("base_score"), F.max("shared").alias("shared"), F.bool_or("is_seed").alias("is_seed"))
    bonus = 1.0 + F.least(F.col("shared"), F.lit(MOST_SHARED)) * SHARED_BONUS
    return c.withColumn("fused_score", F.when(F.col("is_seed"), F.col("base_score")).otherwise(F.col("base_score") * bonus))


def triples(found: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, most: int = MOST_TRIPLES) -> DataFrame:
    """(parent_id, related_triples): the first triples, in order, that start at an entity the parent mentions."""
    name = F.coalesce(F.col("name"), F.col("entity_id").cast("string"), F.lit(""))
    e = entities.select("entity_id", name.alias("shown"))
    source, target = e.select(F.col("entity_id").alias("source_id"), F.col("shown").alias("source")), e.select(F.col("entity_id").alias("target_id"), F.col("shown").alias("target"))
    sentences = relations.join(source, "source_id").join(target, "target_id").select(F.col("source_id").alias("entity_id"), F.concat("source", F.lit(" "), "rel_type", F.lit(" "), "target").alias("triple"))
    hits = mentions.select("parent_id", "entity_id").join(found.select("parent_id").distinct(), "parent_id", "left_semi").join(sentences, "entity_id").select("parent_id", "triple").distinct()
    first = Window.partitionBy("parent_id").orderBy("triple")
    return hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).groupBy("parent_id").agg(F.sort_array(F.collect_list("triple")).alias("related_triples"))


def with_neighbour_chunks(parents: DataFrame) -> DataFrame:
    """Adds prev_chunk_id and next_chunk_id in each document's order."""
    order = Window.partitionBy("document_id").orderBy("parent_index", "parent_id")
    return parents.withColumns({"prev_chunk_id": F.lag("parent_id").over(order), "next_chunk_id": F.lead("parent_id").over(order)})


def hybrid(children: DataFrame, parents: DataFrame, mentions: DataFrame, vector: list[float], top_k: int = 20, candidate_k: int | None = None, filters: Filters = Filters(), strict_filters: bool = False) -> DataFrame:
    """The ranked parents: (parent_id, base_score, shared, is_seed, fused_score), top_k rows.

    Neighbours are not filtered unless strict_filters says so.
    """
    k = candidate_k or candidate_count(top_k)
    s = seeds(F.broadcast(pinned(nearest(children, vector, k), k)), parents, filters)
    s = pinned(s, k)  # used for the seeds themselves and for their neighbours
    n = neighbours(s, mentions, few=True)
    if strict_filters:
        n = n.join(parents.filter(filters.condition()).select(F.col("parent_id").alias("neighbour_id")), "neighbour_id", "left_semi")
    return fuse(s, n).orderBy(F.desc("fused_score"), "parent_id").limit(top_k)


def _with_numbers(mentions: DataFrame, at: str) -> DataFrame:
    """mentions with whole numbers as entity_id: their own, or one for each entity."""
    if isinstance(mentions.schema["entity_id"].dataType, IntegralType):
        return mentions
    numbers = storage.stored(mentions.select("entity_id").dropna().distinct().withColumn("number", F.monotonically_increasing_id()), f"{at}/entities")
    return mentions.join(numbers, "entity_id").select("parent_id", F.col("number").alias("entity_id"))


def hybrid_many(children: DataFrame, parents: DataFrame, mentions: DataFrame, queries: DataFrame, top_k: int = 20, candidate_k: int | None = None, filters: Filters = Filters(), strict_filters: bool = False, index: vector_index.Index | None = None) -> DataFrame:
    """``hybrid`` for a table of queries (query_id, vector): its columns, query_id, and rank from 1 to top_k.

    Seeds come from blocks in which all queries meet all children, or from an index. A parent's neighbours don't depend
    on the query, so each parent that is a seed of any query is expanded once, without a row for each pair of parents that
    share an entity. The seeds are stored, since several steps read them.
    """
    spark, k = queries.sparkSession, candidate_k or candidate_count(top_k)
    at = storage.shared_folder(spark, "hybrid")
    found = vector_index.nearest_many_indexed(spark, index, queries, k) if index else vector_index.nearest_many(children, queries, k)
    s = storage.stored(seeds(found, parents, filters, by=["query_id"]), f"{at}/seeds")
    n = s.join(comention.all_neighbours(_with_numbers(mentions, at), seeds=s.select("parent_id")), "parent_id")
    if strict_filters:
        n = n.join(parents.filter(filters.condition()).select(F.col("parent_id").alias("neighbour_id")), "neighbour_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "parent_id")
    return fuse(s, n, by=["query_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def details(ids: DataFrame, parents: DataFrame, documents: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, with_triples: bool = True, few: bool = False) -> DataFrame:
    """Of each parent (parent_id, unique): its row, document, neighbouring chunks, triples and entities.

    Only these parents' documents are put in order. ``few``: the ids are bounded, so all joins with them are broadcasts."""
    hint = F.broadcast if few else lambda df: df
    of = parents.join(hint(ids), "parent_id", "left_semi").select("document_id").distinct()
    p = with_neighbour_chunks(parents.join(hint(of), "document_id", "left_semi"))
    out = p.join(hint(ids), "parent_id", "left_semi")
    names = documents.select("document_id", F.col("name").alias("document_name")).join(hint(of), "document_id", "left_semi")
    out = out.join(hint(names), "document_id", "left")
    if with_triples:
        out = out.join(hint(triples(ids, mentions, relations, entities)), "parent_id", "left")
    mine = mentions.select("parent_id", "entity_id").join(hint(ids), "parent_id", "left_semi").distinct()
    shown = F.concat(F.col("label"), F.lit(":"), F.coalesce(F.col("name"), F.col("entity_id").cast("string")))
    properties = F.col("properties") if "properties" in entities.columns else F.map_filter(F.create_map(F.lit("id"), F.col("entity_id").cast("string"), F.lit("name"), F.col("name")), lambda k, v: v.isNotNull())
    # a map can't be compared; its entries in order, as JSON, can
    entity = F.struct(F.col("label").alias("type"), F.to_json(F.map_from_entries(F.array_sort(F.filter(F.map_entries(properties), lambda e: e["value"].isNotNull())))).alias("properties"))
    named = mine.join(entities, "entity_id").groupBy("parent_id").agg(F.sort_array(F.collect_set(shown)).alias("related_entities"), F.sort_array(F.collect_set(entity)).alias("entities"))
    return out.join(hint(named), "parent_id", "left")


def _source(df: DataFrame) -> DataFrame:
    return df.withColumn("retrieval_source", F.when(F.col("is_seed"), "vector_match").otherwise("graph_expansion"))


def enriched(ranked: DataFrame, parents: DataFrame, documents: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, with_triples: bool = True) -> DataFrame:
    """The ranked parents, at most the 20 that a query may ask for, with their ``details``."""
    ranked = F.broadcast(pinned(ranked, 20))  # all joins below are with these rows
    ids = F.broadcast(ranked.select("parent_id"))
    return _source(ranked.join(F.broadcast(details(ids, parents, documents, mentions, relations, entities, with_triples, few=True)), "parent_id", "left"))


def enriched_many(ranked: DataFrame, parents: DataFrame, documents: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, with_triples: bool = True) -> DataFrame:
    """The rows of ``hybrid_many`` with their parents' ``details``, found once for each parent that any query ranks.

    The ranked rows are stored, since several steps read them."""
    ranked = storage.stored(ranked, storage.shared_folder(ranked.sparkSession, "ranked"))
    return _source(ranked.join(details(ranked.select("parent_id").distinct(), parents, documents, mentions, relations, entities, with_triples), "parent_id", "left"))


def budget_cut(ranked: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """Passages (rank, content) in rank order as far as the budget of tokens goes; adds tokens and truncated.

    Costs are never negative, so a running sum tells where the budget ends: whole passages before, the first that
    overruns trimmed if it is the first of all or enough is left, nothing after. ``truncated`` marks the trimmed passage,
    ``overflow`` each passage of a query whose evidence was cut at all. ``by``: columns of separate queries.
    """
    if not 50 <= budget <= 32_000:
        raise ValueError("the budget must be from 50 to 32000")
    keys = by or []
    order = Window.partitionBy(*keys).orderBy("rank")
    suffix = -(-len(SUFFIX) * 10 // 33)
    a = ranked.withColumn("cost", T.budget_tokens(F.col("content"))).withColumn("before", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")).withColumn("pos", F.row_number().over(order))
    over = F.col("before") + F.col("cost") > budget
    left = budget - F.col("before")
    a = a.withColumns({"over": over, "left": left, "overs": F.sum(over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "overflow": F.max(over).over(Window.partitionBy(*keys))})
    a = a.filter(~F.col("over") & (F.col("overs") == 0) | F.col("over") & (F.col("overs") == 1) & ((F.col("pos") == 1) | (F.col("left") >= USEFUL_TOKENS + suffix)))
    chars = F.greatest(F.lit(20), F.floor(F.greatest(F.lit(1), F.col("left") - suffix) * F.lit(T.BUDGET_CHARS)).cast("int"))
    trimmed = F.concat(F.regexp_replace(F.substring(F.col("content"), F.lit(1), chars), r"\s+$", ""), F.lit(SUFFIX))
    content = F.when(F.col("over"), trimmed).otherwise(F.col("content"))
    return a.withColumns({"content": content, "truncated": F.col("over")}).withColumn("tokens", T.budget_tokens(F.col("content"))).drop("cost", "before", "pos", "over", "left", "overs")


def unique_triples(results: DataFrame, most: int = 10) -> DataFrame:
    """The first triples over results (rank, related_triples), in order of first sight."""
    e = results.select("rank", F.posexplode("related_triples").alias("pos", "triple"))
    return e.groupBy("triple").agg(F.min(F.struct("rank", "pos")).alias("first")).orderBy("first", "triple").limit(most).select("triple", F.col("first.rank").alias("rank"), F.col("first.pos").alias("pos"))


def evidence_block(rank: Column, header: Column, score: Column, content: Column) -> Column:
    """One passage as the answer's prompt shows it."""
    return F.concat(F.format_string('<evidence rank="%d" score="%.4f" section="%s">\n', rank, score, header), content, F.lit("\n</evidence>"))


def trace(cut: DataFrame, top_k: int, budget: int, mode: str, filters: Filters = Filters()) -> DataFrame:
    """One row about a query: limits, filters, what of the evidence was kept and from where, tokens used, whether it was cut.

    cut: rows of ``budget_cut`` with rank and retrieval_source."""
    if mode not in ("retrieve", "synthesis", "none"):
        raise ValueError("mode must be retrieve, synthesis or none")
    found = F.transform(F.sort_array(F.collect_list(F.struct("rank", "retrieval_source"))), lambda r: r.retrieval_source)  # top_k rows at most
    a = cut.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("token_budget_consumed"), F.coalesce(F.bool_or("overflow"), F.lit(False)).alias("budget_truncated"), F.count("*").alias("results_count"), found.alias("retrieval_sources"))
    limits = F.lit(top_k).alias("top_k"), F.lit(candidate_count(top_k)).alias("candidate_k"), F.lit(budget).alias("token_budget_limit"), F.lit(mode).alias("mode")
    asked = F.lit(",".join(filters.source_types) or None).alias("source_types"), F.lit(filters.time_from).cast("double").alias("time_from"), F.lit(filters.time_to).cast("double").alias("time_to")
    return a.select(*limits, *asked, "*")
