"""The driver's tables in the roles of the engine's model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child chunks: five to a parent, ten parents to a document."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("child_id"), F.floor(F.col("vec_id") / 5).alias("parent_id"), "embedding")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("parent_id")).distinct()
    kind = F.element_at(F.array(F.lit("document"), F.lit("image"), F.lit("audio")), (F.col("parent_id") % 3 + 1).cast("int"))
    return e.select("parent_id", F.floor(F.col("parent_id") / 10).alias("document_id"), (F.col("parent_id") % 10).alias("parent_index"), kind.alias("source_type"), (F.lit(1.7e9) + F.col("parent_id") * 1000).alias("ingested_at"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("parent_id"), F.col("label").cast("long").alias("entity_id")).distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("name"), F.lit("Nation").alias("label"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).select(F.col("entity_id").alias("source_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("step"))
    return e.select("source_id", ((F.col("source_id") + F.col("step")) % 10).alias("target_id"), F.when(F.col("step") == 1, "REGULATES").otherwise("CITES").alias("rel_type"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of queries: the vectors whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


#: The events' kinds in the roles of document events.
KINDS = {"signup": "DocumentAttached", "view": "DocumentStored", "click": "DocumentParsedToMarkdown", "purchase": "DocumentKnowledgeIndexed", "error": "DocumentProcessingFailed"}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log: aggregate is the user, versions number each user's events by time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    e = e.select("event_id", F.col("user_id").alias("aggregate_id"), kind.alias("event_type"), F.col("event_type").alias("kind"), "ts", "value", "props")
    order = Window.partitionBy("aggregate_id").orderBy("ts", "event_id")
    return e.withColumn("event_version", F.row_number().over(order).cast("int"))


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with every kind of event and with payloads: what a kind of event means depends on its value too."""
    value, k = F.col("value"), F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    kind = (
        F.when(F.col("kind") == "view", F.when(value > 50, "DocumentStored").otherwise("DocumentProgressUpdated"))
        .when(F.col("kind") == "click", F.when(value > 60, "DocumentParsedToMarkdown").when(value > 30, "DocumentChunked").otherwise("GraphExtractedFromDocument"))
        .when((F.col("kind") == "error") & (value > 95), "DocumentDeleted").otherwise(F.col("event_type"))
    )
    step = F.when(k < 4, "CHUNKING").when(k < 7, "OCR").otherwise("INDEXING")
    a = log(spark, sf_dir).withColumns({"event_type": kind, "k": k, "step": step})
    return a.select(
        "aggregate_id", "event_type", "event_version", F.concat(F.lit("f"), F.col("k").cast("string")).alias("file_name"), F.concat(F.lit("p"), F.col("event_version").cast("string")).alias("storage_path"), (F.col("k") > 5).alias("enable_ocr"),
        "step", F.concat(F.lit("e"), F.col("k").cast("string")).alias("error_message"), F.col("k").alias("current"), F.lit(10).alias("total"), F.floor("value").cast("int").alias("percentage"), F.lit("m").alias("message"),
        F.col("k").alias("total_parents"), (F.col("k") * 3).alias("total_children"), (F.col("k") + 1).alias("nodes"), (F.col("k") + 2).alias("edges"),
    )


# The same roles in SQL.
SQL_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
SQL_LOG = f"log AS (SELECT event_id, user_id AS aggregate_id, {SQL_KIND} AS event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_version, ts, value, props FROM events)"
SQL_CHILDREN = "children AS (SELECT vec_id AS child_id, vec_id // 5 AS parent_id, embedding::DOUBLE[] AS embedding FROM embeddings)"
SQL_PARENTS = """parents AS (SELECT parent_id, parent_id // 10 AS document_id, parent_id % 10 AS parent_index, CASE parent_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'image' ELSE 'audio' END AS source_type,
    1.7e9::DOUBLE + parent_id * 1000 AS ingested_at FROM (SELECT DISTINCT vec_id // 5 AS parent_id FROM embeddings))"""
SQL_MENTIONS = "mentions AS (SELECT DISTINCT vec_id // 5 AS parent_id, label::BIGINT AS entity_id FROM embeddings)"
SQL_ENTITIES = "entities AS (SELECT n_nationkey::BIGINT AS entity_id, n_name AS name, 'Nation' AS label FROM nation WHERE n_nationkey < 10)"
SQL_RELATIONS = """relations AS (SELECT a.entity_id AS source_id, b.entity_id AS target_id, CASE WHEN (b.entity_id - a.entity_id + 10) % 10 = 1 THEN 'REGULATES' ELSE 'CITES' END AS rel_type
    FROM entities a, entities b WHERE (b.entity_id - a.entity_id + 10) % 10 IN (1, 3))"""
SQL_QUERY = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)"
SQL_KNN = "knn AS (SELECT child_id, parent_id, list_dot_product(embedding, v) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(v, v))) AS score FROM children, q ORDER BY score DESC, child_id LIMIT 50)"
SQL_QUERIES = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)"
SQL_KNN_MANY = "knn AS (SELECT query_id, child_id, parent_id, list_dot_product(embedding, v) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(v, v))) AS score FROM children, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) <= 50)"
