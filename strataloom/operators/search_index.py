"""Quick search by a stored index of trigrams, so that a search reads posting lists and not texts.

Every string that a search looks at (titles, paths of headings, heading lines) becomes one entry, folded once. A posting
says that an entry holds a trigram. Postings lie in folders by segment of the documents' order and by bucket of the
trigram, sorted by trigram, so a search reads few row groups. Candidates that hold all trigrams of the query are verified
on the folded string. Segments are searched in order and the search ends as soon as it has enough hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom import storage
from strataloom.functions import text as T
from strataloom.operators import search

GRAM = 3
BUCKETS = 16
#: Documents of a segment, at least, and the most segments.
SEGMENT = 10_000
MOST_SEGMENTS = 1_000
#: Trigrams of a table of queries that are broadcast, at most.
MOST_SENT = 10_000
#: What tells an entry from others.
KEYS = ["segment", "doc_pos", "doc_id", "stage", "pos"]


@dataclass(frozen=True)
class Index:
    path: str
    segments: int

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/entries")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")


def grams_of(folded: Column, width: int = GRAM) -> Column:
    """The distinct runs of so many letters of a folded string; none of a shorter one."""
    n = F.length(folded) - (width - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(folded, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(documents: DataFrame, chunks: DataFrame, path: str) -> Index:
    """Stores entries and postings of documents and chunks as ``search.quick_search`` takes them.

    doc_pos must be a whole number that tells the order of documents, from 0 or 1 on. Null strings have no entry.
    """
    spark = documents.sparkSession
    top = documents.agg(F.max("doc_pos")).first()[0]
    width = max(SEGMENT, -(-(int(top or 0) + 1) // MOST_SEGMENTS))
    found = search.entries(documents, chunks).filter("text is not null")
    found = found.withColumns({"segment": F.floor(F.col("doc_pos") / width).cast("int"), "folded": search.folded(F.col("text"))})
    found.repartitionByRange("segment", "doc_pos", "doc_id").sortWithinPartitions("segment", "doc_pos", "stage", "pos").write.partitionBy("segment").parquet(f"{path}/entries")
    stored = spark.read.schema(found.schema).parquet(f"{path}/entries")
    p = stored.select(*KEYS, F.explode(grams_of(F.col("folded"))).alias("gram")).withColumn("bucket", bucket_of(F.col("gram")))
    # a trigram that most entries hold is spread by the entries' order
    p.repartitionByRange("segment", "bucket", "gram", "doc_pos").sortWithinPartitions("segment", "bucket", "gram", "doc_pos").write.option("parquet.block.size", 8 << 20).partitionBy("segment", "bucket").parquet(f"{path}/postings")
    for name, df in (("entries", found), ("postings", p)):
        if not spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}").getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/segment=*")):
            df.limit(0).write.mode("overwrite").parquet(f"{path}/{name}")  # an empty table still has a schema
    return Index(path, int(top or 0) // width + 1)


def _candidates(spark: SparkSession, index: Index, wanted: str, segments: list[int]) -> DataFrame:
    """Entries of some segments that hold the folded query."""
    entries = index.entries(spark).filter(F.col("segment").isin(segments))
    holds = F.contains(F.col("folded"), F.lit(wanted))
    grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if not grams:
        return entries.filter(holds)  # too short for the index: the folded strings are read
    buckets = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket_of(F.col("gram"))).collect()})
    p = index.postings(spark).filter(F.col("segment").isin(segments) & F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    keys = p.groupBy(*KEYS).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).drop("n")
    return entries.join(keys, KEYS, "left_semi").filter(holds)


def quick_search(spark: SparkSession, index: Index, query: str, limit: int = 10) -> DataFrame:
    """The rows of ``search.quick_search``, from the index.

    Segments are read in order, twice as many each time, until the limit is met; hits of a document lie in one segment, so
    what was found stays. At most 50 hits, the result, are with the driver."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    wanted = T.fold_text(query.strip())
    first, step, hits = 0, 1, []
    schema = None
    while wanted and first < index.segments and len(hits) < limit:
        found = search.hits(_candidates(spark, index, wanted, list(range(first, min(first + step, index.segments)))), [])
        rows = search.shown(found.orderBy("doc_pos", "stage", "pos").limit(limit - len(hits)))
        schema, hits = rows.schema, hits + rows.collect()
        first, step = first + step, step * 2
    if schema is None:
        return search.shown(search.hits(index.entries(spark).filter("false"), []))
    return spark.createDataFrame(hits, schema)


def search_many(spark: SparkSession, index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, rank, and the columns of a hit) for a table of queries (query_id, query): ``limit`` hits each.

    What is asked for is looked up once, however many queries ask for it. Strings of three letters or more meet the postings
    of their trigrams; shorter ones, of which there are 128 + 128 * 128 at most, the letters and pairs of letters of all folded
    strings. Both are joins on equal keys; trigrams are broadcast unless they are very many. Each document found has a hit,
    so of each string only the first ``limit`` documents go on. A query that is null, blank or without a letter after folding finds nothing."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    q = queries.filter("query is not null").select("query_id", search.folded(F.trim("query")).alias("wanted")).filter("wanted <> ''").distinct()
    q = storage.stored(q, storage.shared_folder(spark, "asked"))
    strings = q.select("wanted").distinct()
    long_, short = strings.filter(F.length("wanted") >= GRAM), strings.filter(F.length("wanted") < GRAM)
    asked = long_.select("wanted", grams_of(F.col("wanted")).alias("grams")).select("wanted", F.size("grams").alias("many"), F.explode("grams").alias("gram")).withColumn("bucket", bucket_of(F.col("gram")))
    asked = F.broadcast(asked) if len(asked.take(MOST_SENT + 1)) <= MOST_SENT else asked
    met = index.postings(spark).join(asked, ["bucket", "gram"]).groupBy("wanted", "many", *KEYS).agg(F.count("*").alias("n")).filter(F.col("n") == F.col("many"))
    entries = index.entries(spark)
    found = entries.join(met.select("wanted", *KEYS), KEYS).filter(F.contains("folded", F.col("wanted")))
    pairs = entries.withColumn("wanted", F.explode(F.concat(*[grams_of(F.col("folded"), n) for n in range(1, GRAM)])))
    found = found.unionByName(pairs.join(F.broadcast(short), "wanted").select(*found.columns))
    place = F.dense_rank().over(Window.partitionBy("wanted").orderBy("doc_pos"))
    found = found.withColumn("place", place).filter(F.col("place") <= limit).drop("place")

    def first(hits: DataFrame, by: str) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("doc_pos", "stage", "pos"))).filter(F.col("rank") <= limit)

    of_strings = first(search.hits(found, ["wanted"]), "wanted").drop("rank")
    return search.shown(first(search.once(q.join(of_strings, "wanted"), ["query_id"]), "query_id"), ["query_id", "rank"])
