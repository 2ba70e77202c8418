"""Ingestion in stages that each commit a table: nothing is computed twice, and a run goes on where the last one stopped.

Stages are PARSING, CHUNKING, EMBEDDINGS, EXTRACTION and INDEXING. A stage takes the documents that finished the one before
and not yet itself, in whatever run, stores its rows and then one status a document: done, or failed with an error. A
document that failed, or whose run was killed before the statuses were stored, is taken again by the next run from that
stage on. Recognized pages are kept too, so a document with one bad page needs only that page anew.

Tables lie below a folder that all executors share: ``<stage>/run=<id>`` and ``status/step=<stage>/run=<id>``. A run that is
repeated under its id overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom import storage
from strataloom.functions import vectors
from strataloom.operators import graph, ingest, markdown, ontology
from strataloom.sources import files as pages_

STAGES = ("PARSING", "CHUNKING", "EMBEDDINGS", "EXTRACTION", "INDEXING")
_STATUS = "document_id string, error string"


@dataclass(frozen=True)
class Ingestion:
    """Where the tables lie and what the outside models are: column functions, whose null means that they failed.

    ``recognize`` turns a page's image into Markdown, ``embed`` (header path, text) into a vector, ``extract`` a text into a
    JSON reply; without it the wording alone is used."""

    root: str
    onto: ontology.Ontology
    parsers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    recognize: Callable[[Column], Column] | None = None
    embed: Callable[[Column, Column], Column] | None = None
    extract: Callable[[Column], Column] | None = None
    dimensions: int = 768
    limits: markdown.Limits = markdown.Limits()

    # tables

    def _there(self, spark: SparkSession, path: str) -> bool:
        return storage.exists(spark, f"{self.root}/{path}")

    def statuses(self, spark: SparkSession) -> DataFrame:
        """(document_id, error, step, run) of all runs; error is null where the step was done."""
        if not self._there(spark, "status"):
            return spark.createDataFrame([], f"{_STATUS}, step string, run int")
        return spark.read.schema(f"{_STATUS}, step string, run int").parquet(f"{self.root}/status")

    def done(self, spark: SparkSession, step: str) -> DataFrame:
        """(document_id, run): the run that finished the step for a document."""
        return self.statuses(spark).filter((F.col("step") == step) & F.col("error").isNull()).groupBy("document_id").agg(F.max("run").alias("run"))

    def failures(self, spark: SparkSession) -> DataFrame:
        """(document_id, step, error, run) of documents that a later run has not taken further."""
        s = self.statuses(spark)
        at = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("step"))
        last = s.groupBy("document_id").agg(F.max_by(F.struct("step", "error", "run"), F.struct("run", at)).alias("l"))
        return last.select("document_id", "l.*").filter("error is not null")

    def rows(self, spark: SparkSession, step: str) -> DataFrame:
        """What a stage has stored for the documents that it is done with, of the run that did it."""
        df = spark.read.parquet(f"{self.root}/{step.lower()}")
        return df.join(self.done(spark, step), ["document_id", "run"], "left_semi").drop("run")

    def _waiting(self, spark: SparkSession, step: str) -> DataFrame:
        """(document_id) that the stage before is done with and this one isn't."""
        before = STAGES[STAGES.index(step) - 1]
        return self.done(spark, before).select("document_id").join(self.done(spark, step).select("document_id"), "document_id", "left_anti")

    # running

    def _commit(self, spark: SparkSession, step: str, run: int, work: DataFrame, made: DataFrame) -> None:
        """Stores rows (document_id, ..., error), then the statuses of all documents of ``work``; a document fails by any
        row with an error, and by having none."""
        at = f"{self.root}/{step.lower()}/run={run}"
        made.write.mode("overwrite").parquet(at)
        stored = spark.read.schema(made.schema).parquet(at)
        own = stored.groupBy("document_id").agg(F.min("error").alias("error"), F.count("*").alias("n"))
        status = work.select("document_id").join(own, "document_id", "left").select("document_id", F.when(F.col("n").isNull(), "nothing made").otherwise(F.col("error")).alias("error"))
        status.write.mode("overwrite").parquet(f"{self.root}/status/step={step}/run={run}")

    def _pages(self, spark: SparkSession, run: int, pages: DataFrame, work: DataFrame) -> DataFrame:
        """(document_id, text, error) of documents that come as pages (document_id, page, image): recognized pages are stored,
        those stored before are not recognized again."""
        own = pages.join(work.select("document_id"), "document_id", "left_semi")
        schema = "document_id string, page int, markdown string"
        earlier = spark.read.schema(f"{schema}, run int").parquet(f"{self.root}/pages").filter(F.col("run") != run).drop("run").dropDuplicates(["document_id", "page"]) if self._there(spark, "pages") else spark.createDataFrame([], schema)
        fresh = own.select(F.col("document_id").cast("string"), F.col("page").cast("int"), "image").join(earlier, ["document_id", "page"], "left_anti")
        model = self.recognize or (lambda image: F.lit(None).cast("string"))
        storage.stored(fresh.select("document_id", "page", model(F.col("image")).alias("markdown")).filter("markdown is not null"), f"{self.root}/pages/run={run}") if not self._there(spark, f"pages/run={run}") else None
        have = earlier.unionByName(spark.read.schema(schema).parquet(f"{self.root}/pages/run={run}"))
        have = have.join(own.select(F.col("document_id").cast("string"), F.col("page").cast("int")), ["document_id", "page"], "left_semi")
        n = own.groupBy("document_id").agg(F.count_distinct("page").alias("wanted"))
        made = n.join(pages_.assemble_pages(have), "document_id", "left")
        missing = F.col("wanted") - F.coalesce("n_pages", F.lit(0))
        return made.select("document_id", "text", F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" pages not recognized"))).alias("error"))

    def run(self, files: DataFrame, run: int, pages: DataFrame | None = None, segments: DataFrame | None = None) -> None:
        """One run over files (document_id, file_name, content_type, content, ingested_at), a document once.

        ``pages``: (document_id, page, image) of documents that are recognized page by page; ``segments``: (file_name, start,
        end, text) of sound files. Documents that are done with a stage skip it, whatever file comes for them."""
        spark = files.sparkSession
        files = files.withColumn("document_id", F.col("document_id").cast("string"))
        work = ingest.route(files).join(self.done(spark, "PARSING").select("document_id"), "document_id", "left_anti")
        plain, made = work, None
        if pages is not None:
            own = self._pages(spark, run, pages, work)
            plain = plain.join(own.select("document_id"), "document_id", "left_anti")
            made = work.join(own, "document_id").select("document_id", "file_name", "text", "source_type", "ingested_at", "error")
        if segments is not None:
            sound = plain.filter("source_type = 'audio'")
            plain = plain.filter("source_type is distinct from 'audio'")
            heard = sound.drop("content").join(ingest.transcripts(sound.select("file_name", "ingested_at").distinct(), segments), "file_name").select("document_id", "file_name", "text", "source_type", "ingested_at", F.lit(None).cast("string").alias("error"))
            made = heard if made is None else made.unionByName(heard)
        parsed = ingest.parse(plain, self.parsers).select("document_id", "file_name", "text", "source_type", "ingested_at", F.lit(None).cast("string").alias("error"))
        made = parsed if made is None else made.withColumn("text", markdown.normalized(F.col("text"))).unionByName(parsed)
        blank = F.coalesce(F.trim("text"), F.lit("")) == ""
        self._commit(spark, "PARSING", run, work, made.withColumn("error", F.coalesce("error", F.when(blank, "no text"))).withColumnRenamed("file_name", "document_name"))

        waiting = self._waiting(spark, "CHUNKING")
        texts = self.rows(spark, "PARSING").drop("error").join(waiting, "document_id", "left_semi")
        self._commit(spark, "CHUNKING", run, waiting, markdown.family_table(texts, self.limits).withColumn("error", F.lit(None).cast("string")))

        waiting = self._waiting(spark, "EMBEDDINGS")
        families = self.rows(spark, "CHUNKING").join(waiting, "document_id", "left_semi")
        vector = self.embed or (lambda title, text: vectors.hash_embedding(vectors.passage_prompt(title, text), self.dimensions))
        own = families.select("document_id", "parent_id", "header_path", "source_type", "ingested_at", F.inline("children")).withColumn("embedding", vector(F.col("header_path"), F.col("content")))
        self._commit(spark, "EMBEDDINGS", run, waiting, own.withColumn("error", F.when(F.col("embedding").isNull(), "no embedding")))

        waiting = self._waiting(spark, "EXTRACTION")
        passages = self.rows(spark, "CHUNKING").join(waiting, "document_id", "left_semi").select("document_id", "parent_id", F.col("content").alias("text"))
        if self.extract is None:
            passages = passages.withColumn("reply", F.lit(""))
        else:
            passages = passages.withColumn("reply", self.extract(F.col("text")))
        self._commit(spark, "EXTRACTION", run, waiting, passages.withColumn("error", F.when(F.col("reply").isNull(), "no reply")))

        # what indexing needs is stored by now; a document is indexed when a run has come to this point
        waiting = self._waiting(spark, "INDEXING")
        self._commit(spark, "INDEXING", run, waiting, waiting.withColumn("error", F.lit(None).cast("string")))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """documents, parents, children, entities, relations, mentions of all indexed documents, and open failures."""
        ready = self.done(spark, "INDEXING").select("document_id")
        of = lambda step: self.rows(spark, step).drop("error").join(ready, "document_id", "left_semi")
        families = of("CHUNKING")
        passages = of("EXTRACTION")
        if self.extract is None:
            nodes, edges = ontology.extract(passages, self.onto)
        else:
            graphs = ontology.parse_graphs(passages, self.onto)
            nodes, edges = ontology.graph_rows(graphs.filter("graph is not null"), self.onto)
            worded = ontology.extract(graphs.filter("graph is null"), self.onto)
            nodes, edges = nodes.unionByName(worded[0]), edges.unionByName(worded[1])
        parents = families.drop("children")
        entities, relations, mentions = ingest.merged_graph(parents, nodes, edges)
        return {"documents": of("PARSING").drop("text"), "parents": parents, "children": of("EMBEDDINGS"), "entities": entities, "relations": relations, "mentions": mentions, "structure": graph.structure_edges(parents, of("EMBEDDINGS")), "failures": self.failures(spark)}
