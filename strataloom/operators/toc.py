"""Tables of contents: the sections that are open at a page, carried over batches of pages, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4
# What is shown without open sections, and between the levels.
NOTHING_OPEN = "Início do documento (nenhuma seção anterior aberta)."
NO_HEADING = "Documento Geral"
CONTENTS = "# Índice / Table of Contents\n"


def _open(level: Column, title: Column, k: int, order) -> Column:
    """The title of level k that is open after each row. A heading of level 1 closes nothing below it."""
    hit = F.when(level == k, F.struct(title.alias("title")))
    closed = F.when((level > 1) & (level < k), F.struct(F.lit(None).cast("string").alias("title"))) if k > 2 else F.lit(None)
    return F.last(F.coalesce(hit, closed) if k > 2 else hit, ignorenulls=True).over(order)["title"]


def hierarchy(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, h1 ... h4, lineage) for each asked page: the sections that are open at its end.

    items: doc_id, pos, level (1 to 4), title, page; a document's order is by pos. The first title of level 1 in the
    document counts as open from the first entry on. One window over entries and asked pages in place of an as-of join.
    """
    asked = pages.select("doc_id", "page").distinct()
    first = Window.partitionBy("doc_id")
    title = F.min_by(F.when(F.col("level") == 1, F.col("title")), F.when(F.col("level") == 1, F.col("pos"))).over(first)
    a = items.select("doc_id", "page", F.lit(0).alias("asks"), F.col("pos").cast("long").alias("pos"), F.col("level").cast("int").alias("level"), "title")
    a = a.unionByName(asked.select("doc_id", "page", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title")))
    a = a.withColumn("document_title", title)
    order = Window.partitionBy("doc_id").orderBy("page", "asks", "pos").rowsBetween(Window.unboundedPreceding, 0)
    names = {f"h{k}": _open(F.col("level"), F.col("title"), k, order) for k in range(1, LEVELS + 1)}
    seen = F.count("level").over(order)
    a = a.withColumns({**names, "seen": seen}).filter("asks = 1").withColumn("h1", F.when(F.col("seen") > 0, F.coalesce("h1", "document_title")))
    marks = [F.concat(F.lit("#" * k + " "), F.nullif(F.col(f"h{k}"), F.lit(""))) for k in range(1, LEVELS + 1)]
    text = F.nullif(F.concat_ws(" -> ", *marks), F.lit(""))
    lineage = F.when(F.col("seen") == 0, NOTHING_OPEN).otherwise(F.coalesce(text, F.lit(NO_HEADING)))
    return a.select("doc_id", "page", *names, lineage.alias("lineage"))


def batch_states(items: DataFrame, pages: DataFrame, size: int = 25) -> DataFrame:
    """(doc_id, batch, first_page, last_page, section, subsection, level) for each batch of so many pages: what is open
    when it begins, thus after the last page of the batch before; nulls where nothing was.

    pages: doc_id, n_pages. One pass over all batches; the state that a batch hands on is a window, not a loop."""
    b = pages.select("doc_id", "n_pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_pages") - 1) / size).cast("int"))).alias("batch")).filter("n_pages > 0")
    b = b.select("doc_id", "batch", (F.col("batch") * size + 1).alias("first_page"), F.least(F.col("batch") * size + size, F.col("n_pages")).alias("last_page"))
    asked = b.select("doc_id", (F.col("first_page") - 1).alias("page"))
    order = Window.partitionBy("doc_id").orderBy("page", "asks", "pos").rowsBetween(Window.unboundedPreceding, 0)
    a = items.select("doc_id", "page", F.lit(0).alias("asks"), F.col("pos").cast("long").alias("pos"), F.col("level").cast("int").alias("level"), "title")
    a = a.unionByName(asked.select("doc_id", "page", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title")))
    a = a.withColumns({"section": _open(F.col("level"), F.col("title"), 2, order), "subsection": _open(F.col("level"), F.col("title"), 3, order), "last": F.last("level", ignorenulls=True).over(order)})
    a = a.filter("asks = 1").select("doc_id", F.col("page").alias("before"), "section", "subsection", F.repeat(F.lit("#"), F.col("last")).alias("level"))
    return b.join(a, (b["doc_id"] == a["doc_id"]) & (b["first_page"] - 1 == a["before"])).select(b["doc_id"], "batch", "first_page", "last_page", "section", "subsection", "level")


# The state as a prompt shows it.
def state_text(first_page: Column, section: Column, subsection: Column, level: Column) -> Column:
    no = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    open_ = F.concat(
        F.lit("Estado hierárquico herdado da Página "), (first_page - 1).cast("string"), F.lit(":\n- Seção Principal Ativa (##): "), no(section, "Nenhuma"), F.lit("\n- Subseção Ativa (###): "), no(subsection, "Nenhuma"),
        F.lit("\n- Nível Ativo: "), no(level, "Nenhum"), F.lit("\nSubseções não nomeadas continuam sob a seção/subseção ativa acima."),
    )
    return F.when(first_page <= 1, "Estado prévio: " + NOTHING_OPEN).otherwise(open_)


def contents_list(items: DataFrame) -> DataFrame:
    """(doc_id, text): the entries of levels 2 to 4 as a nested Markdown list with links to their pages."""
    indent = F.repeat(F.lit("  "), F.col("level").cast("int") - 2)
    line = F.concat(indent, F.lit("- ["), "title", F.lit("](#pág-"), F.col("page").cast("string"), F.lit(")"))
    rows = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("level").between(2, LEVELS), F.struct("pos", line.alias("line"))))).alias("rows"))  # a document's entries
    return rows.select("doc_id", F.array_join(F.concat(F.array(F.lit(CONTENTS)), F.transform("rows", lambda r: r["line"])), "\n").alias("text"))
