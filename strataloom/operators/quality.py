"""How good recognized pages and extracted graphs are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of tables, headings, keywords and figures, patterns of their marks, and the price for a million
# tokens of a model that has none of its own.
WEIGHTS = {"tables": 0.35, "headings": 0.25, "keywords": 0.25, "figures": 0.35}
ROW, DELIMITER = r"\|[^\n]*\|", r"\|[-:\s]+\|"
FIGURE, DESCRIPTION = r"(?i)(>\s*\*\*\[Figura|\[Figura\s*\d+)", r"(?i)descri[cç][aã]o\s*visual"


def found_share(wanted: Column, text: Column) -> Column:
    """The share of the wanted strings that a text holds, case aside."""
    low = F.lower(text)
    return F.size(F.filter(wanted, lambda w: F.contains(low, F.lower(w)))) / F.size(wanted)


def ocr_scores(pages: DataFrame) -> DataFrame:
    """pages with score_tables, score_headings, score_keywords, score_figures (0 to 100, 100 where nothing is expected) and
    quality, the weighted mean of those that apply, 100 if none does.

    pages: text, and what is expected: columns, headings, keywords (arrays of strings) and has_figure.
    """
    text = F.coalesce("text", F.lit(""))
    asks = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0  # noqa: E731  a null array asks for nothing
    table = (F.regexp_count(text, F.lit(ROW)) >= 3) & text.rlike(DELIMITER)
    share = found_share(F.col("columns"), text)
    parts = {
        "tables": (asks("columns"), F.when(table, 50 + share * 50).otherwise(share * 40)),
        "headings": (asks("headings"), found_share(F.col("headings"), text) * 100),
        "keywords": (asks("keywords"), found_share(F.col("keywords"), text) * 100),
        "figures": (F.coalesce("has_figure", F.lit(False)), text.rlike(FIGURE).cast("double") * 50 + text.rlike(DESCRIPTION).cast("double") * 50),
    }
    scored = pages.withColumns({f"score_{k}": F.when(c, s).otherwise(100.0) for k, (c, s) in parts.items()})
    weight = sum((F.when(c, WEIGHTS[k]).otherwise(0.0) for k, (c, _) in parts.items()), F.lit(0.0))
    total = sum((F.when(c, s * WEIGHTS[k]).otherwise(0.0) for k, (c, s) in parts.items()), F.lit(0.0))
    return scored.withColumn("quality", F.when(weight > 0, total / weight).otherwise(100.0))


def cost_of_thousand(prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """What a thousand pages cost, from one page's tokens and prices for a million."""
    return (prompt_tokens / 1e6 * prompt_price + completion_tokens / 1e6 * completion_price) * 1000


def model_means(results: DataFrame) -> DataFrame:
    """(model, n, quality, latency_ms, cost_of_thousand): means by model, the best quality first."""
    return results.groupBy("model").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("latency_ms").alias("latency_ms"), F.avg("cost_of_thousand").alias("cost_of_thousand")).orderBy(F.desc("quality"), "model")
