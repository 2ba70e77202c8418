"""Operator 2, quality rules: a table of thresholds compiled into one projection, with no user functions.

A rule bounds 100 * numerator / denominator, both whole numbers, so that every engine decides alike. The same table
compiles to Spark columns here and to SQL text for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.shared import SPACE_CLASS


@dataclass(frozen=True)
class Rule:
    """Keep while ``least * denominator <= 100 * numerator <= most * denominator``; None: no bound."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None

    def sql(self) -> str:
        sides = []
        if self.least is not None:
            sides.append(f"100 * ({self.numerator}) >= {self.least} * ({self.denominator})")
        if self.most is not None:
            sides.append(f"100 * ({self.numerator}) <= {self.most} * ({self.denominator})")
        return "(" + " AND ".join(sides) + ")"


#: Least words, and the greatest percentage of words in repeated windows, of the base rule.
BASE_WORDS = 50
BASE_REPEAT = 50
WINDOW = 3
#: Bits of a window's place beside its hash.
PLACE_BITS = 24
PLACE = 1 << PLACE_BITS

RULES = (
    Rule("word_length", "word_chars", "n_words", 250, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamation", "n_exclaims", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 6, 70),
    Rule("doubled_words", "n_doubled", "n_words", None, 20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)

# Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the of and to a in is it that was for on are with as be this by or at from an have not "
    "de la le et les des en un du une que pour est dans qui par sur pas avec au ce il se ne plus "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an "
    "el los las del y con por para no lo su al como más pero"
).split()


def _sorted_windows(w: Column) -> Column:
    """Places, in order, of the windows that are found twice or more, by sorting the windows themselves."""
    grams = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.struct(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, WINDOW)]).alias("gram"), i.alias("at")),
    )
    # the sorted array is bound once, as the one item of an array
    return F.flatten(F.transform(F.array(F.sort_array(grams)), _neighbours))


def _neighbours(g: Column) -> Column:
    same = lambda x, y: F.coalesce(x["gram"] == y["gram"], F.lit(False))
    twice = F.filter(g, lambda x, i: same(x, F.get(g, i + 1)) | same(x, F.when(i > 0, F.get(g, i - 1))))
    return F.sort_array(F.transform(twice, lambda x: x["at"].cast("long")))


def _counts(docs: DataFrame) -> DataFrame:
    """The counts that rules name. Expressions build on columns of an inner projection, so each is computed once."""
    words = F.array_remove(F.split("text", f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.withColumns({"words": words, "lines": lines})
    a = a.withColumn("n_words", F.size("words").cast("long"))
    w = F.col("words")
    windows = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    own = F.lit(PLACE - 1).cast("long")
    # a window's hash and place in one number, so that the array to sort is one of plain numbers
    a = a.withColumn("keys", F.sort_array(F.transform(F.slice(w, 1, windows), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]).bitwiseAND(F.bitwise_not(own)).bitwiseOR(i.cast("long")))))
    g = F.col("keys")
    same = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0
    a = a.withColumn("found", F.filter(g, lambda x, i: same(x, F.get(g, i + 1)) | same(x, F.get(g, i - 1))))
    f, place = F.col("found"), lambda x: x.bitwiseAND(own).cast("int")
    # hashes that agree where words don't, or more places than fit: then the windows themselves are sorted
    differ = lambda x, y: same(x, y) & reduce(or_, [F.get(w, place(x) + k) != F.get(w, place(y) + k) for k in range(WINDOW)])
    mixed = F.exists(F.transform(f, lambda x, i: F.coalesce(differ(x, F.get(f, i + 1)), F.lit(False))), lambda x: x)
    a = a.withColumn("twice", F.when((F.size(w) >= PLACE) | mixed, _sorted_windows(w)).otherwise(F.sort_array(F.transform(f, lambda x: x.bitwiseAND(own)))))
    t = F.col("twice")
    covered = F.aggregate(F.transform(t, lambda x, i: F.coalesce(F.least(F.get(t, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    bare = lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))
    return a.select(
        "doc_id", "n_words",
        F.length(F.regexp_replace("text", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaims"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("words", lambda x: bare(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda x, i: F.coalesce(F.get(w, i + 1) == x, F.lit(False)))).cast("long").alias("n_doubled"),
        covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every whole text.

    Words are runs without white space (blank, tab to carriage return), lines are split at line feeds and count
    if they hold a word. Null and empty texts have no words and fail the base rule. Every row is judged by itself:
    repeated rows give repeated rows, an empty table none; a null doc_id stays null. Extra columns are ignored.
    ``failed`` names the rules that a text breaks, in the table's order, joined by blanks.
    """
    counted = _counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    failed = F.concat_ws(" ", *[F.when(~F.expr(r.sql()), F.lit(r.name)) for r in rules])
    out = counted.withColumns({"base_failed": base_failed(), "failed": failed})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "n_exclaims", "n_stop_words", "n_doubled", "n_lines", "n_ellipsis_lines", "n_bullet_lines", "failed")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``judge`` over the view ``documents``."""
    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)
    failed = " || ".join(f"CASE WHEN NOT {r.sql()} THEN ' {r.name}' ELSE '' END" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
                  generate_subscripts(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM d),
near AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS times FROM near WHERE w2 IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM grams, (VALUES (0), (1), (2)) AS t(k) WHERE times > 1 GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars,
                 count(*) FILTER (WHERE lower(rtrim(w, '.,;:!?')) IN ({stops})) AS n_stop_words, count(*) FILTER (WHERE w = w1) AS n_doubled FROM near GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                 count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis_lines,
                 count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS n_bullet_lines
          FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
                  coalesce(n_stop_words, 0)::BIGINT AS n_stop_words, coalesce(n_doubled, 0)::BIGINT AS n_doubled, coalesce(n_lines, 0)::BIGINT AS n_lines,
                  coalesce(n_ellipsis_lines, 0)::BIGINT AS n_ellipsis_lines, coalesce(n_bullet_lines, 0)::BIGINT AS n_bullet_lines
           FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, (n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words) AS base_failed, ltrim({failed}) AS failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed = '') AS kept,
       n_exclaims, n_stop_words, n_doubled, n_lines, n_ellipsis_lines, n_bullet_lines, failed FROM judged
"""
