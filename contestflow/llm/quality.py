"""Quality rules: a table of thresholds compiled into one projection of ratios.

Everything is built from SQL functions; each document is judged inside its own row, so the
operator has no shuffle and the plan is scan -> project.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is it that for on with by as are was be this from at or an a not you have he which but".split(),
    "de": "der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als auch es an er".split(),
    "fr": "le la les de des du et en un une que qui dans est pour par sur au aux ce il elle pas ne se".split(),
    "es": "el la los las de del y en que un una por con para es se su al lo no como más o sus".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; an absent bound is open, 0/0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


# Lengths are judged in code points, symbols and stop words per word, the rest per line.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.20),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.30),
)


def _stop_words() -> list[str]:
    lower = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return lower + [w.capitalize() for w in lower]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only a text with a repeated window pays for the sort
    of (hash, position) pairs; equal neighbours mark the positions.
    """
    grams = F.transform(
        F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c")),
        lambda g: F.xxhash64(g["a"], g["b"], g["c"]),
    )

    def positions(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            size = F.size(p)
            after = F.concat(F.slice(p, 2, size - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(p, 1, size - 1))
            zipped = F.arrays_zip(p.alias("p"), before.alias("b"), after.alias("a"))
            hit = F.filter(zipped, lambda z: (z["p"]["h"] == z["b"]["h"]) | (z["p"]["h"] == z["a"]["h"]))
            at = F.transform(hit, lambda z: z["p"]["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return _let(pairs, marked)

    return F.when(n < 3, F.lit(0)).otherwise(
        _let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(positions(h)))
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(text: Column, words: Column) -> dict[str, Column]:
    n = F.size(words)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    counts = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(_stop_words()))),
        "n_repeat_words": _repeat_words(words, n),
        "lines": _let(
            lines,
            lambda x: F.struct(
                F.size(x).alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09]*[-*•]"))).alias("n_bullet_lines"),
                F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).alias("n_ellipsis_lines"),
            ),
        ),
    }
    return counts


def verdict(rules: Iterable[Rule]) -> Column:
    """Conjunction of all rules, in products so that no division by zero occurs."""
    parts = []
    for r in rules:
        top, bottom = F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            parts.append(top >= F.lit(r.low) * bottom)
        if r.high is not None:
            parts.append(top <= F.lit(r.high) * bottom)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", prefix: str = "") -> DataFrame:
    """Add measures, ``base_failed`` and ``kept`` to every row; no row goes.

    A null text has no words and fails the base rule, as has an empty one. Repeated rows are
    judged alike, and nothing depends on order. A long text is measured whole, in its row. Columns
    of the same name as a measure are replaced. ``prefix`` names the added columns apart from those
    of the input. No rows give no rows.
    """
    longs = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_repeat_words")
    flat = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")
    names = (*longs, *flat, "base_failed", "kept")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), words_of(F.col(f"`{text}`")).alias("_words"))
    m = held.select("_row", F.struct(*[c.alias(k) for k, c in measures(F.col("_row")[text], F.col("_words")).items()]).alias("_m"))
    m = m.select("_row", *[F.col(f"_m.{c}").cast("long").alias(c) for c in longs], *[F.col(f"_m.lines.{c}").cast("long").alias(c) for c in flat])
    m = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    m = m.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    added = {f"{prefix}{c}": c for c in names}
    return m.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *[F.col(c).alias(a) for a, c in added.items()])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in _stop_words())
    conds = []
    for r in RULES:
        if r.low is not None:
            conds.append(f"{r.numerator} >= {r.low}::DOUBLE * {r.denominator}")
        if r.high is not None:
            conds.append(f"{r.numerator} <= {r.high}::DOUBLE * {r.denominator}")
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09]*[-*\x{{2022}}]')) AS n_bullet_lines,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|\x{{2026}})[\x20\x09\x0D]*$')) AS n_ellipsis_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
g AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t) WHERE n >= 2),
p AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines,
         len(list_filter(words, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(conds)} AS kept, n_lines, n_stop_words
FROM b"""


OP7_SQL = _sql()
