"""From raw documents to packed sequences: five stages, each calling one operator.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents; columns beyond
these end with the first stage that rewrites texts. No rows give no rows. Rows are told apart by
keys of their own, never by doc_id, which may be null or repeated. A text is one value of a row,
of any length that fits in a task; no stage looks at a prefix of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestflow.llm import minhash, mixing, packing, quality, suffixes
from contestflow.llm.common import materialize, table, words_of

#: Bytes of a passage that goes when it repeats: fifty words of four bytes with their spaces. A
#: passage of over fifty words that has fewer bytes (words of one or two letters) stays.
PASSAGE_BYTES = 200


def _rows(docs: DataFrame) -> Column:
    """A row as one struct, so that no name of the work meets a column of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null, empty and short texts (under 50 words) fail the base rule and go, as do repetitive ones;
    a null source or lang plays no part. Repeated rows stay or go together. No tie can arise.
    """
    judged = quality.judge(docs.select(_rows(docs), "text"))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id.

    The operator runs on a key of the rows, so repeated rows, rows without doc_id and different
    texts under one doc_id are documents of their own; of rows with the same doc_id the one with
    the least key stays, and null doc_ids come last. Null and wordless texts resemble nothing and
    all stay. Copies are collapsed before they meet, so large groups cost a row each.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("key"), _rows(docs)), "rows")
    keyed = rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    groups = minhash.near_duplicates(keyed).select(F.col("doc_id").alias("key"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stay = rows.select("key", F.col("row.doc_id").alias("doc_id")).join(groups, "key").groupBy("component_id").agg(F.min(first)["key"].alias("key"))
    return rows.join(stay.select("key"), "key", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of ``PASSAGE_BYTES`` that occur elsewhere.

    Every occurrence goes, those inside one text included; a text that is all passage stays as an
    empty one. A null text comes back as an empty one. Repeated rows are two places and lose
    their texts (the stage before leaves none).
    """
    cut = suffixes.remove_repeats(docs, length=PASSAGE_BYTES, with_text=True, carry=("lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at the end of the budget in part.

    Documents without words (null and empty texts) are taken 0 times and go. A null source is a
    source of its own, last in order. Equal hashes are told apart by doc_id and then by the row.
    A text cut at the budget's end is its first words with single spaces.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "lang", "source", "n_chars"), "rows")
    taken = mixing.mix(rows, row="key").filter("taken > 0").select("key", "size", "taken")
    # A document of n words taken k times and r words more is given k times and cut to r words once.
    whole = F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rest = F.col("taken") % F.col("size")
    parts = F.explode(F.when(rest > 0, F.concat(whole, F.array(rest))).otherwise(whole)).alias("words")
    drawn = rows.join(taken.select("key", "size", parts), "key")
    cut = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col("words").cast("int")), " ")
    out = drawn.withColumn("part", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")))
    chars = F.when(F.col("words") < F.col("size"), F.char_length("part").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("part").alias("text"), "lang", "source", chars.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids, with the ids.

    A null or empty text is its end id alone; repeated rows are packed each on their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("packing", packed),
]
ORACLE_SQL = None  # signatures, suffix runs, hash order and ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
