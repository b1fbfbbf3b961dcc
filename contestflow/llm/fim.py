"""Fill-in-middle: documents cut in three and rearranged around sentinels, and put back again.

``regexp_extract_all`` makes the array of units, groups of a SHA-256 of the document's key give the
cuts and the form, slices of the array joined again are the parts. Restoring looks for the
sentinels. SQL functions only; every document is transformed inside its own row, so the plan is
scan -> project without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Sentinels:
    """Strings before the prefix, the suffix and the middle; none may overlap with itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


#: Units are runs of Latin letters and single other code points.
UNIT = "[A-Za-z]+|[^A-Za-z]"
SENTINELS = Sentinels()


def draw(key: Column, seed: int, k: int) -> Column:
    """The k-th (from 0) 32-bit number of the SHA-256 of ``seed:key``; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sentinels = SENTINELS, prefix: str = "") -> DataFrame:
    """Add n (units), form (plain, psm or spm), prefix_chars, middle_chars and output to every row.

    ``plain_percent`` of the documents stay as they are, ``spm_percent`` of the others have their
    suffix first. A null or empty text, and one that holds a sentinel, is always plain, with null
    lengths and its text (null: empty) as output. Draws depend on the key alone: rows with one key,
    repeated ones included, share them (their cuts too, if they have the same number of units), and
    all rows without a key do. A text of any length is cut whole, as one array in its row. Columns
    that have the name of an added one are replaced; ``prefix`` names the added ones apart. No rows
    give no rows, and no tie can arise.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        whole.alias("_text"),
        F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)).alias("_units"),
        *[draw(F.col(f"`{key}`"), seed, k).alias(f"_h{k}") for k in range(4)],
    )
    n = F.size("_units").cast("long")
    sized = held.select("*", n.alias("_n"), F.pmod(F.col("_h0"), n + 1).alias("_x"), F.pmod(F.col("_h1"), n + 1).alias("_y"))
    marked = F.lit(False)
    for s in sentinels.all():
        marked = marked | F.contains("_text", F.lit(s))
    stays = (F.col("_n") == 0) | marked | (F.col("_h2") % 100 >= 100 - plain_percent)
    form = F.when(stays, "plain").when(F.col("_h3") % 100 < spm_percent, "spm").otherwise("psm")
    formed = sized.select("_row", "_text", "_units", "_n", F.least("_x", "_y").cast("int").alias("_a"), F.greatest("_x", "_y").cast("int").alias("_b"), form.alias("_form"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("_form") != "plain", F.array_join(F.slice("_units", start, length), ""))

    a, b = F.col("_a"), F.col("_b")
    parts = formed.select(
        "_row", "_text", "_n", "_form", part(F.lit(1), a).alias("_p"), part(a + 1, b - a).alias("_m"), part(b + 1, F.col("_n").cast("int") - b).alias("_s")
    )
    p, s, m = (F.lit(x) for x in sentinels.all())
    psm = F.concat(p, "_p", s, "_s", m, "_m")
    spm = F.concat(s, "_s", p, "_p", m, "_m")
    added = {
        "n": F.col("_n"),
        "form": F.col("_form"),
        "prefix_chars": F.char_length("_p").cast("long"),
        "middle_chars": F.char_length("_m").cast("long"),
        "output": F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm).otherwise(F.col("_text")),
    }
    names = [prefix + c for c in added]
    return parts.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in names], *[v.alias(c) for c, v in zip(names, added.values(), strict=True)])


def restore(output: Column, form: Column, sentinels: Sentinels = SENTINELS) -> Column:
    """The text that ``rearrange`` made ``output`` of.

    The parts hold no sentinel and none can arise where a part meets one, as a sentinel never
    overlaps with itself; so the first of each kind is the one that was put there. A null output or
    form gives null.
    """
    p, s, m = sentinels.all()
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)

    (psm_prefix, psm_suffix), (spm_suffix, spm_prefix) = parts(p, s), parts(s, p)
    whole = F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix))
    return F.when(form == "plain", output).otherwise(whole)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
d AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS y,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM u),
f AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(units[greatest(x, y) + 1:n], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM f),
r AS (
  SELECT *, instr(output, '<P>') AS ip, instr(output, '<S>') AS is_, instr(output, '<M>') AS im FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                WHEN 'psm' THEN substr(output, 4, is_ - 4) || substr(output, im + 3) || substr(output, is_ + 3, im - is_ - 3)
                ELSE substr(output, ip + 3, im - ip - 3) || substr(output, im + 3) || substr(output, 4, ip - 4) END) AS restored_sha256
FROM r"""
