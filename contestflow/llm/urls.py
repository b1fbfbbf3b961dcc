"""URL filters: explicit host and path rules, then logistic regression on hashed n-grams."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path); a rule fits its host and all subdomains and paths that start with its own.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# The labelled table is built by rule from these. Host names combine a stem with an affix that both
# classes share; made-up names stand for the long tail of ordinary hosts, so that what the model
# does not know it allows.
UNWANTED = (
    "casino poker roulette blackjack jackpot slots bingo betting bookmaker wager gamble lottery "  # gambling
    "porn xxx sexcam escort hentai nude milf adult erotic hookup fetish livesex "  # adult
    "viagra cialis pharmacy pills steroid tramadol valium xanax painkiller weightloss detox botox "  # drugs
    "payday quickloan creditfix getrich prize giveaway doubler profit moneymaker inheritance refund bonus "  # scams
    "adserver banner popunder clicktrack tracking affiliate adnetwork retarget pixel sponsor telemetry doubleclick "  # adverts
    "replica counterfeit warez keygen crack torrent phishing spam malware spyware cheats knockoff"  # fakes and malware
).split()
ORDINARY = (
    "library museum science journal archive history university campus physics chemistry biology maths "
    "garden kitchen recipe weather travel hotel airport railway harbour bridge mountain valley "
    "music theatre cinema orchestra gallery painting poetry novel publisher bookshop letters atlas "
    "council parliament ministry court police firebrigade hospital clinic dentist nursery school teacher "
    "football tennis cycling rowing athletics hiking climbing sailing chess knitting pottery carpentry "
    "software database network compiler robotics astronomy geology forest river wildlife farming bakery"
).split()
AFFIXES = "best free online my the top world hub zone club shop live now plus pro land city box win 24 365 daily direct central group house point first x cheap web".split()
LANGS = ("en", "de", "fr", "es")
#: Made-up ordinary names in the table.
MADE_UP = 700


def named(stems: list[str]) -> list[tuple[str, str]]:
    """(stem, host name): each stem alone and with eight affixes before or after it."""
    out = []
    for i, stem in enumerate(stems):
        out.append((stem, stem))
        for k in range(8):
            affix, dash = AFFIXES[(5 * i + 7 * k) % len(AFFIXES)], "-" * ((i + k) % 2)
            out.append((stem, affix + dash + stem if (i + k) % 3 else stem + dash + affix))
    return out


def made_up(n: int) -> list[str]:
    """Pronounceable names of two to four syllables, every other one with an affix; the same for the same n."""
    draw = random.Random(5)
    begin = ["", *"bcdfghjklmnprstvwyz", *"bl br ch cl cr dr fl fr gl gr pl pr qu sh sk sl sp st str sw th tr wh".split()]
    middle, end = [*"aeiou", *"ai ea ee ie io oa oo ou".split()], ["", "", *"dklmnprstxy", *"ck ld ll nd ng nt rd rn rt sh ss st th".split()]
    out = []
    for k in range(n):
        name = "".join(draw.choice(begin) + draw.choice(middle) + draw.choice(end) for _ in range(2 + k % 3))
        affix, dash = draw.choice(AFFIXES), "-" * draw.randrange(2)
        out.append(name if k % 2 else (affix + dash + name, name + dash + affix)[k % 4 // 2])
    return out


def labelled_urls() -> list[tuple[str, float, str]]:
    """The training table, under 2800 rows: (url, 1.0 for blocked, the stem or made-up name)."""
    rows, bad, good = [], named(UNWANTED), named(ORDINARY)

    def url(n: int, host: str, path: str) -> str:
        sub, top, tail = ("", "www.", "m.", "blog.", "news.")[n % 5], ("com", "net", "info", "example.net", "org")[n // 2 % 5], ("", "?page=2&ref=x", ".html", "#top", "/")[n // 3 % 5]
        return f"{('https', 'http')[n % 2]}://{sub}{host}.{top}/{path}/{100 + 37 * n % 900}{tail}"

    for n, ((x, b), (y, g)) in enumerate(zip(bad, good, strict=True)):
        lang = LANGS[n % 4]
        rows += [(url(n, b, lang), 1.0, x), (url(n, g, lang), 0.0, y)]
        if n % 3 == 0:
            rows += [(url(n, good[-n - 1][1], b), 1.0, x), (url(n, good[-n - 1][1], g), 0.0, y)]
    return rows + [(url(n, name, LANGS[n % 4]), 0.0, name) for n, name in enumerate(made_up(MADE_UP))]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """Character n-grams of ``^host`` and of ``/path$``, each marked with its part; one pass over the string for each size."""
    def grams(mark: str, s: Column, n: int) -> Column:
        # a substring by position, inside a lambda, would build the string and walk it again for every n-gram
        found = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
        return F.coalesce(F.transform(found, lambda g: F.concat(F.lit(mark), g)), F.array().cast("array<string>"))

    h, p = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    p = F.regexp_replace(p, "[0-9]+", "0")
    return F.concat(*[grams("h", h, n) for n in sizes], *[grams("p", p, n) for n in sizes])  # repeats count once: the hashing is binary


#: Prefix of the model's own columns, so that they meet none of the input's.
_MODEL = "__url_model_"


@dataclass(frozen=True)
class UrlModel:
    hashing: HashingTF
    model: LogisticRegressionModel

    def score(self, df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
        """Add ``p_block``, the probability that the url is unwanted."""
        scored = self.model.transform(self.hashing.transform(df.withColumn(_MODEL + "grams", ngrams(F.col(host), F.col(path)))))
        return scored.withColumn("p_block", vector_to_array(_MODEL + "probability")[1]).drop(*[_MODEL + c for c in ("grams", "features", "raw", "probability", "prediction")])


def train(spark: SparkSession, rows: list[tuple[str, float]] | None = None, features: int = 1 << 15) -> UrlModel:
    """Fit on (url, label) rows: by default the labelled table, which does not grow with the input."""
    hashing = HashingTF(numFeatures=features, binary=True, inputCol=_MODEL + "grams", outputCol=_MODEL + "features")
    rows = rows or [r[:2] for r in labelled_urls()]
    data = spark.createDataFrame(rows, "url string, label double").coalesce(1)
    data = data.select("label", ngrams(host_of(F.col("url")), path_of(F.col("url"))).alias(_MODEL + "grams"))
    lr = LogisticRegression(
        featuresCol=_MODEL + "features", labelCol="label", maxIter=60, regParam=0.001,
        rawPredictionCol=_MODEL + "raw", probabilityCol=_MODEL + "probability", predictionCol=_MODEL + "prediction",
    )
    return UrlModel(hashing, lr.fit(hashing.transform(data)))


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule, p_block and verdict to each row; no row goes.

    A null url or one without ``://`` has an empty host and path and is judged by the model.
    Repeated rows are judged alike; columns of those names are replaced. Of rules that fit, the
    longest wins; two of one length that fit would have to be equal. A long url is judged whole: its
    n-grams grow with it, in one row. No rows give no rows. One projection, no shuffle.
    """
    df = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    df = model.score(df).withColumn(_MODEL + "rule", rule_of(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    found = F.col(_MODEL + "rule")
    return df.withColumns({"rule": found["rule"], "verdict": F.coalesce(found["verdict"], by_model)}).drop(_MODEL + "rule")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(spark)).select("page_id", "host", "path", "rule", "verdict", "p_block")
