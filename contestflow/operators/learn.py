"""Impute, scale and classify: aggregates in SQL, models from pyspark.ml, stored and loaded again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def known(c: str) -> Column:
    """The column as a double, null where it is not a number."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


#: Share of the rows on each side of a median among which it is searched for, and the sketch's accuracy.
NEAR, SKETCH = 5e-4, 10_000


def medians(df: DataFrame, columns: Sequence[str], near: float = NEAR) -> dict[str, float | None]:
    """Exact medians, None where a column has no numbers.

    A sketch gives bounds that hold the middle of each column; only the values between them are
    ordered, beside the number of those below. So no task holds a column's values, as the exact
    percentile's one table of all of them does.
    """
    names = {f"_{i}": c for i, c in enumerate(columns)}
    rows = df.select(*[known(c).alias(i) for i, c in names.items()])
    found = rows.agg(*[F.count(i).alias(f"n{i}") for i in names], *[F.percentile_approx(i, [max(0.5 - near, 0.0), min(0.5 + near, 1.0)], SKETCH).alias(f"at{i}") for i in names]).first()
    some = [i for i in names if found[f"n{i}"]]
    if not some:
        return dict.fromkeys(columns)
    bounds = {i: found[f"at{i}"] for i in some}
    below = rows.agg(*[F.count(F.when(F.col(i) < bounds[i][0], 1)).alias(i) for i in some]).first()
    inside = [F.when(F.col(i).between(*bounds[i]), F.struct(F.lit(i).alias("i"), F.col(i).alias("v"))) for i in some]
    counts = rows.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    out: dict[str, float | None] = dict.fromkeys(columns)
    picked = []
    for i in some:
        for place in ((found[f"n{i}"] + 1) // 2, found[f"n{i}"] // 2 + 1):
            picked.append((F.col("i") == i) & (F.col("upto") >= place - below[i]) & (F.col("upto") - F.col("n") < place - below[i]))
    values: dict[str, list[float]] = {}
    for r in upto.filter(reduce(Column.__or__, picked)).collect():  # two a column at most
        values.setdefault(r.i, []).append((r.v, r.upto - r.n + below[r.i], r.upto + below[r.i]))
    for i in some:
        middle = [next((v for v, a, b in values.get(i, []) if a < place <= b), None) for place in ((found[f"n{i}"] + 1) // 2, found[f"n{i}"] // 2 + 1)]
        if None in middle:  # the sketch's bounds missed it
            return medians(df, columns, 0.5 if near >= 0.05 else max(10 * near, NEAR))
        out[names[i]] = 0.5 * middle[0] + 0.5 * middle[1]
    return out


def prepare(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Median, mean and population deviation of each column after imputing; NaN is imputed as null is, columns without values go."""
    med = medians(train, columns)
    used = [c for c in columns if med[c] is not None]
    filled = train.select(*[F.coalesce(known(c), F.lit(med[c])).alias(c) for c in used])
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in used], *[F.stddev_pop(c).alias(f"s_{c}") for c in used]).first()
    return {c: (med[c], row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in used}


def scaled(df: DataFrame, figures: dict[str, tuple[float, float, float]]) -> DataFrame:
    z = {f"_z_{c}": (F.coalesce(known(c), F.lit(median)) - mean) / deviation for c, (median, mean, deviation) in figures.items()}
    return VectorAssembler(inputCols=list(z), outputCol="_features").transform(df.withColumns(z))


def logistic(n: int, c: float = 1.0) -> LogisticRegression:
    """L2 with strength 1/(c n), n the number of training rows: a penalty on the sum of losses."""
    return LogisticRegression(featuresCol="_features", labelCol="target", regParam=1.0 / (c * n), standardization=False, maxIter=1000, tol=1e-9, predictionCol="_prediction", rawPredictionCol="_raw", probabilityCol="_probability")


def boosted(rounds: int = 50, seed: int = 42) -> GBTClassifier:
    trees = GBTClassifier(featuresCol="_features", labelCol="target", predictionCol="_prediction", maxIter=rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=seed)
    return trees.setRawPredictionCol("_raw").setProbabilityCol("_probability")


@dataclass(frozen=True)
class Fitted:
    """A classifier with what its features were imputed and scaled by."""

    figures: dict[str, tuple[float, float, float]]
    model: object

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p``, the probability of the blue side; null features have their medians."""
        out = self.model.transform(scaled(df, self.figures)).withColumn("p", vector_to_array("_probability")[1])
        return out.select(*df.columns, "p")

    def weights(self) -> list[tuple[str, float]]:
        """(feature, importance), best first: tree importances or absolute coefficients."""
        w = self.model.featureImportances if hasattr(self.model, "featureImportances") else abs(self.model.coefficients.toArray())
        return sorted(((c, float(x)) for c, x in zip(self.figures, w.toArray() if hasattr(w, "toArray") else w, strict=True)), key=lambda x: (-x[1], x[0]))


def fit(train: DataFrame, columns: Sequence[str], estimator) -> Fitted:
    figures = prepare(train, columns)
    return Fitted(figures, estimator.fit(scaled(train, figures)))


FIGURES = "position int, feature string, median double, mean double, deviation double"


def save(fitted: Fitted, path: str) -> None:
    """Store model and figures below ``path``; what was there is replaced."""
    fitted.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    rows = [(i, c, *map(float, f)) for i, (c, f) in enumerate(fitted.figures.items())]
    spark.createDataFrame(rows, FIGURES).coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")


def load(spark: SparkSession, path: str) -> Fitted:
    """The stored model; a missing path raises the reader's PATH_NOT_FOUND error."""
    rows = spark.read.schema(FIGURES).parquet(f"{path}/figures").orderBy("position").collect()  # one per feature
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return Fitted({r.feature: (r.median, r.mean, r.deviation) for r in rows}, model)
