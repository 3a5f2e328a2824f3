"""A head fitted on frozen features: logistic regression, the pass kept that has the best balanced accuracy on rows it hasn't seen."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.65


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows)


def with_probability(model: LogisticRegressionModel, rows: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """Rows with the head's probability; rows with a null or NaN feature go."""
    scored = model.transform(assembled(rows, features))
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def fit_head(train: DataFrame, valid: DataFrame, features: list[str], label: str, passes: tuple[int, ...] = (1, 3, 10, 30), cut: float = CUT) -> tuple[LogisticRegressionModel, float]:
    """The model of the number of passes whose balanced accuracy at ``cut`` is best on ``valid`` (``train``, if that is empty), the fewest among equals; and that accuracy."""
    held = assembled(train, features).select("_x", F.col(label).cast("double").alias("_y")).cache()
    check = train if valid.isEmpty() else valid
    best: tuple[LogisticRegressionModel, float] | None = None
    for n in passes:
        model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=n, regParam=1e-4).fit(held)
        scored = with_probability(model, check, features)
        rates = scored.agg(F.avg(F.when(F.col(label) == 1, (F.col("p") >= cut).cast("double"))).alias("t"), F.avg(F.when(F.col(label) == 0, (F.col("p") < cut).cast("double"))).alias("f")).first()
        accuracy = ((rates["t"] or 0.0) + (rates["f"] or 0.0)) / 2 if rates["t"] is not None and rates["f"] is not None else 0.0
        if best is None or accuracy > best[1]:
            best = (model, accuracy)
    held.unpersist()
    return best
