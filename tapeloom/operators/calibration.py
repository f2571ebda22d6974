"""Out-of-sample probabilities of a rise: forward folds over all symbols at once, fitted by Spark, with a Platt step.

Folds are spans of time. The model of a fold learns from rows dated before the fold by more than the embargo, so that no label
reaches into it; its Platt curve is fitted to the out-of-sample scores of the folds before. The first span only trains.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions import scans, windows as w
from tapeloom.sources.shared import cut, files

FOLDS, EMBARGO_DAYS, RIDGE = 4, 5, 0.01
FEATURES = ("close_z", "ret_z", "volume_z", "momentum", "reversal")
#: Rows that a Platt curve needs; before that many the model's own curve stands.
LEAST_PLATT = 200


def panel(bars: DataFrame) -> DataFrame:
    """bars with the features, and y: whether the next log return is positive (missing at the end of a symbol)."""
    x = bars.withColumn("lr", w.log_return())
    x = x.withColumns({"ret": w.change("close"), "reversal": F.coalesce(w.change("close", 5), F.lit(0.0))})
    x = x.withColumn("momentum", F.coalesce(w.mean("ret", 20) / F.nullif(w.std("ret", 20), F.lit(0.0)), F.lit(0.0)))
    x = scans.zscores(x, {"close_z": ("close", 60), "ret_z": ("lr", 126), "volume_z": ("volume", 60)})
    return x.withColumn("y", (F.lead("lr").over(w.W) > 0).cast("double")).where("lr IS NOT NULL")


def spans(x: DataFrame, folds: int = FOLDS, at: str = "date") -> list[datetime.date]:
    """First days of the folds, and the day after the last: each span has about as many days of the calendar of x."""
    days = x.select(at).distinct().agg(F.percentile(F.unix_date(at), [k / (folds + 1) for k in range(1, folds + 1)]).alias("q"), F.max(F.unix_date(at)).alias("last")).first()
    first = datetime.date(1970, 1, 1)
    return [first + datetime.timedelta(days=int(d)) for d in [*days.q, days.last + 1]]


def model_path(path: str, fold: int, kind: str) -> str:
    return f"{path}/fold={fold}/{kind}"


def _margin(model: PipelineModel, x: DataFrame) -> DataFrame:
    return model.transform(x).withColumn("margin", vector_to_array("rawPrediction")[1])


def curve(model: LogisticRegressionModel | None, margin: Column) -> Column:
    """Probability of a margin by a Platt curve, or by the model's own."""
    a, b = (float(model.coefficients[0]), float(model.intercept)) if model else (1.0, 0.0)
    return 1 / (1 + F.exp(-(margin * a + b)))


def platt(scored: DataFrame) -> LogisticRegressionModel:
    """Logistic curve of y over the margin, without a penalty."""
    x = VectorAssembler(inputCols=["margin"], outputCol="m").transform(scored.select("margin", "y"))
    return LogisticRegression(featuresCol="m", labelCol="y", maxIter=200, tol=1e-10, standardization=False).fit(x)


def fit(x: DataFrame, path: str, features: tuple[str, ...] = FEATURES, weight: str | None = None, folds: int = FOLDS, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """Fit the folds' models, store them below `path`, and give (symbol, date, fold, margin, prob, y) of all rows out of sample."""
    edges, done = spans(x, folds), []
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    logistic = LogisticRegression(labelCol="y", regParam=RIDGE, maxIter=100, **({"weightCol": weight} if weight else {}))
    for k, (begin, end) in enumerate(zip(edges[:-1], edges[1:]), 1):
        known = F.col("date") < F.lit(begin - datetime.timedelta(days=embargo))
        model = Pipeline(stages=[*stages, logistic]).fit(x.where(known & F.col("y").isNotNull()))
        model.write().overwrite().save(model_path(path, k, "model"))
        model = PipelineModel.load(model_path(path, k, "model"))
        own = cut(_margin(model, x.where((F.col("date") >= F.lit(begin)) & (F.col("date") < F.lit(end)))).select("symbol", "date", F.lit(k).alias("fold"), "margin", "y"), "fold")
        before = reduce(DataFrame.unionByName, done).where(known & F.col("y").isNotNull()) if done else None
        sides = before.agg(F.count("*").alias("n"), F.count_distinct("y").alias("kinds")).first() if done else None
        shape = platt(before) if sides and sides.n >= LEAST_PLATT and sides.kinds == 2 else None
        if shape:
            shape.write().overwrite().save(model_path(path, k, "platt"))
        done.append(own.withColumn("prob", curve(shape, F.col("margin"))))
    return reduce(DataFrame.unionByName, done).select("symbol", "date", "fold", "margin", "prob", "y")


def score(x: DataFrame, path: str, fold: int) -> DataFrame:
    """x with margin and prob by the stored models of a fold."""
    kept = files(x.sparkSession, model_path(path, fold, "platt"))
    shape = LogisticRegressionModel.load(model_path(path, fold, "platt")) if kept else None
    out = _margin(PipelineModel.load(model_path(path, fold, "model")), x)
    return out.withColumn("prob", curve(shape, F.col("margin"))).drop("raw", "features", "rawPrediction", "probability", "prediction")
