"""The batch scoring plan: wallet features and model probabilities to one score per wallet and pair."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble(train: DataFrame, rows: DataFrame, features: list[str], label: str = "label", seed: int = 7) -> DataFrame:
    """``rows`` with p_forest, p_boost, p_linear, their mean ``probability`` and ``confidence`` = 1 - their deviation.

    Three classifiers are fitted on ``train`` with classes weighted by their
    inverse frequency; null features count as 0, labels other than 0 and 1 don't
    count. Training data with one class
    only, or none, give that class's probability (0 without rows) and confidence 1.
    """
    train = train.filter(F.col(label).isin(0, 1))
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # two rows
    if len(counts) < 2:
        p = float(next(iter(counts), 0))
        return rows.withColumns({c: F.lit(p) for c in ("p_forest", "p_boost", "p_linear", "probability")} | {"confidence": F.lit(1.0)})
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    assemble = VectorAssembler(inputCols=features, outputCol="__x")
    ready = assemble.transform(train.fillna(0.0, features)).select(F.col(label).cast("double").alias("__y"), "__x", weight.alias("__w"))
    common = {"labelCol": "__y", "featuresCol": "__x", "weightCol": "__w"}
    models = {
        "p_forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "p_boost": GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common),
        "p_linear": LogisticRegression(regParam=0.01, maxIter=50, **common),
    }
    out = assemble.transform(rows.fillna(0.0, features))
    for name, model in models.items():
        fitted = model.fit(ready).setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c")
        out = fitted.transform(out).withColumn(name, vector_to_array("__p")[1]).drop("__p", "__r", "__c")
    mean = (F.col("p_forest") + F.col("p_boost") + F.col("p_linear")) / 3
    spread = F.sqrt((F.pow(F.col("p_forest") - mean, 2) + F.pow(F.col("p_boost") - mean, 2) + F.pow(F.col("p_linear") - mean, 2)) / 3)
    return out.drop("__x").withColumns({"probability": mean, "confidence": 1 - spread})


def blend(mad: Column, probability: Column, limit: float = 0.015) -> Column:
    """Risk score 0..100: 30 % digit deviation (capped at its limit), 70 % probability, rounded half to even."""
    score = 0.3 * F.least(mad / limit, F.lit(1.0)) * 100 + 0.7 * probability * 100
    return F.greatest(F.least(F.bround(score, 0), F.lit(100.0)), F.lit(0.0)).cast("int")
