"""One label per item out of several annotators' contradicting labels.

Feature-assisted consensus by expectation-maximisation: an item has a hidden
true label; a ridge logistic regression over the item's features gives its
prior, and each annotator has a 2x2 confusion matrix. Both are fitted jointly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.session import durable

#: Annotators' matrices are held on the driver up to this many; beyond, they stay a table that is joined.
MAX_ANNOTATORS = 20_000


def counted_labels(rows: DataFrame, item: str, annotator: str, label: str, at: str, tie: str) -> DataFrame:
    """(item, annotator, label): the label that counts of each annotator for each item.

    Labels other than 0 and 1 and rows without item or annotator don't count;
    annotators are compared trimmed and in lower case; the latest row counts,
    of equally late ones the one with the highest ``tie``. A null time is the
    earliest.
    """
    name = F.lower(F.btrim(F.col(annotator), F.lit(" \t\n\r\f\x0b 　")))
    return (
        rows.select(F.col(item).alias("item"), name.alias("annotator"), F.col(label).cast("int").alias("label"), F.struct(F.col(at), F.col(tie)).alias("at"))
        .filter(F.col("label").isin(0, 1) & F.col("item").isNotNull() & (F.length("annotator") > 0))
        .groupBy("item", "annotator")
        .agg(F.max_by("label", "at").alias("label"))
    )


@dataclass
class _Model:
    """What the driver holds: log confusion ratios per annotator, regression weights."""

    log_odds: np.ndarray  # (annotators, 2): log P(label | true 1) / P(label | true 0)
    weights: np.ndarray  # intercept first
    mean: np.ndarray
    scale: np.ndarray


def _posterior(model: _Model, labels: pa.ListArray, annotators: pa.ListArray, x: np.ndarray):
    n = len(labels)
    flat_label = labels.flatten().to_numpy(zero_copy_only=False)
    flat_annotator = annotators.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(labels.offsets.to_numpy())
    owner = np.repeat(np.arange(n), sizes)
    evidence = np.bincount(owner, weights=model.log_odds[flat_annotator, flat_label], minlength=n)
    design = np.column_stack([np.ones(n), (np.where(np.isnan(x), model.mean, x) - model.mean) / model.scale])
    prior = design @ model.weights
    logit = np.clip(prior + evidence, -500, 500)
    return 1 / (1 + np.exp(-logit)), design, owner, flat_label, flat_annotator


def _features(batch: pa.RecordBatch, count: int) -> np.ndarray:
    if not count:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(count)])


def fit_consensus(
    labels: DataFrame,
    features: DataFrame | None = None,
    iterations: int = 40,
    ridge: float = 1.0,
    smoothing: float = 1.0,
    tolerance: float = 1e-4,
) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) from ``labels`` (item, annotator, label 0/1; one row per pair).

    ``features``: item and any number of double columns; items without a row, and
    null or NaN values, take the mean. items: item, probability of label 1,
    consensus (1 if the probability exceeds one half, so an exact tie gives 0),
    votes, votes_for (label 1) and agreement (share of the item's annotators whose
    label is the consensus). annotators: annotator, labelled (items), agreed, the
    share reliability = agreed / labelled, and sensitivity and specificity of
    the fitted confusion matrix. Empty labels give empty results.

    Rows of an item are first gathered into two short arrays (an item has as many
    labels as there are annotators at most). Each EM step is one pass of NumPy
    over Arrow batches of items: it returns, per partition, sums per annotator
    and the regression's gradient and Hessian; Spark adds these up. The driver
    holds 4 numbers per annotator (at most ``MAX_ANNOTATORS``; more is an error)
    and as many weights as features. The steps share nothing but these
    parameters, so lineage doesn't grow; the gathered items lie in the shared
    folder, where a lost executor can't take them along. With more annotators
    than ``MAX_ANNOTATORS`` the same model is fitted by ``_fit_by_joins``.
    """
    spark = labels.sparkSession
    people = [r[0] for r in labels.select("annotator").distinct().limit(MAX_ANNOTATORS + 1).collect()]
    if len(people) > MAX_ANNOTATORS:
        return _fit_by_joins(labels, features, iterations, ridge, smoothing, tolerance)
    people.sort()
    index = spark.createDataFrame([(p, i) for i, p in enumerate(people)], "annotator string, a int")
    names = [c for c in (features.columns if features is not None else []) if c != "item"]
    pairs = F.array_sort(F.collect_list(F.struct("a", "label")))
    grouped = labels.join(F.broadcast(index), "annotator").groupBy("item").agg(pairs.alias("p"))
    if features is not None:
        one = features.groupBy("item").agg(*[F.avg(F.col(c).cast("double")).alias(f"f{i}") for i, c in enumerate(names)])
        grouped = grouped.join(one, "item", "left")
    items = durable(
        grouped.select("item", F.col("p.a").alias("a"), F.col("p.label").alias("y"), *[f"f{i}" for i in range(len(names))]),
        "items",
    )
    k = len(names)
    if k:
        moments = items.agg(
            *[g(F.nanvl(f"f{i}", F.lit(None).cast("double"))) for i in range(k) for g in (F.avg, F.stddev_pop)]
        ).first()
        mean = np.array([moments[2 * i] or 0.0 for i in range(k)])
        scale = np.array([moments[2 * i + 1] or 1.0 for i in range(k)])
    else:
        mean, scale = np.zeros(0), np.ones(0)

    # majority start: every annotator counts alike
    start = np.log(0.7 / 0.3) * np.array([-1.0, 1.0])
    model = _Model(np.tile(start, (max(1, len(people)), 1)), np.zeros(k + 1), mean, scale)
    size = 4 * max(1, len(people))
    tail = (k + 1) + (k + 1) ** 2 + 1

    def pass_over(m: _Model):
        def one_pass(batches):
            total = np.zeros(size + tail)
            for batch in batches:
                if not batch.num_rows:
                    continue
                p, design, owner, y, a = _posterior(m, batch.column("y"), batch.column("a"), _features(batch, k))
                weight = p[owner]
                slot = a * 4 + y
                total[:size] += np.bincount(slot, weights=1 - weight, minlength=size)
                total[:size] += np.bincount(slot + 2, weights=weight, minlength=size)
                fitted = 1 / (1 + np.exp(-np.clip(design @ m.weights, -500, 500)))
                total[size : size + k + 1] += design.T @ (p - fitted)
                curve = design * (fitted * (1 - fitted))[:, None]
                total[size + k + 1 : -1] += (design.T @ curve).ravel()
                total[-1] += len(p)
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(total[kept])], names=["i", "v"])

        parts = items.select("a", "y", *[f"f{i}" for i in range(k)]).mapInArrow(one_pass, "i int, v double")
        out = np.zeros(size + tail)
        for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    for _ in range(iterations):
        sums = pass_over(model)
        if not sums[-1]:
            break
        table = sums[:size].reshape(-1, 2, 2) + smoothing  # annotator, truth, label
        # an annotator is taken to know more than chance before any label is seen
        table[:, 0, 0] += smoothing
        table[:, 1, 1] += smoothing
        rates = table / table.sum(axis=2, keepdims=True)
        log_odds = np.log(rates[:, 1, :]) - np.log(rates[:, 0, :])
        penalty = np.full(k + 1, ridge)
        penalty[0] = 1e-6
        gradient = sums[size : size + k + 1] - penalty * model.weights
        hessian = sums[size + k + 1 : -1].reshape(k + 1, k + 1) + np.diag(penalty)
        weights = model.weights + np.clip(np.linalg.solve(hessian, gradient), -3, 3)
        moved = max(np.abs(log_odds - model.log_odds).max(), np.abs(weights - model.weights).max())
        model = _Model(log_odds, weights, mean, scale)
        if moved < tolerance:
            break

    def scored(batches):
        for batch in batches:
            p, *_ = _posterior(model, batch.column("y"), batch.column("a"), _features(batch, k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("a"), batch.column("y"), pa.array(p)], names=["item", "a", "y", "p"]
            )

    kind = items.schema["item"].dataType.simpleString()
    judged = items.mapInArrow(scored, f"item {kind}, a array<int>, y array<int>, p double").withColumn(
        "consensus", (F.col("p") > 0.5).cast("int")
    )
    equal = F.size(F.filter("y", lambda v: v == F.col("consensus")))
    result = judged.select(
        "item",
        F.col("p").alias("probability"),
        "consensus",
        F.size("y").alias("votes"),
        F.aggregate("y", F.lit(0), lambda acc, v: acc + v).alias("votes_for"),
        (equal / F.size("y")).alias("agreement"),
    )
    if not people:
        rates = np.full((1, 2, 2), 0.5)
    elif not iterations:
        rates = np.full((len(people), 2, 2), 0.5)
    fitted = spark.createDataFrame(
        [(i, p, float(rates[i, 1, 1]), float(rates[i, 0, 0])) for i, p in enumerate(people)],
        "a int, annotator string, sensitivity double, specificity double",
    )
    reliability = (
        judged.select("consensus", F.explode(F.arrays_zip("a", "y")).alias("l"))
        .groupBy(F.col("l.a").alias("a"))
        .agg(F.count(F.lit(1)).alias("labelled"), F.sum((F.col("l.y") == F.col("consensus")).cast("long")).alias("agreed"))
        .join(F.broadcast(fitted), "a")
        .select(
            "annotator", "labelled", "agreed", (F.col("agreed") / F.col("labelled")).alias("reliability"),
            "sensitivity", "specificity",
        )
    )
    return result, reliability


def _fit_by_joins(
    labels: DataFrame, features: DataFrame | None, iterations: int, ridge: float, smoothing: float, tolerance: float
) -> tuple[DataFrame, DataFrame]:
    """``fit_consensus`` for any number of annotators: their matrices are a table, evidence a join and a sum per item.

    Each step writes the annotators' rates and reads them again; the driver holds
    the regression's weights only.
    """
    names = [c for c in (features.columns if features is not None else []) if c != "item"]
    k = len(names)
    votes = durable(labels.select("item", F.col("annotator").alias("a"), F.col("label").alias("y")), "votes")
    items = votes.select("item").distinct()
    if features is not None:
        one = features.groupBy("item").agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"f{i}") for i, c in enumerate(names)])
        items = items.join(one, "item", "left")
    items = durable(items, "items")
    mean, scale = [0.0] * k, [1.0] * k
    if k:
        moments = items.agg(*[g(f"f{i}") for i in range(k) for g in (F.avg, F.stddev_pop)]).first()
        mean = [moments[2 * i] or 0.0 for i in range(k)]
        scale = [moments[2 * i + 1] or 1.0 for i in range(k)]
    x = [F.lit(1.0), *[(F.coalesce(f"f{i}", F.lit(mean[i])) - mean[i]) / scale[i] for i in range(k)]]
    items = items.select("item", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    start = float(np.log(0.7 / 0.3))
    rates = votes.select("a").distinct().select("a", F.lit(-start).alias("l0"), F.lit(start).alias("l1"), F.lit(0.5).alias("sensitivity"), F.lit(0.5).alias("specificity"))
    weights = np.zeros(k + 1)

    def judged(now: DataFrame, w: np.ndarray) -> DataFrame:
        seen = F.when(F.col("y") == 1, F.col("l1")).otherwise(F.col("l0"))
        evidence = votes.join(now, "a").groupBy("item").agg(F.sum(seen).alias("e"))
        prior = sum((F.col(f"x{i}") * float(w[i]) for i in range(k + 1)), F.lit(0.0))
        logit = F.greatest(F.least(prior + F.col("e"), F.lit(500.0)), F.lit(-500.0))
        return items.join(evidence, "item").select("*", (1 / (1 + F.exp(-logit))).alias("p"), (1 / (1 + F.exp(-prior))).alias("fitted"))

    for _ in range(iterations):
        now = durable(judged(rates, weights), "judged")
        cell = votes.join(now.select("item", "p"), "item")
        counts = cell.groupBy("a").agg(
            *[(F.sum(F.when(F.col("y") == y, p).otherwise(0.0)) + smoothing * (2 if y == t else 1)).alias(f"n{t}{y}")
              for t, p in ((0, 1 - F.col("p")), (1, F.col("p"))) for y in (0, 1)]
        )
        sensitivity, wrong = F.col("n11") / (F.col("n10") + F.col("n11")), F.col("n01") / (F.col("n00") + F.col("n01"))
        fresh = durable(
            counts.select("a", (F.log(1 - sensitivity) - F.log(1 - wrong)).alias("l0"), (F.log(sensitivity) - F.log(wrong)).alias("l1"), sensitivity.alias("sensitivity"), (1 - wrong).alias("specificity")),
            "rates",
        )
        curve = F.col("fitted") * (1 - F.col("fitted"))
        sums = now.agg(
            *[F.sum(F.col(f"x{i}") * (F.col("p") - F.col("fitted"))) for i in range(k + 1)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * curve) for i in range(k + 1) for j in range(k + 1)],
        ).first()
        penalty = np.full(k + 1, ridge)
        penalty[0] = 1e-6
        gradient = np.array(sums[: k + 1], float) - penalty * weights
        hessian = np.array(sums[k + 1 :], float).reshape(k + 1, k + 1) + np.diag(penalty)
        step = np.clip(np.linalg.solve(hessian, gradient), -3, 3)
        old = rates.select("a", F.col("l0").alias("o0"), F.col("l1").alias("o1"))
        moved = fresh.join(old, "a").agg(F.max(F.greatest(F.abs(F.col("l0") - F.col("o0")), F.abs(F.col("l1") - F.col("o1"))))).first()[0]
        rates, weights = fresh, weights + step
        if max(moved or 0.0, float(np.abs(step).max())) < tolerance:
            break
    final = durable(judged(rates, weights).select("item", "p", (F.col("p") > 0.5).cast("int").alias("consensus")), "judged")
    cell = votes.join(final, "item").withColumn("same", (F.col("y") == F.col("consensus")).cast("long"))
    result = cell.groupBy("item").agg(
        F.max("p").alias("probability"), F.max("consensus").alias("consensus"), F.count(F.lit(1)).cast("int").alias("votes"),
        F.sum("y").cast("int").alias("votes_for"), F.avg("same").alias("agreement"),
    )
    reliability = cell.groupBy("a").agg(F.count(F.lit(1)).alias("labelled"), F.sum("same").alias("agreed")).join(rates, "a").select(
        F.col("a").alias("annotator"), "labelled", "agreed", (F.col("agreed") / F.col("labelled")).alias("reliability"), "sensitivity", "specificity"
    )
    return result, reliability
