"""Scorers over pair features: a linear one as a Column, gradient-boosted trees as a plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erlink.operators.metrics import auc, average_precision, best_threshold, sweep, thresholds
from erlink.operators.pairs import grouped_split

#: A deterministic default: per-mille weights of native features that add up to 1000.
LINEAR = {"name_jaccard": 350, "name_containment": 150, "name_exact": 150, "addr_jaccard": 150, "house_match": 100, "postal_exact": 50, "same_country": 50}


def linear_score(weights: dict[str, int] | None = None) -> Column:
    """Weighted sum of features clipped to 0..1 each, as a probability."""
    parts = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(f).cast("double"), F.lit(0.0)))) * w for f, w in (weights or LINEAR).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / float(sum((weights or LINEAR).values()))


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features}))


def train_trees(labelled: DataFrame, features: list[str], share: float = 0.2, trees: int = 60, depth: int = 6, seed: int = 42):
    """(model, one-row report): trees fitted on the grouped training part, threshold and ranking metrics on the rest."""
    from pyspark.ml.classification import GBTClassifier

    split = _vector(grouped_split(labelled, share), features).withColumn("label", F.col("label").cast("double"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.05 if trees > 100 else 0.1, subsamplingRate=0.8, minInstancesPerNode=50 if trees > 100 else 5, featureSubsetStrategy="0.8", validationIndicatorCol="is_val", seed=seed)
    model = gbt.fit(split)
    scored = score_trees(model, split.where("is_val").drop("features"), features, 0.0).withColumn("label", F.col("label").cast("int"))
    report = best_threshold(sweep(scored, thresholds())).crossJoin(F.broadcast(auc(scored))).crossJoin(F.broadcast(average_precision(scored)))
    return model, report


def score_trees(model, rows: DataFrame, features: list[str], floor: float = 0.2) -> DataFrame:
    """Rows with prob at or above the floor."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_vector(rows, features)).withColumn("prob", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").where(F.col("prob") >= floor)


def leave_one_out(labelled: DataFrame, features: list[str], countries: list[str], **options) -> dict[str, DataFrame]:
    """Per country the sweep's best row of a model that saw the other countries only; rows carry country."""
    out = {}
    for c in countries:
        model, _ = train_trees(labelled.where(F.col("country") != c), features, 0.1, **options)
        out[c] = best_threshold(sweep(score_trees(model, labelled.where(F.col("country") == c), features, 0.0), thresholds()))
    return out


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml.classification import GBTClassificationModel

    return GBTClassificationModel.load(path)
