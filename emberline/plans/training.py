"""Model training on Spark ML: features, weights, baselines, block folds, ablation, factors.

Spark ML has no multiclass boosted trees, so a weighted random forest takes their place; scores
are comparable in kind, not number by number. Local factors are occlusion contributions, not
Shapley values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import features, grid, rules
from emberline.functions.text import half_up, probability_percent
from emberline.operators import incidents, labels, verified

MISSING = -9999.0
#: Rows of a partition that a forest is fitted on: each carries a count for every tree.
FIT_ROWS, FIT_PARTS = 50_000, 16


@dataclass(frozen=True)
class ModelConfig:
    trees: int = 250
    depth: int = 5
    sampling: float = 0.85
    seed: int = 42


def feature_frame(df: DataFrame, keep: Sequence[str] = ("detection_id", "target_label")
                  ) -> DataFrame:
    """Feature columns as doubles; a missing burn scar becomes a sentinel beside its flag."""
    cols = features.feature_columns(df)
    numeric = [F.coalesce(cols[f].cast("double"), F.lit(MISSING)).alias(f)
               for f in features.FEATURES]
    kept = [F.col(k).alias(f"_{k}" if k in features.FEATURES else k) for k in keep]
    return df.select(*kept, *numeric)


def balanced_weights(df: DataFrame, label: str = "target_label") -> DataFrame:
    """n / (classes x class count) per row; the class table has at most a handful of rows."""
    counts = labels.class_counts(df, label)
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    table = counts.select(label, (total / (classes * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(table), label)


def dealt(train: DataFrame) -> DataFrame:
    """Rows in partitions of about FIT_ROWS, by their hash: equal tables are dealt alike, however they lie.

    Trees draw their rows by partition and place, so the same rows give the same forest.
    """
    parts = max(FIT_PARTS, -(-train.count() // FIT_ROWS))
    h = F.xxhash64(*train.columns)
    return train.repartition(parts, h).sortWithinPartitions(h)


def fit_forest(train: DataFrame, names: Sequence[str] = features.FEATURES,
               cfg: ModelConfig = ModelConfig()) -> PipelineModel:
    """Fitting goes over train several times, so it should be a table and not a plan."""
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="features"),
        RandomForestClassifier(
            labelCol="target_label", weightCol="weight", numTrees=cfg.trees, maxDepth=cfg.depth,
            subsamplingRate=cfg.sampling, seed=cfg.seed)]
    return Pipeline(stages=stages).fit(dealt(balanced_weights(train)))


def fit_logistic(train: DataFrame, names: Sequence[str] = features.FEATURES) -> PipelineModel:
    """Median-imputed, scaled logistic regression: the linear baseline."""
    raw = [f"_i_{n}" for n in names]
    stages = [
        Imputer(inputCols=list(names), outputCols=raw, strategy="median", missingValue=MISSING),
        VectorAssembler(inputCols=raw, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol="target_label", weightCol="weight", maxIter=50)]
    return Pipeline(stages=stages).fit(balanced_weights(train))


def majority_class(train: DataFrame) -> int:
    return labels.class_counts(train).orderBy(F.desc("n"), "target_label").first()["target_label"]


def predict(model: PipelineModel, rows: DataFrame, prior: Sequence[float] | None = None
            ) -> DataFrame:
    """Class index, name, probabilities (prior-corrected when asked) and confidence percent."""
    out = model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
    if prior is not None:
        out = out.withColumn("probabilities", labels.apply_prior(
            F.col("probabilities"), F.array(*[F.lit(float(p)) for p in prior])))
    best = F.array_max("probabilities")
    index = (F.array_position("probabilities", best) - 1).cast("int")
    keep = [c for c in rows.columns if c not in ("features", "rawPrediction")]
    return out.select(*keep, "probabilities", index.alias("predicted"),
                      rules.class_name(index).alias("predicted_class"),
                      probability_percent(best).alias("confidence_pct"))


def metrics(scored: DataFrame) -> DataFrame:
    """One row: size, accuracy, macro and weighted F1, log loss."""
    report = verified.class_report(verified.confusion(
        scored, F.col("target_label"), F.col("predicted")))
    loss = verified.log_loss(scored, F.col("target_label"), F.col("probabilities"))
    return verified.overall(report).withColumn("log_loss", loss.scalar())


def block_folds(df: DataFrame, folds: int = 5, degrees: float = 5.0) -> DataFrame:
    """Whole square blocks assigned to folds, largest block to the lightest fold.

    Blocks are at most 36 x 72, so the assignment is a bounded table built on the driver.
    """
    block = grid.block_id("latitude", "longitude", degrees)
    sizes = df.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "block").collect()
    load, placed = [0] * folds, []
    for row in sizes:
        lightest = min(range(folds), key=lambda i: (load[i], i))
        load[lightest] += row.n
        placed.append((row.block, lightest))
    table = df.sparkSession.createDataFrame(placed, "block string, fold int")
    return df.withColumn("block", block).join(F.broadcast(table), "block")


def capped(df: DataFrame, max_rows: int, label: str = "target_label") -> DataFrame:
    """At most about max_rows rows to fit on: classes share them equally, a rare class stays whole."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    u = F.pmod(F.xxhash64(F.col("detection_id"), F.lit("cap")), F.lit(1_000_000))
    kept = F.lit(1_000_000)
    for name, n in sizes.items():
        kept = F.when(F.col(label).eqNullSafe(F.lit(name)),
                      int(1_000_000 * min(1.0, max_rows / len(sizes) / n))).otherwise(kept)
    return df.where(u < kept)


def block_cross_validation(df: DataFrame, folds: int = 5, cfg: ModelConfig = ModelConfig(),
                           max_rows: int = 400_000) -> DataFrame:
    """Macro F1 per geographic fold; folds that lose a side or a second class are skipped.

    A fold's model is fitted on at most about max_rows rows and scored on all rows of the fold.
    """
    rows = feature_frame(block_folds(df, folds), ("detection_id", "target_label", "fold"))
    parts = []
    for fold in range(folds):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if train.select("target_label").distinct().count() < 2 or test.isEmpty():
            continue
        scored = predict(fit_forest(capped(train, max_rows), cfg=cfg), test)
        parts.append(metrics(scored).withColumn("fold", F.lit(fold)))
    if not parts:
        raise ValueError("no usable fold")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def independent_features() -> list[str]:
    """Features left after dropping every column whose name starts with a rule input."""
    return [f for f in features.FEATURES if not f.startswith(C.RULE_INPUT_PREFIXES)]


def ablation(train: DataFrame, test: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Score with and without the rule's own inputs: how much of the model is the rule."""
    kept = independent_features()
    full = metrics(predict(fit_forest(train, cfg=cfg), test)).select(
        F.col("macro_f1").alias("full_f1"))
    bare = metrics(predict(fit_forest(train, kept, cfg), test)).agg(F.max("macro_f1")).scalar()
    gap = F.col("full_f1") - F.col("reduced_f1")
    return full.withColumn("reduced_f1", bare).withColumns({
        "delta": gap, "dropped": F.lit(len(features.FEATURES) - len(kept)),
        "reading": F.when(gap > 0.2, "MOSTLY_RULE").when(gap > 0.05, "PARTLY_RULE")
        .otherwise("INDEPENDENT_SIGNAL")})


def training_medians(train: DataFrame, names: Sequence[str]) -> list[float]:
    """One number per feature, from a summary of bounded size (rank error below 1 in 10,000)."""
    row = train.agg(*[F.percentile_approx(F.col(n), 0.5, 10_000).alias(n) for n in names]).first()
    return [float(row[n] or 0.0) for n in names]


def occlusion_factors(model: PipelineModel, alerts: DataFrame, medians: Sequence[float],
                      names: Sequence[str] = features.FEATURES, top_k: int = 4) -> DataFrame:
    """Strongest features per alert row: probability lost when one is set to its median.

    Every row unfolds to one copy per feature (a fixed number) and all copies are scored at once.
    A copy that its median leaves as it was loses nothing and is not scored again.
    """
    base = predict(model, alerts)
    # dealt by id before they unfold; the number is fixed, as the few bytes of these rows say nothing of the work on them
    parts = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = base.select("detection_id", *names, F.col("predicted").alias("_cls"),
                       F.get("probabilities", F.col("predicted")).alias("_p")).repartition(parts, "detection_id")
    values = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(n).alias("_value"),
                                F.col(n).eqNullSafe(F.lit(m)).alias("_same"))
                       for i, (n, m) in enumerate(zip(names, medians))])

    def copies(same: bool) -> DataFrame:
        some = F.filter(values, lambda v: v["_same"] if same else ~v["_same"])
        return kept.withColumn("_v", F.explode(some)).select("*", "_v._f", "_v._value")

    swapped = copies(False).select(
        "detection_id", "_cls", "_p", "_f", "_value",
        *[F.when(F.col("_f") == i, F.lit(m)).otherwise(F.col(n)).alias(n)
          for i, (n, m) in enumerate(zip(names, medians))])
    rescored = model.transform(swapped).withColumn(
        "_q", F.get(vector_to_array("probability"), F.col("_cls")))
    gains = rescored.select("detection_id", "_f", "_value", (F.col("_p") - F.col("_q")).alias("_gain")).unionByName(
        copies(True).select("detection_id", "_f", "_value", F.lit(0.0).alias("_gain")))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_f") + 1)
    ranked = Window.partitionBy("detection_id").orderBy(F.desc("strength"), "feature")
    return gains.select("detection_id", name.alias("feature"), F.col("_value").alias("value"),
                        half_up(F.col("_gain"), 4).alias("contribution"),
                        F.abs("_gain").alias("strength")) \
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_k)


def global_importance(factors: DataFrame) -> DataFrame:
    return factors.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def score_detections(model: PipelineModel, df: DataFrame,
                     prior: Sequence[float] | None = None) -> DataFrame:
    """Predict every detection from the full feature vector, then apply the serving guards."""
    side = ("detection_id", "latitude", "longitude", "site_type", "site_inside", "site_forest")
    tagged = df.withColumns({"site_type": F.col("facility_type"),
                             "site_inside": F.col("inside_industrial"),
                             "site_forest": F.col("in_forest")})
    out = predict(model, feature_frame(tagged, side), prior)
    renamed = out.drop("inside_industrial", "in_forest").withColumnsRenamed({
        "site_type": "facility_type", "site_inside": "inside_industrial",
        "site_forest": "in_forest"})
    return incidents.score(renamed, F.col("predicted_class"), F.col("confidence_pct"))


def metrics_bundle(scores: DataFrame, thresholds: DataFrame, run_id: str, trained_at: Column,
                   provenance: str) -> DataFrame:
    """One row that says which rule, gates and data a set of scores belongs to."""
    gates = {n: thresholds.select(n).scalar() for n in C.THRESHOLD_NAMES}
    return scores.withColumns({
        "run_id": F.lit(run_id), "rule_version": F.lit(C.RULE_VERSION),
        "trained_at": trained_at, "provenance": F.lit(provenance), **gates,
        "caveat": F.lit("labels come from a rule, so scores measure agreement with it")})


def model_provenance(bundles: DataFrame | None, spark) -> DataFrame:
    """Latest bundle, or a NO_METRICS row when nothing was trained."""
    if bundles is None or bundles.isEmpty():
        return spark.sql("SELECT 'NO_METRICS' AS status")
    return bundles.orderBy(F.desc("trained_at")).limit(1).select(
        F.lit("OK").alias("status"), "run_id", "rule_version", "trained_at", "macro_f1",
        "provenance")
