"""Quantities recorded in different units, converted to one unit per kind (problem 3).

Stated units are read by rule (`permeate.functions.quantities`). Amounts that state a number but no unit go to a
calibrated tree ensemble that predicts the missing unit from the magnitude, the source and the neighbouring
fields; confident assignments are converted, uncertain ones are routed for review.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeate.functions import quantities as q
from permeate.session import cut

SPECIMENS = "structure_determination_list"


def _specimens(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-null specimen with its path; null levels and elements keep their positions."""
    spec = F.expr("d.specimen_preparation_list.specimen_preparation")
    return (
        entries.select("row_id", *keep, F.posexplode(SPECIMENS).alias("_i", "d"))
        .select("row_id", *keep, "_i", F.posexplode(spec).alias("_j", "s"))
        .where("s is not null")
        .select("row_id", *keep, F.concat_ws(".", F.col("_i").cast("string"), F.col("_j").cast("string")).alias("path"), F.col("s.buffer").alias("buffer"), F.col("s.details").alias("details"))
    )


def amounts(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every component amount with its reading: ``row_id, path, name, formula, number, unit, kind, value, from_name, status``.

    The amount is read from the concentration or, where that struct is null, from the end of the name.
    """
    one = (
        _specimens(entries, keep)
        .select("row_id", *keep, F.col("path").alias("parent_path"), F.posexplode("buffer.component").alias("_k", "c"))
        .where("c is not null")
        .select("row_id", *keep, "parent_path", F.concat_ws(".", "parent_path", F.col("_k").cast("string")).alias("path"), F.col("c.name").alias("name"), F.col("c.formula").alias("formula"), F.col("c.concentration").alias("concentration"))
    )
    text = F.when(F.col("concentration").isNull(), q.amount_in_name(F.coalesce("name", F.lit("")))).otherwise(F.col("concentration.valueOf_"))
    one = one.withColumn("amount_text", text).withColumn("unit_text", F.col("concentration.units"))
    read = q.read_amounts(one, "amount_text", "unit_text")
    # a name that ends in no known amount states none
    status = F.when(F.col("concentration").isNull() & (F.col("status") != "stated"), "none").otherwise(F.col("status"))
    return read.select("row_id", *keep, "parent_path", "path", "name", "formula", "number", "unit", "unit_code", "kind", "value", F.col("concentration").isNull().alias("from_name"), q.once(status).alias("status"))


def ph_values(entries: DataFrame) -> DataFrame:
    """Every stated pH: ``row_id, path, value`` in hundredths, from buffer.ph or, where that is null, from details."""
    stated = F.col("buffer.ph").isNotNull()
    own = q.read_ph(_specimens(entries).withColumn("_ph", F.col("buffer.ph")), "_ph", "_own")
    read = q.read_ph_in_text(own.withColumn("_details", F.when(~stated, F.col("details"))), "_details", "_other")
    return read.select("row_id", "path", q.once(F.coalesce("_own", "_other")).alias("value")).where("value is not null")


def quantities(entries: DataFrame) -> DataFrame:
    """Stated quantities in common units: ``row_id, path, kind, value``.

    Kinds: molar (nmol/L), mass (ug/mL), volume (uL/L), ph (hundredths). Ranges, words, amounts without a unit or
    with a unit of another kind give no row (the second go to `predict_units`). Nulls at any level give no rows,
    repeated rows count each, empty tables give an empty result, extra columns are ignored. No shuffle.
    """
    stated = amounts(entries).where("status = 'stated'").select("row_id", "path", "kind", F.col("value").cast("long").alias("value"))
    ph = ph_values(entries).select("row_id", "path", F.lit("ph").alias("kind"), F.col("value").cast("long").alias("value"))
    return stated.unionByName(ph)


# ---------------------------------------------------------------- missing units

FEATURES = ("magnitude", "digits", "source_field", "source_year", "category_known", "category_kind", "category_power", "category_magnitude", "n_near", "near_kind", "near_power", "near_magnitude", "near_bare", "has_formula", "name_length")
_KIND_NUMBER = {"molar": 1.0, "mass": 2.0, "volume": 3.0}
_NEAR = ("n_near", "near_kind", "near_power", "near_magnitude", "near_bare")


def _near_means(frame: pd.DataFrame) -> pd.DataFrame:
    """Means over the other stated amounts of the same buffer; -1 where there is none."""
    stated = (frame["status"] == "stated").to_numpy()
    group = frame.groupby(["rid", "parent_path"], sort=False).ngroup().to_numpy()
    n = np.bincount(group, stated)[group] - stated
    out = {"n_near": n.astype(float), "near_bare": np.bincount(group, frame["status"] == "unitless")[group] - (frame["status"] == "unitless").to_numpy()}
    for name, column in (("near_kind", "kind_number"), ("near_power", "power"), ("near_magnitude", "magnitude")):
        own = np.where(stated, frame[column].fillna(0.0).to_numpy(), 0.0)
        out[name] = np.where(n > 0, (np.bincount(group, own)[group] - own) / np.maximum(n, 1), -1.0)
    return frame.assign(**{k: np.asarray(v, dtype=float) for k, v in out.items()})


def unit_features(entries: DataFrame) -> DataFrame:
    """Features of every amount with a number: magnitude, source, category and neighbours.

    Source is where the amount was read (field or name) and the year of receipt, if the entries have ``received_at``;
    category is what the other stated amounts of the same substance in all entries say (the amount's own label is taken
    out); neighbours are the stated amounts of the same buffer. A buffer is one array of one row and its components lie in a
    row, so its means need no shuffle: batches are cut at the border of a buffer.
    """
    year = F.year("received_at").cast("double") if "received_at" in entries.columns else F.lit(None).cast("double")
    read = amounts(entries.select("row_id", SPECIMENS, F.monotonically_increasing_id().alias("rid"), F.coalesce(year, F.lit(0.0)).alias("source_year")), ("rid", "source_year"))
    log = F.log10(F.greatest(F.abs(F.col("number").cast("double")), F.lit(1e-9)))
    substance = F.regexp_replace(F.lower(F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("formula"), F.lit(""))), r"(?U)[\s,–(-]*[~≈]?\d+(?:[.,]\d+)?\s*\S*\)?$|[^\p{L}\d]+", "")
    one = read.where("status in ('stated', 'unitless')").select(
        "rid",
        "row_id",
        "parent_path",
        "path",
        F.col("number").cast("double").alias("number"),
        "unit_code",
        "status",
        F.col("source_year"),
        F.when(F.col("from_name"), 2.0).otherwise(1.0).alias("source_field"),
        log.alias("magnitude"),
        F.least(F.length(F.regexp_replace(F.col("number").cast("double").cast("string"), r"[^\d]|0+$", "")), F.lit(9)).cast("double").alias("digits"),
        F.when(F.col("status") == "stated", F.substring_index("unit_code", "@", -1).cast("double")).alias("power"),
        F.coalesce(*[F.when((F.col("status") == "stated") & (F.col("kind") == k), v) for k, v in _KIND_NUMBER.items()]).alias("kind_number"),
        F.when(F.trim(F.coalesce("formula", F.lit(""))) == "", 0.0).otherwise(1.0).alias("has_formula"),
        F.least(F.length(F.coalesce("name", F.lit(""))), F.lit(60)).cast("double").alias("name_length"),
        substance.alias("substance"),
    )
    schema = one.schema.simpleString()[len("struct<") : -1] + "".join(f",{c}:double" for c in _NEAR)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (whole["rid"] == whole["rid"].iloc[-1]) & (whole["parent_path"] == whole["parent_path"].iloc[-1])
            rest = whole[last].reset_index(drop=True)
            if not last.all():
                yield _near_means(whole[~last].reset_index(drop=True))
        if rest is not None:
            yield _near_means(rest)

    rows = cut(one.mapInPandas(near, schema))
    # one row per substance; the join's big side is split by AQE where a substance is hot
    said = rows.where("status = 'stated'").groupBy("substance").agg(F.count("*").alias("_n"), F.sum("kind_number").alias("_kind"), F.sum("power").alias("_power"), F.sum("magnitude").alias("_size"))
    own = F.when(F.col("status") == "stated", 1).otherwise(0)
    n = F.coalesce("_n", F.lit(0)) - own
    mean = lambda total, column: F.when(n > 0, (F.col(total) - own * F.coalesce(column, F.lit(0.0))) / n).otherwise(-1.0)
    joined = rows.join(said, "substance", "left")
    return joined.select(*rows.columns, F.log1p(n.cast("double")).alias("category_known"), mean("_kind", "kind_number").alias("category_kind"), mean("_power", "power").alias("category_power"), mean("_size", "magnitude").alias("category_magnitude"))


@dataclass
class UnitModel:
    """Forest over the labels ``kind@power`` and the calibration of its top probability, as (lower border, accuracy)."""

    model: PipelineModel
    labels: list[str]
    calibration: list[tuple[float, float]]

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``predicted`` and the calibrated ``confidence``."""
        scored = self.model.stages[-1].transform(self.model.stages[-2].transform(rows))
        top = F.array_max(vector_to_array("probability"))
        names = F.array(*[F.lit(x) for x in self.labels])
        out = scored.select(*rows.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted"), top.alias("_raw"))
        # below the lowest calibrated bin the forest's own probability holds, if it is smaller
        level = F.least(F.col("_raw"), F.lit(self.calibration[0][1] if self.calibration else 0.0))
        for low, accuracy in self.calibration:
            level = F.when(F.col("_raw") >= low, F.lit(accuracy)).otherwise(level)
        return out.withColumn("confidence", level).drop("_raw")


#: Folds of the labelled rows by row: 0 calibrates, 1 is for tests and never seen in fitting, the rest fit.
FOLDS = 5


def _fold(seed: int = 11):
    return F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(FOLDS))


def fit_unit_model(features: DataFrame, sample_rows: int = 20_000, trees: int = 24, depth: int = 10, seed: int = 11) -> UnitModel | None:
    """Random forest over labelled amounts, on at most ``sample_rows`` of them (the smallest row hashes; documented bound),
    without the test fold. Its top probability is calibrated on fold 0: twenty bins, made monotone by pooling. None if there
    are fewer than two units."""
    order = F.xxhash64("row_id", "path")
    sample = cut(features.where("status = 'stated'").withColumn("_fold", _fold(seed)).where("_fold <> 1").orderBy(order, "row_id", "path").limit(sample_rows))
    if len(sample.where("_fold > 1").select("unit_code").distinct().take(2)) < 2:
        return None
    stages = [
        StringIndexer(inputCol="unit_code", outputCol="label", handleInvalid="skip"),
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=3, maxBins=64, featureSubsetStrategy="0.7", seed=seed, labelCol="label", featuresCol="features"),
    ]
    # a quarter of the fitted rows forget their category, so that substances nobody gave a unit for are no surprise
    forget = F.pmod(F.xxhash64("path", "row_id", F.lit(seed)), F.lit(4)) == 0
    unknown = {"category_known": 0.0, "category_kind": -1.0, "category_power": -1.0, "category_magnitude": -1.0}
    fit_on = sample.where("_fold > 1").withColumns({c: F.when(forget, v).otherwise(F.col(c)) for c, v in unknown.items()})
    model = Pipeline(stages=stages).fit(fit_on)
    fitted = UnitModel(model, model.stages[0].labels, [(k / 20, (2 * k + 1) / 40) for k in range(20)])
    raw = F.col("confidence")  # of the uncalibrated bins: their middle
    held = fitted.score(sample.where("_fold = 0")).groupBy(F.floor(raw * 20).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("unit_code")).cast("int")).alias("hit")).collect()
    # isotonic: accuracies made monotone by pooling neighbours, with one success and one failure added to each bin
    pooled: list[list[float]] = []
    for r in sorted(held, key=lambda r: r["bin"]):
        pooled.append([r["bin"], r["hit"] + 1.0, r["n"] + 2.0])
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] > pooled[-1][1] / pooled[-1][2]:
            _, hit, n = pooled.pop()
            pooled[-1][1] += hit
            pooled[-1][2] += n
    fitted.calibration = [(b / 20, hit / n) for b, hit, n in pooled]
    return fitted


def predict_units(entries: DataFrame, threshold: float = 0.8, sample_rows: int = 20_000) -> DataFrame:
    """Amounts without a unit with the predicted one: ``row_id, path, number, predicted_kind, value, confidence, route``.

    ``confidence`` is the calibrated probability; ``route`` is ``converted`` from ``threshold`` on, else ``review``
    with a null value. With too little labelled data everything is routed for review. The model is fitted on a
    bounded sample; it is applied to every amount that lacks a unit. Repeated rows count each, empty tables give an empty
    result.
    """
    features = cut(unit_features(entries))
    bare = features.where("status = 'unitless'")
    fitted = fit_unit_model(features, sample_rows)
    if fitted is None:
        return bare.select("row_id", "path", "number", F.lit(None).cast("string").alias("predicted_kind"), F.lit(None).cast("long").alias("value"), F.lit(0.0).alias("confidence"), F.lit("review").alias("route"))
    kind, power = F.substring_index("predicted", "@", 1), F.substring_index("predicted", "@", -1).cast("double")
    sure = F.col("confidence") >= threshold
    return fitted.score(bare).select(
        "row_id",
        "path",
        "number",
        kind.alias("predicted_kind"),
        F.when(sure, F.round(F.col("number") * F.pow(F.lit(10.0), power), 0).cast("long")).alias("value"),
        "confidence",
        F.when(sure, "converted").otherwise("review").alias("route"),
    )


def unit_quality(entries: DataFrame, threshold: float = 0.8, sample_rows: int = 20_000) -> DataFrame:
    """Held-out quality of the classifier: ``route, n_amounts, n_right, n_right_kind, accuracy, mean_confidence``.

    Stated amounts of the test fold, all of them, with their unit hidden (as amount and as neighbour's label it stays out
    of its own features) are predicted and routed as amounts without a unit are.
    """
    features = cut(unit_features(entries))
    fitted = fit_unit_model(features, sample_rows)
    schema = "route string, n_amounts long, n_right long, n_right_kind long, accuracy double, mean_confidence double"
    if fitted is None:
        return entries.sparkSession.createDataFrame([], schema)
    tested = fitted.score(features.where("status = 'stated'").where(_fold() == 1))
    right, kind = F.col("predicted") == F.col("unit_code"), F.substring_index("predicted", "@", 1) == F.substring_index("unit_code", "@", 1)
    route = F.when(F.col("confidence") >= threshold, "converted").otherwise("review").alias("route")
    return tested.groupBy(route).agg(F.count("*").alias("n_amounts"), F.sum(right.cast("int")).alias("n_right"), F.sum(kind.cast("int")).alias("n_right_kind"), F.avg(right.cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
