"""Batch scoring from one saved folder: fitted tables, plan and model."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.boosting import BoostedModel
from wayfold.operators.calendar import holidays_of
from wayfold.operators.outliers import bounds_as_dict, clip_to_bounds
from wayfold.plans.conversion import ConversionColumns, FeatureFit, Prepared, apply_features, apply_fill, encode_columns
from wayfold.plans.model import with_probability
from wayfold.sources.fitted import load_fitted_tables, load_model, save_fitted_tables, save_model

_TABLES = ("fill", "zips", "bounds")


def save_scoring(prepared: Prepared, model: BoostedModel, folder: str) -> None:
    """Store all that scoring needs: zip, fill and bound tables, category levels, sparse and chosen columns, the model."""
    plan = {
        "levels": {c: list(v) for c, v in prepared.fit.levels.items()},
        "sparse": list(prepared.fit.sparse),
        "numeric": prepared.numeric,
        "categorical": prepared.categorical,
        "tables": [t for t in _TABLES if t in prepared.tables],
    }
    spark = prepared.train.sparkSession
    save_fitted_tables({t: prepared.tables[t] for t in plan["tables"]}, folder)
    spark.createDataFrame([(json.dumps(plan),)], "plan string").write.mode("overwrite").parquet(f"{folder}/plan")
    save_model(model, f"{folder}/model")


def score_fitted(
    rows: DataFrame,
    c: ConversionColumns,
    fit: FeatureFit,
    tables: Mapping[str, DataFrame],
    model: BoostedModel,
    ids: Sequence[str],
    first: date,
    last: date,
    name: str = "pred_prob",
) -> DataFrame:
    """Identifiers and probability of the rows dated within the closed range.

    Rows pass through the steps of training: typed columns, zip values, holiday flag, 0/1 columns, zip
    fill with the batch's own markets behind it, and the fitted bounds. The holidays are those of the
    batch's years. Columns are filled independently of each other, so only those that the model reads
    are stored on the way.
    """
    chosen = rows.where(F.col(c.day).cast("date").between(F.lit(first), F.lit(last)))
    built = apply_features(encode_columns(chosen, c), c, fit, holidays_of(chosen, c.day))
    built = built.select(*dict.fromkeys([*ids, c.zip, c.market, *model.features]))
    limits = bounds_as_dict(tables["bounds"]) if "bounds" in tables else {}
    limits = {x: limit for x, limit in limits.items() if x in built.columns}
    filled = clip_to_bounds(apply_fill(built, c, tables["fill"]), limits)
    return with_probability(model, filled, name).select(*ids, name)


def score_saved(
    rows: DataFrame, c: ConversionColumns, folder: str, ids: Sequence[str], first: date, last: date, name: str = "pred_prob"
) -> DataFrame:
    """The same from the folder alone, in any session."""
    spark = rows.sparkSession
    plan = json.loads(spark.read.parquet(f"{folder}/plan").first()["plan"])
    tables = load_fitted_tables(spark, folder, plan["tables"])
    fit = FeatureFit(tables["zips"], plan["levels"], plan["sparse"])
    return score_fitted(rows, c, fit, tables, load_model(spark, f"{folder}/model"), ids, first, last, name)
