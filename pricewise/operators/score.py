"""H1 / H2: request encoding and batch scoring.

A scoring request is one row ``(km, trunk, cylinder, power, hp, brand, year,
condition, design, aircon, fuel, gearbox)``.  Encoding turns the seven
categorical fields into 51 0/1 flags in a fixed order; scoring scales the
five numerics, appends the flags and applies a linear model.  Both are single
projections, so a request table of any size is scored by a narrow map stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ["km", "trunk", "cylinder", "power", "hp"]

# The form vocabulary that must equal the reference's, in its
# order.  Per field: the levels that get a flag column (in column order), the
# baseline level (all flags 0), and the level an unknown value falls through
# to under ``compat=True`` (None: all flags 0; "reject": the request fails).
VOCABULARY = [
    ("brand", ["audi", "bmw", "chevrolet", "citroen", "dacia", "fiat", "ford", "honda", "hyundai", "kia",
               "mazda", "mercedes", "mini", "mitsubishi", "nissan", "opel", "peugeot", "renault", "seat",
               "skoda", "smart", "suzuki", "toyota", "volkswagen", "volvo"], "alfa", None),
    ("year", ["2012", "2013", "2014", "2015", "2016", "2017", "2018", "2019"], "2011", "2019"),
    ("condition", ["megkimelt", "normal", "serulesmentes", "ujszeru"], "kituno", "reject"),
    ("design", ["egyter", "ferde", "kisbusz", "kombi", "sedan", "varosi"], "cabrio", "varosi"),
    ("aircon", ["digital", "manual"], "automata", None),
    ("fuel", ["dizel", "elektromos", "hibrid", "hibriddizel"], "benzin", "hibriddizel"),
    ("gearbox", ["manual", "szekvencia"], "automata", "szekvencia"),
]


def flag_columns() -> list[str]:
    """The 51 flag column names in feature order."""
    return [f"{field}_{level}" for field, levels, _, _ in VOCABULARY for level in levels]


def feature_columns() -> list[str]:
    return NUMERIC + flag_columns()


def encode_request(df: DataFrame, compat: bool = False) -> DataFrame:
    """H1: append the 51 flags and a ``reject_reason``.

    Default: a value outside a field's vocabulary (levels + baseline) rejects
    the request with a reason.  ``compat=True`` keeps the original form's
    fall-through rules (SURVEY 2.8) and only rejects an unknown condition.
    """
    flags, reasons = [], []
    for field, levels, baseline, fallback in VOCABULARY:
        v = F.lower(F.trim(F.col(field).cast("string")))
        known = v.isin(*levels, baseline)
        if compat and fallback != "reject":
            eff = F.when(known, v).otherwise(F.lit(fallback)) if fallback else F.when(known, v)
        else:
            eff = v
            reasons.append(F.when(~known | v.isNull(),
                                  F.concat(F.lit(f"unknown {field}: "), F.coalesce(v, F.lit("NULL")))))
        for level in levels:
            flags.append(F.coalesce((eff == F.lit(level)).cast("int"), F.lit(0)).alias(f"{field}_{level}"))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return df.select("*", *flags, reason.alias("reject_reason"))


@dataclass
class LinearScorer:
    """A fitted scaler (means, standard deviations of the numerics) plus
    linear coefficients over the scaled numerics and the flags."""

    means: dict[str, float]
    stds: dict[str, float]
    coef: dict[str, float]
    intercept: float

    def prediction(self) -> Column:
        """The score as one JVM expression, rounded to 2 decimals."""
        acc = F.lit(float(self.intercept))
        for c in NUMERIC:
            s = self.stds[c] or 1.0
            acc = acc + F.lit(float(self.coef[c])) * ((F.col(c) - F.lit(float(self.means[c]))) / F.lit(float(s)))
        for c in flag_columns():
            acc = acc + F.lit(float(self.coef[c])) * F.col(c)
        return F.round(acc * 100.0, 0) / 100.0


def fit_scaler(df: DataFrame, cols: Sequence[str] = NUMERIC) -> tuple[dict[str, float], dict[str, float]]:
    """Population mean and standard deviation of each numeric (one
    aggregation; only 2 x len(cols) numbers reach the driver)."""
    aggs = [F.avg(c).alias(f"m_{c}") for c in cols] + [F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    row = df.agg(*aggs).first()
    return {c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols}


def fit_request_pipeline(train: DataFrame, label: str) -> PipelineModel:
    """``pyspark.ml`` pipeline: standardize the numerics, append the flags,
    fit a linear regression.  ``train`` must be encoded (H1) and clean."""
    stages = [VectorAssembler(inputCols=NUMERIC, outputCol="_num"),
              StandardScaler(inputCol="_num", outputCol="_num_z", withMean=True, withStd=True),
              VectorAssembler(inputCols=["_num_z"] + flag_columns(), outputCol="features"),
              LinearRegression(featuresCol="features", labelCol=label, regParam=0.0)]
    return Pipeline(stages=stages).fit(train)


def score_requests(encoded: DataFrame, model: LinearScorer | PipelineModel,
                   keep: Sequence[str] = ("id",), out: str = "prediction") -> DataFrame:
    """H2: score encoded, accepted requests; the prediction is rounded to 2
    decimals as the form displayed it."""
    ok = encoded.where(F.col("reject_reason").isNull())
    if isinstance(model, LinearScorer):
        return ok.select(*keep, model.prediction().alias(out))
    scored = model.transform(ok)
    return scored.select(*keep, (F.round(F.col("prediction") * 100.0, 0) / 100.0).alias(out))
