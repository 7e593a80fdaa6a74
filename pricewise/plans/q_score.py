"""Checked queries for request encoding and batch / stream scoring (H1-H3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pricewise.operators import score as H
from pricewise.operators.features import split_hash
from pricewise.plans.registry import register
from pricewise.session import checkpoint_dir
from pricewise.sources.fixtures import fixture, with_fixture
from pricewise.streaming.score_stream import run_score_stream

REQ_COLS = ["id"] + H.NUMERIC + [f for f, _, _, _ in H.VOCABULARY]


# ------------------------------------------------------------- SQL helpers
def _sql_encoded(compat: bool = False) -> str:
    """SELECT list of the 51 flags plus reject_reason over ``fx_requests``."""
    flags, reasons = [], []
    for field, levels, baseline, fallback in H.VOCABULARY:
        v = f"lower(trim({field}))"
        known_list = ", ".join(f"'{x}'" for x in levels + [baseline])
        known = f"{v} IN ({known_list})"
        if compat and fallback != "reject":
            eff = f"CASE WHEN {known} THEN {v} ELSE {f"'{fallback}'" if fallback else 'NULL'} END"
        else:
            eff = v
            reasons.append(f"WHEN {v} IS NULL OR NOT ({known}) THEN 'unknown {field}: ' || coalesce({v}, 'NULL')")
        for level in levels:
            flags.append(f"coalesce(CAST({eff} = '{level}' AS INTEGER), 0) AS {field}_{level}")
    reason = f"CASE {' '.join(reasons)} END" if reasons else "CAST(NULL AS VARCHAR)"
    return ", ".join(flags) + f", {reason} AS reject_reason"


def fixed_coefficients() -> tuple[dict[str, float], float]:
    """A fixed linear model over the 56 features (test model with a known
    closed form): numerics weigh 100000 * (i + 1), flags +/-1000 * (j + 1)."""
    coef = {c: 100000.0 * (i + 1) for i, c in enumerate(H.NUMERIC)}
    coef.update({c: 1000.0 * (j + 1) * (-1) ** j for j, c in enumerate(H.flag_columns())})
    return coef, 1_000_000.0


def _sql_fixed_scores() -> str:
    coef, b0 = fixed_coefficients()
    stats = ", ".join([f"avg({c}) AS m_{c}" for c in H.NUMERIC] + [f"stddev_pop({c}) AS s_{c}" for c in H.NUMERIC])
    terms = [f"{float(b0)!r}"]
    terms += [f"{coef[c]!r} * (({c} - m_{c}) / s_{c})" for c in H.NUMERIC]
    terms += [f"{coef[c]!r} * {c}" for c in H.flag_columns()]
    return with_fixture("fx_requests", f"""
, enc AS (SELECT *, {_sql_encoded()} FROM fx_requests),
ok AS (SELECT * FROM enc WHERE reject_reason IS NULL),
s AS (SELECT {stats} FROM ok)
SELECT id, round(({' + '.join(terms)}) * 100.0) / 100.0 AS prediction FROM ok, s""")


def _fixed_scorer(encoded_ok) -> H.LinearScorer:
    means, stds = H.fit_scaler(encoded_ok)
    coef, b0 = fixed_coefficients()
    return H.LinearScorer(means, stds, coef, b0)


def _requests(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_requests")


# ------------------------------------------------------------- H1
@register("h01_encode_request", with_fixture("fx_requests", f"""
SELECT id, {_sql_encoded()} FROM fx_requests"""))
def q_encode(spark, sf_dir):
    return H.encode_request(_requests(spark, sf_dir).select(*REQ_COLS)).drop(*REQ_COLS[1:])


@register("h01_encode_request_compat", with_fixture("fx_requests", f"""
SELECT id, {_sql_encoded(compat=True)} FROM fx_requests"""))
def q_encode_compat(spark, sf_dir):
    return H.encode_request(_requests(spark, sf_dir).select(*REQ_COLS), compat=True).drop(*REQ_COLS[1:])


# ------------------------------------------------------------- H2
@register("h02_score_requests_fixed", _sql_fixed_scores())
def q_score_fixed(spark, sf_dir):
    enc = H.encode_request(_requests(spark, sf_dir).select(*REQ_COLS))
    model = _fixed_scorer(enc.where(F.col("reject_reason").isNull()))
    return H.score_requests(enc, model)


@register("h02_score_requests_pipeline")
def q_score_pipeline(spark, sf_dir):
    enc = H.encode_request(_requests(spark, sf_dir))
    ok = enc.where(F.col("reject_reason").isNull())
    model = H.fit_request_pipeline(ok.where(split_hash("id") < 800), "price")
    return H.score_requests(enc, model, keep=("id", "price"))


# ------------------------------------------------------------- H3
@register("h03_score_stream", _sql_fixed_scores())
def q_score_stream(spark, sf_dir):
    """Requests land as files in a shared folder; the stream scores them in
    micro-batches (one file each) with the same fixed model as H2."""
    base = os.path.join(checkpoint_dir(spark), f"score-stream-{uuid.uuid4().hex}")
    src, sink, ckpt = (os.path.join(base, n) for n in ("requests", "scores", "checkpoint"))
    req = _requests(spark, sf_dir).select(*REQ_COLS)
    req.write.option("maxRecordsPerFile", 50_000).parquet(src)  # as many files as there are requests for
    landed = spark.read.parquet(src)
    enc = H.encode_request(landed)
    model = _fixed_scorer(enc.where(F.col("reject_reason").isNull()))
    run_score_stream(spark, src, landed.schema, model, sink, ckpt, max_files_per_trigger=1)
    return spark.read.parquet(sink)
