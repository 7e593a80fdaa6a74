"""H3: the request stream scores each file exactly once across restarts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pricewise.operators import score as H
from pricewise.session import checkpoint_dir
from pricewise.sources.fixtures import fixture
from pricewise.streaming.score_stream import run_score_stream


def test_restart_scores_only_new_files(spark, sf_dir):
    base = os.path.join(checkpoint_dir(spark), f"stream-test-{uuid.uuid4().hex}")
    src, sink, ckpt = (os.path.join(base, n) for n in ("requests", "scores", "checkpoint"))
    cols = ["id", *H.NUMERIC, *[f for f, _, _, _ in H.VOCABULARY]]
    req = fixture(spark, sf_dir, "fx_requests").select(*cols)
    first, second = req.where(F.col("id") % 2 == 0), req.where(F.col("id") % 2 == 1)
    first.write.parquet(os.path.join(src, "batch=1"))
    enc = H.encode_request(req)
    means, stds = H.fit_scaler(enc.where(F.col("reject_reason").isNull()))
    coef = {c: 1.0 for c in H.feature_columns()}
    model = H.LinearScorer(means, stds, coef, 0.0)

    run_score_stream(spark, src, req.schema, model, sink, ckpt)
    n1 = spark.read.parquet(sink).count()
    # a new file arrives; the restarted query (same checkpoint) scores only it
    second.write.parquet(os.path.join(src, "batch=2"))
    run_score_stream(spark, src, req.schema, model, sink, ckpt)
    out = spark.read.parquet(sink)
    batch = H.score_requests(enc, model)
    assert n1 == H.score_requests(H.encode_request(first), model).count()
    assert out.count() == batch.count()
    assert out.select("id").distinct().count() == out.count()
    assert out.exceptAll(batch).count() == 0
