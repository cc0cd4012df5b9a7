"""Request admission: per client, a window opens at its first request and admits so many."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import fusion

# Fixed values (must match for right results).
MAX_REQUESTS = 60
WINDOW_S = 60.0

ADMISSION_OUT = (
    "client_key string, request_id bigint, at_s double, admitted boolean, remaining int, reset_at double, "
    "retry_after_s bigint"
)


class Gate(NamedTuple):
    count: int
    reset_at: float


def admit(gate: Gate | None, rows: pd.DataFrame, limit: int, window_s: float) -> tuple[Gate, pd.DataFrame]:
    """Ordered rows of one client through its gate."""
    out = []
    for r in rows.itertuples(index=False):
        if gate is None or gate.reset_at <= r.at_s:
            gate = Gate(0, r.at_s + window_s)
        ok = gate.count < limit
        gate = gate._replace(count=gate.count + ok)
        left = limit - gate.count if ok else 0
        wait = None if left else max(1, int(-((r.at_s - gate.reset_at) // 1)))
        out.append((r.client_key, r.request_id, r.at_s, ok, left, gate.reset_at, wait))
    names = [c.split()[0] for c in ADMISSION_OUT.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    return gate, frame.astype({"retry_after_s": "Int64"})


def request_admission(request: DataFrame, limit: int = MAX_REQUESTS, window_s: float = WINDOW_S) -> DataFrame:
    """Admission decisions for a table of ``client_key, request_id, asked_at``.

    Where a client's windows open is found by the chunked anchor walk over its distinct instants;
    inside a window only the rank of a request counts.
    """
    timed = request.select(
        "client_key", "request_id", F.col("asked_at").cast("timestamp").cast("double").alias("start_s")
    )
    opened = fusion.cluster_anchors(
        timed.select("client_key", "start_s").distinct(), ["client_key"], window_s, True
    )
    w = Window.partitionBy("client_key", "anchor_s").orderBy("start_s", "request_id")
    ranked = timed.join(opened, ["client_key", "start_s"]).withColumn("rank", F.row_number().over(w))
    ok = F.col("rank") <= limit
    left: Column = F.when(ok, F.lit(limit) - F.col("rank")).otherwise(F.lit(0)).cast("int")
    reset = F.col("anchor_s") + window_s
    return ranked.select(
        "client_key",
        "request_id",
        F.col("start_s").alias("at_s"),
        ok.alias("admitted"),
        left.alias("remaining"),
        reset.alias("reset_at"),
        F.when(left == 0, F.greatest(F.lit(1).cast("bigint"), F.ceil(reset - F.col("start_s")))).alias("retry_after_s"),
    )
