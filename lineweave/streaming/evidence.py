"""Streaming twins: present runs from a stream of frames, latest version of each line from a log of commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "scan_id long, first_frame int, last_frame int"
_STATE = "present boolean, first int, last int"


def stream_runs(frames: DataFrame, enter: float, leave: float, idle_ms: int | None = None) -> DataFrame:
    """Present runs of (scan_id, frame, coverage[, ocr_box]) that ended, by the rule of presence(); frames of a scan come in order. A scan
    without frames for `idle_ms` of processing time is over: a run that is still open ends with its last present frame, and its
    state goes. Without idle_ms, as for a trigger that ends when all is read, states stay and open runs don't come."""
    boxed = "ocr_box" in frames.columns

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        present, first, last = state.get if state.exists else (False, -1, -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], first, last)] * bool(present), columns=["scan_id", "first_frame", "last_frame"])
            return
        out = []
        for p in batches:
            box = p.ocr_box if boxed else [None] * len(p)
            for f, c, b in sorted(zip(p.frame, p.coverage, box), key=lambda x: x[0]):
                vetoed = b is not None and not pd.isna(b) and not b
                now = present if c < 0 else not vetoed and (c >= enter or (present and c >= leave))
                if now and not present:
                    first = f
                if present and not now:
                    out.append((key[0], first, last))
                present, last = now, f if now else last
        state.update((bool(present), int(first), int(last)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["scan_id", "first_frame", "last_frame"])

    return frames.groupBy("scan_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(commits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each row of a commit log, deleted ones left out; in a stream, with output mode complete."""
    rest = [c for c in commits.columns if c not in (*keys, order)]
    return commits.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*").where("not deleted").drop("deleted")
