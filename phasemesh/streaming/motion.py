"""Displacement between frames of unbounded streams of motion parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.motion import PARAMS, RADIUS

FIELDS = "session_id string, t long, fd double"
STATE = "t long, " + ", ".join(f"{p} double" for p in PARAMS)


def framewise_displacement(frames: DataFrame, radius: float = RADIUS, idle_ms: int | None = None, late: bool = False) -> DataFrame:
    """Streaming form of the batch operator: each session keeps its last frame as state, dropped after ``idle_ms`` if given
    (Spark then goes on running empty batches to look for idle sessions).

    Frames are put in order within a micro-batch; one not after the session's last is late.  Late frames are left out, or
    with ``late`` come as rows whose ``fd`` is null and whose column ``late`` is true.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(batches)).sort_values("t", kind="stable")
        t, x = frame["t"].to_numpy(np.int64), frame[list(PARAMS)].to_numpy(np.float64)
        last = state.get if state.exists else None
        ok = np.append(True, t[1:] > t[:-1]) if last is None else np.diff(t, prepend=last[0]) > 0
        # of frames in order, those not after the last that was kept are at the beginning or repeat the one before
        if last is not None:
            ok &= t > last[0]
        behind = t[~ok]
        t, x = t[ok], x[ok]
        if len(t):
            moved = np.abs(np.diff(x, axis=0, prepend=x[:1] if last is None else np.array([last[1:]], np.float64)))
            fd = moved[:, 0] + moved[:, 1] + moved[:, 2] + radius * (moved[:, 3] + moved[:, 4] + moved[:, 5])
            state.update((int(t[-1]), *x[-1].tolist()))
            first = int(last is None)
        else:
            fd, first = np.zeros(0), 0
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        out = pd.DataFrame({"session_id": key[0], "t": t[first:], "fd": fd[first:]})
        if late:
            out["late"] = False
            out = pd.concat([out, pd.DataFrame({"session_id": key[0], "t": behind, "fd": np.nan, "late": True})])
            out["fd"] = out["fd"].astype("Float64").mask(out["late"].astype(bool))
        if len(out):
            yield out

    fields = FIELDS + ", late boolean" * late
    return frames.groupBy("session_id").applyInPandasWithState(step, fields, STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")
