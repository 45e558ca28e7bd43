"""A stateful tracker over a stream of detections: ids by clip, tracks end after max_age frames unseen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def track_stream(detections: DataFrame, reach: float = 6.0, max_age: int = 15) -> DataFrame:
    """STR-01, STR-02: detections: clip, frame, x, y, side. Frames of a clip must come in order between batches; within a batch they are sorted. State is bounded by the live tracks of a clip."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, ids, frames, xs, ys, sides = state.get if state.exists else (1, [], [], [], [], [])
        live = {i: (f, x, y, s) for i, f, x, y, s in zip(ids, frames, xs, ys, sides, strict=True)}
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["frame", "x", "y"]).reset_index(drop=True)
        found = np.zeros(len(rows), np.int64)
        for frame, part in rows.groupby("frame", sort=True):
            live = {i: t for i, t in live.items() if frame - t[0] <= max_age}
            free = dict(live)
            for i, x, y, side in zip(part.index, part["x"], part["y"], part["side"], strict=True):
                near = min(((float(np.hypot(x - t[1], y - t[2])), k) for k, t in free.items() if t[3] == side), default=(reach + 1, 0))
                if near[0] <= reach:
                    track = near[1]
                    del free[track]
                else:
                    track, following = following, following + 1
                live[track] = (int(frame), float(x), float(y), side)
                found[i] = track
        state.update((following, list(live), *([t[k] for t in live.values()] for k in range(4))))
        yield rows.assign(clip=key[0], track=found)[["clip", "frame", "x", "y", "side", "track"]]

    return detections.groupBy("clip").applyInPandasWithState(run, "clip long, frame long, x double, y double, side string, track long", "following long, ids array<long>, frames array<long>, xs array<double>, ys array<double>, sides array<string>", "append", GroupStateTimeout.NoTimeout)
