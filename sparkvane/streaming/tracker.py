"""The scene tracker as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracker import RESULT, STATE, Scene, as_frame


def track_stream(frames: DataFrame, threshold: float = 0.85, method: str = "window", window_size: int = 15) -> DataFrame:
    """A row per frame; each stream's scene is kept in the state store and checkpointed with every micro-batch.

    Within a micro-batch frames go by (ts_ms, image_id), between them in order of arrival.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scene = Scene(threshold, method, window_size)
        if state.exists:
            scene.load(state.get)
        t = pd.concat(list(batches)).sort_values(["ts_ms", "image_id"])
        rows = [(key[0], i, ts, *scene.append(int(i), int(ts), float(s), v)) for i, ts, s, v in zip(t["image_id"], t["ts_ms"], t["score"], t["embedding"], strict=True)]
        state.update(scene.saved())
        yield as_frame(rows)

    wanted = frames.select("stream", "image_id", "ts_ms", "score", "embedding")
    return wanted.groupBy("stream").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
