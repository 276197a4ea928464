"""Scene segmentation of frames in streams, by similarity to a running centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RESULT = (
    "stream string, image_id long, ts_ms long, scene_id int, is_new_scene boolean, similarity double, scene_frame_count int, scene_start_ts long, scene_end_ts long, "
    "best_image_id long, best_score double, completed_scene struct<scene_id:int,best_image_id:long,best_score:double,frame_count:int,start_ts:long,end_ts:long>"
)
NAMES = [part.split()[0] for part in RESULT.split(", ")[:12]]


@dataclass
class Scene:
    """One stream's state; method is `window` (mean of the last frames of the scene) or `centroid` (running mean)."""

    threshold: float = 0.85
    method: str = "window"
    window_size: int = 15
    scene_id: int = 0
    count: int = 0
    start_ts: int = 0
    end_ts: int = 0
    best_id: int = 0
    best_score: float = 0.0
    centroid: np.ndarray | None = None
    recent: list = field(default_factory=list)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        length = float(np.sqrt((v * v).sum()))
        return v / length if length else v

    def _open(self, unit, image_id, ts, score) -> None:
        self.count, self.start_ts, self.end_ts, self.best_id, self.best_score = 1, ts, ts, image_id, score
        self.centroid, self.recent = unit, [unit]

    def append(self, image_id: int, ts: int, score: float, embedding) -> tuple:
        """The row for one frame, after it joined its scene or opened the next."""
        unit = self._unit(np.asarray(embedding, np.float64))
        if self.centroid is not None and len(unit) != len(self.centroid):
            raise ValueError(f"a frame of {len(unit)} components in a stream of {len(self.centroid)}")
        done, new, similarity = None, False, 1.0
        if self.centroid is None:
            self._open(unit, image_id, ts, score)
        else:
            similarity = float((unit * self.centroid).sum())
            new = similarity < self.threshold
            if new:
                done = (self.scene_id, self.best_id, self.best_score, self.count, self.start_ts, self.end_ts)
                self.scene_id += 1
                self._open(unit, image_id, ts, score)
            else:
                if self.method == "centroid":
                    self.centroid = self._unit(self.centroid * self.count + unit)
                else:
                    self.recent = [*self.recent, unit][-max(1, self.window_size) :]
                    self.centroid = self._unit(np.sum(self.recent, axis=0) / len(self.recent))
                self.count += 1
                self.end_ts = ts
                if score > self.best_score:
                    self.best_id, self.best_score = image_id, score
        return (self.scene_id, new, similarity, self.count, self.start_ts, self.end_ts, self.best_id, self.best_score, done)

    def reset(self) -> None:
        self.scene_id, self.count, self.centroid, self.recent = 0, 0, None, []

    def saved(self) -> tuple:
        """The state as plain values."""
        centroid = [] if self.centroid is None else self.centroid.tolist()
        return (self.scene_id, self.count, self.start_ts, self.end_ts, self.best_id, self.best_score, centroid, [u.tolist() for u in self.recent])

    def load(self, state: tuple) -> Scene:
        self.scene_id, self.count, self.start_ts, self.end_ts, self.best_id, self.best_score, centroid, recent = state
        self.centroid = np.array(centroid) if len(centroid) else None
        self.recent = [np.array(u) for u in recent]
        return self


STATE = "scene_id int, count int, start_ts long, end_ts long, best_id long, best_score double, centroid array<double>, recent array<array<double>>"


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    keys = ("scene_id", "best_image_id", "best_score", "frame_count", "start_ts", "end_ts")
    out = pd.DataFrame(rows, columns=NAMES)
    out["completed_scene"] = [None if x is None else dict(zip(keys, x, strict=True)) for x in out["completed_scene"]]
    return out


def track(frames: DataFrame, threshold: float = 0.85, method: str = "window", window_size: int = 15) -> DataFrame:
    """A row per frame of (stream, image_id, ts_ms, score, embedding), each stream in order of (ts_ms, image_id).

    Streams are spread over tasks; a task reads its sorted frames as they come and holds one stream's state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, scene = None, None
        for b in batches:
            rows = []
            for s, i, t, score, v in zip(b["stream"], b["image_id"], b["ts_ms"], b["score"], b["embedding"], strict=True):
                if scene is None or s != stream:
                    stream, scene = s, Scene(threshold, method, window_size)
                rows.append((s, i, t, *scene.append(int(i), int(t), float(score), v)))
            yield as_frame(rows)

    ordered = frames.select("stream", "image_id", "ts_ms", "score", "embedding").repartition("stream").sortWithinPartitions("stream", "ts_ms", "image_id")
    return ordered.mapInPandas(run, RESULT)
