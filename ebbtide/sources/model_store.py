"""Versions of a fitted analysis under one folder, for scoring without a fit.

A version is written to a folder of its own first. Then a small manifest that names it is
renamed to the next free number; renaming never replaces a file, so of two writers one takes
the number after. Readers follow the manifest with the highest number: what has no manifest,
such as the folder of a writer that died, is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ebbtide.operators.forecaster import Forecaster
from ebbtide.operators.scaling import Scaler
from ebbtide.sources.files import Folder

_FRAMES = ["users", "series", "correlated", "importance", "scores"]
_MANIFEST = "manifest-"


@dataclass(frozen=True)
class State:
    """What later calls reuse instead of fitting again."""

    users: DataFrame
    series: DataFrame
    correlated: DataFrame
    importance: DataFrame
    scores: DataFrame
    forecaster: Forecaster
    classifier: PipelineModel
    scaler: Scaler
    selected: list[str]
    approach: str
    as_of: date


class ModelStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(n.removeprefix(_MANIFEST)) for n in self.folder.names() if n.startswith(_MANIFEST))

    def save(self, state: State) -> int:
        """Write ``state`` and publish it as the newest version; its number."""
        name = f"state-{uuid.uuid4().hex}"
        path = f"{self.folder.path}/{name}"
        for frame in _FRAMES:
            getattr(state, frame).write.parquet(f"{path}/{frame}")
        state.forecaster.trees.write.parquet(f"{path}/trees")
        state.classifier.save(f"{path}/classifier")
        about = json.dumps({
            "state": name, "mode": state.forecaster.mode, "horizon_days": state.forecaster.horizon_days, "selected": state.selected,
            "approach": state.approach, "as_of": state.as_of.isoformat(), "offset": state.scaler.offset, "width": state.scaler.width,
        })
        while True:
            version = max(self.versions(), default=0) + 1
            if self.folder.publish(f"{_MANIFEST}{version:08d}", about):
                return version

    def load(self, version: int | None = None) -> State:
        """A published version, the newest if none is named."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no such version in {self.folder.path}")
        about = json.loads(self.folder.read(f"{_MANIFEST}{version or known[-1]:08d}"))
        path = f"{self.folder.path}/{about['state']}"
        users, series, correlated, importance, scores, trees = (self.spark.read.parquet(f"{path}/{f}") for f in [*_FRAMES, "trees"])
        return State(
            users, series, correlated, importance, scores, Forecaster(about["mode"], trees, about["horizon_days"]),
            PipelineModel.load(f"{path}/classifier"), Scaler(about["offset"], about["width"]), about["selected"],
            about["approach"], date.fromisoformat(about["as_of"]),
        )

    def expire(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` versions, the manifests first; the deleted numbers."""
        versions = self.versions()
        old = versions[: -keep or None]
        states = {v: json.loads(self.folder.read(f"{_MANIFEST}{v:08d}"))["state"] for v in versions}
        for version in old:
            self.folder.delete(f"{_MANIFEST}{version:08d}")
        for state in {states[v] for v in old} - {states[v] for v in versions if v not in old}:
            self.folder.delete(state)
        return old
