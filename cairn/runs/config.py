"""Settings and locations of runs; all of them can be written as JSON."""

from __future__ import annotations

import dataclasses
import time
from dataclasses import dataclass
from pathlib import Path

import pyspark

from cairn.operators.models import AXES, PATIENCE, RETUNE_AXES
from cairn.sources.tables import ID, TARGET


@dataclass(frozen=True)
class RunConfig:
    seed: int = 42
    test_size: float = 0.2
    validation_size: float = 0.2
    bins: int = 10
    replicates: int = 1000
    validation_replicates: int = 500
    rounds: int = 5000
    patience: int = PATIENCE
    min_gain: float = 5e-4
    axes: tuple = AXES
    retune_axes: tuple = RETUNE_AXES
    id_column: str = ID
    target: str = TARGET

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


#: A grid that ends in seconds, for smoke runs.
QUICK = RunConfig(replicates=10, validation_replicates=10, rounds=3, patience=10, axes=(("max_depth", (2, 4)),), retune_axes=(("max_depth", (2, 4)),))


@dataclass(frozen=True)
class Paths:
    """Where a run keeps what it makes. ``root`` must be a folder that the driver writes; tables may be elsewhere."""

    root: Path
    tables: str | None = None

    def table(self, source: str) -> str:
        return f"{self.tables or self.root / 'tables'}/{source}.parquet"

    def manifest(self, source: str) -> Path:
        return self.root / "manifests" / f"{source}.json"

    @property
    def build_log(self) -> Path:
        return self.root / "build_log.json"

    @property
    def membership(self) -> str:
        return f"{self.tables or self.root / 'tables'}/membership.parquet"

    def metrics(self, name: str) -> Path:
        return self.root / "metrics" / f"{name}.json"

    def model(self, name: str) -> str:
        return str(self.root / "models" / name)

    def report(self, name: str) -> str:
        return str(self.root / "reports" / name)

    @property
    def trials(self) -> Path:
        return self.root / "trials.csv"

    @property
    def retune_trials(self) -> Path:
        return self.root / "retune_trials.csv"

    @property
    def lock(self) -> Path:
        return self.root / "locked.json"


def run_metadata(began: float) -> dict:
    return {"finished": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "spark": pyspark.__version__, "seconds": round(time.time() - began, 1)}
