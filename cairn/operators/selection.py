"""Choosing challengers and sources: trial log, coordinate search, ablations, backward elimination. Driver loops over few fits."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from cairn.operators.models import ChallengerSpec
from cairn.operators.provenance import load_checkpoint, save_checkpoint

MIN_GAIN = 5e-4


@dataclass
class TrialLog:
    """Records of fits in order; the same specification is never fitted twice.

    If a path is given, the log is written after each fit as CSV, with a checkpoint beside it that names the run's ``context``.
    """

    path: Path | None = None
    records: list[dict] = field(default_factory=list)
    context: dict = field(default_factory=dict)
    _known: dict[str, dict] = field(default_factory=dict)

    @property
    def checkpoint(self) -> Path:
        return Path(self.path).with_suffix(".json")

    @classmethod
    def resumed(cls, path: Path, context: dict) -> TrialLog:
        """The log of a run that stopped, or an empty one; raises if its context or its CSV is not what the checkpoint says."""
        state = load_checkpoint(Path(path).with_suffix(".json"), context, [path]) or {"records": []}
        return cls(path, state["records"], context, {r["spec"]: r for r in state["records"]})

    def run(self, spec: ChallengerSpec, evaluate: Callable[[ChallengerSpec], dict], stage: str, about: str = "") -> dict:
        if (key := spec.key()) in self._known:
            return self._known[key]
        record = {"trial": len(self.records), "stage": stage, "about": about, "spec": key, **evaluate(spec)}
        self.records.append(record)
        self._known[key] = record
        if self.path:
            with Path(self.path).open("w", newline="") as out:
                writer = csv.DictWriter(out, sorted({k for r in self.records for k in r}))
                writer.writeheader()
                writer.writerows(self.records)
            save_checkpoint(self.checkpoint, self.context, [self.path], {"records": self.records})
        return record

    def of_stage(self, prefix: str = "") -> list[dict]:
        """The records of the stages that start with ``prefix``; ``best`` marks those of the lowest validation log loss among them."""
        chosen = [r for r in self.records if r["stage"].startswith(prefix)]
        least = min((r["val_log_loss"] for r in chosen), default=None)
        return [r | {"best": r["val_log_loss"] == least} for r in chosen]


def coordinate_search(base: ChallengerSpec, axes, evaluate: Callable[[ChallengerSpec], dict], log: TrialLog) -> tuple[ChallengerSpec, dict]:
    """Sweep one axis after another from the best so far; a value is taken only if it lowers ``val_log_loss``."""
    best, record = base, log.run(base, evaluate, "initial", "start")
    for axis, values in axes:
        held = best.get(axis)
        for value in values:
            if value == held:
                continue
            trial = best.with_params(**{axis: value})
            found = log.run(trial, evaluate, f"search:{axis}", f"{axis}={value}")
            if found["val_log_loss"] < record["val_log_loss"]:
                best, record = trial, found
    return best, record


def adopt_variant(incumbent: ChallengerSpec, record: dict, variants: dict[str, ChallengerSpec], evaluate, log: TrialLog, name: str, min_gain: float = MIN_GAIN) -> tuple[ChallengerSpec, dict, str | None]:
    """The best of the variants if it lowers the validation log loss by at least ``min_gain``, else the incumbent."""
    found = {label: log.run(spec, evaluate, f"ablation:{name}", label) for label, spec in variants.items()}
    label = min(found, key=lambda k: found[k]["val_log_loss"])
    if record["val_log_loss"] - found[label]["val_log_loss"] >= min_gain:
        return variants[label], found[label], label
    return incumbent, record, None


def ablation_configs(sources: tuple[str, ...], single: bool = True, leave_one_out: bool = True) -> list[tuple[str, str, tuple[str, ...]]]:
    """(name, group, sources): the application alone, sources one by one added, each alone, each left out; no subset twice."""
    out, seen = [], set()

    def add(name: str, group: str, subset: tuple[str, ...]) -> None:
        if subset not in seen:
            seen.add(subset)
            out.append((name, group, subset))

    add("M0_application", "sequential", ())
    for n in range(len(sources)):
        add(f"M{n + 1}_+{sources[n]}", "sequential", tuple(sources[: n + 1]))
    for s in sources if single else ():
        add(f"S_{s}", "single", (s,))
    for s in sources if leave_one_out and len(sources) > 1 else ():
        add(f"L-{s}", "leave-one-out", tuple(x for x in sources if x != s))
    return out


def config_name(subset: tuple[str, ...], sources: tuple[str, ...]) -> str:
    """The name of a subset: as in the grid where it is there, else by what it leaves out."""
    subset = tuple(s for s in sources if s in subset)
    named = {x: name for name, _, x in ablation_configs(sources)}
    return named.get(subset) or "L-" + "-".join(s for s in sources if s not in subset)


def backward_elimination(sources: tuple[str, ...], cost: Callable[[tuple[str, ...], tuple[str, ...]], dict]) -> dict:
    """Drop the source whose removal costs least while the interval of that cost reaches zero; one source always stays.

    cost(full, without): log-loss cost of the removal with ``estimate`` and ``ci_low``, by paired bootstrap.
    """
    left, rounds = list(sources), []
    while len(left) > 1:
        found = {s: cost(tuple(left), tuple(x for x in left if x != s)) for s in left}
        weakest = min(left, key=lambda s: found[s]["estimate"])
        drop = found[weakest]["ci_low"] <= 0
        rounds.append({"remaining": list(left), "weakest": weakest, "dropped": drop, "candidates": found})
        if not drop:
            break
        left.remove(weakest)
    return {"retained": left, "final_config": config_name(tuple(left), sources), "rounds": rounds}
