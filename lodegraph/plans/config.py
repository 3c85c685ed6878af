"""Settings from a JSON file, with values given on the command line in their place."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from .answering import Settings

#: Where a run's file keeps the values that a command line may replace: fixed names.
PLACES = {
    "exp_name": ("experiment", "exp_name"),
    "dataset": ("experiment", "dataset"),
    "split": ("experiment", "split"),
    "alpha": ("retrieval_params", "step5_vss_merge", "alpha"),
    "score_decay": ("grounding_params", "score_decay"),
    "num_workers": ("pipeline", "max_workers"),
}


def load(path: str | Path, **given: object) -> dict:
    """The file's sections with what is given in its place; a value of None leaves the file's, an unknown name is an error."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, value in given.items():
        *sections, key = PLACES[name]
        if value is not None:
            at = config
            for section in sections:
                at = at.setdefault(section, {})
            at[key] = value
    return config


def value(config: dict, name: str, default: object = None) -> object:
    for key in PLACES[name]:
        config = config.get(key) if isinstance(config, dict) else None
    return default if config is None else config


def settings(config: dict, base: Settings = Settings()) -> Settings:
    """``base`` with the alpha and the decay of scores that the file states."""
    policy = dataclasses.replace(base.policy, decay=float(value(config, "score_decay", base.policy.decay)))
    return dataclasses.replace(base, alpha=int(value(config, "alpha", base.alpha)), policy=policy)
