"""YAML parameter files: lists of single-key maps under `required` and `optional`."""

from __future__ import annotations

import argparse

REQUIRED = ("n_dft", "time_step", "n_space_dims", "n_variables")


def read_config(path: str | None = None, strict: bool = True) -> dict:
    """A flat dictionary; without a path the command line's --config_file is read. Missing required keys raise unless strict is off."""
    import yaml

    if path is None:
        parser = argparse.ArgumentParser()
        parser.add_argument("--config_file", required=True)
        path = parser.parse_known_args()[0].config_file
    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    flat = {k: v for part in ("required", "optional") for item in raw.get(part) or [] for k, v in item.items()}
    missing = [k for k in REQUIRED if k not in flat]
    if strict and missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return flat
