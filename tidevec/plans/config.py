"""Configuration from TOML, and the level of logging."""

from __future__ import annotations

import logging
import os
import tomllib

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF")


def load(path: str) -> dict[str, str | int | float | bool]:
    """The scalars at the top of a file; tables and arrays are left out."""
    with open(path, "rb") as f:
        return {k: v for k, v in tomllib.load(f).items() if not isinstance(v, (dict, list))}


def load_nested(path: str) -> dict[str, object]:
    """All values under dotted keys; arrays of tables stay lists of such dictionaries."""
    with open(path, "rb") as f:
        return flatten(tomllib.load(f))


def flatten(tree: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tree.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            out[prefix + k] = [flatten(x) for x in v]
        else:
            out[prefix + k] = v
    return out


def log_level(config: dict, variable: str = "TIDEVEC_LOG_LEVEL") -> str:
    """The environment's level, else the configuration's ``log_level``, else WARN."""
    level = str(os.environ.get(variable) or config.get("log_level") or "WARN").upper()
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return level


def apply_log_level(spark, config: dict) -> str:
    level = log_level(config)
    spark.sparkContext.setLogLevel(level)
    logging.getLogger("tidevec").setLevel({"TRACE": 5, "WARN": 30, "FATAL": 50, "OFF": 100}.get(level) or getattr(logging, level))
    return level
