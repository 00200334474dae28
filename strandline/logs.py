"""Logging of the command line and of drivers: Spark's own logs are left alone."""

from __future__ import annotations

import datetime
import logging


def time_stamp() -> str:
    return datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def enable_logging(verbose: bool = False, path: str | None = None) -> logging.Logger:
    """Messages of this package to the terminal, and to a file if one is named. Called again it replaces its handlers."""
    log = logging.getLogger("strandline")
    log.setLevel(logging.INFO if verbose else logging.WARNING)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
