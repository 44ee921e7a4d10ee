"""Logging of the driver: a rotating file and the console (SNK-10). Executors log through Spark."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

NAME = "paperloom"
# Size of a log file and how many old ones are kept.
FILE_BYTES, FILES = 10 * 1024 * 1024, 5


def set_up(folder: str | Path | None = None, level: str = "INFO", console: bool = True) -> logging.Logger:
    """The package's logger, writing to folder/paperloom.log if there is a folder. Calling it again replaces its handlers."""
    log = logging.getLogger(NAME)
    log.setLevel(level.upper())
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if folder:
        Path(folder).expanduser().mkdir(parents=True, exist_ok=True)
        handlers.append(RotatingFileHandler(Path(folder).expanduser() / f"{NAME}.log", maxBytes=FILE_BYTES, backupCount=FILES, encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(form)
        log.addHandler(handler)
    return log


def get(part: str) -> logging.Logger:
    return logging.getLogger(f"{NAME}.{part}")
