"""The run's own log: events with fields, as JSON or as key=value lines, to standard error and to a file.

``operators.analytics.log_fields`` reads the lines back as a table.
"""

from __future__ import annotations

import datetime
import json
import logging
import os
import sys

NAME = "trailbase"
OFF = logging.CRITICAL + 10


def event(name: str, level: int = logging.INFO, **fields) -> None:
    """Log an event, such as ``walk.round``, with its fields."""
    logging.getLogger(NAME).log(level, name, extra={"fields": fields})


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat(timespec="milliseconds")
        line = {"time": at, "level": record.levelname, "event": record.getMessage(), **getattr(record, "fields", {})}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


class KeyValues(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).strftime("%H:%M:%S")
        shown = lambda v: f'"{v}"' if isinstance(v, str) and (" " in v or not v) else v
        parts = [at, record.levelname, record.getMessage(), *(f"{k}={shown(v)}" for k, v in getattr(record, "fields", {}).items())]
        return " ".join(map(str, parts)) + (f"\n{self.formatException(record.exc_info)}" if record.exc_info else "")


def setup(level: str = "INFO", form: str = "text", file: str | None = None) -> None:
    """Send events of ``level`` and above to standard error, as ``text`` or ``json``, and to a file as text; OFF sends none. A second call replaces the first."""
    logger = logging.getLogger(NAME)
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    number = OFF if level.upper() in ("OFF", "NONE", "") else logging.getLevelNamesMapping().get(level.upper(), logging.INFO)
    logger.setLevel(number)
    logger.propagate = False
    if number >= OFF:
        logger.addHandler(logging.NullHandler())
        return
    screen = logging.StreamHandler(sys.stderr)
    screen.setFormatter(JsonLines() if form == "json" else KeyValues())
    logger.addHandler(screen)
    if file:
        os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
        kept = logging.FileHandler(file)
        kept.setFormatter(KeyValues())
        logger.addHandler(kept)
