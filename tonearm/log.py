"""Log lines as JSON on standard error."""

from __future__ import annotations

import json
import logging
import sys
import uuid
from datetime import UTC, datetime

_FIXED = ("repo", "tool", "step", "run_id")


class JsonFormatter(logging.Formatter):
    def __init__(self, **fixed: str):
        super().__init__()
        self.fixed = fixed

    def format(self, record: logging.LogRecord) -> str:
        body = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "message": record.getMessage(), "logger": record.name}
        body |= {k: getattr(record, k, v) for k, v in self.fixed.items()}
        if record.exc_info:
            body["exception"] = self.formatException(record.exc_info)
        return json.dumps(body, default=str)


def init(repo: str, tool: str, step: str | None = None, run_id: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The logger of a tool; a second call changes its fields and adds no handler."""
    logger = logging.getLogger(f"{repo}.{tool}")
    formatter = JsonFormatter(repo=repo, tool=tool, step=step, run_id=run_id or uuid.uuid4().hex)
    handler = next((h for h in logger.handlers if getattr(h, "json_lines", False)), None)
    if handler is None:
        handler = logging.StreamHandler(sys.stderr)
        handler.json_lines = True
        logger.addHandler(handler)
        logger.propagate = False
    handler.setFormatter(formatter)
    logger.setLevel(level)
    return logger
