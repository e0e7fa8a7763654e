"""Settings in a JSON file, and logging."""

from __future__ import annotations

import json
import logging
import os
import sys
from pathlib import Path

from . import schema

log = logging.getLogger("quillmatch")
TRACE = 5
logging.addLevelName(TRACE, "TRACE")

DEFAULTS = {
    "language": "en", "log_level": "info", "reports_extension": "csv", "show_progress": 0, "short_output": 0, "max_depth": schema.DEFAULT_MAX_DEPTH,
    "ngrams_length": schema.DEFAULT_NGRAMS, "threshold": schema.DEFAULT_THRESHOLD, "workers": os.cpu_count() or 1,
    "mongo_host": "host.docker.internal", "mongo_port": 27017, "mongo_user": "root",
}
KEYS = ("environment", "reports", *DEFAULTS, "mongo_pass")
PATHS = ("environment", "reports")


def config_path() -> Path:
    return Path(os.environ.get("QUILLMATCH_CONFIG", Path.home() / ".config/quillmatch/settings.json"))


def read_config(path: Path, safe: bool = False) -> dict | None:
    """The file's settings; with ``safe``, None if it is missing, unreadable or no JSON."""
    try:
        return json.loads(Path(path).read_text())
    except (FileNotFoundError, PermissionError, json.JSONDecodeError):
        if not safe:
            raise
        return None


def write_config(path: Path, settings: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(settings, default=str, indent=4))


def read_settings(path: Path | None = None) -> dict:
    found = read_config(path or config_path(), safe=True)
    if found is None:
        log.warning("No readable settings at %s; the defaults hold.", path or config_path())
        return dict(DEFAULTS)
    merged = DEFAULTS | {k: v for k, v in found.items() if k in KEYS}
    return {k: Path(v) if k in PATHS and v is not None else v for k, v in merged.items()}


def modify(changes: dict, path: Path | None = None) -> dict:
    """Take over the given values that are not None."""
    settings = read_settings(path)
    for key in KEYS:
        if (value := changes.get(key)) is not None:
            settings[key] = Path(value).resolve() if key in PATHS else value
    write_config(path or config_path(), settings)
    return settings


def table(settings: dict) -> str:
    import pandas as pd

    shown = {k: v for k, v in settings.items() if k != "mongo_pass"}
    return str(pd.DataFrame({"Value": list(shown.values())}, index=pd.Index(list(shown), name="Key"), dtype=object))


def set_logging(level: str = "info", file: Path | None = None) -> None:
    """Errors go to stderr, all else to stdout; everything goes to the file."""
    log.setLevel(TRACE if level == "trace" else level.upper())
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    out, err = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    out.addFilter(lambda r: r.levelno < logging.ERROR)
    err.setLevel(logging.ERROR)
    log.handlers = [out, err, *([logging.FileHandler(file)] if file else [])]
    for h in log.handlers:
        h.setFormatter(form)
