"""What a run is told from outside: paths, environment files, numbers, templates, the log."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterable, MutableMapping
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for "no limit" in a setting.
UNLIMITED = ("none", "null", "unlimited", "inf", "infinite")
LOG_LEVEL, FILE_LOG_LEVEL = "WEFTLINE_LOG_LEVEL", "WEFTLINE_FILE_LOG_LEVEL"


def plain_path(raw: str | None) -> str:
    """A path as typed or dropped: quotes and blanks off, ``file:`` URIs as paths; a host makes it //host/path. '' for nothing."""
    text = (raw or "").strip().strip('"')
    if not text.lower().startswith("file:"):
        return text
    parts = urlsplit(text)
    path = unquote(parts.path).replace("\\", "/")
    if parts.netloc:
        return f"//{unquote(parts.netloc)}/{path.lstrip('/')}"
    return path[1:] if re.match("/[A-Za-z]:", path) else path


def distinct_paths(raw: Iterable[str]) -> list[str]:
    """Paths in order, without blanks and without repeats that differ in case only."""
    out: dict[str, str] = {}
    for path in filter(None, map(plain_path, raw)):
        out.setdefault(path.lower(), path)
    return list(out.values())


def output_path(source: str, override: str | None = None, folder: str | None = None) -> str:
    """Where the repaired file goes: the override, else the folder or one named ``output`` beside the source."""
    p = PurePosixPath(source)
    return override or str(PurePosixPath(folder or p.parent / "output") / f"{p.stem}_repaired{p.suffix}")


def report_path(source: str, kind: str, override: str | None = None, folder: str | None = None) -> str:
    """Where a report goes; kind is ``verification.json`` or ``diff-report.xlsx``. A folder that is not absolute lies beside the source, and holds one folder a source."""
    p = PurePosixPath(source)
    base = p.parent / "output" if folder is None else p.parent / folder / p.stem
    return override or str(base / f"{p.stem}.{kind}")


def cleaned_path(source: str, folder: str) -> str:
    p = PurePosixPath(source)
    return str(PurePosixPath(folder) / f"{p.stem}__cleaned{p.suffix.lower()}")


def env_values(text: str) -> dict[str, str]:
    """KEY=value lines; comments and lines without a key are left out, one pair of quotes goes."""
    out = {}
    for line in text.removeprefix("﻿").splitlines():
        key, equals, value = line.strip().partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key or key.startswith("#"):
            continue
        quoted = len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]
        out[key] = value[1:-1] if quoted else value
    return out


def load_env(paths: Iterable[str], env: MutableMapping[str, str] | None = None) -> list[str]:
    """Fills what is missing or empty in the environment from files, the first file first. Gives the files that held something."""
    env = os.environ if env is None else env
    used = []
    for path in paths:
        if not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8") as f:
            values = env_values(f.read())
        for key, value in values.items():
            if not env.get(key, "").strip():
                env[key] = value
        if values:
            used.append(path)
    return used


def number_or(text: str | None, default: float) -> float:
    """A number that is not negative, else the default."""
    try:
        value = float((text or "").strip())
    except ValueError:
        return default
    return value if value >= 0 else default


def limit_or(text: str | None, default: int) -> int | None:
    """A limit of at least one; None for no limit (a word for it, or a number below one)."""
    word = (text or "").strip().lower()
    if word in UNLIMITED:
        return None
    try:
        return int(word) if int(word) > 0 else None
    except ValueError:
        return max(1, default)


def limit_column(text: Column, default: int) -> Column:
    """``limit_or`` for a column."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    value = word.try_cast("int")
    return F.when(word.isin(*UNLIMITED) | (value < 1), F.lit(None)).otherwise(F.coalesce(value, F.lit(max(1, default))))


def elapsed(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS under an hour."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%02d:%02d", (s % 3600 / 60).cast("long"), s % 60)
    return F.when(s >= 3600, F.concat(F.format_string("%02d:", (s / 3600).cast("long")), short)).otherwise(short)


def read_template(path: str) -> str:
    with open(path, encoding="utf-8-sig") as f:
        return f.read()


def logger(log_file: str | None = None, env: MutableMapping[str, str] | None = None) -> logging.Logger:
    """The engine's log on the console and, if asked, in a file, each from the level its setting names."""
    env = os.environ if env is None else env
    log = logging.getLogger("weftline")
    level = lambda name, default: getattr(logging, env.get(name, "").strip().upper() or default, getattr(logging, default))
    log.setLevel(min(level(LOG_LEVEL, "INFO"), level(FILE_LOG_LEVEL, "WARNING")))
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handlers = [(logging.StreamHandler(), level(LOG_LEVEL, "INFO"))]
    if log_file:
        handlers.append((logging.FileHandler(log_file, encoding="utf-8"), level(FILE_LOG_LEVEL, "WARNING")))
    for handler, at in handlers:
        handler.setLevel(at)
        handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s", "%H:%M:%S"))
        log.addHandler(handler)
    return log
