"""Settings from the environment and an optional file, and the run's log."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields
from pathlib import Path


def read_env_file(path: str | Path) -> dict[str, str]:
    """KEY=value lines; comments and blank lines are skipped, quotes around values dropped. No file gives nothing."""
    out: dict[str, str] = {}
    if not Path(path).is_file():
        return out
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not key.lstrip().startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


@dataclass(frozen=True)
class Settings:
    """Sizes and thresholds of a run; the defaults are the operators'."""

    chunk_bytes: int = 1024
    overlap_frac: float = 0.10
    judge_action: str = "annotate"
    node_threshold: float = 0.5
    rel_threshold: float = 0.5
    cluster_threshold: float = 0.85
    ground_threshold: float = 0.9

    @classmethod
    def load(cls, env_file: str | Path | None = None, prefix: str = "FACTLOOM_") -> Settings:
        """The environment wins over the file, the file over the defaults."""
        known = {**(read_env_file(env_file) if env_file else {}), **os.environ}
        given = {f.name: known[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in known}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if f.name in given})


def run_logger(name: str = "factloom", path: str | Path | None = None, console: bool = False, level: int = logging.INFO) -> logging.Logger:
    """The driver's log, to a file and, if wanted, to the console; asking twice adds nothing."""
    log = logging.getLogger(name)
    log.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    have = {getattr(h, "baseFilename", type(h).__name__) for h in log.handlers}
    wanted: list[logging.Handler] = []
    if path and str(Path(path).resolve()) not in have:
        wanted.append(logging.FileHandler(path, encoding="utf-8"))
    if console and "StreamHandler" not in have:
        wanted.append(logging.StreamHandler())
    for handler in wanted:
        handler.setFormatter(form)
        log.addHandler(handler)
    return log
