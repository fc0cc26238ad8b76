"""Settings: an argument wins over the environment, that over a file of lines NAME=value, that over the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Texts that mean yes.
YES = frozenset({"1", "true", "yes", "on"})


@dataclass(frozen=True)
class Settings:
    """Of requests (threads: at a time in a task; timeout: seconds of one; retries: after one that failed) and packing; prefix of the variables: QUILL_."""

    model: str = ""
    threads: int = 8
    unit_least: int = 1000
    unit_most: int = 1500
    timeout: int = 60
    retries: int = 3
    temperature: float = 0.3
    use_summary: bool = True
    export_formats: str = ""


def read_lines(path: str) -> dict[str, str]:
    """NAME=value of each line, quotes around a value taken off; comments, other lines and a missing file give nothing."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def resolve(path: str = ".env", prefix: str = "QUILL_", **given) -> Settings:
    told = {**read_lines(path), **os.environ}
    out = {}
    for f in fields(Settings):
        kind = type(f.default)
        if given.get(f.name) is not None:
            out[f.name] = given[f.name]
        elif told.get(prefix + f.name.upper(), "") != "":
            value = told[prefix + f.name.upper()]
            out[f.name] = value.lower() in YES if kind is bool else kind(value)
    return Settings(**out)
