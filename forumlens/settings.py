"""Settings from environment-like mappings: unset, empty and unreadable values give the default."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

_SECONDS = {"ms": 0.001, "s": 1, None: 1, "m": 60, "h": 3600}


def text(env: Mapping[str, str], key: str, default: str) -> str:
    return env.get(key) or default


def number(env: Mapping[str, str], key: str, default: float) -> float:
    try:
        value = float(env.get(key) or default)
    except ValueError:
        return default
    return value if math.isfinite(value) else default


def whole(env: Mapping[str, str], key: str, default: int, least: float = -math.inf) -> int:
    value = number(env, key, default)
    return int(value) if value == int(value) and value >= least else default


def seconds(env: Mapping[str, str], key: str, default: float) -> float:
    """'5m', '90s', '250ms', '1.5h' or plain seconds."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m|h)?", env.get(key) or "")
    return float(m[1]) * _SECONDS[m[2]] if m else default
