"""How a feature column is normalised, as the operator that makes it declares.

identity: as it is; raw: the median for the missing mark, then standardised; log: log1p, then
standardised; zscore: standardised, what any column is that nobody declares.
"""

from __future__ import annotations

import re
from collections.abc import Callable

DECLARED: list[tuple[re.Pattern, str]] = []


def columns(**names: str) -> Callable:
    """Decorates an operator with its columns' scales: columns(log="indegree {d}_last{n}"); {d}: in or out, {e}: in, out or total, {n}: digits, {*}: anything."""
    for mode, words in names.items():
        for word in words.split():
            parts = {"d": "(in|out)", "e": "(in|out|total)", "n": r"\d+", "*": ".*"}
            DECLARED.append((re.compile("".join(parts[p[1:-1]] if p.startswith("{") else re.escape(p) for p in re.split(r"(\{.\})", word))), mode))
    return lambda operator: operator


def normalization(name: str) -> str:
    return next((mode for pattern, mode in DECLARED if pattern.fullmatch(name)), "zscore")
