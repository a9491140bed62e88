"""Column names that carry meaning, and selectors over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

PREDICTION, PROBABILITY = "predictions_", "probabilities_"


def c(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def select(patterns: str | Iterable[str], columns: list[str]) -> list[str]:
    """Columns by "all", "prefix*", "*suffix" or name, in the order of the patterns, each once."""
    out: list[str] = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        if p == "all":
            found = columns
        elif p.endswith("*"):
            found = [x for x in columns if x.startswith(p[:-1])]
        elif p.startswith("*"):
            found = [x for x in columns if x.endswith(p[1:])]
        else:
            found = [p]
        out += [x for x in found if x not in out]
    return out


def is_prediction(columns: list[str]) -> bool:
    return len(columns) == 1 or (bool(columns) and all(x.startswith((PREDICTION, PROBABILITY)) for x in columns) and any(x.startswith(PREDICTION) for x in columns))


def prediction(columns: list[str]) -> str:
    """The prediction column: the first so named, or the only column there is."""
    found = [x for x in columns if x.startswith(PREDICTION)]
    if found:
        return found[0]
    if len(columns) == 1:
        return columns[0]
    raise ValueError(f"no prediction among {columns}")


def probabilities(columns: list[str]) -> list[str]:
    found = [x for x in columns if x.startswith(PROBABILITY)]
    if not found:
        raise ValueError(f"no probability among {columns}")
    return found


def has_probabilities(columns: list[str]) -> bool:
    return any(x.startswith(PROBABILITY) for x in columns)


def classes(columns: list[str]) -> list[str]:
    """Classes of probability columns: what stands after the last underscore."""
    return [x.rsplit("_", 1)[-1] for x in probabilities(columns)]


def nested(params: dict, mark: str = "¦") -> dict:
    """{"block¦param": v} as {"block": {"param": v}}, at any depth."""
    out: dict = {}
    for key, value in params.items():
        *path, last = key.split(mark)
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out
