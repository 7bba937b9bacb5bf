"""Settings of an analysis; each is a convention that changes results, so they are named here and checked once."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields

_positive: Callable = lambda v: v > 0
_not_negative: Callable = lambda v: v >= 0
#: What each setting must fulfil, and how that reads in a message.
RULES: dict[str, tuple[Callable, str]] = {
    "abundance": (lambda v: 0 < v < 1, "a share between 0 and 1"),
    "target_pp": (_positive, "more than 0 percentage points"),
    "z": (_positive, "a quantile above 0"),
    "min_n_eff": (_not_negative, "0 or more"),
    "min_cells": (_not_negative, "0 or more"),
    "n_boot": (_positive, "at least one replicate"),
}


@dataclass(frozen=True)
class Settings:
    """abundance: a category's share in design tables; target_pp: percentage points to resolve; z: normal quantile;
    min_n_eff, min_cells: least effective number of a row, and of nuclei in either library of a pair; n_boot, seed:
    replicates of donors."""

    # The published conventions.
    abundance: float = 0.10
    target_pp: float = 1.0
    z: float = 1.96
    min_n_eff: float = 0.0
    min_cells: int = 50
    n_boot: int = 1000
    seed: int = 0

    def __post_init__(self) -> None:
        wrong = []
        for f in fields(self):
            value = getattr(self, f.name)
            test, reads = RULES.get(f.name, (lambda v: True, ""))
            if not math.isfinite(value) or not test(value):
                wrong.append(f"{f.name} is {value}; it must be {reads or 'a finite number'}")
        if wrong:
            raise ValueError("; ".join(wrong))
