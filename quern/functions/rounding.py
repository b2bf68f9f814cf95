"""Rounding in numpy by the rule of the SQL functions."""

from __future__ import annotations

import numpy as np


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to ``digits`` decimals, halves away from zero, as SQL's round does."""
    p = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * p + 0.5) / p, x)
