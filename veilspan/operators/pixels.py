"""Watermark pixels: the white of an image without transparency becomes clear, the rest fades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: A pixel at least this bright in every channel is background.
WHITE = 240


def fade(rgb: np.ndarray, opacity: float) -> np.ndarray:
    """n x 3 values to n x 4, with premultiplied colours."""
    alpha = np.where((rgb >= WHITE).all(axis=1), 0.0, opacity)
    colour = rgb.astype(np.float64) * alpha[:, None]
    return np.concatenate([colour, 255 * alpha[:, None]], axis=1).round().astype(np.uint8)


def faded(opacity: float):
    @F.pandas_udf("binary")
    def apply(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda b: None if b is None else fade(np.frombuffer(b, dtype=np.uint8).reshape(-1, 3), opacity).tobytes())

    return apply
