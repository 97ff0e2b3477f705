"""Colour gradients: 256 RGBA entries by visit count."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The built-in palettes as count:colour stops.
PALETTES = {
    "pinkish": "1:ffb1ff7f;10:ffb1ffff;50:ffffffff",
    "blue-red": "1:3f5efbff;10:fc466bff;50:ffffffff",
    "red": "1:b20a2cff;10:fffbd5ff;50:ffffffff",
    "orange": "1:fc4a1aff;10:f7b733ff;50:fdedceff",
}


def colour(text: str) -> tuple[int, int, int, int]:
    """RGB, RRGGBB or RRGGBBAA."""
    if not re.fullmatch(r"[0-9a-fA-F]+", text) or len(text) not in (3, 6, 8):
        raise ValueError(f"not a colour: {text!r}")
    if len(text) == 3:
        text = "".join(c * 2 for c in text)
    value = bytes.fromhex(text if len(text) == 8 else text + "ff")
    return tuple(value)


def stops(text: str) -> list[tuple[int, tuple[int, int, int, int]]]:
    out = []
    for part in text.split(";"):
        n, sep, c = part.partition(":")
        if not sep or not n.strip().isdigit() or int(n) > 255:
            raise ValueError(f"not a gradient: {text!r}")
        out.append((int(n), colour(c.strip())))
    return sorted(out)


def palette(text: str) -> np.ndarray:
    """256 x 4 bytes; transparent below the first stop, the last colour from the last stop on."""
    at = stops(PALETTES.get(text, text))
    out = np.zeros((256, 4), np.uint8)
    for (n, a), (m, b) in zip(at, at[1:]):
        for i in range(n, m):
            t = np.float32(i - n) / np.float32(m - n)
            out[i] = (np.array(a, np.float32) * (1 - t) + np.array(b, np.float32) * t).astype(np.uint8)
    out[at[-1][0] :] = at[-1][1]
    return out


def table(spark: SparkSession, text: str) -> DataFrame:
    """visits, rgba (hex) of all 256 counts: a broadcast dimension."""
    return spark.createDataFrame([(i, bytes(c).hex()) for i, c in enumerate(palette(text).tolist())], "visits long, rgba string")


def choose(color: str | None, gradient: str | None, default: str) -> np.ndarray:
    if color and gradient:
        raise ValueError("give a palette or a gradient, not both")
    if color and color not in PALETTES:
        raise ValueError(f"no such palette: {color!r}")
    return palette(color or gradient or default)
