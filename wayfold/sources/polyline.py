"""Encoded polylines (the public algorithm, precision 5), in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.sources import batches


def encode(points: Iterable[tuple[float, float]], precision: int = 5) -> str:
    out, last = [], (0, 0)
    for p in points:
        now = tuple(int(x * 10**precision + (0.5 if x >= 0 else -0.5)) for x in p)
        for a, b in zip(last, now):
            v = b - a
            v = ~(v << 1) if v < 0 else v << 1
            while v >= 0x20:
                out.append(chr((0x20 | (v & 0x1F)) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode(text: str, precision: int = 5) -> list[tuple[float, float]]:
    values, value, shift = [], 0, 0
    for c in text:
        b = ord(c) - 63
        if not 0 <= b < 64:
            raise ValueError("not a polyline")
        value |= (b & 0x1F) << shift
        shift += 5
        if b < 0x20:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    if shift or len(values) % 2:
        raise ValueError("the polyline is cut off")
    out, lat, lng = [], 0, 0
    for i in range(0, len(values), 2):
        lat, lng = lat + values[i], lng + values[i + 1]
        out.append((lat / 10**precision, lng / 10**precision))
    return out


def _mapped(df: DataFrame, source: str, target: str, ddl: str, f) -> DataFrame:
    """df with f of each piece of a column."""
    batches.limit(df.sparkSession)

    def run(rows):
        for b in batches.pieces(rows, source):
            yield pa.RecordBatch.from_arrays([*b.columns, f(b.column(source))], [*b.schema.names, target])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{target}` {ddl}")


def encoded(df: DataFrame, points: str, target: str) -> DataFrame:
    """df with a column of encoded polylines of an array of (lat, lng) structs."""

    def f(lines: pa.Array) -> pa.Array:
        rows = (line.values for line in lines)
        return pa.array([None if p is None else encode(zip(p.field("lat").to_pylist(), p.field("lng").to_pylist(), strict=True)) for p in rows], pa.string())

    return _mapped(df, points, target, "string", f)


def decoded(df: DataFrame, line: str, target: str) -> DataFrame:
    """df with an array of (lat, lng) structs of encoded polylines; a damaged one gives null."""

    def f(lines: pa.Array) -> pa.Array:
        found, size, bad = [np.zeros((0, 2))], [], []
        for text in lines:
            try:
                line = None if not text.is_valid else np.array(decode(text.as_py()), float).reshape(-1, 2)
            except ValueError:
                line = None
            bad.append(line is None)
            found.append(found[0] if line is None else line)
            size.append(len(found[-1]))
        flat = np.concatenate(found)
        points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lat", "lng"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), points, mask=pa.array(bad, pa.bool_()))

    return _mapped(df, line, target, "array<struct<lat: double, lng: double>>", f)
