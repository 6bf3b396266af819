"""Rasters from files by windows: TIFF images as tiles, a band of rows at a time, without a row per pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import SIDE, THERE, VALID, each
from . import archives
from .scenes import NotConfigured

#: Tags and number types of the format (fixed values): number of bytes and struct's letter of each type that sizes and offsets come in.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _FORMAT, _TILES = 256, 257, 258, 259, 273, 277, 278, 339, 322
_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}


@dataclass
class Layout:
    """Where the rows of an uncompressed image of one sample a pixel lie."""

    height: int
    width: int
    kind: np.dtype
    rows: int
    offsets: list[int]

    @classmethod
    def of(cls, f: BinaryIO) -> Layout:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        if order is None:
            raise NotConfigured("no TIFF image")
        take = lambda form: struct.unpack(order + form, f.read(struct.calcsize(order + form)))
        large = take("H")[0] == 43
        at = take("HHQ")[2] if large else take("I")[0]
        f.seek(at)
        entries = [take("HHQ8s" if large else "HHI4s") for _ in range(take("Q" if large else "H")[0])]
        tags: dict[int, list[int]] = {}
        for tag, kind, count, inline in entries:
            size, letter = _TYPES.get(kind, (0, ""))
            if size and tag in (_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _FORMAT, _TILES):
                data = inline
                if size * count > len(inline):
                    f.seek(struct.unpack(order + ("Q" if large else "I"), inline)[0])
                    data = f.read(size * count)
                tags[tag] = list(struct.unpack(f"{order}{count}{letter}", data[: size * count]))
        one = lambda tag, default: tags.get(tag, [default])[0]
        if one(_COMPRESSION, 1) != 1 or one(_SAMPLES, 1) != 1 or one(_FORMAT, 1) > 3 or _TILES in tags or _OFFSETS not in tags:
            raise NotConfigured("only uncompressed strips of one sample a pixel are read")
        kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
        return cls(one(_HEIGHT, 0), one(_WIDTH, 0), kind, min(one(_ROWS, 1 << 31), one(_HEIGHT, 0)), tags[_OFFSETS])

    def read(self, f: BinaryIO, first: int, last: int) -> np.ndarray:
        """Rows from ``first`` up to, without, ``last``; only their bytes are read."""
        parts, line = [], self.width * self.kind.itemsize
        while first < last:
            strip, inside = divmod(first, self.rows)
            n = min(last - first, self.rows - inside)
            f.seek(self.offsets[strip] + inside * line)
            parts.append(f.read(n * line))
            first += n
        return np.frombuffer(b"".join(parts), self.kind).reshape(-1, self.width)


def image_sizes(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """(path, scene_id, height, width) of the images at or below a path; the scene's id is the file's name without its ending."""

    def one(name: str) -> Iterator[tuple]:
        with archives.opened(name) as f:
            layout = Layout.of(f)
        yield name, layout.height, layout.width

    found = archives.read_each(archives.listed(spark, path, glob), one, "path string, height long, width long", 1)
    return found.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("scene_id"), "height", "width")


def read_tiles(images: DataFrame, side: int = SIDE, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Tiles of ``images`` (path, scene_id, height, width): numbers as they are stored, valid where they are above 0.

    With ``rows`` and ``cols`` (the second number not in it) only the tiles that these touch. A task reads a band of
    ``side`` rows; of a window's other rows nothing is read.
    """
    top, bottom = (F.lit(0), F.col("height")) if rows is None else (F.lit(max(0, rows[0])), F.least(F.lit(rows[1]), F.col("height")))
    left, right = (F.lit(0), F.col("width")) if cols is None else (F.lit(max(0, cols[0])), F.least(F.lit(cols[1]), F.col("width")))
    spans = images.select("path", "scene_id", top.alias("top"), bottom.alias("bottom"), left.cast("long").alias("c0"), right.cast("long").alias("c1")).where("top < bottom AND c0 < c1")
    bands = spans.select("path", "scene_id", "c0", "c1", F.explode(F.sequence(F.floor(F.col("top") / side), F.floor((F.col("bottom") - 1) / side))).alias("band"))

    def read(path: str, scene: str, c0: int, c1: int, band: int) -> Iterator[tuple]:
        with archives.opened(path) as f:
            layout = Layout.of(f)
            data = layout.read(f, band * side, min((band + 1) * side, layout.height))
        for k in range(c0 // side, (c1 - 1) // side + 1):
            part = data[:, k * side : (k + 1) * side]
            value, state = np.zeros((side, side)), np.zeros((side, side), np.uint8)
            value[: part.shape[0], : part.shape[1]] = part
            state[: part.shape[0], : part.shape[1]] = np.where(part > 0, THERE | VALID, THERE)
            yield scene, band, k, value.tobytes(), state.tobytes()

    return each(bands.repartition("path", "band"), read, "scene_id string, tile_row long, tile_col long, value binary, state binary", 16)


def calibrated(source: DataFrame, tables: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of backscatter less noise, with ``noise``, the noise's own backscatter of each pixel, from tiles of stored numbers.

    ``tables`` has a row for each scene: lines, pixels (ascending), gain and noise (a number for each line and pixel,
    line by line). Between lines and pixels both are linear; beyond the last line the slope goes on, beyond the last pixel
    the value stays. Backscatter is (number^2 - noise) / gain^2 and may be negative.
    """

    def one(scene: str, tr: int, tc: int, value: bytes, state: bytes, lines: list, pixels: list, gain: list, noise: list) -> Iterator[tuple]:
        r, c = np.arange(side) + tr * side, np.arange(side) + tc * side
        x, y = np.array(lines, float), np.array(pixels, float)
        i, j = (np.clip(np.searchsorted(a, b, side="right") - 1, 0, len(a) - 2) for a, b in ((x, r), (y, c)))
        u, v = ((r - x[i]) / (x[i + 1] - x[i]))[:, None], np.clip((c - y[j]) / (y[j + 1] - y[j]), 0, 1)[None, :]

        def at(values: list) -> np.ndarray:
            g = np.array(values, float).reshape(len(x), len(y))
            near, far = (g[k][:, j] * (1 - v) + g[k][:, j + 1] * v for k in (i, i + 1))
            return near * (1 - u) + far * u

        power, dn = at(gain) ** 2, np.frombuffer(value).reshape(side, side)
        floor = at(noise)
        yield scene, tr, tc, ((dn * dn - floor) / power).tobytes(), state, (floor / power).tobytes()

    rows = source.select("scene_id", "tile_row", "tile_col", "value", "state").join(tables.select("scene_id", "lines", "pixels", "gain", F.col("noise").alias("floor")), "scene_id")
    return each(rows, one, "scene_id string, tile_row long, tile_col long, value binary, state binary, noise binary", 16)
