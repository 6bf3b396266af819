"""Rasters as tables of tiles: reading by windows, halos, block statistics, masks, blobs over any number of tiles.

A tile is a row (scene_id, tile_row, tile_col, value, state): SIDE x SIDE doubles and as many bytes of
flags, row by row. Pixels that aren't there have no flag, so the edge of an image needs no padding.
After the tiler no step has a row per pixel; what tiles exchange are strips and border pixels:

* a halo is up to eight strips a tile, whatever its width, put around the tile by its key;
* components are labelled within tiles, and only labels that meet at a border are joined;
* a blob grows in the tiles that its window touches, and its parts are joined in the same way. So
  no blob is too large, and none is looked at in one piece: parts give counts, boxes, peaks and hulls.

Tiles that several steps read are written to the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import components, cut, shared_folder
from .radar import Config, from_db

#: Pixels along a tile; a multiple of the blocks.
SIDE = 256
#: Flags of a pixel or cell.
THERE, VALID, FLAG, FILL, HOT = 1, 2, 4, 8, 16
KEY = ["scene_id", "tile_row", "tile_col"]


def _schema(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([df.schema["scene_id"], *T.StructType.fromDDL(f"tile_row long, tile_col long, {more}").fields])


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    shape = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), shape.types, strict=True)], names=shape.names)


def each(tiles: DataFrame, fn: Callable[..., Iterator[tuple]], schema: T.StructType | str, most: int = 64) -> DataFrame:
    """Rows of ``schema`` that ``fn`` gives for each row of ``tiles``, ``most`` at a time."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                for made in fn(*(c[k].as_py() for c in batch.columns)):
                    out.append(made)
                    if len(out) >= most:
                        yield _batch(schema, out)
                        out = []
        if out:
            yield _batch(schema, out)

    return tiles.mapInArrow(run, schema)


def _grid(data: bytes, kind: str, side: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(side, side)


# -- in and out ----------------------------------------------------------------------------------

def tile(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of pixels (scene_id, row, col, value, valid if there is such a column); the one step with a row per pixel.

    Null values aren't valid. Of a pixel given several times the largest value counts, valid ones first.
    """
    valid = F.col("value").isNotNull() & (F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pixels.columns else F.lit(True))
    place = (F.pmod("row", F.lit(side)) * side + F.pmod("col", F.lit(side))).cast("int")
    px = pixels.select("scene_id", F.floor(F.col("row") / side).alias("tile_row"), F.floor(F.col("col") / side).alias("tile_col"), place.alias("at"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"), valid.alias("ok"))
    schema = _schema(px, "value binary, state binary")
    shape = to_arrow_schema(schema)

    def gather(table: pa.Table) -> pa.Table:
        at, v, ok = (table.column(c).to_numpy() for c in ("at", "v", "ok"))
        order = np.lexsort((v, ok))
        value, state = np.zeros(side * side), np.zeros(side * side, np.uint8)
        value[at[order]] = v[order]
        state[at[order]] = np.where(ok[order], THERE | VALID, THERE)
        key = [pa.array([table.column(c)[0].as_py()], k) for c, k in zip(KEY, shape.types, strict=False)]
        return pa.table([*key, pa.array([value.tobytes()]), pa.array([state.tobytes()])], schema=shape)

    return px.groupBy(*KEY).applyInArrow(gather, schema)


def tile_cells(cells: DataFrame, row: str, col: str, flag: str, side: int) -> DataFrame:
    """As ``tile``, of cells with one flag and no value."""
    place = (F.pmod(row, F.lit(side)) * side + F.pmod(col, F.lit(side))).cast("int")
    own = cells.select("scene_id", F.floor(F.col(row) / side).alias("tile_row"), F.floor(F.col(col) / side).alias("tile_col"), place.alias("at"), F.coalesce(F.col(flag), F.lit(False)).alias("on"))
    schema = _schema(own, "state binary")
    shape = to_arrow_schema(schema)

    def gather(table: pa.Table) -> pa.Table:
        state = np.zeros(side * side, np.uint8)
        np.bitwise_or.at(state, table.column("at").to_numpy(), np.where(table.column("on").to_numpy(), THERE | FLAG, THERE).astype(np.uint8))
        key = [pa.array([table.column(c)[0].as_py()], k) for c, k in zip(KEY, shape.types, strict=False)]
        return pa.table([*key, pa.array([state.tobytes()])], schema=shape)

    return own.groupBy(*KEY).applyInArrow(gather, schema)


def written(tiles: DataFrame, name: str) -> DataFrame:
    """The tiles from the shared folder, so that what follows reads them and not what made them."""
    return cut(tiles, shared_folder(tiles, "tiles"), name)


def window(tiles: DataFrame, rows: tuple[int, int], cols: tuple[int, int], side: int = SIDE) -> DataFrame:
    """The tiles that touch rows and columns from the first up to, without, the second number; a filter on stored columns."""
    (r0, r1), (c0, c1) = rows, cols
    return tiles.where(F.col("tile_row").between(r0 // side, (r1 - 1) // side) & F.col("tile_col").between(c0 // side, (c1 - 1) // side))


# -- halos ---------------------------------------------------------------------------------------

def with_halo(tiles: DataFrame, width: int, side: int = SIDE) -> DataFrame:
    """``value`` (where there is one) and ``state`` with ``width`` more pixels on every side, from the neighbours' strips.

    A tile sends each neighbour the strip that this one needs, so a wider halo makes longer strips and not more rows.
    """
    has_value, reach, wide = "value" in tiles.columns, -(-width // side), side + 2 * width
    around = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)]
    cuts = {d: (max(0, d * side - width), min(side, (d + 1) * side + width)) for d in range(-reach, reach + 1)}
    schema = _schema(tiles, "dr int, dc int, value binary, state binary")

    def strips(scene, r: int, c: int, state: bytes, value: bytes | None = None) -> Iterator[tuple]:
        s, v = _grid(state, "u1", side), None if value is None else _grid(value, "f8", side)
        for dr, dc in around:
            (a, b), (p, q) = cuts[dr], cuts[dc]
            part = s[a:b, p:q]
            if (dr, dc) == (0, 0) or part.any():  # what isn't there need not be sent
                yield scene, r + dr, c + dc, dr, dc, None if v is None else v[a:b, p:q].tobytes(), part.tobytes()

    sent = each(tiles.select(*KEY, "state", *(["value"] if has_value else [])), strips, schema)
    ordered = sent.repartition(*KEY).sortWithinPartitions(*KEY)
    done = _schema(tiles, "state binary" + (", value binary" if has_value else ""))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, core, state, value = None, False, None, None

        def result() -> Iterator[pa.RecordBatch]:
            if core:
                yield _batch(done, [(*now, state.tobytes(), *([value.tobytes()] if has_value else []))])

        for batch in batches:
            for scene, r, c, dr, dc, v, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (scene, r, c) != now:
                    yield from result()
                    now, core, state, value = (scene, r, c), False, np.zeros((wide, wide), np.uint8), np.zeros((wide, wide)) if has_value else None
                (a, b), (p, q) = cuts[dr], cuts[dc]
                y, x = width - dr * side + a, width - dc * side + p
                box = (slice(y, y + b - a), slice(x, x + q - p))
                state[box] = np.frombuffer(s, "u1").reshape(b - a, q - p)
                if has_value:
                    value[box] = np.frombuffer(v, "f8").reshape(b - a, q - p)
                core = core or (dr, dc) == (0, 0)
        yield from result()

    return ordered.mapInArrow(assemble, done)


# -- morphology ----------------------------------------------------------------------------------

def within(mask: np.ndarray, radius: int) -> np.ndarray:
    """Cells at most ``radius`` steps to the four neighbours away from a set one, by two sweeps of distances along each axis."""
    far = np.int32(1 << 29)
    d = np.where(mask, np.int32(0), far)
    for axis in (0, 1):
        d = np.moveaxis(d, axis, 0)
        for k in range(1, len(d)):
            np.minimum(d[k], d[k - 1] + 1, out=d[k])
        for k in range(len(d) - 2, -1, -1):
            np.minimum(d[k], d[k + 1] + 1, out=d[k])
        d = np.moveaxis(d, 0, axis)
    return d <= radius


def dilate_cells(cells: DataFrame, radius: int, flag: str, invert: bool = False, row: str = "block_row", col: str = "block_col", side: int = 64) -> DataFrame:
    """(scene_id, row, col, flag) after growth by ``radius`` within the cells that are there; inverted before and after for erosion."""
    padded = with_halo(tile_cells(cells, row, col, flag, side), radius, side)
    schema = T.StructType([cells.schema["scene_id"], *T.StructType.fromDDL(f"`{row}` long, `{col}` long, `{flag}` boolean").fields])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scene, r, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                state = _grid(data, "u1", side + 2 * radius)
                there, on = (state & THERE) > 0, (state & FLAG) > 0
                wide = within(there & ~on if invert else on, radius) != invert
                core = slice(radius, radius + side)
                y, x = np.nonzero(there[core, core])
                yield pa.RecordBatch.from_arrays([pa.array([scene] * len(y), batch.schema.types[0]), pa.array(y + r * side), pa.array(x + c * side), pa.array(wide[core, core][y, x])], names=schema.names)

    return padded.select(*KEY, "state").mapInArrow(grow, schema)


# -- statistics ----------------------------------------------------------------------------------

def _blocks(x: np.ndarray, block: int) -> np.ndarray:
    n = len(x) // block
    return x.reshape(n, block, n, block)


def _sum(x: np.ndarray, block: int) -> np.ndarray:
    return _blocks(x, block).sum(axis=(1, 3))


def _stretched(x: np.ndarray, block: int) -> np.ndarray:
    return x.repeat(block, axis=0).repeat(block, axis=1)


def statistics(value: np.ndarray, valid: np.ndarray, block: int, censor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and number of valid pixels of each block, without what lies over ``censor`` deviations above a first mean.

    Where less than an eighth of a block is left, the first pass counts; a block without valid pixels is 0.
    """

    def one(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, n = np.where(keep, value, 0.0), _sum(keep, block)
        mean = _sum(v, block) / np.maximum(n, 1)
        return n, mean, np.sqrt(np.maximum(_sum(v * v, block) / np.maximum(n, 1) - mean * mean, 0.0))

    n0, mean0, std0 = one(valid)
    n1, mean1, std1 = one(valid & (value <= _stretched(mean0 + censor * std0, block)))
    thin = n1 < max(block * block // 8, 1)
    return np.where(thin, mean0, mean1), np.where(thin, std0, std1), n0


def _block_rows(tiles: DataFrame, block: int, side: int, fn: Callable, more: str) -> DataFrame:
    schema = T.StructType([tiles.schema["scene_id"], *T.StructType.fromDDL(f"block_row long, block_col long, {more}").fields])

    def rows(scene, r: int, c: int, value: bytes, state: bytes) -> Iterator[tuple]:
        keep, *columns = fn(_grid(value, "f8", side), _grid(state, "u1", side))
        y, x = np.nonzero(keep)
        k = side // block
        yield from zip([scene] * len(y), (y + r * k).tolist(), (x + c * k).tolist(), *(col[y, x].tolist() for col in columns), strict=True)

    return each(tiles.select(*KEY, "value", "state"), rows, schema, 4096)


def block_stats(tiles: DataFrame, block: int, censor: float, side: int = SIDE) -> DataFrame:
    """(scene_id, block_row, block_col, mean, std, fill) of blocks with a valid pixel; ``fill`` is the valid share of a whole block."""

    def fn(value: np.ndarray, state: np.ndarray) -> tuple:
        mean, std, n = statistics(value, (state & VALID) > 0, block, censor)
        return n > 0, mean, std, n / float(block * block)

    return _block_rows(tiles, block, side, fn, "mean double, std double, fill double")


def block_mean(tiles: DataFrame, block: int, side: int = SIDE) -> DataFrame:
    """(scene_id, block_row, block_col, mean, fill) of blocks with a pixel: mean of the valid ones, 0 without any."""

    def fn(value: np.ndarray, state: np.ndarray) -> tuple:
        ok = (state & VALID) > 0
        n = _sum(ok, block)
        return _sum((state & THERE) > 0, block) > 0, _sum(np.where(ok, value, 0.0), block) / np.maximum(n, 1), n / float(block * block)

    return _block_rows(tiles, block, side, fn, "mean double, fill double")


# -- thresholds ----------------------------------------------------------------------------------

def land_mask(tiles: DataFrame, config: Config = Config(), side: int = SIDE) -> DataFrame:
    """(scene_id, tile_row, tile_col, mask): a byte for each land block, FLAG where it is land or fill.

    Bright means, opened so that ships don't count, grown along the coast; fill is a block with fewer valid
    pixels of those that are there than ``max_fill_fraction`` allows.
    """
    n, level = side // config.land_block, from_db(config.land_sigma0_db)
    schema = _schema(tiles, "state binary")

    def cells(scene, r: int, c: int, value: bytes, state: bytes) -> Iterator[tuple]:
        s = _grid(state, "u1", side)
        ok, there = (s & VALID) > 0, _sum((s & THERE) > 0, config.land_block)
        count = _sum(ok, config.land_block)
        land = _sum(np.where(ok, _grid(value, "f8", side), 0.0), config.land_block) / np.maximum(count, 1) > level
        fill = count < (1.0 - config.max_fill_fraction) * there
        grid = (there > 0) * (THERE | land * FLAG | fill * FILL)
        yield scene, r, c, grid.astype(np.uint8).tobytes()

    halo = 2 * config.land_open_blocks + config.land_dilate_blocks
    padded = with_halo(each(tiles.select(*KEY, "value", "state"), cells, schema), halo, n)
    done = _schema(tiles, "mask binary")

    def opened(scene, r: int, c: int, state: bytes) -> Iterator[tuple]:
        s = _grid(state, "u1", n + 2 * halo)
        land, there = (s & FLAG) > 0, (s & THERE) > 0
        land = land & ~within(there & ~land, config.land_open_blocks)
        land = within(land, config.land_open_blocks + config.land_dilate_blocks)
        core = slice(halo, halo + n)
        yield scene, r, c, ((land | ((s & FILL) > 0))[core, core] * np.uint8(FLAG)).tobytes()

    return each(padded.select(*KEY, "state"), opened, done)


COUNTS = ("examined", "masked", "water", "px_above_cfar", "px_above_floor", "px_hot")


def tested(tiles: DataFrame, mask: DataFrame | None, nesz: float | None, config: Config = Config(), side: int = SIDE) -> DataFrame:
    """Tiles with FLAG for the mask and HOT for what passes both tests in ``state``, each block's ``threshold``, and COUNTS.

    Means and deviations are of the water only. A pixel is hot above mean + k deviations of its block and, given a
    noise floor, ``min_snr_db`` above it: one number, or a column ``noise`` of the tiles with as many as pixels.
    """
    per_pixel = "noise" in tiles.columns
    cols = tiles.select(*KEY, "value", "state", F.col("noise") if per_pixel else F.lit(None).cast("binary").alias("noise"))
    cols = cols.withColumn("mask", F.lit(None).cast("binary")) if mask is None else cols.join(mask, KEY, "left")
    schema = _schema(tiles, "value binary, state binary, threshold binary, " + ", ".join(f"{c} long" for c in COUNTS))
    snr = from_db(config.min_snr_db)

    def test(scene, r: int, c: int, value: bytes, state: bytes, noise: bytes | None, masked: bytes | None) -> Iterator[tuple]:
        v, s = _grid(value, "f8", side), _grid(state, "u1", side)
        valid = (s & VALID) > 0
        land = np.zeros_like(valid) if masked is None else _stretched(_grid(masked, "u1", side // config.land_block) > 0, config.land_block)
        water = valid & ~land
        mean, std, _ = statistics(v, water, config.block, config.censor)
        threshold = mean + config.k * std
        above = v > _stretched(threshold, config.block)
        floor = v > _grid(noise, "f8", side) * snr if noise is not None else np.ones_like(valid) if nesz is None else v > nesz * snr
        hot = water & above & floor
        flags = s | land * np.uint8(FLAG) | hot * np.uint8(HOT)
        yield scene, r, c, value, flags.tobytes(), threshold.tobytes(), *(int(x.sum()) for x in (valid, valid & land, water, water & above, water & floor, hot))

    return each(cols.select(*KEY, "value", "state", "noise", "mask"), test, schema)


# -- blobs ---------------------------------------------------------------------------------------

def labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the set pixels in row order, and for each the first place of its 8-connected group."""
    at = np.flatnonzero(mask)
    index = np.full(mask.size, -1, np.int64)
    index[at] = np.arange(len(at))
    g = index.reshape(mask.shape)
    a, b = [], []
    for p, q in ((g[:, :-1], g[:, 1:]), (g[:-1], g[1:]), (g[:-1, :-1], g[1:, 1:]), (g[:-1, 1:], g[1:, :-1])):
        both = (p >= 0) & (q >= 0)
        a.append(p[both])
        b.append(q[both])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(at))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return at, at[root]


def _edge(at: np.ndarray, side: int) -> np.ndarray:
    """Whether places lie in a tile's outermost rows and columns."""
    y, x = np.divmod(at, side)
    return (y == 0) | (y == side - 1) | (x == 0) | (x == side - 1)


def _met(border: DataFrame, group: list[str]) -> DataFrame:
    """(a, b) from border pixels (group..., row, col, node): nodes of neighbouring pixels, each pair of pixels once."""
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))))
    ahead = border.select(*group, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("node").alias("a"), F.explode(steps).alias("s"))
    ahead = ahead.select(*group, (F.col("r0") + F.col("s.r")).alias("row"), (F.col("c0") + F.col("s.c")).alias("col"), "a")
    return ahead.join(border.withColumnRenamed("node", "b"), [*group, "row", "col"]).where("a <> b").select("a", "b").distinct()


def _parts(hot: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Labels within tiles: (scene_id, tile_row, tile_col, at, label: arrays of places), and border pixels (scene_id, row, col, node)."""
    schema = _schema(hot, "at array<int>, label array<int>, edge array<boolean>")

    def find(scene, r: int, c: int, state: bytes) -> Iterator[tuple]:
        at, label = labelled((_grid(state, "u1", side) & HOT) > 0)
        if len(at):
            yield scene, r, c, at.tolist(), label.tolist(), _edge(at, side).tolist()

    parts = written(each(hot.select(*KEY, "state"), find, schema), "labels")
    px = parts.select(*KEY, F.explode(F.filter(F.arrays_zip("at", "label", "edge"), lambda p: p["edge"])).alias("p"))
    return parts, px.select("scene_id", _global("tile_row", "p.at", side, 0), _global("tile_col", "p.at", side, 1), _node(side, "p.label"))


def _global(tile_col: str, at: str, side: int, axis: int):
    own = F.floor(F.col(at) / side) if axis == 0 else F.col(at) % side
    return (F.col(tile_col) * side + own).cast("long").alias("col" if axis else "row")


def _node(side: int, at: str):
    return F.struct("scene_id", _global("tile_row", at, side, 0), _global("tile_col", at, side, 1)).alias("node")


def labels(hot: DataFrame, side: int = SIDE) -> DataFrame:
    """(scene_id, row, col, blob) of the HOT pixels: ``blob`` is the first pixel (scene_id, row, col) of each 8-connected group over all tiles."""
    parts, border = _parts(hot, side)
    known = components(_met(border, ["scene_id"])).withColumnRenamed("node", "own")
    px = parts.select(*KEY, F.explode(F.arrays_zip("at", "label")).alias("p")).select("scene_id", _global("tile_row", "p.at", side, 0), _global("tile_col", "p.at", side, 1), _node(side, "p.label"))
    return px.join(known, F.col("node") == F.col("own"), "left").select("scene_id", "row", "col", F.coalesce("label", "node").alias("blob"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of whole points (x, y), counter-clockwise."""
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(pts) < 3:
        return np.array(pts, np.int64).reshape(-1, 2)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for seq in (pts, pts[::-1]):
        part: list = []
        for p in seq:
            while len(part) > 1 and turn(part[-2], part[-1], p) <= 0:
                part.pop()
            part.append(p)
        halves.append(part[:-1])
    return np.array(halves[0] + halves[1], np.int64)


def corners(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Hull of whole pixels, from the ends of each row."""
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    last = np.r_[first[1:], len(rows)] - 1
    ends = [(cols[first], rows[first]), (cols[last] + 1, rows[last])]
    return hull(np.concatenate([np.column_stack([x, y + d]) for x, y in ends for d in (0, 1)]))


def rectangle(points: np.ndarray) -> tuple[float, float, float, float]:
    """(length, width, dx, dy) of the smallest rectangle around whole points; dx, dy along its long side, dx >= 0.

    Of rectangles of one area the longest counts, then the one with the least |dy| and the greatest dy. Areas and
    lengths are ratios of whole numbers, so equal ones are equal.
    """
    h = hull(points)
    best = None
    for k in range(len(h)):
        ex, ey = (int(x) for x in h[(k + 1) % len(h)] - h[k])
        g = int(np.gcd(ex, ey))
        ex, ey = ex // max(g, 1), ey // max(g, 1)
        n = ex * ex + ey * ey
        along, across = int(np.ptp(h @ (ex, ey))), int(np.ptp(h @ (-ey, ex)))
        for long, wide, x, y in ((along, across, ex, ey), (across, along, -ey, ex)):
            if long >= wide:
                x, y = (-x, -y) if x < 0 or (x == 0 and y < 0) else (x, y)
                found = (along * across / n, -(long * long) / n, abs(y) / np.sqrt(n), -y, long / np.sqrt(n), wide / np.sqrt(n), x / np.sqrt(n), y / np.sqrt(n))
                best = found if best is None or found[:4] < best[:4] else best
    return best[4:]


MEASURED = "row double, col double, length_px double, width_px double, dx double, dy double, margin double, pixels long"


def measure(hot: DataFrame, config: Config = Config(), side: int = SIDE) -> DataFrame:
    """One row per blob of at least ``min_pixels`` HOT pixels: scene_id, centroid, size and axis after growing, margin of its peak, pixels.

    A blob grows to the 8-connected pixels above the lower threshold, k_grow / k of the block's, within
    ``grow_halfwidth_px`` of its box; if that has fewer pixels than the blob, the blob's own are measured. The
    margin is the largest value over the largest threshold in its box.
    """
    hot = written(hot.select(*KEY, "value", "state", "threshold"), "tested")
    parts, border = _parts(hot, side)
    known = components(_met(border, ["scene_id"])).select(F.col("node").alias("own"), F.col("label").alias("blob"))
    px = parts.select(*KEY, F.explode(F.arrays_zip("at", "label")).alias("p")).select(*KEY, F.col("p.label").alias("label"), _global("tile_row", "p.at", side, 0), _global("tile_col", "p.at", side, 1))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("row").alias("sr"), F.sum("col").alias("sc"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")]
    local = px.groupBy(*KEY, "label").agg(*sums).withColumn("node", _node(side, "label"))
    local = written(local.join(known, F.col("node") == F.col("own"), "left").withColumn("blob", F.coalesce("blob", "node")).drop("node", "own"), "local")
    total = [F.sum(c).alias(c) for c in ("n", "sr", "sc")] + [F.min(c).alias(c) for c in ("r0", "c0")] + [F.max(c).alias(c) for c in ("r1", "c1")]
    blobs = written(local.groupBy("blob").agg(*total).where(F.col("n") >= config.min_pixels), "blobs")

    pad = config.grow_halfwidth_px
    tiles_of = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - pad) / side), F.floor((F.col(b) + pad) / side)))
    id_ = [F.col("blob.row").alias("br"), F.col("blob.col").alias("bc")]
    touched = blobs.select(F.col("blob.scene_id").alias("scene_id"), *id_, "r0", "r1", "c0", "c1").withColumn("tile_row", tiles_of("r0", "r1")).withColumn("tile_col", tiles_of("c0", "c1"))
    windows = touched.groupBy(*KEY).agg(F.collect_list(F.struct("br", "bc", "r0", "r1", "c0", "c1")).alias("windows"))
    seeds = local.select(*KEY, *id_, "label").groupBy(*KEY).agg(F.collect_list(F.struct("br", "bc", "label")).alias("seeds"))
    # a tile at the image's edge may be missing
    work = hot.join(windows, KEY).join(seeds, KEY, "left").join(parts.select(*KEY, "at", "label"), KEY, "left")
    fields = "br long, bc long, kind int, row long, col long, seeded boolean, n long, hull array<long>, peak double, lim double, edge array<int>"
    schema = _schema(hot, fields)
    lower = config.k_grow / config.k

    def grow(scene, tr: int, tc: int, value: bytes, state: bytes, threshold: bytes, todo: list, owners: list | None, at: list | None, label: list | None) -> Iterator[tuple]:
        v, s = _grid(value, "f8", side), _grid(state, "u1", side)
        limit = _stretched(_grid(threshold, "f8", side // config.block), config.block)
        valid = (s & VALID) > 0
        above = valid & (v > limit * lower)
        mine: dict = {}
        for o in owners or ():
            mine.setdefault((o["br"], o["bc"]), []).append(o["label"])
        at, label = np.array(at or [], np.int64), np.array(label or [], np.int64)
        for w in todo:
            key, top, left = (w["br"], w["bc"]), tr * side, tc * side
            span = lambda a, b, o, p: slice(min(max(a - p - o, 0), side), max(min(b + p - o, side - 1), -1) + 1)
            box = span(w["r0"], w["r1"], top, 0), span(w["c0"], w["c1"], left, 0)
            inside = valid[box]
            if inside.any():
                yield scene, tr, tc, *key, 0, None, None, None, None, None, float(v[box][inside].max()), float(limit[box][inside].max()), None
            own = at[np.isin(label, mine.get(key, []))]
            if len(own):
                y, x = np.divmod(own, side)
                yield scene, tr, tc, *key, 1, None, None, None, len(own), (corners(y, x) + (left, top)).ravel().tolist(), None, None, None
            region = np.zeros_like(above)
            wide = span(w["r0"], w["r1"], top, pad), span(w["c0"], w["c1"], left, pad)
            region[wide] = above[wide]
            places, group = labelled(region)
            on_edge, is_seed = _edge(places, side), np.isin(places, own)
            for g in np.unique(group[on_edge | is_seed]):  # others can't belong to it
                all_of = group == g
                y, x = np.divmod(places[all_of], side)
                rim = places[all_of & on_edge]
                yield scene, tr, tc, *key, 2, int(g // side) + top, int(g % side) + left, bool(is_seed[all_of].any()), int(all_of.sum()), (corners(y, x) + (left, top)).ravel().tolist(), None, None, rim.tolist()

    made = written(each(work.select(*KEY, "value", "state", "threshold", "windows", "seeds", "at", "label"), grow, schema, 1024), "grown")
    of = ["scene_id", "br", "bc"]
    regions = made.where("kind = 2").withColumn("node", F.struct("row", "col"))
    node = F.struct(*of, "row", "col")
    rim = regions.select(*of, "tile_row", "tile_col", node.alias("node"), F.explode("edge").alias("at"))
    rim = rim.select(*of, _global("tile_row", "at", side, 0), _global("tile_col", "at", side, 1), "node")
    joined = components(_met(rim, of)).withColumnRenamed("node", "own")
    named = regions.withColumn("node", node).join(joined, F.col("node") == F.col("own"), "left").withColumn("label", F.coalesce("label", "node"))
    whole = named.groupBy(*of, "label").agg(F.bool_or("seeded").alias("seeded"), F.sum("n").alias("n"), F.flatten(F.collect_list("hull")).alias("hull")).where("seeded")
    whole = whole.groupBy(*of).agg(F.sum("n").alias("grown"), F.flatten(F.collect_list("hull")).alias("grown_hull"))
    own = made.where("kind < 2").groupBy(*of).agg(F.max("peak").alias("peak"), F.max("lim").alias("lim"), F.flatten(F.collect_list("hull")).alias("own_hull"))
    about = blobs.select(F.col("blob.scene_id").alias("scene_id"), *id_, "n", "sr", "sc").join(own, of).join(whole, of, "left")
    chosen = F.when(F.col("grown") >= F.col("n"), F.col("grown_hull")).otherwise(F.col("own_hull"))
    rows = about.select("scene_id", F.lit(0).cast("long").alias("tile_row"), F.lit(0).cast("long").alias("tile_col"), (F.col("sr") / F.col("n") + 0.5).alias("row"), (F.col("sc") / F.col("n") + 0.5).alias("col"), chosen.alias("hull"), (F.col("peak") / F.greatest("lim", F.lit(1e-12))).alias("margin"), "n")
    done = T.StructType([hot.schema["scene_id"], *T.StructType.fromDDL(MEASURED).fields])

    def size(scene, _r: int, _c: int, row: float, col: float, points: list, margin: float, n: int) -> Iterator[tuple]:
        yield scene, row, col, *(float(x) for x in rectangle(np.array(points, np.int64).reshape(-1, 2))), margin, n

    return each(rows, size, done, 1024)


def detect(tiles: DataFrame, nesz: float | None = None, config: Config = Config(), side: int = SIDE) -> DataFrame:
    """Measured blobs of a raster: mask, statistics of the water, thresholds, components, sizes."""
    tiles = written(tiles, "source")
    return measure(tested(tiles, land_mask(tiles, config, side), nesz, config, side), config, side)


def chips(tiles: DataFrame, centres: DataFrame, sizes: DataFrame, half: int = 40, decimate: int = 1, side: int = SIDE) -> DataFrame:
    """(id, y, x, db): decibels around each of ``centres`` (id, scene_id, row, col), one pixel of ``decimate`` in each direction.

    A chip reaches ``half`` pixels to each side and is cut at the image's edges (``sizes``: scene_id, height, width). Its pixels are
    those nearest to the middles of its cells; null where there is none or none that is valid. Only the tiles that chips touch
    are looked into, each for its own part of them.
    """
    edge = lambda c, size: (F.greatest(F.lit(0), F.col(c).cast("long") - half), F.least(F.col(size).cast("long"), F.col(c).cast("long") + half))
    (r0, r1), (c0, c1) = edge("row", "height"), edge("col", "width")
    boxes = centres.select("id", "scene_id", "row", "col").join(sizes, "scene_id").select("id", "scene_id", r0.alias("r0"), c0.alias("c0"), (r1 - r0).alias("h"), (c1 - c0).alias("w")).where("h > 0 AND w > 0")
    out = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / decimate))
    boxes = boxes.withColumns({"out_h": out("h"), "out_w": out("w")})
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(a) + F.col(n) - 1) / side)))
    touched = boxes.withColumn("tile_row", span("r0", "h")).withColumn("tile_col", span("c0", "w"))
    todo = touched.groupBy(*KEY).agg(F.collect_list(F.struct("id", "r0", "c0", "h", "w", "out_h", "out_w")).alias("todo"))
    schema = T.StructType([T.StructField("id", centres.schema["id"].dataType), *T.StructType.fromDDL("y long, x long, db double").fields])

    def look(scene, tr: int, tc: int, value: bytes, state: bytes, asked: list) -> Iterator[tuple]:
        v, ok = _grid(value, "f8", side), (_grid(state, "u1", side) & VALID) > 0
        for a in asked:
            rows = a["r0"] + ((np.arange(a["out_h"]) + 0.5) * a["h"] / a["out_h"]).astype(np.int64) - tr * side
            cols = a["c0"] + ((np.arange(a["out_w"]) + 0.5) * a["w"] / a["out_w"]).astype(np.int64) - tc * side
            ys, xs = np.flatnonzero((rows >= 0) & (rows < side)), np.flatnonzero((cols >= 0) & (cols < side))
            if len(ys) and len(xs):
                part = np.ix_(rows[ys], cols[xs])
                db, good = 10 * np.log10(np.maximum(v[part], 1e-9)), ok[part]
                for i, y in enumerate(ys.tolist()):
                    yield from ((a["id"], y, x, float(d)) for x, d, g in zip(xs.tolist(), db[i], good[i], strict=True) if g)

    seen = each(tiles.select(*KEY, "value", "state").join(todo, KEY), look, schema, 4096)
    grid = boxes.select("id", "out_w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_h") - 1)).alias("y")).select("id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_w") - 1)).alias("x"))
    return grid.join(seen, ["id", "y", "x"], "left")
