"""Nearest places and linked cells without a row for each pair: whoever can meet comes to one cell, whose places go into a tree.

Cells are wide against the reach, and of two sides only one, with the places at the borders, is sent to more than one cell.
A task holds one cell's distinct places of the sent side, and of the other one a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geo, near

#: Rows that are looked up or linked in one go.
_BATCH = 50_000


def placed(lon: str, lat: str) -> Column:
    """Whether both are numbers."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known(lon) & known(lat)


def numbered(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the number of each row's group; groups are runs of equal values in the first ``by`` columns, a null equals none."""
    last, group = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(by):
            c = batch.column(k)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        head = [batch.column(k)[0].as_py() for k in range(by)]
        new[0] = last is not None and head != last
        last = [batch.column(k)[-1].as_py() for k in range(by)]
        number = group + np.cumsum(new)
        group = int(number[-1])
        yield batch, number


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each run of equal rows, and the run of each row."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new), np.cumsum(new) - 1


class _Sought:
    """The places of the groups at hand, and the answers to what is asked of them."""

    def __init__(self, reach_m: float):
        self.reach_m, self.held, self.more, self.tree, self.base = reach_m, (np.empty(0), np.empty(0), np.empty(0, int)), [], None, None

    def add(self, lon: np.ndarray, lat: np.ndarray, group: np.ndarray) -> None:
        self.more.append((lon, lat, group))

    def nearest(self, lon: np.ndarray, lat: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Metres to the nearest place of the group, nan beyond the reach. Rows of one place that follow each other are looked up once."""
        if self.more:
            held = tuple(np.concatenate(x) for x in zip(self.held, *self.more, strict=True))
            first, _ = runs(*held)
            self.held, self.more, self.tree = tuple(h[first] for h in held), [], None
        out = np.full(len(lon), np.nan)
        if not len(lon) or not len(self.held[0]):
            return out
        if self.tree is None or self.base != group[0]:
            self.base = group[0]
            self.tree = near.Tree(*self.held[:2], self.held[2] - self.base)
        first, run = runs(lon, lat, group)
        x, y = lon[first], lat[first]
        at = near.nearest(near.Tree(x, y, group[first] - self.base), self.tree, self.reach_m)
        away = near.metres(x, y, self.held[0][at], self.held[1][at])
        away[(at < 0) | ~(away <= self.reach_m)] = np.nan
        return away[run]

    def forget(self, group: int) -> None:
        """Places of other groups go."""
        self.more = [m for m in self.more if m[2][-1] == group]
        kept = self.held[2] == group
        if not kept.all():
            self.held, self.tree = tuple(h[kept] for h in self.held), None


def nearest_places(left: DataFrame, right: DataFrame, reach_m: float, keys: list[str]) -> DataFrame:
    """Rows of ``left`` (keys, lon, lat, others) with ``nearest_m``, metres to the nearest of ``right`` (keys, t_lon, t_lat) of equal keys; null where none is within the reach."""
    side = 4 * reach_m
    own = [*keys, "_row", "_col"]
    there = right.where(placed("t_lon", "t_lat"))
    for k in keys:
        there = there.where(F.col(k).isNotNull())
    cells = there.select(*keys, geo.cells_touching(F.col("t_lon"), F.col("t_lat"), reach_m, side).alias("_cells"), F.col("t_lon").cast("double").alias("_x"), F.col("t_lat").cast("double").alias("_y"))
    b = cells.select(*keys, F.explode_outer("_cells").alias("_cell"), "_x", "_y").select(*keys, F.col("_cell.row").alias("_row"), F.col("_cell.col").alias("_col"), F.lit(False).alias("_asks"), "_x", "_y", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    # what has no position is spread over cells that nobody has
    nowhere = F.struct(F.lit(-1).alias("row"), F.pmod(F.xxhash64(*left.columns), F.lit(1000)).cast("int").alias("col"))
    at = F.when(placed("lon", "lat"), geo.cell(F.col("lon").cast("double"), F.col("lat").cast("double"), side)).otherwise(nowhere)
    a = left.withColumns({"_cell": at, "_left": F.struct(*left.columns)}).select(*keys, F.col("_cell.row").alias("_row"), F.col("_cell.col").alias("_col"), F.lit(True), F.col("lon").cast("double"), F.col("lat").cast("double"), "_left")
    dealt = b.union(a).repartition(*own).sortWithinPartitions(*own, "_asks", "_x", "_y")
    schema = T.StructType([T.StructField("_left", dealt.schema["_left"].dataType), T.StructField("nearest_m", T.DoubleType())])
    width = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, waiting, count = _Sought(reach_m), [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            group = np.concatenate([g for _, g in waiting])
            column = lambda k: np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r, _ in waiting])
            found = np.full(len(group), np.nan)
            here = column(width - 2) >= 0
            found[here] = sought.nearest(*(column(width + k)[here] for k in (1, 2)), group[here])
            done = 0
            for rows, _ in waiting:
                metres = found[done : done + rows.num_rows]
                done += rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column(width + 3), pa.array(metres, mask=np.isnan(metres))], names=schema.names)

        for batch, number in numbered(batches, width):
            asks = batch.column(width).to_numpy(zero_copy_only=False)
            if not asks.all():
                sought.add(*(batch.column(width + k).to_numpy(zero_copy_only=False)[~asks] for k in (1, 2)), number[~asks])
            if asks.any():
                waiting.append((batch.filter(pa.array(asks)), number[asks]))
                count += int(asks.sum())
            if count >= _BATCH:
                yield from answers()
                waiting, count = [], 0
                sought.forget(number[-1])
            elif not waiting:
                sought.forget(number[-1])
        yield from answers()

    return dealt.mapInArrow(run, schema).select("_left.*", "nearest_m")


def linked_cells(places: DataFrame, reach_m: float, key: str) -> DataFrame:
    """Edges (a, b) between tight cells (key, row, col) that join those cells whose places (key, lon, lat) are linked within the reach.

    Any two places of a tight cell are within the reach. A cell is joined to the least one of its set, so that there are fewer edges than tight cells.
    """
    side = 8 * reach_m
    at = places.where(placed("lon", "lat") & F.col(key).isNotNull())
    tight = geo.tight_cell(F.col("lon"), F.col("lat"), reach_m)
    rows = at.select(key, geo.cells_touching(F.col("lon"), F.col("lat"), reach_m, side).alias("_cells"), tight.alias("_tight"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    own = [key, "_row", "_col"]
    rows = rows.select(key, F.explode_outer("_cells").alias("_cell"), "_tight", "lon", "lat").select(key, F.col("_cell.row").alias("_row"), F.col("_cell.col").alias("_col"), F.col("_tight.row").alias("t_row"), F.col("_tight.col").alias("t_col"), "lon", "lat")
    dealt = rows.repartition(*own).sortWithinPartitions(*own)
    ends = ["a_row", "a_col", "b_row", "b_col"]
    schema = T.StructType([rows.schema[key], *(T.StructField(c, T.LongType()) for c in ends)])
    kinds = to_arrow_schema(schema).types

    def join(parts: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([r for r, _ in parts])
        group = np.concatenate([g for _, g in parts])
        cells = np.stack([group, *(table.column(c).to_numpy() for c in ("t_row", "t_col"))], 1)
        order = np.lexsort(cells.T[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (cells[order[1:]] != cells[order[:-1]]).any(1)
        label = np.empty(len(order), int)
        label[order] = np.cumsum(new) - 1
        first = order[new]
        parent = near.linked(near.Tree(table.column("lon").to_numpy(), table.column("lat").to_numpy(), group - group[0]), label, len(first), reach_m)
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        a, b = first[moved], first[parent[moved]]
        columns = [table.column(0).take(pa.array(a)).combine_chunks(), *(pa.array(cells[x, k]) for x in (a, b) for k in (1, 2))]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch, number in numbered(batches, len(own)):
            # whole groups are linked; the last may go on
            ends_at = int(np.searchsorted(number, number[-1]))
            done = parts and parts[-1][1][-1] != number[-1]
            if count + ends_at >= _BATCH and (done or ends_at):
                if ends_at:
                    parts.append((batch.slice(0, ends_at), number[:ends_at]))
                yield join(parts)
                parts, count, batch, number = [], 0, batch.slice(ends_at), number[ends_at:]
            parts.append((batch, number))
            count += batch.num_rows
        if parts:
            yield join(parts)

    cell = lambda e: F.struct(F.col(key), F.struct(F.col(f"{e}_row").alias("row"), F.col(f"{e}_col").alias("col")).alias("cell"))
    return dealt.mapInArrow(run, schema).select(cell("a").alias("a"), cell("b").alias("b")).distinct()
