"""Grids and regions: cell arithmetic, attribute and polygon masks, filling a grid.

Cells count from 1, row by row from the top left. A cell lies in a polygon if its centre does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]


@dataclass(frozen=True)
class GridSpec:
    nrows: int
    ncols: int
    xmin: float
    xmax: float
    ymin: float
    ymax: float
    crs: str = "EPSG:4326"

    def __post_init__(self):
        if self.nrows < 1 or self.ncols < 1 or self.xmin >= self.xmax or self.ymin >= self.ymax:
            raise ValueError("a grid needs rows, columns and a positive extent")

    @property
    def size(self) -> int:
        return self.nrows * self.ncols

    def row(self, cell: Column) -> Column:
        return F.floor((cell - 1) / self.ncols).cast("long") + 1

    def col(self, cell: Column) -> Column:
        return (cell - 1) % self.ncols + 1

    def x(self, cell: Column) -> Column:
        return F.lit(self.xmin) + (self.col(cell) - F.lit(0.5)) * ((self.xmax - self.xmin) / self.ncols)

    def y(self, cell: Column) -> Column:
        return F.lit(self.ymax) - (self.row(cell) - F.lit(0.5)) * ((self.ymax - self.ymin) / self.nrows)

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.range(1, self.size + 1).withColumnRenamed("id", "cell")


def translate(cell: Column, source: GridSpec, target: GridSpec, row_offset: int, col_offset: int) -> Column:
    """The cell of `target` (whose first row and column lie at the offsets in `source`), NULL outside it."""
    row, col = source.row(cell) - row_offset, source.col(cell) - col_offset
    return F.when(row.between(1, target.nrows) & col.between(1, target.ncols), (row - 1) * target.ncols + col)


def polygon(rings: Sequence[Ring] | Ring) -> list[list[tuple[float, float]]]:
    """Rings of (x, y) vertices; inner rings are holes."""
    rings = [rings] if rings and isinstance(rings[0][0], (int, float)) else rings
    if not rings or any(len(set(map(tuple, r))) < 3 for r in rings):
        raise TypeError("a region is one or more rings of at least three (x, y) vertices")
    return [[(float(x), float(y)) for x, y in r] for r in rings]


def contains(rings, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the rings' edges an odd number of times."""
    odd = F.lit(False)
    for ring in polygon(rings):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                cross = ((y < y1) != (y < y2)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))
                odd = odd != cross
    return odd


def mask_polygon(df: DataFrame, grid: GridSpec, rings, *, crs: str | None = None, cell: str = "cell") -> DataFrame:
    """The cells inside a polygon. The box around it becomes a range of rows, hence of cell ids, which reaches the scan."""
    if crs is not None and crs != grid.crs:
        raise ValueError(f"the region is in {crs}, the grid in {grid.crs}; reproject it first")
    flat = [v for r in polygon(rings) for v in r]
    x0, x1, y0, y1 = min(x for x, _ in flat), max(x for x, _ in flat), min(y for _, y in flat), max(y for _, y in flat)
    if x1 < grid.xmin or x0 > grid.xmax or y1 < grid.ymin or y0 > grid.ymax:
        raise ValueError("The region does not overlap with the input rasters")
    height = (grid.ymax - grid.ymin) / grid.nrows
    first = max(1, int((grid.ymax - y1) / height))
    last = min(grid.nrows, int((grid.ymax - y0) / height) + 2)
    c = F.col(cell)
    inside = c.between((first - 1) * grid.ncols + 1, last * grid.ncols)
    return df.where(inside).where(grid.x(c).between(x0, x1) & grid.y(c).between(y0, y1) & contains(rings, grid.x(c), grid.y(c)))


def mask_cells(df: DataFrame, region: DataFrame, *, cell: str = "cell") -> DataFrame:
    """The rows whose cell the region holds."""
    return df.join(region.select(cell).distinct(), cell, "left_semi")


def drop_missing(df: DataFrame, reference: str) -> DataFrame:
    """The cells that have a value in the reference column (a layer)."""
    c = F.col(reference)
    return df.where(c.isNotNull() & ~F.isnan(c))


def fill_grid(df: DataFrame, grid: GridSpec, *, cell: str = "cell") -> DataFrame:
    """A row for every cell of the grid, NULL where there is no result."""
    return grid.cells(df.sparkSession).withColumnRenamed("cell", cell).join(df, cell, "left")
