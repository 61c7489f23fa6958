"""A raster: a dense array per key, held as a pixel table (one row per pixel) or as array rows.

Pixel table: key columns, one integer column per axis (true indices, which need not start at 0), one value
column. Array rows: key columns and ``data`` (row-major). The keys decide where an image lives: an
image-wise shuffle on them is shared by all later stages of an operator. One image that is too large for a task
has no key: stencils then spread by pixel, and windows by line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Axis:
    """Indices first..last of one dimension. ``last`` may be a SQL expression where lengths differ by key."""

    name: str
    first: int
    last: int | str

    @property
    def ragged(self) -> bool:
        return isinstance(self.last, str)

    def last_column(self) -> Column:
        return F.expr(self.last) if self.ragged else F.lit(self.last)

    def __len__(self) -> int:
        if self.ragged:
            raise ValueError(f"axis {self.name} has no common length")
        return self.last - self.first + 1

    def grown(self, low: int, high: int) -> Axis:
        """The axis with ``low`` more indices before and ``high`` after (negative: fewer)."""
        last = f"({self.last}) + ({high})" if self.ragged else self.last + high
        return replace(self, first=self.first - low, last=last)

    def contains(self, at: Column) -> Column:
        return at.between(F.lit(self.first), self.last_column())


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    keys: tuple[str, ...]
    axes: tuple[Axis, ...]
    value: str = "v"
    carried: tuple[str, ...] = ()
    rows: DataFrame | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.axes)

    @property
    def group(self) -> list[str]:
        return [*self.keys, *self.carried]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(a) for a in self.axes)

    def with_df(self, df: DataFrame, axes: Iterable[Axis] | None = None, value: str | None = None) -> Raster:
        return replace(self, df=df, axes=tuple(axes or self.axes), value=value or self.value, rows=None)

    @staticmethod
    def from_array_column(df: DataFrame, key: str, column: str, shape: tuple[int, ...], names: tuple[str, ...] | None = None, value: Column | None = None) -> Raster:
        """One image per row, from a row-major array column. Rows are dealt by key before they are
        exploded, so the only data that move are the arrays themselves. ``value`` may rework F.col("v")."""
        names = names or tuple("ijkl"[: len(shape)]) if len(shape) <= 4 else names
        rows = df.select(key, F.transform(F.col(column), lambda x: x.cast("double")).alias("data"))
        pixels = rows.repartition(key).select(key, F.posexplode("data").alias("__at", "v"))
        for k, name in enumerate(names):
            below = int(np.prod(shape[k + 1 :]))
            pixels = pixels.withColumn(name, (F.floor(F.col("__at") / below) % shape[k]).cast("int"))
        pixels = pixels.select(key, *names, (F.col("v") if value is None else value).alias("v"))
        axes = tuple(Axis(n, 0, s - 1) for n, s in zip(names, shape))
        return Raster(pixels, (key,), axes, rows=rows if value is None else None)

    @staticmethod
    def from_sequences(df: DataFrame, key: str, order: list[str], value: str) -> Raster:
        """One signal per key, as long as it has rows; index 0.. in the given order."""
        from pyspark.sql import Window

        w = Window.partitionBy(key)
        numbered = df.select(
            key,
            (F.row_number().over(w.orderBy(*order)) - 1).cast("int").alias("i"),
            F.col(value).cast("double").alias("v"),
            (F.count("*").over(w) - 1).cast("int").alias("__last"),
        )
        return Raster(numbered, (key,), (Axis("i", 0, "__last"),), carried=("__last",))

    @staticmethod
    def from_counts(df: DataFrame, keys: tuple[str, ...], axes: tuple[Axis, ...], value: Column) -> Raster:
        """A dense raster from an aggregation: cells without rows are 0. ``value`` is an aggregate. Rows without an
        index belong to no cell; a row outside the axes is an error."""
        names = [a.name for a in axes]
        df = df.dropna(subset=names)
        for a in axes:
            df = df.withColumn(a.name, F.when(a.contains(F.col(a.name)), F.col(a.name)).otherwise(F.raise_error(F.lit(f"a row lies outside axis {a.name}"))))
        cells = df.groupBy(*keys, *names).agg(value.alias("v"))
        return Raster(cells, keys, axes).filled(0)

    def filled(self, value: float | int | str | None) -> Raster:
        """The raster with a row for every pixel: ``value`` where there was none. Images without a key have their lines made by many tasks."""
        cells = self.df.withColumnRenamed(self.value, "__v").withColumn("__there", F.lit(True))
        first = self.axes[0]
        if self.group or first.ragged:
            grid = self.df.select(*self.group).distinct() if self.group else self.df.sparkSession.range(1).select()
            lines, left = grid, self.axes
        else:
            lines, left = self.df.sparkSession.range(first.first, first.last + 1).select(F.col("id").cast("int").alias(first.name)), self.axes[1:]
        for a in left:
            lines = lines.withColumn(a.name, F.explode(F.sequence(F.lit(a.first), a.last_column().cast("int")))).where(a.contains(F.col(a.name)))
        on = [*self.group, *self.names]
        kind = self.df.schema[self.value].dataType
        dense = lines.join(cells, on, "left").select(*on, F.when(F.col("__there"), F.col("__v")).otherwise(F.lit(value).cast(kind)).alias(self.value))
        return self.with_df(dense)

    def pixels(self) -> DataFrame:
        return self.df.select(*self.keys, *self.names, self.value)

    def array_rows(self) -> DataFrame:
        """(keys.., data): each image in one row, row-major; pixel tables are gathered by key."""
        if self.rows is not None:
            return self.rows
        pixel = F.struct(*self.names, self.value)
        data = F.transform(F.array_sort(F.collect_list(pixel)), lambda p: p[self.value].cast("double"))
        return self.df.groupBy(*self.keys).agg(data.alias("data"))

    def map_images(self, function: Callable[[np.ndarray], np.ndarray], axes: tuple[Axis, ...] | None = None) -> Raster:
        """``function`` on whole images as numpy arrays, in Arrow batches; its result has ``axes``.

        An image is one row here, so this is for images that fit a task. A row without an array has no image, and none
        comes out; a null pixel is NaN; an array of another length is an error.
        """
        shape, size, axes = self.shape, int(np.prod(self.shape)), axes or self.axes
        out_shape = tuple(len(a) for a in axes)
        rows = self.array_rows()
        schema = to_arrow_schema(rows.schema)
        place = rows.columns.index("data")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(place).is_valid())
                sizes = batch.column(place).value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != size).any():
                    raise ValueError(f"the raster doesn't have one row for each of its pixels: {size} are needed, an image has {sizes[sizes != size][0]}")
                images = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)
                made = np.stack([np.asarray(function(x), float).reshape(out_shape) for x in images]) if len(images) else np.zeros((0, *out_shape))
                flat = pa.array(made.reshape(-1))
                step = int(np.prod(out_shape))
                data = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, step), pa.int32()), flat)
                columns = [data.cast(schema.field(k).type) if k == place else batch.column(k) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        made = rows.mapInArrow(run, rows.schema)
        df = made.select(*self.keys, F.posexplode("data").alias("__at", "v"))
        for k, a in enumerate(axes):
            below = int(np.prod(out_shape[k + 1 :]))
            df = df.withColumn(a.name, (F.floor(F.col("__at") / below) % out_shape[k] + a.first).cast("int"))
        return Raster(df.drop("__at"), self.keys, tuple(axes), rows=made if all(a.first == 0 for a in axes) else None)

    def region(self, **bounds: tuple[int, int]) -> Raster:
        """The pixels whose named indices lie in the given closed ranges, with their true indices."""
        axes, df = [], self.df
        for a in self.axes:
            if a.name in bounds:
                low, high = bounds[a.name]
                if low < a.first or (not a.ragged and high > a.last):
                    raise ValueError(f"{a.name}: {low}..{high} is outside {a.first}..{a.last}")
                df = df.where(F.col(a.name).between(low, high))
                a = replace(a, first=low, last=high)
            axes.append(a)
        return self.with_df(df, axes)
