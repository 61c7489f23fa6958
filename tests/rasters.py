import numpy as np
from pyspark.sql import functions as F

from rastrum import Axis, Raster


def raster(spark, array, first=None, kind="double"):
    """One image from a numpy array; ``first``: the first index of each axis."""
    array = np.asarray(array)
    first = first or (0,) * array.ndim
    names = [f"i{k}" for k in range(array.ndim)]
    cast = int if kind in ("int", "long", "short") else str if kind == "string" else float
    rows = [(1, *[int(a + f) for a, f in zip(at, first)], cast(x)) for at, x in np.ndenumerate(array)]
    df = spark.createDataFrame(rows, "image long, " + ", ".join(f"{n} int" for n in names) + f", v {kind}")
    return Raster(df, ("image",), tuple(Axis(n, f, f + s - 1) for n, f, s in zip(names, first, array.shape)))


def array(r, column=None):
    rows = r.df.select(*r.names, F.col(column or r.value).alias("x")).toPandas()
    out = np.full(r.shape, None, object)
    for row in rows.itertuples(index=False):
        out[tuple(int(x) - a.first for x, a in zip(row[:-1], r.axes))] = row[-1]
    assert len(rows) == out.size
    return out.astype(float) if not isinstance(out.flat[0], str) else out
