"""Joins on keys of which one may hold a large part of all rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.session import materialise

#: Rows of a key on one side that one cell of its grid holds, on average.
CHUNK = 2000
#: Hot keys that are sent to every task; more are joined as the engine chooses.
SENT = 50_000


#: One in so many ids is counted to see which keys are hot. A misjudged key costs time, never a row.
COUNTED = 16


def hot_keys(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, chunk: int = CHUNK) -> DataFrame:
    """(key, _m, _n): keys of more than one cell, with the lines and columns of their grids.

    Rows are counted for one in `COUNTED` ids, by hash, and multiplied.
    """

    def parts(rows: DataFrame, by: str, name: str) -> DataFrame:
        some = rows.where(F.col(on).isNotNull() & (F.pmod(F.xxhash64(by), F.lit(COUNTED)) == 0))
        return some.groupBy(on).agg(F.ceil(F.count("*") * COUNTED / chunk).cast("int").alias(name)).where(F.col(name) > 1)

    return parts(left, left_id, "_m").join(parts(right, right_id, "_n"), on, "full").na.fill(1, ["_m", "_n"])


def grid_join(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, chunk: int = CHUNK, cells: DataFrame | None = None) -> DataFrame:
    """Inner equi-join whose hot keys are spread over a grid of cells.

    A key with m rows on the left and n on the right is parted in m/chunk by n/chunk cells by hashes
    of the ids; each row is copied to the cells of its line or column, so no task gets more than
    about chunk * chunk pairs of a key, and no pair is lost or doubled. Keys with fewer rows have one
    cell, and then nothing is copied. Columns other than `on` must differ between the sides. `cells`:
    hot keys found before, where sides of which these are parts are joined.
    """
    # At most rows / chunk keys, and most often none.
    cells = materialise(hot_keys(left, right, on, left_id, right_id, chunk)) if cells is None else cells
    n_cells = cells.count()
    if n_cells == 0:
        return left.join(right, on)
    if n_cells <= SENT:  # else both sides may be shuffled by the key, and then once more by the cell
        cells = F.broadcast(cells)
    place = lambda x, n: F.when(F.col(n) > 1, F.pmod(F.xxhash64(x), F.col(n)).cast("int")).otherwise(0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = left.join(cells, on, "left").withColumn("_i", place(left_id, "_m")).withColumn("_j", every("_n")).drop("_m", "_n")
    b = right.join(cells, on, "left").withColumn("_j", place(right_id, "_n")).withColumn("_i", every("_m")).drop("_m", "_n")
    return a.join(b, [on, "_i", "_j"]).drop("_i", "_j")
