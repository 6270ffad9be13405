"""Head motion: displacement between frames, summaries by session, and the table of visits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from .quantiles import few, quantiles

#: Radius in millimetres on which rotations are measured (fixed value of Power's definition).
RADIUS = 50.0
#: Voxels of a session that meet its frames in one task.
SPREAD = 4096
PARAMS = ("p1", "p2", "p3", "p4", "p5", "p6")  # three translations, three rotations


def framewise_displacement(motion: DataFrame, radius: float = RADIUS) -> DataFrame:
    """``session_id, t, fd``: sum of absolute changes of the parameters, rotations as arcs on a sphere of ``radius``.

    The first frame of a session has none.  One window over the session's order; nothing else is shuffled.
    """
    order = Window.partitionBy("session_id").orderBy("t")
    change = [F.abs(F.col(p) - F.lag(p).over(order)) for p in PARAMS]
    fd = change[0] + change[1] + change[2] + F.lit(float(radius)) * (change[3] + change[4] + change[5])
    return motion.select("session_id", "t", fd.alias("fd")).where(F.col("fd").isNotNull())


def fd_summary(fd: DataFrame) -> DataFrame:
    """Mean displacement and number of frames (one more than displacements) by session."""
    return fd.groupBy("session_id").agg(F.avg("fd").alias("mean_fd"), (F.count("*") + 1).cast("long").alias("length"))


def _rotation(a: Column, b: Column, g: Column) -> list[list[Column]]:
    sa, ca, sb, cb, sg, cg = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(g), F.cos(g)
    return [
        [cg * cb, cg * sb * sa - sg * ca, cg * sb * ca + sg * sa],
        [sg * cb, sg * sb * sa + cg * ca, sg * sb * ca - cg * sa],
        [-sb, cb * sa, cb * ca],
    ]


def voxel_displacement(voxels: DataFrame, motion: DataFrame, affine: Sequence[float]) -> DataFrame:
    """``session_id, i, j, k, t, fd``: how far each voxel moves between frames; the first frame has 0.

    ``affine``: 16 numbers by rows, from voxel indices to millimetres.  A frame's inverse transform is the transposed
    rotation of (point - translation).  The previous frame's parameters are put beside each frame's before the join, so
    there is a window over frames only, not over voxels times frames; voxels meet frames of their own session.  Where a
    session has more than SPREAD voxels (they are counted first), its frames are copied for each SPREAD of them, so that
    it is not one task.  Frames, which lie by session, meet at most SPREAD voxels at a time; the voxels of all sessions are
    not broadcast, though their table may look small enough for it.
    """
    order = Window.partitionBy("session_id").orderBy("t")
    frames = motion.select("session_id", "t", *[F.col(p).alias(f"n{i}") for i, p in enumerate(PARAMS)], *[F.lag(p).over(order).alias(f"o{i}") for i, p in enumerate(PARAMS)])
    m = [float(x) for x in affine]
    points = voxels.select("session_id", "i", "j", "k", *[(F.col("i") * m[4 * r] + F.col("j") * m[4 * r + 1] + F.col("k") * m[4 * r + 2] + m[4 * r + 3]).alias(f"c{r}") for r in range(3)])
    # rotations by frame, before voxels multiply the rows
    turned = frames.select(
        "session_id", "t", *[f"{w}{i}" for w in "no" for i in range(3)],
        *[_rotation(*[F.col(f"{w}{i}") for i in (3, 4, 5)])[r][c].alias(f"{w}r{r}{c}") for w in "no" for r in range(3) for c in range(3)],
    )

    def place(w: str, axis: int) -> Column:
        terms = [F.col(f"{w}r{r}{axis}") * (F.col(f"c{r}") - F.col(f"{w}{r}")) for r in range(3)]
        return terms[0] + terms[1] + terms[2]

    salts = voxels.groupBy("session_id").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("_salts"))
    if (salts.agg(F.max("_salts")).first()[0] or 0) > 1:
        points = points.join(salts, "session_id").withColumn("_salt", F.expr("cast(pmod(hash(i, j, k), _salts) as int)"))
        turned = turned.join(salts, "session_id").withColumn("_salt", F.explode(F.expr("sequence(0, _salts - 1)")))
        met = turned.drop("_salts").join(points.drop("_salts").hint("merge"), ["session_id", "_salt"])
    else:
        met = turned.join(points.hint("merge"), "session_id")
    squares = [F.pow(place("n", a) - place("o", a), F.lit(2.0)) for a in range(3)]
    return met.select("session_id", "i", "j", "k", "t", F.coalesce(F.sqrt(squares[0] + squares[1] + squares[2]), F.lit(0.0)).alias("fd"))


def region_mean(values: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Mean over voxels by session and frame, over voxels with ``mask > 0`` if there is one."""
    if mask is not None:
        values = values.join(mask.where("mask > 0").select("i", "j", "k"), ["i", "j", "k"], "left_semi")
    return values.groupBy("session_id", "t").agg(F.avg("fd").alias("mean_fd"))


def region_means(values: DataFrame, mask: DataFrame) -> DataFrame:
    """Means over all voxels (``whole``) and over those with ``mask > 0`` (``region``) in one pass over the values."""
    met = values.join(mask.select("i", "j", "k", "mask"), ["i", "j", "k"], "left")
    return met.groupBy("session_id", "t").agg(F.avg("fd").alias("whole"), F.avg(F.when(F.col("mask") > 0, F.col("fd"))).alias("region"))


def brain_mask(volume: DataFrame) -> DataFrame:
    """Voxels whose mean over time is over 0."""
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + x)
    return volume.where(total / F.size("y") > 0).select("session_id", "i", "j", "k")


def check_lengths(motion: DataFrame, volume: DataFrame) -> DataFrame:
    """``motion`` with a check that each session has as many rows as its volume has frames; fails when evaluated."""
    frames = volume.groupBy("session_id").agg(F.max(F.size("y")).alias("frames"))
    rows = motion.groupBy("session_id").agg(F.count("*").alias("rows"))
    checked = rows.join(frames, "session_id").select(
        "session_id", F.when(F.col("rows") == F.col("frames"), True).otherwise(F.raise_error(F.lit("motion rows and frames differ")).cast("boolean")).alias("ok")
    )
    return motion.join(checked.where("ok"), "session_id", "left_semi")


def pivot_unique(df: DataFrame, key: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Long to wide; fails when evaluated if a key has two rows for a column (rather than taking either)."""
    once = F.when(F.count(value) > 1, F.raise_error(F.lit("duplicate key in pivot"))).otherwise(F.first(value, ignorenulls=True))
    return df.groupBy(key).pivot(column, list(values)).agg(once)


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def visit_grid(subjects: DataFrame, visits: Sequence, attributes: DataFrame, key: str = "id") -> DataFrame:
    """Every subject with every visit, and the attributes where there are any (null elsewhere)."""
    grid = subjects.select(key).distinct().withColumn("visit", F.explode(F.array(*[F.lit(v) for v in visits])))
    return grid.join(attributes, [key, "visit"], "left")


def pick_series(df: DataFrame, column: str, variants: Mapping[str, Sequence[str]], run: str) -> DataFrame:
    """``series_name``: the first name listed in ``column`` that holds a variant of ``run`` (null if none, or no such run)."""
    wanted = list(variants.get(run, []))
    name = keys.first_match(keys.words(column), wanted) if wanted else F.lit(None).cast("string")
    return df.withColumn("series_name", name)


def outliers(table: DataFrame, first: str, second: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Rows with both visits, their mean ``agg``, and ``is_out``: over the interpolated ``level`` quantile of all means, or of
    those of the row's group of ``by``.
    """
    both = table.dropna(subset=[first, second]).withColumn("agg", (F.col(first) + F.col(second)) / 2)
    limit = quantiles(both, by, "agg", [float(level)]).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("q")[0].alias("_limit"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    met = both.join(few(limit), same) if by else both.crossJoin(F.broadcast(limit))  # one row
    return met.withColumn("is_out", F.col("agg") > F.col("_limit")).drop("_limit", *[f"_by{i}" for i in range(len(by))])


def without(df: DataFrame, part: str) -> DataFrame:
    """Without the columns whose names hold ``part``."""
    return df.drop(*[c for c in df.columns if part in c])


def histogram(df: DataFrame, column: str, width: float, right_closed: bool = False) -> DataFrame:
    """Counts in bins of fixed width, ``[a, b)`` or ``(a, b]``: ``bin`` is the number of its left edge."""
    x = F.col(column) / F.lit(float(width))
    at = F.ceil(x) - 1 if right_closed else F.floor(x)
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
