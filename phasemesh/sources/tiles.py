"""A matrix stored as tiles: Parquet folders by block of rows and block of columns, of which any window is read or replaced.

A row of a tile is ``row, session_id, t, re[], im[]`` with the columns of its block.  Reading a window opens the folders of
the tiles it touches and no others, and so does a solver for the blocks of rows of a mini-batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..scratch import Scratch

#: Rows and columns of a tile: 32 MB of complex numbers.
ROWS, COLUMNS = 512, 4096


@dataclass(frozen=True)
class Tiles:
    """An open matrix of ``n`` rows and ``p`` columns below ``path``."""

    spark: SparkSession
    path: str
    n: int
    p: int
    rows: int
    columns: int
    schema: str

    @property
    def row_blocks(self) -> int:
        return -(-self.n // self.rows)

    @property
    def column_blocks(self) -> int:
        return -(-self.p // self.columns)

    def tiles(self) -> DataFrame:
        """All tiles' rows with ``row_block, column_block``."""
        return self.spark.read.schema(f"row long, {self.schema}, re array<double>, im array<double>, row_block int, column_block int").parquet(f"{self.path}/tiles")

    def window(self, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
        """``row, session_id, t, re[], im[]`` of rows and columns from the first to before the second number; what lies
        outside the matrix is left out.  Tiles beside each other are joined by row; a window within one block of columns
        moves nothing.
        """
        (r0, r1), (c0, c1) = ((max(0, a), min(b, most)) for (a, b), most in ((rows, self.n), (columns, self.p)))
        if r0 >= r1 or c0 >= c1:
            return self.tiles().where("false").select("row", "session_id", "t", "re", "im")
        b0, b1 = c0 // self.columns, (c1 - 1) // self.columns
        found = self.tiles().where(F.col("row_block").between(r0 // self.rows, (r1 - 1) // self.rows) & F.col("column_block").between(b0, b1))
        found = self._glued(found.where(F.col("row").between(r0, r1 - 1)), b1 > b0)
        if c0 % self.columns == 0 and c1 == min((b1 + 1) * self.columns, self.p):
            return found
        return found.select("row", "session_id", "t", *[F.slice(c, c0 - b0 * self.columns + 1, c1 - c0).alias(c) for c in ("re", "im")])

    def _glued(self, found: DataFrame, several: bool) -> DataFrame:
        if not several:
            return found.select("row", "session_id", "t", "re", "im")
        listed = F.array_sort(F.collect_list(F.struct("column_block", "re", "im")))
        joined = found.groupBy("row").agg(F.first("session_id").alias("session_id"), F.first("t").alias("t"), listed.alias("l"))
        return joined.select("row", "session_id", "t", F.flatten("l.re").alias("re"), F.flatten("l.im").alias("im"))

    def matrix(self) -> DataFrame:
        """All rows."""
        return self.window((0, self.n), (0, self.p))

    def blocks(self, chosen: Sequence[int]) -> DataFrame:
        """The rows of some blocks of rows, read from their folders alone."""
        found = self.tiles().where(F.col("row_block").isin([int(b) for b in chosen]))
        return self._glued(found, self.column_blocks > 1)

    def replace(self, row: int, column: int, values: DataFrame) -> None:
        """Replace cells by ``values(row, re[], im[])``: rows counted from ``row``, arrays from ``column`` on.

        The tiles touched are written anew (to the shared folder first), others are left alone; doing it again changes
        nothing more.  Rows or columns outside the matrix, repeated rows and arrays of unequal lengths raise.
        """
        with Scratch(self.spark, "tiles") as tmp:
            new = tmp.save(values.select((F.col("row") + row).alias("row"), "re", "im"), "values")
            said = new.agg(F.min("row"), F.max("row"), F.count("*"), F.count_distinct("row"), F.min(F.size("re")), F.max(F.size("re")), F.min(F.size("im")), F.max(F.size("im"))).first()
            if not said[2]:
                return
            width = said[4]
            if len(set(said[4:])) > 1 or said[2] != said[3]:
                raise ValueError("values have one array length, and each row once")
            if said[0] < 0 or said[1] >= self.n or column < 0 or width < 1 or column + width > self.p:
                raise ValueError(f"values lie outside a matrix of {self.n} x {self.p}")
            new = new.withColumn("row_block", F.floor(F.col("row") / self.rows).cast("int"))
            touched = [r[0] for r in new.select("row_block").distinct().collect()]
            first, last = column // self.columns, (column + width - 1) // self.columns
            old = self.tiles().where(F.col("row_block").isin(touched) & F.col("column_block").between(first, last))
            met = old.join(new.select("row", F.col("re").alias("_re"), F.col("im").alias("_im")), "row", "left")
            # the part of the new array that lies in this tile
            left = F.col("column_block") * self.columns
            begin = F.greatest(F.lit(column) - left, F.lit(0))
            end = F.least(F.lit(column + width) - left, F.size("re"))

            def put(c: str):
                given = F.slice(f"_{c}", (left + begin - column + 1).cast("int"), (end - begin).cast("int"))
                whole = F.concat(F.slice(c, F.lit(1), begin.cast("int")), given, F.slice(c, (end + 1).cast("int"), (F.size(c) - end).cast("int")))
                return F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(whole).alias(c)

            done = tmp.save(met.select("row", "session_id", "t", put("re"), put("im"), "row_block", "column_block"), "tiles")
            _write(done, self.path)


def _write(rows: DataFrame, path: str, others: bool = True) -> None:
    """Each tile as one file; ``others``: tiles that are not among the rows stay."""
    dealt = rows.repartition("row_block", "column_block").sortWithinPartitions("row_block", "column_block", "row")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if others else "static").partitionBy("row_block", "column_block").parquet(f"{path}/tiles")


def write(x: DataFrame, path: str, order: Sequence[str] = ("session_id", "t"), rows: int = ROWS, columns: int = COLUMNS) -> Tiles:
    """Store ``x(session_id, t, re[], im[])``, its rows numbered in a total order; a matrix that is there is replaced.

    Rows of unequal lengths, and nulls for arrays, raise; an empty matrix has no tiles.
    """
    spark = x.sparkSession
    known = numbered(x.select("session_id", "t", "re", "im"), list(order))
    n, least, most, other, full = known.agg(F.count("*"), F.min(F.size("re")), F.max(F.size("re")), F.max(F.abs(F.size("re") - F.size("im"))), F.count("re") + F.count("im")).first()
    if n and (least != most or other or full != 2 * n):
        raise ValueError("a matrix has rows of one length without nulls")
    p = int(most or 0)
    cut = known.withColumn("column_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-p // columns) - 1)))))
    parts = [F.slice(c, F.col("column_block") * columns + 1, F.lit(columns)).alias(c) for c in ("re", "im")]
    cut = cut.select("row", "session_id", "t", *parts, F.floor(F.col("row") / rows).cast("int").alias("row_block"), "column_block")
    _write(cut, path, others=False)
    schema = f"session_id {dict(x.dtypes)['session_id']}, t {dict(x.dtypes)['t']}"
    spark.createDataFrame([(n, p, rows, columns, schema)], "n long, p long, rows long, columns long, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    return open_tiles(spark, path)


def open_tiles(spark: SparkSession, path: str) -> Tiles:
    """A matrix that was stored before."""
    r = spark.read.parquet(f"{path}/shape").first()
    return Tiles(spark, path, r["n"], r["p"], r["rows"], r["columns"], r["schema"])
