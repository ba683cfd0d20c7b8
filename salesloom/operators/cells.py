"""A set of keys of fixed size that column expressions can look into.

Keys are hashed to a fixed number of cells. A key whose cell is empty is surely not in the set; others may be. Rows that
cannot match are dropped where they lie, before anything is exploded or shuffled; an equality join decides the rest, so
results do not depend on how full the cells are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: One byte each, and part of the plan: so much the driver gets and every task holds, however many keys there are.
CELLS = 1 << 16


class Cells:
    """The cells of the keys of all rows. At most `size` rows come to the driver."""

    def __init__(self, rows: DataFrame, *keys: Column, size: int = CELLS):
        self.size = size
        found = bytearray(size)
        for r in rows.select(self.cell(*keys).alias("cell")).distinct().collect():
            found[r["cell"]] = 1
        self.bytes = F.lit(bytes(found))

    def cell(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.size)).cast("int")

    def may_hold(self, *keys: Column) -> Column:
        """False only for keys that are not in the set."""
        return F.substring(self.bytes, self.cell(*keys) + 1, F.lit(1)) == F.lit(b"\x01")
