"""Many-to-one joins whose left key may be held by a third of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.session import as_small

SALTS = 32


def lookup(big: DataFrame, small: DataFrame, keys: list, how: str = "left", hot: bool = True) -> DataFrame:
    """Joins ``small`` (at most one row per key) to every row of ``big``.

    A small side that proves to be small is broadcast.  A larger one is
    repeated once per salt and ``big`` is spread over the salts, so one hot key
    never lands in a single task.  Keys that are unique in ``big`` too, such as ids, need no
    salts (``hot=False``).
    """
    local = as_small(small)
    if local is not None:
        return big.join(local, keys, how)
    if not hot:
        return merged(big, small, keys, how)
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return merged(spread, small.withColumn("_salt", salts), [*keys, "_salt"], how).drop("_salt")


def merged(left: DataFrame, right: DataFrame, keys: list, how: str = "left") -> DataFrame:
    """A join that shuffles both sides, whatever Spark takes their sizes to be.

    Spark guesses from the bytes of compressed files, before salts multiply the rows: a table of
    a few MB may hold millions of rows, and a broadcast of them ends the driver.
    """
    return left.join(right.hint("merge"), keys, how)
