"""A stated set of queries against all rows of a table, in blocks of a checked size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import checkpointed

#: Rows of a block; what is broadcast is no larger.
BLOCK_ROWS = 20_000


def in_blocks(queries: DataFrame, keys: list[str], join: Callable[[DataFrame], DataFrame], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The union of ``join(block)`` over blocks of ``queries``, each of about ``block_rows`` and broadcast.

    The queries are counted first: a set of one block is broadcast whole, a
    larger one is cut by the hash of its keys and takes a pass for each block.
    """
    queries = checkpointed(queries)
    blocks = max(1, -(-queries.count() // block_rows))
    if blocks == 1:
        return join(F.broadcast(queries))
    number = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    return reduce(DataFrame.unionByName, [join(F.broadcast(queries.where(number == i))) for i in range(blocks)])
