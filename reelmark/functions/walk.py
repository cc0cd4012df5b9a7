"""Ordered passes per key with a small state, for rules that depend on earlier decisions.

Rows are shuffled by key, sorted inside the partitions and streamed through Arrow batches. Only
the state of the current key is held, so a long key costs time but no memory, and many short keys
cost no per-group overhead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[object], "tuple | None"]


def ordered_walk(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Step], schema: str
) -> DataFrame:
    """``start()`` gives the step of a new key; a step takes a row and may return an output row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for batch in batches:
            out = []
            key_values = zip(*[batch[k] for k in keys])
            for key, row in zip(key_values, batch.itertuples(index=False)):
                if step is None or key != current:
                    current, step = key, start()
                found = step(row)
                if found is not None:
                    out.append(found)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
