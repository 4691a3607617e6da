"""Sums over rows of small vectors and matrices: one distributed pass each.

Every task reduces its rows to one vector. Vectors of a few KB reach the driver as
they are, in one stage; longer ones are summed by position on the cluster first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Largest vector that each task sends to the driver, and the numbers of a longer one that are summed together.
DIRECT_BYTES = 16 << 10
CHUNK = 8192

#: A fit in steps: it asks for the sum of a function over all rows, is sent the sum, and ends with its result.
Steps = Generator[Callable[[np.ndarray], np.ndarray], np.ndarray, object]


def summed(df: DataFrame, columns: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``fn(block)`` over blocks of rows; ``fn`` returns a vector of fixed length, for no rows too."""
    if 8 * len(fn(np.empty((0, len(columns))))) <= DIRECT_BYTES:
        return _summed_here(df, columns, fn)

    def reduce_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = fn(batch.to_numpy(dtype=np.float64))
                total = part if total is None else total + part
        if total is not None:
            cuts = range(0, len(total), CHUNK)
            yield pd.DataFrame({"i": np.arange(len(cuts), dtype=np.int32), "v": [total[c: c + CHUNK].astype(np.float64).tobytes() for c in cuts]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that a repeated task gives the same sum.
        return pd.DataFrame({"i": group["i"].iloc[:1], "v": [sum(np.frombuffer(v, np.float64) for v in sorted(group["v"])).tobytes()]})

    parts = df.select(*columns).mapInPandas(reduce_partition, "i int, v binary")
    rows = parts.groupBy("i").applyInPandas(add, "i int, v binary").collect()
    return np.concatenate([np.empty(0), *[np.frombuffer(r["v"], np.float64) for r in sorted(rows, key=lambda r: r["i"])]])


def _summed_here(df: DataFrame, columns: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The same, with a short vector of each task; exact whatever the order in which tasks end."""

    def reduce_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [fn(batch.to_numpy(dtype=np.float64)) for batch in batches if len(batch)]
        if parts:
            yield pd.DataFrame({"v": [sum(parts).astype(np.float64).tobytes()]})

    rows = df.select(*columns).mapInPandas(reduce_partition, "v binary").collect()
    vectors = [np.frombuffer(r["v"], np.float64) for r in rows]
    if not vectors:
        return np.empty(0)
    return np.array([math.fsum(v) if np.all(np.isfinite(v)) else sum(v) for v in zip(*vectors)])


def together(df: DataFrame, columns: list[str], steps: list[Steps]) -> list:
    """The results of fits over the same rows; each pass over the rows answers all that are not done."""
    results: list = [None] * len(steps)
    asked: dict[int, Callable[[np.ndarray], np.ndarray]] = {}

    def send(i: int, answer: np.ndarray | None) -> None:
        try:
            asked[i] = steps[i].send(answer)
        except StopIteration as done:
            asked.pop(i, None)
            results[i] = done.value

    for i in range(len(steps)):
        send(i, None)
    while asked:
        fns = list(asked.values())
        edges = np.cumsum([0, *[len(fn(np.empty((0, len(columns))))) for fn in fns]])
        out = summed(df, columns, lambda rows, fns=fns: np.concatenate([fn(rows) for fn in fns]))
        out = out if len(out) else np.zeros(edges[-1])
        for i, a, b in zip(list(asked), edges, edges[1:]):
            send(i, out[a:b])
    return results


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """``X'WX`` of the columns, as a dense matrix of columns x columns numbers."""
    k = len(columns)

    def block(rows: np.ndarray) -> np.ndarray:
        x = rows[:, :k]
        return ((x * rows[:, k:]).T @ x if weight else x.T @ x).ravel()

    flat = summed(df, [*columns, weight] if weight else columns, block)
    return flat.reshape(k, k) if flat.size else np.zeros((k, k))


def gram_table(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """The same matrix as ``(a, b, v)`` rows."""
    g = gram(df, columns, weight)
    rows = [(a, b, float(g[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, v double")
