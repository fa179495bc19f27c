"""What changed between two versions of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.folds import task_count


def lines_changed(before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines removed and added per document as multisets: one signed count, combined before the shuffle."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(key, F.explode_outer(F.split(text, "\n")).alias("line"), F.lit(sign).alias("n"))
    balance = signed(before, 1).unionByName(signed(after, -1)).groupBy(key, "line").agg(F.sum("n").alias("n"))
    return balance.filter("n <> 0").select(key, "line", F.when(F.col("n") > 0, "removed").otherwise("added").alias("change"), F.abs("n").alias("times"))


def _kept(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lines of either side that belong to the longest common subsequence; on ties the left side moves."""
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(line, len(codes)) for line in a])
    y = np.array([codes.setdefault(line, len(codes)) for line in b])
    # Every k-th row of the table is kept; the rows between two of them are computed again while walking through.
    k = max(1, int(np.sqrt(len(x))))

    def above(row: np.ndarray, i: int) -> np.ndarray:
        reach = np.where(y == x[i], row[1:] + 1, row[:-1])
        return np.append(np.maximum.accumulate(reach[::-1])[::-1], 0).astype(np.int32)

    row = np.zeros(len(y) + 1, np.int32)
    kept = {len(x): row}
    for i in range(len(x) - 1, -1, -1):
        row = above(row, i)
        if i % k == 0:
            kept[i] = row
    in_a, in_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
    table: dict[int, np.ndarray] = {}
    i = j = 0
    while i < len(x) and j < len(y):
        if i + 1 not in table or i not in table:
            end = min(len(x), (i // k + 1) * k)
            table = {end: kept[end]}
            for n in range(end - 1, i // k * k - 1, -1):
                table[n] = above(table[n + 1], n)
        if x[i] == y[j]:
            in_a[i] = in_b[j] = True
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return in_a, in_b


def line_diff(before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line of either side with a changed flag, for documents whose versions differ.

    Equal documents are dropped by the join itself; a pair is one row, so it never gathers a group.
    """
    pairs = before.select(key, F.col(text).alias("_a")).join(after.select(key, F.col(text).alias("_b")), key).filter("_a <> _b")
    pairs = pairs.repartition(task_count(pairs), key)
    schema = f"{key} {before.schema[key].dataType.simpleString()}, side string, line_no int, line string, changed boolean"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, old, new in zip(batch[key], batch["_a"], batch["_b"]):
                a, b = old.split("\n"), new.split("\n")
                in_a, in_b = _kept(a, b)
                for side, lines, kept in (("before", a, in_a), ("after", b, in_b)):
                    yield pd.DataFrame({key: doc, "side": side, "line_no": np.arange(len(lines), dtype=np.int32), "line": lines, "changed": ~kept})

    return pairs.mapInPandas(compare, schema)
