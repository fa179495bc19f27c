"""Substring deduplication by seed and extend.

Every document is winnowed: each window of ``words`` words chooses the smallest of its ``seed``-word
anchors, and neighbouring windows that choose the same one form a run. Documents meet on anchors. Around an
anchor the match is first extended both ways at once, to all that its run covers: runs that are equal
throughout are one class, and only the class and its smallest document go on. Where an anchor carries several
classes, these are extended both ways window by window, each class once, in the smallest document that holds
it. Windows found in an earlier document are the matches; overlapping ones make up the maximal repeats, which
are removed. Groups of thousands of copies are one class from the first aggregation on; nothing is paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import rolling
from quire.llm.common import LAST, lists, map_batches, order_id, save, signed

#: Rows are found again by order and part; the part tells rows without an id, which all come last, from one another.
ORDER, PART, FOUND = "__order", "__part", "__found"


def _window_names(slices: rolling.Slices, lo: np.ndarray, n: np.ndarray, seed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    at = rolling.ranges(lo, n)
    return at, rolling.mix(slices.at(at, at + depth) + np.repeat(seed, n))


def _listed(doc: np.ndarray, names: np.ndarray, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which (doc, name) pairs are among (rows, found)."""
    if not len(found):
        return np.zeros(len(names), bool)
    return np.isin(names ^ rolling.mix(doc.astype(np.uint64) + rolling.U64(1)), found ^ rolling.mix(rows.astype(np.uint64) + rolling.U64(1)))


def _runs(docs: DataFrame, text: str, depth: int, seed: int) -> DataFrame:
    def rule(batch: pa.RecordBatch) -> dict | None:
        ids = batch.column(0).to_numpy()
        parts = batch.column(1).to_numpy()
        out: dict[str, list] = {"seed": [], "span": [], "doc": [], "part": []}
        for block in rolling.texts(batch.column(2)):
            tokens, bounds = rolling.word_tokens(block)
            runs = rolling.window_runs(tokens, bounds, depth, seed)
            out["seed"].append(signed(runs.seed))
            out["span"].append(signed(runs.span))
            out["doc"].append(ids[block.first + runs.doc])
            out["part"].append(parts[block.first + runs.doc])
        return {k: np.concatenate(v) for k, v in out.items()} if out["doc"] else None

    return map_batches(docs.select(ORDER, PART, text), rule, "seed long, span long, doc long, part long")


def _extended(docs: DataFrame, text: str, open_classes: DataFrame, depth: int, seed: int) -> DataFrame:
    """The windows of the named classes, each in the smallest document that holds the class.

    A class of rows without an id only has no smallest one: its windows are taken in each of them.
    """
    named = open_classes.where(F.col("first") < LAST).select(F.col("first").alias(ORDER), F.lit(0).cast("long").alias(PART), "span")
    last = open_classes.where(F.col("first") == LAST).select("seed", "span")
    late = _runs(docs.where(F.col(ORDER) == LAST), text, depth, seed).join(last, ["seed", "span"]).select(F.col("doc").alias(ORDER), F.col("part").alias(PART), "span")
    wanted = named.unionByName(late).groupBy(ORDER, PART).agg(F.collect_set("span").alias(FOUND))

    def rule(batch: pa.RecordBatch) -> dict | None:
        ids = batch.column(0).to_numpy()
        parts = batch.column(1).to_numpy()
        rows, found = lists(batch.column(3))
        out: dict[str, list] = {"seed": [], "window": [], "doc": [], "part": []}
        for block in rolling.texts(batch.column(2)):
            tokens, bounds = rolling.word_tokens(block)
            if not len(tokens):
                continue
            slices = rolling.Slices(tokens)
            runs = rolling.window_runs(tokens, bounds, depth, seed, slices)
            take = _listed(block.first + runs.doc, runs.span, rows, found.view(np.uint64))
            _, names = _window_names(slices, runs.lo[take], runs.n[take], runs.seed[take], depth)
            out["window"].append(signed(names))
            out["seed"].append(signed(np.repeat(runs.seed[take], runs.n[take])))
            out["doc"].append(np.repeat(ids[block.first + runs.doc[take]], runs.n[take]))
            out["part"].append(np.repeat(parts[block.first + runs.doc[take]], runs.n[take]))
        return {k: np.concatenate(v) for k, v in out.items()} if out["doc"] else None

    return map_batches(docs.select(ORDER, PART, text).join(wanted, [ORDER, PART]), rule, "seed long, window long, doc long, part long")


def drop_repeats(docs: DataFrame, words: int = 50, seed: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes from every document the words of passages that stand in a document with a smaller id.

    A passage is ``words`` or more consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document; windows are judged
    on the input. Returns the columns of ``docs`` with the text cut (the kept words joined by one space), and
    ``n_words`` and ``n_removed``, which take the place of columns of that name.

    A null text has no words and becomes empty. A null id counts as larger than every id. Rows that share an id
    never cut each other; each is cut by smaller ids. Repeats within one document stay. Rows, ties included, are
    as many as before; an empty table gives an empty one. No text is too long: it is hashed whole.
    """
    depth = words
    seed = min(seed, depth)
    part = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    kept = docs.withColumn(PART, part).withColumn(ORDER, order_id(id_col))
    runs = _runs(kept, text_col, depth, seed)
    classes = save(runs.groupBy("seed", "span").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "classes")
    several = classes.groupBy("seed").agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).where("n > 1 AND a < b").select("seed")
    windows = save(_extended(kept, text_col, classes.join(several, "seed"), depth, seed), "windows")
    earliest = windows.groupBy("seed", "window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    matched = windows.join(save(earliest, "earliest"), ["seed", "window"]).where("doc > first").select(F.col("doc").alias(ORDER), F.col("part").alias(PART), F.col("window").alias("name"))
    shared = save(classes.where("first < last").drop("last"), "shared")
    whole = runs.join(shared, ["seed", "span"]).where("doc > first").select(F.col("doc").alias(ORDER), F.col("part").alias(PART), F.col("span").alias("name"))
    found = whole.unionByName(matched).groupBy(ORDER, PART).agg(F.collect_list("name").alias(FOUND))

    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    place = columns.index(text_col)

    def cut(batch: pa.RecordBatch) -> dict:
        rows, names = lists(batch.column(len(columns)))
        texts, n_words, n_removed = [], [], []
        for block in rolling.texts(batch.column(place)):
            tokens, bounds = rolling.word_tokens(block)
            gone = _gone(block, tokens, bounds, rows, names.view(np.uint64))
            data = block.data.tobytes()
            for i in range(len(block.bounds) - 1):
                parts = data[block.bounds[i]:block.bounds[i + 1]].split()
                mask = gone[bounds[i]:bounds[i + 1]]
                removed = int(mask.sum())
                if removed:
                    parts = [parts[j] for j in np.flatnonzero(~mask)]
                texts.append(b" ".join(parts))
                n_words.append(len(mask))
                n_removed.append(removed)
        out = {c: batch.column(i) for i, c in enumerate(columns)}
        return out | {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": n_words, "n_removed": n_removed}

    def _gone(block: rolling.Texts, tokens: np.ndarray, bounds: np.ndarray, rows: np.ndarray, names: np.ndarray) -> np.ndarray:
        mine = (rows >= block.first) & (rows < block.first + len(block.bounds) - 1)
        if not mine.any() or len(tokens) < depth:
            return np.zeros(len(tokens), bool)
        rows, names = rows[mine], names[mine]
        slices = rolling.Slices(tokens)
        runs = rolling.window_runs(tokens, bounds, depth, seed, slices)
        whole = _listed(block.first + runs.doc, runs.span, rows, names)
        lo, hi = runs.lo[whole], runs.lo[whole] + runs.n[whole] + depth - 1
        rest = ~whole & np.isin(block.first + runs.doc, rows)
        at, window = _window_names(slices, runs.lo[rest], runs.n[rest], runs.seed[rest], depth)
        at = at[_listed(block.first + np.repeat(runs.doc[rest], runs.n[rest]), window, rows, names)]
        return rolling.covered(len(tokens), np.append(lo, at), np.append(hi, at + depth))

    kinds = [f for f in docs.schema.fields if f.name in columns]
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return map_batches(kept.join(found, [ORDER, PART], "left").select(*columns, FOUND), cut, schema)

