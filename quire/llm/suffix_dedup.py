"""Repeated byte strings by depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes, and only as far as needed to tell which are equal
that far. Most-significant-digit passes refine groups; a suffix alone in its group leaves. Neighbouring suffixes
that choose the same smallest ``seed``-byte string within their first ``depth`` bytes travel as one record as
long as they share their fate:

1. the first digit is that smallest string, the second all that the record's suffixes cover: records equal in
   both are repeated whole;
2. groups that the second digit splits are dealt out again, in pieces of ``piece`` suffixes, by the bytes that all
   suffixes of a piece have in common, then by all that they cover;
3. groups of pieces that this splits are dealt out as single suffixes, through the full depth.

Each distinct record is dealt on once, from the smallest document that holds it. Equal groups after the last pass
are exactly the repeated strings.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import rolling
from quire.llm.common import lists, map_batches, save, signed
from quire.llm.rolling import U64

ORDER, FOUND = "__order", "__found"


class Pieces(NamedTuple):
    run: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    digit: np.ndarray
    name: np.ndarray


class Sorter:
    """The records of one block, at any of the three grains."""

    def __init__(self, block: rolling.Texts, depth: int, seed: int, piece: int):
        tokens = rolling.byte_tokens(block)
        self.first, self.depth, self.piece = block.first, depth, piece
        self.slices = rolling.Slices(tokens)
        self.runs = rolling.window_runs(tokens, block.bounds, depth, seed, self.slices)

    def pieces(self, take: np.ndarray) -> Pieces:
        """The chosen runs cut at fixed distances before their smallest string, so that equal suffixes are cut alike."""
        r = self.runs
        which = np.flatnonzero(take)
        lo, n = r.lo[which], r.n[which]
        far = r.place[which] - lo
        low, high = (far - n + 1) // self.piece, far // self.piece
        count = high - low + 1
        run = np.repeat(which, count)
        step = rolling.ranges(low, count)
        far, lo, n = np.repeat(far, count), np.repeat(lo, count), np.repeat(n, count)
        begin = lo + far - np.minimum(far, step * self.piece + self.piece - 1)
        end = lo + far - np.maximum(far - n + 1, step * self.piece)
        # All suffixes of a piece begin with bytes that end in this core; other pieces at that distance without it can't equal any.
        core = r.place[run] - step * self.piece
        digit = rolling.mix(r.seed[run] + rolling.mix(self.slices.at(core, core + self.depth - self.piece + 1) + step.astype(U64)))
        shape = ((lo + far - begin).astype(U64) << U64(32)) | (end - begin + 1).astype(U64)
        name = rolling.mix(self.slices.at(begin, end + self.depth) + rolling.mix(digit + shape))
        return Pieces(run, begin, end - begin + 1, digit, name)

    def singles(self, lo: np.ndarray, n: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = rolling.ranges(lo, n)
        return at, rolling.mix(self.slices.at(at, at + self.depth) + np.repeat(digit, n))

    def listed(self, run: np.ndarray, names: np.ndarray, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        if not len(found) or not len(names):
            return np.zeros(len(names), bool)
        doc = (self.first + self.runs.doc[run]).astype(U64)
        return np.isin(names ^ rolling.mix(doc + U64(1)), found.view(U64) ^ rolling.mix(rows.astype(U64) + U64(1)))


def _records(docs: DataFrame, text: str, sizes: tuple[int, int, int]) -> DataFrame:
    def rule(batch: pa.RecordBatch) -> dict | None:
        ids = batch.column(0).to_numpy()
        out: dict[str, list] = {"digit": [], "name": [], "doc": []}
        for block in rolling.texts(batch.column(1)):
            runs = Sorter(block, *sizes).runs
            out["digit"].append(signed(runs.seed))
            out["name"].append(signed(runs.span))
            out["doc"].append(ids[block.first + runs.doc])
        return {k: np.concatenate(v) for k, v in out.items()} if out["doc"] else None

    return map_batches(docs.select(ORDER, text), rule, "digit long, name long, doc long")


def _dealt(docs: DataFrame, text: str, split: DataFrame, sizes: tuple[int, int, int], single: bool) -> DataFrame:
    """The named records' next grain: pieces, or single suffixes."""
    wanted = split.groupBy(F.col("doc").alias(ORDER)).agg(F.collect_list("name").alias(FOUND))

    def rule(batch: pa.RecordBatch) -> dict | None:
        ids = batch.column(0).to_numpy()
        rows, found = lists(batch.column(2))
        out: dict[str, list] = {"digit": [], "name": [], "doc": []}
        for block in rolling.texts(batch.column(1)):
            s = Sorter(block, *sizes)
            if single:
                p = s.pieces(np.ones(len(s.runs.lo), bool))
                take = s.listed(p.run, p.name, rows, found)
                run, digit = np.repeat(p.run[take], p.n[take]), np.repeat(p.digit[take], p.n[take])
                _, name = s.singles(p.lo[take], p.n[take], p.digit[take])
            else:
                p = s.pieces(s.listed(np.arange(len(s.runs.lo)), s.runs.span, rows, found))
                run, digit, name = p.run, p.digit, p.name
            out["digit"].append(signed(digit))
            out["name"].append(signed(name))
            out["doc"].append(ids[block.first + s.runs.doc[run]])
        return {k: np.concatenate(v) for k, v in out.items()} if out["doc"] else None

    return map_batches(docs.select(ORDER, text).join(wanted, ORDER), rule, "digit long, name long, doc long")


def _groups(records: DataFrame) -> DataFrame:
    return records.groupBy("digit", "name").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))


def _split(groups: DataFrame) -> DataFrame:
    """Records whose group of the digit before holds different ones."""
    several = groups.groupBy("digit").agg(F.count("*").alias("kinds")).where("kinds > 1").select("digit")
    return groups.join(several, "digit").select("name", "doc")


def drop_repeated_bytes(docs: DataFrame, depth: int = 200, seed: int = 40, piece: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte covered by a ``depth``-byte string that also starts anywhere else, the same text included.

    Texts are UTF-8; strings never cross documents, overlaps count, and strings are judged on the input. Returns the
    columns of ``docs`` but the text, and ``kept`` (binary: what is left may cut characters), ``n_bytes``,
    ``n_removed`` and ``n_spans`` (maximal removed runs), which take the place of columns of those names.

    A null text is empty. Ids only find rows again: a null id, repeated ids and repeated rows are rows like others,
    and equal rows repeat each other. An empty table gives an empty one. A text over one block is sorted whole.
    """
    seed = min(seed, depth)
    sizes = (depth, seed, piece)
    # The key only finds rows again, so a hash of the text parts rows without an id, and 16 bits of it rows that repeat one.
    hashed = F.xxhash64(text_col)
    key = F.coalesce(F.col(id_col).cast("long").bitwiseXOR(F.shiftleft(hashed.bitwiseAND(F.lit(0xFFFF)), 40)), hashed)
    kept = docs.withColumn(ORDER, key)
    records = _records(kept, text_col, sizes)
    runs = save(_groups(records), "runs")
    pieces = save(_dealt(kept, text_col, _split(runs), sizes, False), "pieces")
    piece_groups = save(_groups(pieces), "piece_groups")
    singles = save(_dealt(kept, text_col, _split(piece_groups), sizes, True), "singles")
    repeated_runs = save(runs.where("n > 1").select("digit", "name"), "repeated_runs")
    repeated_pieces = save(piece_groups.where("n > 1").select("digit", "name"), "repeated_pieces")
    repeated_singles = save(_groups(singles).where("n > 1").select("digit", "name"), "repeated_singles")
    equal = [rows.join(names, ["digit", "name"]).select(F.col("doc").alias(ORDER), "name") for rows, names in ((records, repeated_runs), (pieces, repeated_pieces), (singles, repeated_singles))]
    found = equal[0].union(equal[1]).union(equal[2]).groupBy(ORDER).agg(F.collect_list("name").alias(FOUND))

    added = ("kept", "n_bytes", "n_removed", "n_spans")
    columns = [c for c in docs.columns if c != text_col and c not in added]

    def gone(block: rolling.Texts, rows: np.ndarray, names: np.ndarray) -> np.ndarray:
        mine = (rows >= block.first) & (rows < block.first + len(block.bounds) - 1)
        if not mine.any():
            return np.zeros(len(block.data), bool)
        rows, names = rows[mine], names[mine]
        s = Sorter(block, *sizes)
        whole = s.listed(np.arange(len(s.runs.lo)), s.runs.span, rows, names)
        p = s.pieces(~whole & np.isin(s.first + s.runs.doc, rows))
        equal = s.listed(p.run, p.name, rows, names)
        at, name = s.singles(p.lo[~equal], p.n[~equal], p.digit[~equal])
        at = at[s.listed(np.repeat(p.run[~equal], p.n[~equal]), name, rows, names)]
        lo = np.concatenate([s.runs.lo[whole], p.lo[equal], at])
        n = np.concatenate([s.runs.n[whole], p.n[equal], np.ones(len(at), np.int64)])
        return rolling.covered(len(block.data), lo, lo + n + depth - 1)

    def cut(batch: pa.RecordBatch) -> dict:
        rows, names = lists(batch.column(len(columns) + 1))
        out: dict[str, list] = {c: [] for c in added}
        for block in rolling.texts(batch.column(len(columns))):
            mask = gone(block, rows, names)
            for a, b in zip(block.bounds[:-1], block.bounds[1:]):
                own = mask[a:b]
                removed = int(own.sum())
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(removed)
                out["n_spans"].append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0)
                out["kept"].append((block.data[a:b][~own] if removed else block.data[a:b]).tobytes())
        return {c: batch.column(i) for i, c in enumerate(columns)} | out

    counts = [T.StructField(c, T.LongType()) for c in added[1:]]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in columns), T.StructField("kept", T.BinaryType()), *counts])
    return map_batches(kept.join(found, ORDER, "left").select(*columns, text_col, FOUND), cut, schema)
