"""Quality rules as learned decision lists.

Sequential covering: rules are grown one after another on the labelled documents that no earlier rule covers. A
rule is a conjunction of thresholds; each step adds the threshold with the best FOIL gain, read from labelled
counts per feature and bin that Spark aggregates over all labelled rows. A third of the labels prunes: trailing
conditions go while precision over the pruning rows doesn't fall, and a rule below the wanted precision ends the
list. The list is one ordered conditional expression over the features, which any document is put through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import rolling
from quire.llm.common import discard, map_batches, save

U64 = np.uint64
#: Thresholds tried per measure; they are quantiles over all labelled documents.
BINS = 64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_marks", "n_digits")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOLS, _MARKS, _DIGITS = _table(b"#*$%&|<>"), _table(b"!?"), _table(b"0123456789")
_UPPER = _table(bytes(range(65, 91)))
_STARTS = _table(bytes(x for x in range(256) if x & 0xC0 != 0x80))


def _totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated_words(tokens: np.ndarray, bounds: np.ndarray, size: int = 3) -> np.ndarray:
    """Per document, the words in windows of ``size`` words that occur twice or more in it."""
    n = len(tokens)
    if n < size:
        return np.zeros(len(bounds) - 1, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    windows = rolling.Slices(tokens).every(size) ^ rolling.mix(doc[:n - size + 1].astype(U64) + U64(1))
    at = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:])
    order = at[np.argsort(windows[at])]
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = np.zeros(n, bool)
    for step in range(size):
        hit[order[again] + step] = True
    return _totals(hit, bounds)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds counts over the whole text to every row; columns of their names are replaced.

    n_words: words ``[^\\x20\\x09-\\x0D]+``; word_chars: code points in words; n_symbols: characters of ``[#*$%&|<>]``;
    n_dup_lines: lines (cut at \\n) with a word that equal an earlier line; n_repeat_words: words in 3-word windows
    found twice or more in the text, the first included; n_lines: lines with a word; n_upper: A-Z; n_marks: ! and ?;
    n_digits: 0-9. A null or empty text has zeros throughout.
    """
    added = (*BASE, *EXTRA)
    columns = [c for c in docs.columns if c not in added]
    place = columns.index(text_col)

    def rule(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in added}
        for block in rolling.texts(batch.column(place)):
            data, bounds = block.data, block.bounds
            tokens, words = rolling.word_tokens(block)
            out["n_words"].append(np.diff(words))
            out["word_chars"].append(_totals(_STARTS[data] & ~rolling.SPACE[data], bounds))
            for name, members in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_marks", _MARKS), ("n_digits", _DIGITS)):
                out[name].append(_totals(members[data], bounds))
            out["n_repeat_words"].append(_repeated_words(tokens, words))
            raw = data.tobytes()
            lines = [[x for x in raw[a:b].split(b"\n") if x.strip()] for a, b in zip(bounds[:-1], bounds[1:])]
            out["n_lines"].append(np.array([len(x) for x in lines]))
            out["n_dup_lines"].append(np.array([len(x) - len(set(x)) for x in lines]))
        return {c: batch.column(i) for i, c in enumerate(columns)} | {k: np.concatenate(v) if v else [] for k, v in out.items()}

    schema = T.StructType([*(f for f in docs.schema.fields if f.name in columns), *(T.StructField(c, T.LongType()) for c in added)])
    return map_batches(docs.select(*columns), rule, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def measures() -> dict[str, Column]:
    """What conditions may test: names and expressions over the features."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "upper_share": _share("n_upper", "word_chars"),
        "mark_share": _share("n_marks", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
    }


class Condition(NamedTuple):
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = measures()[self.measure]
        return value > self.threshold if self.above else value <= self.threshold


class Rule(NamedTuple):
    """Documents that meet all conditions are rejected."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.measure} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions) + f" -> reject ({self.right}:{self.wrong})"


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < value))


def _counts(rows: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """Per measure an array (bin, label) of the rows' counts; one row per measure and bin comes to the driver."""
    bins = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"bin_{n}").alias("bin")) for n in names])).alias("b")
    out: dict[str, np.ndarray] = {n: np.zeros((BINS + 1, 2), np.int64) for n in names}
    for r in rows.select("bad", bins).groupBy("b.measure", "b.bin", "bad").count().collect():
        out[r["measure"]][r["bin"], int(r["bad"])] += r["count"]
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> list[Condition]:
    """Adds the condition with the best FOIL gain until no good document is covered or nothing gains."""
    found: list[Condition] = []
    while len(found) < most:
        best, gain = None, 0.0
        for name, table in _counts(rows, list(cuts)).items():
            good, bad = table.sum(axis=0)
            if not bad or not good:
                return found
            before = np.log2(bad / (good + bad))
            below = table.cumsum(axis=0)
            for above in (True, False):
                side = (below[-1] - below if above else below)[:len(cuts[name])]
                g, b = side[:, 0], side[:, 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(b > 0, b * (np.log2(b / (g + b)) - before), 0)
                i = int(np.argmax(gains))
                if gains[i] > gain + 1e-9:
                    best, gain = Condition(name, above, cuts[name][i]), float(gains[i])
        if best is None:
            return found
        found.append(best)
        rows = rows.where(best.column())
    return found


def _prune(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The shortest head of the conjunction with the best (bad - good) / (bad + good) over the pruning rows."""
    covered, totals = F.lit(True), []
    for i, c in enumerate(conditions):
        covered = covered & c.column()
        totals += [F.count_if(covered & F.col("bad")).alias(f"b{i}"), F.count_if(covered & ~F.col("bad")).alias(f"g{i}")]
    seen = rows.agg(*totals).first()
    worth = [(seen[f"b{i}"] - seen[f"g{i}"]) / max(1, seen[f"b{i}"] + seen[f"g{i}"]) for i in range(len(conditions))]
    i = int(np.argmax(worth))
    return Rule(tuple(conditions[:i + 1]), seen[f"b{i}"], seen[f"g{i}"])


def learn(labelled: DataFrame, most_rules: int = 8, most_conditions: int = 4, precision: float = 0.9, least: int = 2) -> list[Rule]:
    """The decision list for rows with features and ``bad`` (boolean): which documents to reject.

    All labelled rows count. A rule must keep ``precision`` on the pruning rows and cover ``least`` bad ones of them,
    else the list ends before it. No labels, or labels of one kind only, give an empty list.
    """
    names = list(measures())
    rows = save(labelled.where("bad IS NOT NULL").select(*BASE, *EXTRA, "bad", F.pmod(F.xxhash64(F.lit(9), "row"), F.lit(3)).alias("fold")), "labelled")
    quantiles = rows.agg(*[F.percentile_approx(m, [i / BINS for i in range(1, BINS)], 10000).alias(n) for n, m in measures().items()]).first()
    values = {n: sorted(set(quantiles[n] or ())) for n in names}
    # Halfway between neighbours, so that a document just past the last good one isn't rejected.
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in values.items() if len(v) > 1}
    if not cuts:
        return []
    binned = [_bin(measures()[n], c).alias(f"bin_{n}") for n, c in cuts.items()]
    rows = save(rows.select("*", *binned), "binned")
    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        conditions = _grow(left.where("fold <> 0"), cuts, most_conditions)
        if not conditions:
            break
        rule = _prune(left.where("fold = 0"), conditions)
        if rule.right < least or rule.right < precision * (rule.right + rule.wrong):
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where a document stays: the list's first matching rule rejects, none keeps."""
    out = F
    if not rules:
        return F.lit(True)
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def training_rows(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features of the labelled documents; bad: quality 0. Unlabelled rows, and null ids or labels, take no part."""
    marks = labels.select(F.col(id_col).alias("row"), (F.col("quality") == 0).alias("bad")).where("row IS NOT NULL AND bad IS NOT NULL")
    marks = marks.groupBy("row").agg(F.max("bad").alias("bad"))
    return counted.select(F.col(id_col).alias("row"), *BASE, *EXTRA).join(marks, "row")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, the base counts, ``base_failed`` and ``kept``.

    Labels are (id, quality 0/1); several labels of one id count as one, bad if any is. A null or empty text fails the
    base rule. Without labels only the base rule speaks. Repeated rows stay rows; an empty table gives an empty one.
    """
    counted = save(features(docs.select(id_col, text_col), text_col).drop(text_col), "features")
    rules = learn(training_rows(counted, labels, id_col))
    return counted.select(id_col, *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the list learned from ``labels``; columns as they are."""
    mine = features(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), "text").drop("text")
    counted = save(mine.withColumnRenamed("row", id_col), "features")
    rules = learn(training_rows(counted, labels, id_col))
    discard(counted)
    others = [c for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    kept = features(whole, "text").where(~base_failed() & verdict(rules))
    return kept.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
