"""SentencePiece encoding and decoding in numpy batches.

A text is cut where no piece can cross: before a space mark that follows another character. The distinct parts of
a batch are encoded once, parts of equal length together, their substrings named by hashes from prefix sums that
probe the sorted hashes of the pieces:

* unigram models: Viterbi. All parts advance by one character at a time; the best of the pieces that end there
  is kept with its start, and the starts are followed back.
* BPE models: the best score is not the encoding (merges are greedy), so each round takes every part's best
  adjacent pair, leftmost of equals, until no pair is a piece. Very long parts merge through a heap.

The vocabulary is read from a model file on the driver and sent to the tasks; it is bounded by the file.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import map_batches
from quire.llm.rolling import U64, mix, powers

MARK = "▁"
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.float32(-np.inf)
#: Parts longer than this merge through a heap; parts kept between batches.
LONG, KEPT = 256, 200_000
#: What an unknown character scores below the worst piece in a unigram model (a fixed value of the format).
UNKNOWN_PENALTY = 10.0


# Every byte that is no UTF-8 is a replacement character of its own.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """Pieces, their scores and kinds, as plain data that travels to the tasks."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: str, unigram: bool, unknown: int, prefix: bool = True):
        """``kinds`` has a letter per piece: p a piece, b a byte, - anything that text never becomes."""
        self.pieces, self.unigram, self.unknown, self.prefix = pieces, unigram, unknown, prefix
        self.bytes = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "b"}
        ids = [i for i, k in enumerate(kinds) if k == "p"]
        names = np.concatenate([_names([pieces[i]])[0] for i in ids]) if ids else np.zeros(0, U64)
        order = np.argsort(names)
        self.keys = names[order]
        self.ids = np.array(ids, np.int32)[order]
        self.scores = np.array([scores[i] for i in ids], np.float32)[order]
        self.longest = max((len(pieces[i]) for i in ids), default=1)
        self.worst = float(min((scores[i] for i in ids), default=0.0))
        self.by_piece = {pieces[i]: i for i in ids}
        self.score_of = {pieces[i]: scores[i] for i in ids}
        self.raw = [bytes([int(pieces[i][3:5], 16)]) if k == "b" else pieces[i].replace(MARK, " ").encode() if k == "p" else b"" for i, k in enumerate(kinds)]
        if unknown >= 0:
            self.raw[unknown] = " ⁇ ".encode()

    def probe(self, names: np.ndarray) -> np.ndarray:
        """Places of the names among the sorted keys, -1 where none is equal."""
        at = np.searchsorted(self.keys, names)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == names, at, -1) if len(self.keys) else np.full(names.shape, -1)

    def fallback(self, text: str) -> list[int]:
        """Ids of a character that is no piece."""
        if self.bytes:
            return [self.bytes[b] for b in text.encode()]
        return [self.unknown]


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file on the driver."""
    with open(path, "rb") as file:
        return from_bytes(file.read())


def from_bytes(model: bytes) -> Vocabulary:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    kind = {1: "p", 4: "p", 6: "b"}
    kinds = "".join(kind.get(p.type, "-") for p in spec.pieces)
    if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that take text as it is are supported")
    unknown = sentencepiece.SentencePieceProcessor(model_proto=model).unk_id()
    return Vocabulary([p.piece for p in spec.pieces], [p.score for p in spec.pieces], kinds, spec.trainer_spec.model_type == 1, unknown, spec.normalizer_spec.add_dummy_prefix)


def _sums(parts: list[str]) -> np.ndarray:
    """Prefix sums over the characters of parts of equal length, a row each."""
    chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).reshape(len(parts), -1)
    sums = np.zeros((len(parts), chars.shape[1] + 1), U64)
    np.cumsum(mix(chars.astype(U64) + U64(1)) * powers(chars.shape[1]), axis=1, out=sums[:, 1:])
    return sums


def _between(sums: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[row, end] - sums[row, start]) * powers(sums.shape[1], inverse=True)[start] + (end - start).astype(U64))


def _names(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sums = _sums(parts)
    rows = np.arange(len(parts))
    return _between(sums, rows, np.zeros(len(parts), np.int64), np.full(len(parts), sums.shape[1] - 1)), sums


def _cuts_viterbi(parts: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flags where a token begins, and the tokens' places among the keys (-1: unknown), each at its beginning."""
    sums = _sums(parts)
    n, length = sums.shape[0], sums.shape[1] - 1
    rows = np.arange(n)
    best = np.full((n, length + 1), _NONE, np.float32)
    best[:, 0] = 0
    came, piece = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1)
    unknown = np.float32(words.worst - UNKNOWN_PENALTY)
    for end in range(1, length + 1):
        starts = np.arange(max(0, end - words.longest), end)
        at = words.probe(_between(sums, np.repeat(rows, len(starts)), np.tile(starts, n), np.full(n * len(starts), end))).reshape(n, -1)
        score = np.where(at >= 0, best[:, starts] + words.scores[at], _NONE)
        score[:, -1] = np.where(at[:, -1] >= 0, score[:, -1], best[:, end - 1] + unknown)
        choice = np.argmax(score, axis=1)
        best[:, end], came[:, end], piece[:, end] = score[rows, choice], starts[choice], at[rows, choice]
    begins, token = np.zeros((n, length), bool), np.full((n, length), -1)
    at = np.full(n, length)
    active = rows
    while len(active):
        start = came[active, at[active]]
        begins[active, start] = True
        token[active, start] = piece[active, at[active]]
        at[active] = start
        active = active[start > 0]
    return begins, token


def _cuts_merge(parts: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    sums = _sums(parts)
    n, length = sums.shape[0], sums.shape[1] - 1
    begins = np.zeros((n, length), bool)
    rows = np.arange(n)
    edges = np.tile(np.arange(length + 1), (n, 1))

    def scored(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = words.probe(_between(sums, row, start, end))
        return np.where(at >= 0, words.scores[at], _NONE)

    pairs = scored(np.repeat(rows, length - 1), edges[:, :-2].ravel(), edges[:, 2:].ravel()).reshape(n, -1)
    while len(rows):
        best = np.argmax(pairs, axis=1) if pairs.shape[1] else np.zeros(len(rows), np.int64)
        here = np.arange(len(rows))
        going = pairs[here, best] > _NONE if pairs.shape[1] else np.zeros(len(rows), bool)
        done = ~going
        begins[np.repeat(rows[done], edges.shape[1] - 1), edges[done, :-1].ravel()] = True
        rows, edges, pairs, best = rows[going], edges[going], pairs[going], best[going]
        if not len(rows):
            break
        # The pair's inner edge goes; pairs left and right of it are scored anew.
        here, width = np.arange(len(rows)), edges.shape[1]
        keep = np.arange(width) != (best + 1)[:, None]
        edges = edges[keep].reshape(len(rows), width - 1)
        pairs = pairs[np.arange(width - 2) != best[:, None]].reshape(len(rows), width - 3)
        left = here[best > 0]
        if len(left):
            b = best[left] - 1
            pairs[left, b] = scored(rows[left], edges[left, b], edges[left, b + 2])
        right = here[best < width - 3]
        if len(right):
            b = best[right]
            pairs[right, b] = scored(rows[right], edges[right, b], edges[right, b + 2])
    row, start = np.nonzero(begins)
    end = np.append(start[1:], 0)
    end[np.append(row[1:] != row[:-1], True)] = length
    token = np.full((n, length), -1)
    token[row, start] = words.probe(_between(sums, row, start, end))
    return begins, token


def _heap_merge(part: str, words: Vocabulary) -> list[str]:
    n = len(part)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if 0 <= a and b < n and end[b] - a <= words.longest:
            score = words.score_of.get(part[a:end[b]])
            if score is not None:
                heapq.heappush(heap, (-score, a, b, end[b]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not alive[a] or not alive[b] or after[a] != b or end[b] != e:
            continue
        alive[b], end[a], after[a] = False, e, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [part[i:end[i]] for i in range(n) if alive[i]]


def _encode_parts(parts: list[str], words: Vocabulary) -> dict[str, bytes]:
    """The ids (as int32 bytes) of each part."""
    out: dict[str, bytes] = {}
    by_length: dict[int, list[str]] = {}
    for p in parts:
        by_length.setdefault(len(p), []).append(p)
    for length, group in by_length.items():
        if length > LONG and not words.unigram:
            for p in group:
                ids = [i for piece in _heap_merge(p, words) for i in ([words.by_piece[piece]] if piece in words.by_piece else words.fallback(piece))]
                out[p] = np.array(ids, np.int32).tobytes()
            continue
        step = max(1, (1 << 18) // length)
        for lo in range(0, len(group), step):
            some = group[lo:lo + step]
            begins, token = (_cuts_viterbi if words.unigram else _cuts_merge)(some, words)
            row, start = np.nonzero(begins)
            place = token[row, start]
            ids = np.where(place >= 0, words.ids[place], -1).astype(np.int32)
            bounds = np.searchsorted(row, np.arange(len(some) + 1))
            odd = set(row[place < 0].tolist())
            for i, p in enumerate(some):
                own = ids[bounds[i]:bounds[i + 1]]
                if i in odd:
                    own = _with_unknown(p, own, start[bounds[i]:bounds[i + 1]], words)
                out[p] = own.tobytes()
    return out


def _with_unknown(part: str, ids: np.ndarray, start: np.ndarray, words: Vocabulary) -> np.ndarray:
    made: list[int] = []
    ends = [*start[1:].tolist(), len(part)]
    last_unknown = False
    for i, a, b in zip(ids.tolist(), start.tolist(), ends):
        if i >= 0:
            made.append(i)
        elif words.bytes or not last_unknown:
            made += words.fallback(part[a:b])
        last_unknown = i < 0
    return np.array(made, np.int32)


class Encoder:
    """Encodes texts; parts met before are remembered, up to a bound."""

    def __init__(self, words: Vocabulary):
        self.words, self.known = words, {}

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        lead = MARK if self.words.prefix else ""
        if self.words.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return [lead + p for p in text.split(" ")]
        return _PART.findall(lead + text.replace(" ", MARK))

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [self.parts(t) for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        fresh = {p for parts in cut for p in parts}.difference(self.known)
        self.known.update(_encode_parts(list(fresh), self.words))
        for parts in cut:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)


def encode(docs: DataFrame, words: Vocabulary, text_col: str = "text", name: str = "ids") -> DataFrame:
    """Adds the ids of a text's tokens (array<int>; none for a null or empty text), as the model's own library gives them.

    Nothing is cut, capped or normalised: space marks in the text stay what they are, characters without a piece become
    bytes (or the unknown id). Rows stay as they are; an empty table gives an empty one; a column of that name is replaced.
    """
    columns = [c for c in docs.columns if c != name]
    place = columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    held: list[Encoder] = []

    def rule(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Encoder(sent.value))
        made: list[np.ndarray] = []
        texts, size = [], 0
        for t in batch.column(place).to_pylist():
            texts.append(t or "")
            size += len(t or "")
            if size > 1 << 20:
                made += held[0](texts)
                texts, size = [], 0
        made += held[0](texts)
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
        return {c: batch.column(i) for i, c in enumerate(columns)} | {name: ids}

    schema = T.StructType([*(f for f in docs.schema.fields if f.name in columns), T.StructField(name, T.ArrayType(T.IntegerType()))])
    return map_batches(docs.select(*columns), rule, schema)


def decode(rows: DataFrame, words: Vocabulary, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of a list of ids: pieces joined, space marks as spaces, the leading one dropped; null for null.

    Bytes that are no UTF-8 become a replacement character each; ids outside the vocabulary are an error.
    """
    columns = [c for c in rows.columns if c != name]
    place = columns.index(ids_col)
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def rule(batch: pa.RecordBatch) -> dict:
        raw, prefix, unknown = sent.value.raw, sent.value.prefix, sent.value.unknown
        made = []
        for ids in batch.column(place):
            if not ids.is_valid:
                made.append(None)
                continue
            values = ids.values.to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() >= len(raw)):
                raise ValueError("an id outside the vocabulary")
            text = b"".join(map(raw.__getitem__, values.tolist())).decode("utf-8", "each_byte")
            lead = prefix and text.startswith(" ") and next(i for i in values.tolist() if raw[i]) != unknown
            made.append(text[1:] if lead else text)
        return {c: batch.column(i) for i, c in enumerate(columns)} | {name: made}

    schema = T.StructType([*(f for f in rows.schema.fields if f.name in columns), T.StructField(name, T.StringType())])
    return map_batches(rows.select(*columns), rule, schema)


def round_trip(docs: DataFrame, words: Vocabulary, text_col: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``same``: whether decoding gives the text back.

    It does but for literal space marks, which become spaces; a null text counts as empty.
    """
    back = decode(encode(docs, words, text_col), words)
    return back.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("same", F.col("decoded") == F.coalesce(text_col, F.lit(""))).drop("decoded")
