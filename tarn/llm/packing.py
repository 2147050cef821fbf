"""Best-fit packing of tokenized documents into sequences of a fixed length, by exact-complement hashing.

The plan needs only how many pieces there are of each length, a table of at most ``capacity`` counts whatever the
corpus holds. Indexes of single lengths, pair sums and triple sums (a length plus a pair) give the combinations that
fill a gap exactly; they are consumed as often as the counts allow, longest piece and fewest parts first. What is left
is packed best-fit decreasing, again by counts. The plan is a list of patterns with multiplicities; each piece finds
its place from its rank among the pieces of its length, so neither texts nor ids cross the network to be placed.

Defined results: a null text counts as empty and packs as its end token alone; null ids and repeated rows are packed
row by row; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.memory import lean
from tarn.llm.token_counts import _LATIN, byte_letters
from tarn.plans.materialize import materialize

CAPACITY, END = 2048, 0
#: Pre-tokens whose ids a task remembers, at most.
CACHE = 200_000

_FAST = re.compile("[\t\n\r\x0b\x0c" + re.escape("".join(_LATIN)) + "‐-‧€™]*")
_L = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_N = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")


@cache
def token_ids(path: str) -> Callable[[bytes], bytes]:
    """A function from a text's bytes to its ids as little-endian unsigned 32-bit integers.

    It remembers pre-tokens; a worker process keeps it from task to task.
    """
    from tokenizers import Tokenizer

    tok, letters = Tokenizer.from_file(path), byte_letters()
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")
    known: dict[str, bytes] = {}

    class Pieces(dict):
        def __missing__(self, piece: str) -> bytes:
            found = tok.model.tokenize(piece.encode().decode("latin-1").translate(letters))
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            return out

    known = Pieces()

    def run(raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if _FAST.fullmatch(text) and not special.search(text):
            return b"".join(map(known.__getitem__, _PIECES.findall(text)))
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, times) that use every piece once and fit into ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        patterns.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)[::-1]
    pairs = _pair_index(lengths, capacity)

    def use(*parts: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(int(left[p]) // k for p, k in need.items())
        if times:
            patterns.append((dict(need), times))
            for p, k in need.items():
                left[p] -= times * k

    for length in lengths.tolist():
        gap = capacity - length
        if left[length] and left[gap]:
            use(length, gap)
        if left[length] and gap in pairs:
            for a, b in pairs[gap].tolist():
                if not left[length]:
                    break
                if left[a] and left[b]:
                    use(length, a, b)
        if left[length]:
            for c in lengths[lengths < gap].tolist():
                if not left[length]:
                    break
                if not left[c] or gap - c not in pairs:
                    continue
                found = pairs[gap - c]
                for a, b in found[(left[found[:, 0]] > 0) & (left[found[:, 1]] > 0)].tolist():
                    if not (left[length] and left[c]):
                        break
                    use(length, c, a, b)
    return patterns + _best_fit(left, capacity)


def _pair_index(lengths: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """Pair sums: sum -> (a, b) with a >= b, larger a first."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    out = {}
    for total in range(2, capacity):
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[present[a] & present[total - a]]
        if len(a):
            out[total] = np.stack([a, total - a], axis=1)
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit by decreasing length, with counts: every length goes to the smallest gap that takes it."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in bins if g >= length and bins[g]), default=None)
            pattern, times = bins[gap].pop() if gap is not None else ({}, n)
            gap = capacity if gap is None else gap
            copies = min(n, gap // length)
            used = min(times, n // copies)
            if times > used and pattern:
                bins[gap].append((pattern, times - used))
            bins.setdefault(gap - length * copies, []).append((pattern | {length: copies}, used))
            n -= used * copies
    return [entry for found in bins.values() for entry in found]


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, copies, first sequence, offset), ordered by length and rank."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, next_rank[length], times * copies, copies, sequence, offset))
            next_rank[length] += times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, _task, _rank): documents as pieces of at most ``capacity`` ids; the first may be shorter."""
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    id_type = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids", "_task", "_rank"]
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, seen = TaskContext.get().partitionId(), token_ids(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at, piece, start, length, ids, rank = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                data = encode(text.as_py()) + tail
                n, begin, number = len(data) // 4, 0, 0
                while begin < n:
                    size = (n - begin) % capacity or capacity
                    at.append(k)
                    piece.append(number)
                    start.append(begin)
                    length.append(size)
                    ids.append(data[4 * begin : 4 * (begin + size)])
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    begin, number = begin + size, number + 1
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(at), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids binary, _task int, _rank bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, piece, start, length, *carry, sequence_id, offset), one row for each piece.

    ``carry``: named expressions over the piece's ids, evaluated where the piece is made; the ids themselves (binary,
    little-endian unsigned 32-bit) by default.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    made = tokenize_pieces(docs, path, capacity, end, id_col, text_col)
    # Written once: a piece's rank within its task must not change between the count and the placement.
    pieces = materialize(made.select(id_col, "piece", "start", "length", *[e.alias(n) for n, e in carry.items()], "_task", "_rank"), "pieces")
    by_task = pieces.groupBy("length", "_task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_task.withColumn("_base", before).select("length", "_task", "_base")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    ranked = pieces.join(bases, ["length", "_task"]).withColumn("_rank", F.col("_base") + F.col("_rank")).select(id_col, "piece", "start", "length", *carry, "_rank")
    schema = ranked.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",_rank bigint", "") + ",sequence_id bigint,offset bigint"

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(table[:, 2])
        first = {int(x): int(ends[k] - table[k, 2]) for k, x in reversed(list(enumerate(table[:, 0])))}
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            starts = np.fromiter((first[x] for x in length.tolist()), np.int64, len(length))
            slot = table[np.searchsorted(ends, starts + rank, side="right")] if len(rank) else table[:0]
            inside = rank - slot[:, 1]
            columns = [*batch.columns[:-1], pa.array(slot[:, 4] + inside // slot[:, 3]), pa.array(slot[:, 5] + inside % slot[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
