"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a ``WINDOW``-byte string that also starts in a document with a smaller id. Windows that are
equal choose the same content-defined anchors (``windows.anchors``), so only windows of one anchor need to meet:

1. Documents are written as compressed blocks of texts, a few blocks to a group; the table is bucketed by group, so
   that later steps read it in place and only hashes and decisions move. Each group sends its distinct anchor classes
   (anchor hash, hash of the whole span of windows that chose the anchor, smallest id) to the anchor's bucket. Equal
   spans are decided there: every occurrence with an id above the smallest one is repeated as a whole. Equal classes
   form a chain by their ids; each sends its bytes to the group of the one before it, which compares them byte by byte,
   so no group is asked by more than one other for a class. Occurrences within a group are compared there. Should one
   comparison fail, everything runs again with other hash functions.
2. Anchors with different spans send the bytes of one span for each class. Their window suffixes are sorted by
   mergesort; two suffixes are compared by the longest common extension, found by binary search over prefix polynomial
   hashes. Neighbours that agree in ``WINDOW`` bytes by hash are compared byte by byte before they count as equal.
   An anchor with more than ``Limits.crowded`` spans (the edge of a passage that very many documents hold) is sorted
   within each group first; what is left of it goes window by window, each to the bucket of its own bytes, so that it
   meets in no single task.
3. Decisions return to the groups, which cut the bytes out.

A class comes at most once from each group and a span once for each class, so copies in any number stay cheap, and no
window is sampled away. Buckets are ranges of a hash of the anchor that is independent of its choice, and as many as
keep ``Limits.bucket`` bytes of text in each on average. Groups and buckets both grow with the text, pairs of them by
its square: a pair gets one packed string and costs nothing but that.

Ids must be of an integer type (a ``TypeError`` says so otherwise); they are ordered as integers, nulls last. Defined
results: a null text counts as empty; texts shorter than ``WINDOW`` lose nothing; equal ids do not remove one another's
bytes, so repeated rows are all kept or cut alike; the other columns are carried along under their own names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.memory import give_back, lean
from tarn.llm.windows import anchors, mix, powers, prefix_hashes, substring_hashes
from tarn.plans.materialize import materialize

WINDOW, GRAM = 50, 24
LAST = np.iinfo(np.int64).max
#: So many buckets are used, if there are partitions for them, however little text there is.
BUCKETS = 48


@dataclass(frozen=True)
class Limits:
    """What is held at once; results do not depend on it.

    ``block``: bytes of text in a block (its columns stay well below a megabyte, so that the JVM does not have to treat
    them as huge objects). ``group``: bytes of text whose anchors are sent together. ``chunk``: bytes hashed at once.
    ``decided``, ``sorted``: classes decided and windows sorted at once, unless one anchor has more. ``crowded``: spans
    of an anchor that are compared in one task, at most. ``bucket``: bytes of text whose anchors one bucket takes.
    """

    block: int = 1 << 20
    chunk: int = 1 << 18
    decided: int = 200_000
    sorted: int = 200_000
    crowded: int = 1000
    group: int = 8 << 20
    bucket: int = 32 << 20


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Integers with their bytes transposed, all columns compressed as one: most strings of this operator are short, and
    there is one for each pair of a group and a bucket, so that each call counts."""
    head = np.array([len(columns), *(len(c) for c in columns)], "<i8").tobytes() + "".join(c.dtype.str for c in columns).encode()
    return zstandard.compress(head + b"".join(c.tobytes() if c.dtype.itemsize == 1 else np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns), level)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 11 * n, []
    for k, size in enumerate(np.frombuffer(raw, "<i8", n, 8).tolist()):
        kind = np.dtype(raw[8 + 8 * n + 3 * k : 11 + 8 * n + 3 * k].decode())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        out.append(planes.view(kind) if kind.itemsize == 1 else np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def unpack_all(data: Iterable[bytes], empty: Sequence[str]) -> list[np.ndarray]:
    """The columns of several packed strings, one after another; of none, empty columns of the types ``empty``."""
    found = [unpack(x) for x in data]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in empty]


class Group:
    """A group's occurrences of anchors, and its distinct classes in the order of their hashes."""

    def __init__(self, text: bytes, ends: np.ndarray, keys: np.ndarray, chunk: int = Limits.chunk, seed: int = 0) -> None:
        self.keys = keys
        data = np.frombuffer(text, np.uint8)
        starts = np.r_[0, ends[:-1]] if len(ends) else np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for pieces in self._chunks(starts, ends, chunk):
            part = np.concatenate([data[a:b] for _, a, b in pieces])
            sizes = np.array([b - a for _, a, b in pieces])
            part_ends = np.cumsum(sizes)
            prefix = prefix_hashes(part, seed)
            at, first, last = anchors(prefix, part_ends, GRAM, WINDOW)
            piece = np.searchsorted(part_ends, at, side="right")
            length = last - first + WINDOW
            gram = mix(substring_hashes(prefix, at, GRAM))
            half = mix(substring_hashes(prefix, first, length // 2) + np.uint64(0x632BE59BD9B4E019))
            span = mix(mix(substring_hashes(prefix, first, length)) + half * np.uint64(31) + gram + ((at - first) * 64 + last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            shift = np.array([a for _, a, _ in pieces])[piece] - (part_ends - sizes)[piece]
            # Anchors are chosen for a small hash; a second hash spreads them evenly.
            even = mix(gram * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D))
            found.append(((even >> np.uint64(32)).astype(np.uint32), span, np.array([d for d, _, _ in pieces], np.int32)[piece], first + shift, (last - first + 1).astype(np.int32), (at - first).astype(np.int32)))
        empty = [np.zeros(0, t) for t in (np.uint32, np.uint64, np.int32, np.int64, np.int32, np.int32)]
        gram, span, doc, first, count, lead = [np.concatenate(c) for c in zip(*found, strict=True)] if found else empty
        key = keys[doc] if len(doc) else np.zeros(0, np.int64)
        del found
        order = np.lexsort((key, span, gram))
        self.gram, self.span, self.doc, self.key, self.first, self.count, self.lead = gram[order], span[order], doc[order], key[order], first[order], count[order], lead[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.gram[1:] != self.gram[:-1]) | (self.span[1:] != self.span[:-1])
        self.of_class = np.cumsum(new) - 1
        #: The first occurrence of each class, which has its smallest id.
        self.rep = np.flatnonzero(new)

    @staticmethod
    def _chunks(starts: np.ndarray, ends: np.ndarray, chunk: int) -> Iterator[list[tuple[int, int, int]]]:
        """(document, start, end) pieces of about ``chunk`` bytes; pieces of one text overlap by a window less one."""
        held: list[tuple[int, int, int]] = []
        size = 0
        for doc, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            while b - a >= WINDOW:
                stop = min(b, a + chunk + WINDOW - 1)
                held.append((doc, a, stop))
                size += stop - a
                if size >= chunk:
                    yield held
                    held, size = [], 0
                if stop == b:
                    break
                a = stop - WINDOW + 1
        if held:
            yield held

    def buckets(self, n: int) -> np.ndarray:
        """Where each bucket's classes begin."""
        edges = (np.arange(n + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n)
        return np.searchsorted(self.gram[self.rep].astype(np.uint64), edges)


def _texts(docs: DataFrame, id_col: str, text_col: str, limits: Limits, n: int) -> DataFrame:
    """group, block, size, ends, data, keys and the carried columns as lists of structs; bucketed by group."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, to order documents by")
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(int(LAST))).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_carry"))
    schema = T.StructType.fromDDL("group bigint, block bigint, size bigint, ends binary, data binary, keys binary").add("carry", T.ArrayType(rows.schema["_carry"].dataType))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, group, held = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limits.block, side="left")) + 1
                b = min(b, len(texts))
                own = ends[a:b] - (ends[a - 1] if a else 0)
                if held and held + int(own[-1]) > limits.group:
                    group, held = serial, 0
                carry = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | group]), pa.array([task << 32 | serial]), pa.array([int(own[-1])]), pa.array([pack(own.astype("<i8"))], pa.binary()), pa.array([zstandard.compress(b"".join(texts[a:b]), 3)], pa.binary()), pa.array([pack(batch.column(1).slice(a, b - a).to_numpy().astype("<i8"))], pa.binary()), carry],
                    names=["group", "block", "size", "ends", "data", "keys", "carry"],
                )
                held += int(own[-1])
                serial, a = serial + 1, b

    return materialize(rows.mapInArrow(run, schema), "texts", bucket_by=("group", n))


def _joined(rows: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray, pa.Table]:
    """text, ends, keys of a group's blocks, and the blocks in order."""
    rows = rows.take(pa.array(np.argsort(rows["block"].to_numpy())))
    parts, ends, at = [], [], 0
    for data, own in zip(rows["data"], rows["ends"], strict=True):
        parts.append(zstandard.decompress(data.as_py()))
        ends.append(unpack(own.as_py())[0] + at)
        at += len(parts[-1])
    return b"".join(parts), np.concatenate(ends), unpack_all((k.as_py() for k in rows["keys"]), ["<i8"])[0], rows


ASKED, ASKS = 4, 8


@dataclass
class Decided:
    """What is decided of each class of a bucket.

    ``least``: the smallest id of the class. ``send``: 1 if it must send its span, 2 its windows; ``ASKED`` more if the
    next class of its chain compares itself with it, ``ASKS`` more if it has one before it. ``home``, ``there``: the
    group of the class before it, and the number of that class among what the group sent.
    """

    least: np.ndarray
    send: np.ndarray
    home: np.ndarray
    there: np.ndarray


def _decide_classes(groups: np.ndarray, sizes: np.ndarray, gram: np.ndarray, span: np.ndarray, key: np.ndarray, limits: Limits) -> Decided:
    """One bucket's classes, of each group in turn. The anchors' hashes are taken in ranges of about ``limits.decided``
    classes; no step is taken for each group, as there are ever more of them."""
    part = np.repeat(np.arange(len(groups), dtype=np.int32), sizes)
    place = (np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    out = Decided(np.empty(len(gram), np.int64), np.empty(len(gram), np.uint8), np.empty(len(gram), np.int64), np.empty(len(gram), np.int32))
    low, width = int(gram.min()), int(gram.max()) - int(gram.min()) + 1
    n = min(1 << 16, max(1, len(gram) // limits.decided))
    ranges = ((gram - np.uint32(low)).astype(np.uint64) * np.uint64(n) // np.uint64(width)).astype(np.uint16)
    order = np.argsort(ranges, kind="stable")
    for some in np.split(order, np.cumsum(np.bincount(ranges, minlength=n))[:-1]):
        if not len(some):
            continue
        k = key[some]
        first, before, send = _decide_range(gram[some], span[some], k, limits.crowded)
        before = some[before]
        out.least[some], out.send[some], out.home[some], out.there[some] = k[first], send, groups[part[before]], place[before]
    return out


def _decide_range(gram: np.ndarray, span: np.ndarray, key: np.ndarray, crowded: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class the place of the equal one with the smallest id, of the one before it by id, and ``Part.send``."""
    order = np.lexsort((key, span, gram))
    g, s, k = gram[order], span[order], key[order]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new = new_gram | np.r_[True, s[1:] != s[:-1]]
    group, kind = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    heads, begin = np.flatnonzero(new), np.flatnonzero(new_gram)
    least = k[heads][kind]
    classes = np.add.reduceat(new.astype(np.int64), begin)
    several = np.where((classes > 1) & (np.minimum.reduceat(k, begin) < np.maximum.reduceat(k, begin)), np.where(classes > crowded, 2, 1), 0)
    first, before, send = np.empty(len(order), np.int64), np.empty(len(order), np.int64), np.empty(len(order), np.uint8)
    first[order], before[order] = order[heads][kind], np.r_[order[:1], order[:-1]]
    # Of each class those with its smallest id send a span; larger ids are repeated as a whole.
    send[order] = several[group] * (k == least) | np.where(new, 0, ASKS) | np.where(np.r_[new[1:], True], 0, ASKED)
    return first, before, send


def suffix_order(segment: np.ndarray, start: np.ndarray, prefix: np.ndarray, data: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Order suffixes (first ``length`` bytes) within segments by mergesort with hash comparisons.

    ``segment`` must be sorted. Suffixes of a segment compare by longest common extension: binary search over the
    prefix hashes, then the next byte. All segments merge side by side, runs doubling.
    """
    n = len(segment)
    order = np.arange(n)
    seg_start = np.r_[0, np.flatnonzero(segment[1:] != segment[:-1]) + 1] if n else np.zeros(0, np.int64)
    seg_len = np.diff(np.r_[seg_start, n])
    of = np.repeat(np.arange(len(seg_start)), seg_len)
    inside = np.arange(n) - seg_start[of]
    run = 1
    while len(seg_len) and run < seg_len.max():
        active = np.flatnonzero(seg_len[of] > run)
        at = inside[active]
        pair = at // (2 * run) * 2 * run
        left = at - pair < run
        base, size = seg_start[of[active]], seg_len[of[active]]
        low = base + np.where(left, np.minimum(pair + run, size), pair)
        high = base + np.where(left, np.minimum(pair + 2 * run, size), np.minimum(pair + run, size))
        first = low.copy()
        mine = start[order[active]]
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) // 2
            sign = compare(mine[k], start[order[middle]], prefix, data, length)
            goes_right = np.where(left[k], sign > 0, sign >= 0)
            low[k] = np.where(goes_right, middle + 1, low[k])
            high[k] = np.where(goes_right, high[k], middle)
        rank = np.where(left, at - pair, at - pair - run) + (low - first)
        merged = order.copy()
        merged[base + pair + rank] = order[active]
        order = merged
        run *= 2
    return order


def extension(a: np.ndarray, b: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """The longest common extension of suffixes, at most ``length``, by binary search over hashes."""
    # What of ``substring_hashes`` depends on the start alone is looked up once, not at every step.
    inverse = powers(len(prefix))[1]
    before_a, before_b, scale_a, scale_b = prefix[a], prefix[b], inverse[a], inverse[b]
    low = np.zeros(len(a), np.int64)
    for step in (1 << np.arange(int(length).bit_length())[::-1]).tolist():
        middle = np.minimum(low + step, length)
        same = (prefix[a + middle] - before_a) * scale_a == (prefix[b + middle] - before_b) * scale_b
        low = np.where(same, middle, low)
    return low


def compare(a: np.ndarray, b: np.ndarray, prefix: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """The sign of each comparison of two suffixes' first ``length`` bytes."""
    common = extension(a, b, prefix, length)
    ends = common >= length
    step = np.minimum(common, length - 1)
    return np.where(ends, 0, np.sign(data[a + step].astype(np.int64) - data[b + step].astype(np.int64)))


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray | int, step: int = 1 << 14) -> np.ndarray:
    """Which strings of ``length`` bytes at ``a`` and ``b`` are equal, byte by byte."""
    length = np.broadcast_to(length, len(a))
    out = np.ones(len(a), bool)
    for k in range(0, len(a), step):
        n = length[k : k + step]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        same = data[np.repeat(a[k : k + step], n) + inside] == data[np.repeat(b[k : k + step], n) + inside]
        out[k : k + step] = np.logical_and.reduceat(same, begin) if len(same) else True
    return out


def window_classes(gram: np.ndarray, lead: np.ndarray, count: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(span, number within it, start in ``data``, class) of each window of spans (concatenated in ``data``) that is not
    alone at its distance from its anchor; equal windows are of one class.

    Where verification finds a collision, the sort is done again with another hash function.
    """
    lengths = count + WINDOW - 1
    begin = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(gram)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[of] + number
    # Equal windows stand at an equal distance before their anchor; a segment of one span has nothing to compare.
    distance = lead[of] - number + 64
    order = np.lexsort((distance, gram[of]))
    segment = gram[of][order].astype(np.int64) * 256 + distance[order]
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]), len(segment)]) if len(segment) else np.zeros(0, np.int64)
    some = np.repeat(sizes, sizes) > 1
    order, segment = order[some], segment[some]
    kind = np.zeros(len(order), np.int64)
    for seed in range(4 if len(order) else 0):
        prefix = prefix_hashes(data, seed)
        sort = order[suffix_order(segment, start[order], prefix, data)]
        a, b = start[sort[:-1]], start[sort[1:]]
        same = segment[1:] == segment[:-1]
        same[same] = extension(a[same], b[same], prefix, WINDOW) >= WINDOW
        # Verification: what the hashes call equal is compared byte by byte.
        checked = np.flatnonzero(same)
        same[checked] = _equal(data, a[checked], b[checked], WINDOW)
        kind = np.cumsum(np.r_[True, ~same]) - 1
        if same[checked].all():
            break
    order = sort if len(order) else order
    return of[order], number[order], start[order], kind


def repeated_windows(gram: np.ndarray, key: np.ndarray, lead: np.ndarray, count: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each span (concatenated in ``data``) the bits of its windows that a span with a smaller key has, too."""
    of, number, _, kind = window_classes(gram, lead, count, data)
    mask = np.zeros(len(gram), np.uint64)
    if not len(of):
        return mask
    repeated = key[of] > np.minimum.reduceat(key[of], np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]))[kind]
    np.bitwise_or.at(mask, of[repeated], np.uint64(1) << number[repeated].astype(np.uint64))
    return mask


@dataclass
class Loose:
    """Windows of crowded anchors: span, number within it, hash; and which of them the group itself repeats."""

    of: np.ndarray
    number: np.ndarray
    start: np.ndarray
    hash: np.ndarray
    repeated: np.ndarray


def _loose(gram: np.ndarray, key: np.ndarray, lead: np.ndarray, count: np.ndarray, data: np.ndarray) -> Loose:
    """All windows of the spans in ``data``."""
    lengths = count + WINDOW - 1
    of = np.repeat(np.arange(len(gram)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[of] + number
    masks = repeated_windows(gram, key, lead, count, data)
    hashes = (mix(substring_hashes(prefix_hashes(data), start, WINDOW)) >> np.uint64(32)).astype(np.uint32)
    return Loose(of, number, start, hashes, (masks[of] >> number.astype(np.uint64)) & np.uint64(1) == 1)


def _in_slices(gram: np.ndarray, key: np.ndarray, lead: np.ndarray, count: np.ndarray, data: np.ndarray, most: int) -> np.ndarray:
    """``repeated_windows`` for slices of whole anchors, so that memory does not grow with the bucket."""
    lengths = count + WINDOW - 1
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(gram, kind="stable")
    sizes = np.cumsum(count[order])
    mask = np.zeros(len(gram), np.uint64)
    heads = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1], True])
    at = 0
    while at < len(heads) - 1:
        done = sizes[heads[at] - 1] if heads[at] else 0
        stop = max(at + 1, int(np.searchsorted(sizes[heads[1:] - 1], done + most)))
        mine = order[heads[at] : heads[stop]]
        part = np.concatenate([data[begin[k] : begin[k] + lengths[k]] for k in mine.tolist()])
        mask[mine] = repeated_windows(gram[mine], key[mine], lead[mine], count[mine], part)
        at = stop
    return mask


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition sorted by its first column, one list for each bucket."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def _concatenated(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The strings at ``first``, one after another."""
    begin = np.cumsum(length) - length
    return text[np.repeat(first - begin, length) + np.arange(int(length.sum()))]


#: What a row of the step between the two shuffles is: for its own group what is repeated, and where classes stand that
#: others are compared with; for another group bytes to compare; a comparison that failed. From 0 on it is a bucket.
COVER, HOME, CLAIM, FAILED = -1, -2, -3, -4
STEP = "group bigint, bucket int, packed binary"


def _step(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["group", "bucket", "packed"])


def _cover(rows: pa.Table, found: pa.Table, n_buckets: int, limits: Limits, seed: int) -> pa.Table:
    """The spans repeated as a whole, and what must be compared: spans by bucket, whole classes by the group to ask."""
    text, ends, keys, _ = _joined(rows)
    b = Group(text, ends, keys, limits.chunk, seed)
    data = np.frombuffer(text, np.uint8)
    edges, own = b.buckets(n_buckets), b.key[b.rep]
    # The buckets' answers, one after another, are in the order of the classes.
    answers = found["packed"].take(pa.array(np.argsort(found["bucket"].to_numpy()))).to_pylist()
    delta, send, homes, places = unpack_all(answers, ["<i8", "|u1", "<i8", "<i4"])
    least, asks = own - delta, np.flatnonzero(send & ASKS)
    home, there = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    home[asks], there[asks] = homes, places | np.searchsorted(edges, asks, side="right") - 1 << 32
    me = int(rows["group"][0].as_py())
    out: list[tuple[int, int, bytes]] = []

    whole = b.key > least[b.of_class]
    rep = b.rep[b.of_class]
    more = np.flatnonzero(np.arange(len(rep)) != rep)
    alike = (b.count[more] == b.count[rep[more]]) & (b.lead[more] == b.lead[rep[more]])
    alike[alike] = _equal(data, b.first[more[alike]], b.first[rep[more[alike]]], b.count[more[alike]] + WINDOW - 1)
    if not alike.all():
        out.append((me, FAILED, b""))
    # Bytes for others to compare, in the order of the text: neighbours overlap, and compress for it.
    asks = asks[np.lexsort((b.first[b.rep[asks]], home[asks]))]
    for some in np.split(asks, np.flatnonzero(np.diff(home[asks])) + 1) if len(asks) else []:
        r = b.rep[some]
        out.append((int(home[some[0]]), CLAIM, pack(there[some].astype("<i8"), (b.lead[r] * 64 + b.count[r]).astype("<i4"), _concatenated(data, b.first[r], b.count[r].astype(np.int64) + WINDOW - 1))))
    homes = np.flatnonzero(send & ASKED)
    if len(homes):
        bucket = np.searchsorted(edges, homes, side="right") - 1
        r = b.rep[homes]
        out.append((me, HOME, pack((homes - edges[bucket] | bucket << 32).astype("<i8"), (b.lead[r] * 64 + b.count[r]).astype("<i4"), b.first[r].astype("<i8"))))
    send = send & 3

    steps = np.zeros(len(text) + 1, np.int32)
    np.add.at(steps, b.first[whole], 1)
    np.add.at(steps, b.first[whole] + b.count[whole] + WINDOW - 1, -1)
    crowd = np.flatnonzero(send == 2)
    r = b.rep[crowd]
    loose = _loose(b.gram[r], b.key[r], b.lead[r], b.count[r], _concatenated(data, b.first[r], b.count[r].astype(np.int64) + WINDOW - 1))
    for number in np.unique(loose.number[loose.repeated]):
        kinds = np.zeros(len(own), bool)
        kinds[crowd[loose.of[loose.repeated & (loose.number == number)]]] = True
        starts = b.first[kinds[b.of_class] & ~whole] + number
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + WINDOW, -1)
    runs = np.flatnonzero(np.diff(np.r_[False, np.cumsum(steps, dtype=np.int32) > 0])).astype("<i8")
    # Places of the classes that are compared, in the documents with the smallest id.
    places = np.flatnonzero((send[b.of_class] > 0) & ~whole)
    out.append((me, COVER, pack(runs, b.of_class[places].astype("<i8"), b.first[places].astype("<i8"))))

    # Spans and loose windows as one list: class, first, windows, lead, number within the class, hash.
    spans, alone = np.flatnonzero(send == 1), np.flatnonzero(~loose.repeated)
    kind = np.r_[spans, crowd[loose.of[alone]]]
    number = np.r_[np.zeros(len(spans), np.int64), loose.number[alone]]
    count = np.r_[b.count[b.rep[spans]], np.ones(len(alone), np.int64)].astype(np.int64)
    gram = np.r_[b.gram[b.rep[spans]], loose.hash[alone]]
    to = np.r_[np.searchsorted(edges, spans, side="right") - 1, loose.hash[alone].astype(np.int64) * n_buckets >> 32]
    order = np.argsort(to, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
        r = b.rep[kind[some]]
        shape = (b.lead[r] - number[some]) * 64 + count[some] + (number[some] << 12)
        spelled = _concatenated(data, b.first[r] + number[some], count[some] + WINDOW - 1)
        out.append((me, int(to[some[0]]), pack(gram[some].astype("<u4"), kind[some].astype("<i8"), b.key[r].astype("<i8"), shape.astype("<i4"), spelled, level=3)))
    give_back()
    return _step(out)


def _portions(packed: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Strings of about ``most`` bytes together."""
    ends = np.cumsum([len(x) for x in packed])
    cuts = np.flatnonzero(np.diff(ends // most)) + 1 if len(packed) else []
    for some in np.split(np.arange(len(packed)), cuts):
        if len(some):
            yield packed[some[0] : some[-1] + 1]


def _verify(rows: pa.Table, found: pa.Table, limits: Limits) -> pa.Table:
    """A row if what another group takes for this group's bytes is something else."""
    text, _, _, _ = _joined(rows)
    data = np.frombuffer(text, np.uint8)
    kinds, packed = found["bucket"].to_numpy(), found["packed"]
    where, shape, first = unpack_all(packed.filter(pa.array(kinds == HOME)).to_pylist(), ["<i8", "<i4", "<i8"])
    order = np.argsort(where)
    where, shape, first = where[order], shape[order], first[order]
    failed = False
    # Many claims at a time: there is one from each other group, ever more of them and ever smaller ones.
    for some in _portions(packed.filter(pa.array(kinds == CLAIM)).to_pylist(), limits.chunk):
        there, same, theirs = unpack_all(some, [])
        at = np.searchsorted(where, there)
        failed |= not (shape[at] == same).all() or not np.array_equal(_concatenated(data, first[at], (same & 63).astype(np.int64) + WINDOW - 1), theirs)
    give_back()
    return pa.table({"failed": pa.array([True] * failed, pa.bool_())})


def _united(kind: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct kinds in order, and all bits of each."""
    order = np.argsort(kind, kind="stable")
    kind, bits = kind[order], bits[order]
    heads = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else order
    return kind[heads], np.bitwise_or.reduceat(bits, heads) if len(kind) else bits


def _cut(rows: pa.Table, found: pa.Table, whole_characters: bool) -> pa.Table:
    text, ends, _, rows = _joined(rows)
    carry = rows["carry"].combine_chunks().flatten()
    steps = np.zeros(len(text) + 1, np.int32)
    is_cover = found["bucket"].to_numpy() == COVER
    runs, kinds, places = unpack_all(found["packed"].filter(pa.array(is_cover)).to_pylist(), ["<i8"] * 3)
    np.add.at(steps, runs[::2], 1)
    np.add.at(steps, runs[1::2], -1)
    # All buckets' answers at once: there are ever more of them, and the group's places are gone through each time.
    kind, mask = _united(*unpack_all(found["packed"].filter(pa.array(~is_cover)).to_pylist(), ["<i8", "<u8"]))
    if len(kind):
        at = np.clip(np.searchsorted(kind, kinds), 0, len(kind) - 1)
        hit = kind[at] == kinds
        first, bits = places[hit], mask[at[hit]]
        for n in range(64):
            start = first[(bits >> np.uint64(n)) & np.uint64(1) == 1] + n
            np.add.at(steps, start, 1)
            np.add.at(steps, start + WINDOW, -1)
    gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
    spans, kept, begin = [], [], 0
    for end in ends.tolist():
        runs = np.flatnonzero(np.diff(np.r_[False, gone[begin:end], False]))
        spans.append([{"start": a, "stop": b} for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True)])
        edges = [0, *runs.tolist(), end - begin]
        pieces = [text[begin + a : begin + b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        kept.append(b"".join(p.decode("utf-8", "ignore").encode() if whole_characters and len(runs) else p for p in pieces))
        begin = end
    sizes = np.diff(np.r_[0, ends])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    out = pa.table([carry, pa.array(sizes), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=["carry", "n_bytes", "spans", "kept"])
    give_back()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), whole_characters: bool = False) -> DataFrame:
    """The other columns of ``docs``, n_bytes, spans (array of start, stop: removed bytes) and kept (binary).

    ``whole_characters``: kept is without what a cut leaves of a character that it splits.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, id_col, text_col, limits, n)
    size = texts.agg(F.sum("size")).first()[0] or 0
    # No more than the text needs: each group sends to each bucket, so their number counts by its square.
    n_buckets = max(min(n, BUCKETS), -(-size // limits.bucket))
    seed = 0
    while (steps := _steps(texts, n, n_buckets, limits, seed)) is None:
        seed += 1

    @lean
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            found = [unpack(r[1]) for r in rows]
            group = np.repeat([r[0] for r in rows], [len(f[0]) for f in found])
            gram, kind, key, shape, data = (np.concatenate(c) for c in zip(*found, strict=True))
            del rows, found
            mask = _in_slices(gram, key, (shape & 4095) // 64, shape & 63, data, limits.sorted) << (shape >> 12).astype(np.uint64)
            hit = np.flatnonzero(mask)
            hit = hit[np.argsort(group[hit], kind="stable")]
            parts = np.split(hit, np.flatnonzero(np.diff(group[hit])) + 1) if len(hit) else []
            yield pa.RecordBatch.from_arrays([pa.array([group[h[0]] for h in parts], pa.int64()), pa.array([pack(*_united(kind[h], mask[h])) for h in parts], pa.binary())], names=["group", "packed"])

    spans = steps.where("bucket >= 0").select("bucket", "group", "packed")
    masks = _to_bucket(spans, n).mapInArrow(resolve, "group bigint, packed binary")
    both = steps.where(F.col("bucket") == COVER).unionByName(masks.select("group", F.lit(0).alias("bucket"), "packed"))
    schema = T.StructType().add("carry", texts.schema["carry"].dataType.elementType)
    for f in T.StructType.fromDDL("n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"):
        schema.add(f)
    final = texts.groupBy("group").cogroup(both.groupBy("group")).applyInArrow(lambda rows, found: _cut(rows, found, whole_characters), schema)
    return final.select("carry.*", "n_bytes", "spans", "kept")


def _to_bucket(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly by bucket, sorted by it."""
    return rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")


def _steps(texts: DataFrame, n: int, n_buckets: int, limits: Limits, seed: int) -> DataFrame | None:
    """What the groups do once equal spans are decided, written; None if a comparison of bytes has failed."""

    def classes(rows: pa.Table) -> pa.Table:
        text, ends, keys, _ = _joined(rows)
        b = Group(text, ends, keys, limits.chunk, seed)
        edges, rep = b.buckets(n_buckets), b.rep
        sent = [(k, rep[edges[k] : edges[k + 1]]) for k in range(n_buckets) if edges[k] < edges[k + 1]]
        columns = [pa.array([k for k, _ in sent], pa.int32()), pa.array([rows["group"][0].as_py()] * len(sent), pa.int64())]
        columns.append(pa.array([pack(b.gram[r].astype("<u4"), b.span[r].astype("<u8"), b.key[r].astype("<i8")) for _, r in sent], pa.binary()))
        give_back()
        return pa.table(columns, names=["bucket", "group", "packed"])

    @lean
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            groups = np.array([group for group, _ in rows], np.int64)
            found = [unpack(packed) for _, packed in rows]
            sizes = np.array([len(f[0]) for f in found])
            gram, span, key = (np.concatenate(c) for c in zip(*found, strict=True))
            del rows, found
            of = _decide_classes(groups, sizes, gram, span, key, limits)
            delta, asks = key - of.least, of.send & ASKS > 0
            ends = np.cumsum(sizes).tolist()
            parts = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            answers = [pack(delta[p], of.send[p], of.home[p][asks[p]], of.there[p][asks[p]]) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array([bucket] * len(groups), pa.int32()), pa.array(answers, pa.binary())], names=["group", "bucket", "packed"])

    def cover(rows: pa.Table, found: pa.Table) -> pa.Table:
        return _cover(rows, found, n_buckets, limits, seed)

    def verify(rows: pa.Table, found: pa.Table) -> pa.Table:
        return _verify(rows, found, limits)

    read = texts.select("group", "block", "ends", "data", "keys")
    sent = read.groupBy("group").applyInArrow(classes, "bucket int, group bigint, packed binary")
    decided = _to_bucket(sent, n).mapInArrow(decide, "group bigint, bucket int, packed binary")
    steps = materialize(read.groupBy("group").cogroup(decided.groupBy("group")).applyInArrow(cover, STEP), "steps")
    claims = steps.where(F.col("bucket").isin(HOME, CLAIM))
    wrong = read.groupBy("group").cogroup(claims.groupBy("group")).applyInArrow(verify, "failed boolean")
    if steps.where(F.col("bucket") == FAILED).isEmpty() and not wrong.agg(F.count("*")).first()[0]:
        return steps
    return None
