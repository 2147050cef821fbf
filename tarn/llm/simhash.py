"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits hold two 23-bit blocks, each covered by the perfect binary Golay code: every block value lies
within 3 bits of exactly one of 4096 code words, so pairs of code words are anchors of covering radius 6 over 46 bits.
Two fingerprints at t or fewer differing bits have a midpoint within ceil(t/2) of both; the midpoint's own anchor is
within covering radius plus ceil(t/2) of both. Each distinct fingerprint is therefore replicated to every anchor within
that distance (counted block by block: the excess over radius 3 sums to at most ceil(t/2); about 61 anchors for t = 4),
and fingerprints are compared in full at each anchor. No linked pair is missed and no pair is linked unchecked.

Equal fingerprints are one class before any replication. Members of an anchor with more than ``CAP`` of them meet by
bands: two fingerprints at t or fewer differing bits agree in one of t + 1 bands of their 64 bits at least, so each
member goes once to each of its bands' values, and only members of one value are compared. What is still crowded then
(near copies of one text) is dealt out by pairs of member blocks, so no task holds more than two blocks. Each group
sends on a spanning forest of its links, not all pairs, and the links are joined into components without the driver.

Defined results: a null text counts as empty, and an empty one has fingerprint 0, linked like any other; a null id is
never the smallest id of a component unless all ids in it are null; repeated rows are returned as often as they come;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.memory import lean
from tarn.llm.components import connected_components
from tarn.plans.materialize import materialize

SHINGLE, SEED = 4, 42
#: Differing bits at which fingerprints link, at most.
THRESHOLD = 4
#: Members of an anchor that one task compares with one another, at most.
CAP = 4096
#: Rows of a table of crowded anchors that may be broadcast; a larger one is joined by shuffle.
MAX_BROADCAST = 1_000_000
#: The binary Golay code: length, generator polynomial, covering radius (fixed values).
LENGTH, GENERATOR, RADIUS = 23, 0xC75, 3


def fingerprint(text: bytes | None) -> bytes:
    """The eight bytes of a text's SimHash over word shingles."""
    words = (text or b"").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= 1:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)])
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8, min(n - k, 1 << 14) * 8, k * 8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("_text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp bigint"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(fingerprint(t.as_py()) for t in batch.column(1))
            values = np.frombuffer(fps, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[id_col, "fp"])

    return rows.mapInArrow(run, schema)


@cache
def _golay(excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; by syndrome, the error patterns within ``excess`` and their excess."""

    def syndrome(x: int) -> int:
        for bit in range(LENGTH - 1, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    single = [syndrome(1 << b) for b in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for b in range(12):
        low[np.arange(1 << 12) >> b & 1 == 1] ^= single[b]
    for b in range(11):
        high[np.arange(1 << 11) >> b & 1 == 1] ^= single[12 + b]
    lists: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + excess + 1):
        for bits in combinations(range(LENGTH), weight):
            pattern = s = 0
            for b in bits:
                pattern |= 1 << b
                s ^= single[b]
            lists[s].append((max(0, weight - RADIUS), pattern))
    width = max(map(len, lists))
    patterns, over = np.zeros((1 << 11, width), np.int64), np.full((1 << 11, width), 50, np.int8)
    for s, found in enumerate(lists):
        over[s, : len(found)] = [e for e, _ in found]
        patterns[s, : len(found)] = [p for _, p in found]
    return low, high, patterns, over


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fps``, anchor) for every anchor of every fingerprint."""
    excess = -(-threshold // 2)
    low, high, patterns, over = _golay(excess)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(fps), 2048):
        x = fps[at : at + 2048].astype(np.int64)
        blocks = [x & (1 << LENGTH) - 1, x >> LENGTH & (1 << LENGTH) - 1]
        s = [low[b & 4095] ^ high[b >> 12] for b in blocks]
        i, j, k = np.nonzero(over[s[0]][:, :, None] + over[s[1]][:, None, :] <= excess)
        words = (blocks[0][i] ^ patterns[s[0][i], j]) | (blocks[1][i] ^ patterns[s[1][i], k]) << LENGTH
        found.append((i + at, words))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(run: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal ``run`` (sorted): pairs of fingerprints."""
    n = len(fp)
    fp = np.ascontiguousarray(fp)
    label, us, vs = np.arange(n), [], []
    left = np.arange(n)
    delta = 0
    while len(left):
        delta += 1
        left = left[left + delta < n]
        left = left[run[left] == run[left + delta]]
        near = left[np.bitwise_count((fp[left] ^ fp[left + delta]).view(np.uint64)) <= threshold]
        near = near[label[near] != label[near + delta]]
        if not len(near):
            continue
        root = dict[int, int]()

        def find(a: int, root: dict[int, int] = root) -> int:
            while a in root:
                a = root[a]
            return a

        for i in near.tolist():
            a, b = find(int(label[i])), find(int(label[i + delta]))
            if a != b:
                root[max(a, b)] = min(a, b)
                us.append(i)
                vs.append(i + delta)
        olds = np.fromiter(root, np.int64, len(root))
        news = np.fromiter((find(o) for o in root), np.int64, len(root))
        order = np.argsort(olds)
        at = np.clip(np.searchsorted(olds[order], label), 0, len(olds) - 1)
        hit = olds[order][at] == label
        label[hit] = news[order][at[hit]]
    return fp[np.array(us, int)], fp[np.array(vs, int)]


def _links_of_runs(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Compares within runs of a sorted partition; a run has at most two blocks of members."""
    held: list[np.ndarray] = []

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        key = np.cumsum(np.r_[False, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, int)
        u, v = forest(key, rows[:, 1], threshold)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1))
        rows = np.concatenate(held)
        if not len(rows):
            continue
        last = int(np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])[-1])
        held = [rows[last:]]
        if last:
            yield emit(rows[:last])
    if held:
        yield emit(np.concatenate(held))


def _crowded(members: DataFrame, keys: list[str], cap: int, name: str) -> tuple[DataFrame, bool]:
    """The groups of more than ``cap`` members, written, and whether there are few enough to broadcast."""
    crowded = materialize(members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > cap), name)
    return crowded, crowded.count() <= MAX_BROADCAST


def _banded(members: DataFrame, threshold: int, cap: int) -> DataFrame:
    """anchor, band, fp: the members of crowded anchors once for each band, with the band's number and value."""
    crowded, few = _crowded(members, ["anchor"], cap, "crowded")
    if crowded.isEmpty():
        return members.select("anchor", F.lit(-1).cast("bigint").alias("band"), "fp")
    n = threshold + 1
    edges = [64 * k // n for k in range(n + 1)]
    values = [F.shiftrightunsigned(F.shiftleft("fp", 64 - edges[k + 1]), 64 - (edges[k + 1] - edges[k])) * n + k for k in range(n)]
    marked = members.join(F.broadcast(crowded) if few else crowded, "anchor", "left")
    bands = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(*values))
    return marked.select("anchor", F.explode(bands).alias("band"), "fp")


def _dealt(members: DataFrame, cap: int) -> DataFrame:
    """anchor, band, pair, fp: groups of several blocks as pairs of blocks (i <= j); a member of block b joins every pair with b."""
    crowded, few = _crowded(members, ["anchor", "band"], cap, "dense")
    if crowded.isEmpty():
        return members.select("anchor", "band", F.lit(0).cast("bigint").alias("pair"), "fp")
    blocks = F.coalesce(F.ceil(F.col("n") / cap), F.lit(1)).cast("bigint")
    marked = members.join(F.broadcast(crowded) if few else crowded, ["anchor", "band"], "left").withColumn("s", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("s")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s") - 1)).alias("o")
    pair = (F.least("b", "o") * F.col("s") + F.greatest("b", "o")).alias("pair")
    return marked.select("anchor", "band", "fp", "s", "b", others).select("anchor", "band", pair, "fp")


def linked_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD, cap: int = CAP) -> DataFrame:
    """(u, v): links that span the components of the distinct fingerprints of column fp."""

    @lean
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                i, a = anchors(fps[at : at + 4096], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(fps[at : at + 4096][i])], names=["anchor", "fp"])

    # Fingerprints are small and make many rows each: dealt out by number of partitions, not by bytes.
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = spread.mapInArrow(replicate, "anchor bigint, fp bigint")
    keyed = _dealt(_banded(members, threshold, cap), cap)
    run = F.xxhash64("anchor", "band", "pair").alias("run")
    # Runs of one hash are compared together: more pairs than need be in the rare case that two groups share it.
    grouped = keyed.select(run, "fp").repartition("run").sortWithinPartitions("run")
    return grouped.mapInArrow(lambda it: _links_of_runs(it, threshold), "u bigint, v bigint").distinct()


def _roots(classes: DataFrame, threshold: int) -> DataFrame:
    """``classes`` (fp, ...) with the smallest fingerprint of each one's component as ``root``."""
    roots = connected_components(linked_fingerprints(classes, threshold))
    return classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, fp, component): ``component`` is the smallest id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    rooted = _roots(classes, threshold)
    # Written, so that the join has a shuffle of its own, which adaptive execution splits where a component is large.
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    found = rooted.join(least, "root").select("fp", "component")
    return rows.join(found, "fp").select(id_col, "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the smallest id (nulls last)."""
    docs_columns = list(docs.columns)
    carried = F.struct(*[F.col(f"`{c}`") for c in docs_columns]).alias("row")
    rows = docs.select(carried)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(docs_columns.index(text_col)).cast(pa.binary())
            fps = b"".join(fingerprint(t.as_py()) for t in texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=["row", "fp"])

    # Written once: the row numbers must not change between the choice and the join.
    marked = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())])).withColumn("uid", F.monotonically_increasing_id())
    table = materialize(marked, "fingerprints")
    first = F.min(F.struct(F.col(f"row.`{id_col}`").isNull().alias("unknown"), F.col(f"row.`{id_col}`").alias("id"), "uid")).alias("first")
    rooted = _roots(table.groupBy("fp").agg(first), threshold)
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return table.join(winners, "uid", "left_semi").select("row.*")
