"""Per-document sums over a corpus-wide vocabulary, without a row for each document and word.

``count_blocks`` deals documents into blocks (about ``BLOCK_BYTES`` of text each). A block has one dictionary of its
distinct types, dealt by a hash into buckets, and one compact table of document x type frequencies. Only the
dictionaries meet across blocks, bucket by bucket; the values found for a block's types return to the block, where one
sparse product gives every document's sums. A type comes at most once from each block, however frequent it is.

Types are bytes without white space of ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.memory import lean
from tarn.plans.materialize import materialize

BLOCK_BYTES = 24 << 20
#: Rows of the block table: dictionary parts and document tables.
PART, DOCS = 0, 1

Analyse = Callable[[bytes], tuple[dict[bytes, int], tuple[int, ...]]]


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, bytes transposed so that small values compress."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(raw.tobytes(), 1)


def unpack_ints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def pack_types(types: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(types), 1)


def unpack_types(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n")


def count_blocks(docs: DataFrame, analyse: Callable[[], Analyse], extras: list[str], id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[bytes], int] = zlib.crc32, hash_bits: int = 32, train: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written block table: block, kind, bucket, data, counts, ends, ids and one array for each of ``extras``.

    ``analyse()`` is called once in each task and gives a function from a text's bytes to (type frequencies, extras).
    ``hash_of``: a 32-bit hash of a type, whose first ``hash_bits`` bits choose the bucket; a bucket is a range of them.
    ``train``: the rows whose type frequencies the counts of
    a dictionary part sum up (all, if not given).
    """
    spark = docs.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train") if train is not None else F.lit(True).alias("_train"))
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"block bigint, kind int, bucket int, data binary, counts binary, ends binary, ids array<{id_type}>" + "".join(f", {e} array<bigint>" for e in extras)
    names = ["block", "kind", "bucket", "data", "counts", "ends", "ids", *extras]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, look = TaskContext.get().partitionId(), 0, analyse()
        held: list[tuple] = []
        known: dict[bytes, int] = {}
        size = 0

        def flush(id_arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal held, known, size, serial
            block = task << 24 | serial
            types = list(known)
            bucket = (np.fromiter(map(hash_of, types), np.int64, len(types)) >> 32 - hash_bits) * n_buckets >> hash_bits
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(types), np.int64)
            place[order] = np.arange(len(types))
            learned = np.zeros(len(types), np.int64)
            for _, idx, cnt, _, trains in held:
                if trains:
                    learned[idx] += cnt
            parts = []
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in range(n_buckets):
                if edges[b] < edges[b + 1]:
                    mine = order[edges[b] : edges[b + 1]]
                    parts.append((b, pack_types([types[k] for k in mine]), pack_ints(learned[mine])))
            deltas, counts, ends, at = [], [], [], 0
            for _, idx, cnt, _, _ in held:
                where = place[idx]
                o = np.argsort(where)
                deltas.append(np.diff(where[o], prepend=0))
                counts.append(cnt[o])
                at += len(idx)
                ends.append(at)
            join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            n = len(parts)
            listed = lambda values, kind: pa.array([None] * n + [values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([PART] * n + [DOCS], pa.int32()),
                    pa.array([b for b, _, _ in parts] + [-1], pa.int32()),
                    pa.array([d for _, d, _ in parts] + [pack_ints(join(deltas))], pa.binary()),
                    pa.array([c for _, _, c in parts] + [pack_ints(join(counts))], pa.binary()),
                    pa.array([None] * n + [pack_ints(np.array(ends, np.int64))], pa.binary()),
                    listed([h[0] for h in held], id_arrow),
                    *[listed([h[3][k] for h in held], pa.int64()) for k in range(len(extras))],
                ],
                names=names,
            )
            held, known, size, serial = [], {}, 0, serial + 1

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for doc, value, trains in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = value.as_py()
                found, more = look(text)
                idx = np.fromiter((known.setdefault(t, len(known)) for t in found), np.int64, len(found))
                held.append((doc, idx, np.fromiter(found.values(), np.int64, len(found)), more, trains))
                size += len(text) + 64
                if size >= block_bytes:
                    yield from flush(id_arrow)
        if held:
            yield from flush(id_arrow)

    return materialize(rows.mapInArrow(run, schema), "blocks")


def parts_by_bucket(blocks: DataFrame) -> DataFrame:
    """The dictionary parts, dealt so that equal buckets meet, in the order of their buckets."""
    return blocks.where(F.col("kind") == PART).select("bucket", "block", "data").repartition("bucket").sortWithinPartitions("bucket")


def sum_by_document(blocks: DataFrame, values: DataFrame, combine: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], outputs: str, extras: list[str], id_col: str = "doc_id") -> DataFrame:
    """Bring ``values`` (block, bucket, value binary: float64 rows in the order of the part's types) back to the blocks.

    ``combine(values of each pair's type, pair frequencies, pair's document number)`` gives one array for each column
    of ``outputs`` (a DDL string), by pairs; they are summed over each document.
    """
    tables = blocks.where(F.col("kind") == DOCS).select("block", "data", "counts", "ends", "ids", *extras)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {id_type}" + "".join(f", {e} bigint" for e in extras) + f", {outputs}"
    names = [id_col, *extras, *[x.split()[0] for x in outputs.split(", ")]]
    kinds = [pa.float64() if x.split()[1] == "double" else pa.int64() for x in outputs.split(", ")]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        parts = sorted(zip(found["bucket"].to_pylist(), found["value"].to_pylist(), strict=True))
        values = np.concatenate([np.frombuffer(zstandard.decompress(v), "<f8") for _, v in parts]) if parts else np.zeros(0)
        row = docs.to_pylist()[0]
        ends = unpack_ints(row["ends"])
        lengths = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(len(ends)), lengths)
        deltas, counts = unpack_ints(row["data"]), unpack_ints(row["counts"])
        running = np.cumsum(deltas)
        base = np.r_[0, running][np.r_[0, ends[:-1]]] if len(ends) else np.zeros(0, np.int64)
        index = running - np.repeat(base, lengths)
        width = len(values) // max(1, int(index.max()) + 1 if len(index) else 1)
        pairs = values.reshape(-1, width)[index] if len(index) else np.zeros((0, max(1, width)))
        sums = [np.bincount(of, weights=x, minlength=len(ends)) for x in combine(pairs, counts, of)]
        columns = [docs["ids"].combine_chunks().flatten(), *[docs[e].combine_chunks().flatten() for e in extras]]
        columns += [pa.array(s if k == pa.float64() else np.rint(s).astype(np.int64)) for s, k in zip(sums, kinds, strict=True)]
        return pa.table(columns, names=names)

    return tables.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)
