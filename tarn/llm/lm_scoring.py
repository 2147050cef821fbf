"""Language-model scores by online logistic context mixing.

A document is coded as its class, its lower-cased words and one end. Each token is coded bit by bit, and each bit's
probability is a gated logistic mix of predictions from several contexts, refined by an adaptive map:

- A bit tells known words from new ones. A known word is a path of bits of its hash (``lm_paths``), predicted by the
  counts of training tokens below the node in all documents, in documents of the kind, and there after words of the
  previous word's class. So the order of words matters.
- A new word is spelled: its bytes' bits are predicted by hashed contexts (the word's last bytes, its beginning, the
  document's kind) from the spellings of all known words.

While a document is scored, what it has said adapts the model: after words of one class, the words that the document
has used there before gain on the model, which weighs as much as ``ALPHA`` words. A document whose class misleads is
told by its own words, too: its probability is the mean of this model's and of plain word frequencies'.

Weights and maps are learned online, one mini-batch after another, on all training words, each taken out of the counts
for its own bits; every partition learns its own and the means by use are taken.

A document's class is its commonest word, hashed to 6 bits; classes with like frequent words are one kind (``KINDS``,
mostly one for each language). The class is coded with the document, so the score is the log10 probability of a complete
code.

Without that, a token's probability depends only on the word, the class and the previous word's class (a hash of it).
It is computed once for each distinct triple and brought to the documents by ``vocabulary``; counts of all training
tokens meet there by hash.

Bounds: counts of words grow with the corpus, in tasks. What all tasks hold is bounded: the counts of the first
``lm_paths.TOP`` bits by context (some 10 MB) and the spelling tables, which have an entry for each distinct training
word, ``SLOTS`` at least and ``MAX_SLOTS`` at most, in powers of two (2 bytes in each of five tables, 4 while they are
learned: 170 MB at most). Counts have no end; states hold their odds and evidence.

Defined results: a null text counts as empty and scores its end alone; a null id is hashed as the empty text and so
falls into training or not; repeated rows are scored one by one; without training rows every probability falls back
to the untrained model; bits_per_byte is null for an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import lm_paths, vocabulary
from tarn.llm.lm_paths import CLASSES, KINDS, PREVIOUS, TOP, PathMixer, codes_of, context_ids, path_ends, word_hash
from tarn.llm.memory import give_back, lean
from tarn.llm.vocabulary import DOCS, PART, sum_by_document, unpack_ints, unpack_types
from tarn.plans.materialize import materialize

#: How many words that a document has used weigh as much as the model.
ALPHA = 1000.0
#: Entries of each spelling context's table, at least and at most.
SLOTS, MAX_SLOTS = 1 << 20, 1 << 23
ORDERS = 5
END = b"\xff"
#: Table entries in one row of the shuffled tables.
SLICE = 1 << 16
LEVELS = 24
#: Weight that is added up in single precision before it is passed on.
EXACT = float(1 << 23)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


class Words(dict):
    """Numbers of words, from 1 on (0 is the end); ``marks``: the class that each word gives to the one after it."""

    def __init__(self) -> None:
        super().__init__({END: 0})
        self.every, self._marks, self._marked = [END], np.zeros(1 << 12, np.int64), 1

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.every)
        self.every.append(word)
        return found

    @property
    def marks(self) -> np.ndarray:
        n = len(self.every)
        if n > len(self._marks):
            self._marks = np.concatenate([self._marks, np.zeros(n, np.int64)])
        if n > self._marked:
            self._marks[self._marked : n] = np.fromiter(map(zlib.crc32, self.every[self._marked : n]), np.int64, n - self._marked) % PREVIOUS
            self._marked = n
        return self._marks


def analyse(raw: bytes, known: Words) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(class, words with the class of the word before, how often, tokens) of a text; each word as its number times
    ``PREVIOUS`` and that class."""
    words = raw.lower().split()
    numbers = np.zeros(len(words) + 1, np.int64)
    numbers[:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    before = np.zeros(len(words) + 1, np.int64)
    before[1:] = known.marks[numbers[:-1]]
    keys, counts = np.unique(numbers * PREVIOUS + before, return_counts=True)
    kind = 0
    if words:
        own = keys[1:] // PREVIOUS if keys[0] < PREVIOUS else keys // PREVIOUS
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        times = np.add.reduceat(counts[len(keys) - len(own) :], starts)
        # Of the commonest words the first by its bytes: ties are not left to the order of words.
        top = min(known.every[k] for k in own[starts[times == times.max()]].tolist())
        kind = zlib.crc32(top) % CLASSES
    return kind, keys, counts, len(words) + 1


#: Codes of a class and the class of the word before.
CODES = CLASSES * PREVIOUS


def text_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column, block_bytes: int) -> DataFrame:
    """The written block table as ``vocabulary`` lays it out, of types that are words in their contexts.

    A part has the words of its bucket in ``data``, its types (place among these words times ``CODES`` and their code)
    in ``entries`` and their training tokens in ``counts``.
    """
    n_buckets = min(1 << TOP, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    id_type = rows.schema[id_col].dataType.simpleString()
    extras = ["n_tokens", "n_bytes"]
    schema = f"block bigint, kind int, bucket int, data binary, counts binary, entries binary, ends binary, ids array<{id_type}>" + "".join(f", {e} array<bigint>" for e in extras)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        known = Words()

        def flush(id_arrow: pa.DataType) -> pa.RecordBatch:
            nonlocal held, known, size, serial
            block = task << 24 | serial
            lengths = np.array([len(h[2]) for h in held])
            of = np.repeat(np.arange(len(held)), lengths)
            # A type: word, class, class of the word before.
            keys = np.concatenate([h[2] // PREVIOUS * CODES + h[1] * PREVIOUS + h[2] % PREVIOUS for h in held])
            counts = np.concatenate([h[3] for h in held])
            types, at = np.unique(keys, return_inverse=True)
            learned = np.bincount(at, weights=counts * np.repeat([h[5] for h in held], lengths), minlength=len(types)).astype(np.int64)
            bucket_of = (np.fromiter(map(word_hash, known.every), np.int64, len(known.every)) >> 32 - TOP) * n_buckets >> TOP
            word = types // CODES
            bucket = bucket_of[word]
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(types), np.int64)
            place[order] = np.arange(len(types))
            parts = []
            for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                own, local = np.unique(word[mine], return_inverse=True)
                parts.append((int(bucket[mine[0]]), vocabulary.pack_types([known.every[k] for k in own.tolist()]), vocabulary.pack_ints(learned[mine]), vocabulary.pack_ints(local * CODES + types[mine] % CODES)))
            # Of each document its types' places in order, as steps.
            where = place[at]
            by_place = np.argsort(of * len(types) + where)
            steps = np.diff(where[by_place], prepend=0)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            steps[starts] = where[by_place][starts]
            n = len(parts)
            listed = lambda values, kind: pa.array([None] * n + [values], pa.list_(kind))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([PART] * n + [DOCS], pa.int32()),
                    pa.array([p[0] for p in parts] + [-1], pa.int32()),
                    pa.array([p[1] for p in parts] + [vocabulary.pack_ints(steps)], pa.binary()),
                    pa.array([p[2] for p in parts] + [vocabulary.pack_ints(counts[by_place])], pa.binary()),
                    pa.array([p[3] for p in parts] + [None], pa.binary()),
                    pa.array([None] * n + [vocabulary.pack_ints(ends)], pa.binary()),
                    listed([h[0] for h in held], id_arrow),
                    listed([h[4] for h in held], pa.int64()),
                    listed([h[6] for h in held], pa.int64()),
                ],
                names=["block", "kind", "bucket", "data", "counts", "entries", "ends", "ids", *extras],
            )
            held, known, size, serial = [], Words(), 0, serial + 1
            return out

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for doc, value, trains in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = value.as_py()
                kind, keys, counts, tokens = analyse(text, known)
                held.append((doc, kind, keys, counts, tokens, trains, len(text)))
                size += len(text) + 64
                if size >= block_bytes:
                    yield flush(id_arrow)
        if held:
            yield flush(id_arrow)

    return materialize(rows.mapInArrow(run, schema), "blocks")


def cluster_classes(counts: np.ndarray) -> np.ndarray:
    """The kind of each class, from the training tokens of its words by their first bits: k-means of the shares (square
    roots), so that the commonest words, which tell languages, count most."""
    size = counts.sum(axis=1)
    points = np.sqrt(counts / np.maximum(1, size)[:, None])
    centers = points[[int(np.argmax(size))]]
    for _ in range(KINDS - 2):
        away = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1)
        centers = np.concatenate([centers, points[[int(np.argmax(away * size))]]])
    kind = np.zeros(CLASSES, np.int64)
    for _ in range(20):
        kind = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(KINDS - 1):
            if size[kind == k].sum():
                centers[k] = (points * size[:, None])[kind == k].sum(axis=0) / size[kind == k].sum()
    return np.where(size > 0, kind, KINDS - 1)


def contexts(types: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context hash of each order, byte, type number) for every coded byte of every type."""
    coded = [b"\n" if t[1:] == END else t[1:] + b" " for t in types]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8)
    of = np.repeat(np.arange(len(types)), lengths)
    kind = kinds[np.frombuffer(b"".join(t[:1] for t in types), np.uint8).astype(np.int64) - 48].astype(np.uint64)[of]
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    within = np.arange(len(data)) - starts
    last = []
    for back in range(1, 7):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[: max(0, len(data) - back)]
        last.append(np.where(within >= back, shifted, np.uint64(0)))
    mul = np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((ORDERS, len(data)), np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(data), np.uint64)
        depth = [h]
        for b in last:
            h = (h + b + np.uint64(1)) * mul
            h ^= h >> np.uint64(29)
            depth.append(h)
        place = np.minimum(within, 12).astype(np.uint64)
        out[0] = depth[1] * mul ^ (kind + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        out[1] = depth[2] ^ place
        out[2], out[3], out[4] = depth[3], depth[4], depth[6] + np.minimum(within, 7).astype(np.uint64)
        out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return out, data.astype(np.int64), of


def table_slots(distinct: int) -> int:
    """Entries of each spelling table for so many distinct training words, a power of two."""
    return min(MAX_SLOTS, max(SLOTS, 1 << max(0, distinct - 1).bit_length()))


def bit_slots(hashes: np.ndarray, data: np.ndarray, size: int = SLOTS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bit number, slots by order, bit) for the eight bits of each byte."""
    mul = np.uint64(0x94D049BB133111EB)
    for bit in range(8):
        node = ((1 << bit) | data >> (8 - bit)).astype(np.uint64)
        with np.errstate(over="ignore"):
            slots = ((hashes + node[None, :] * np.uint64(0x632BE59BD9B4E019)) * mul >> np.uint64(32)).astype(np.int64) & (size - 1)
        yield bit, slots, data >> (7 - bit) & 1


def _weight(n: np.ndarray) -> np.ndarray:
    """A word counts for the tables with 1 + ln of its frequency: the tables model spellings, not frequencies."""
    return 1 + np.log(np.maximum(n, 1))


def _inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions and the evidence behind them."""
    total = n0 + n1
    stretch = np.log((n1 + 0.3) / (n0 + 0.3))
    return np.clip(stretch * np.minimum(1.0, 0.25 + total / 4), -9, 9), total


def quantize(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """An entry's state: 10 bits of its stretched prediction and 6 bits of the evidence on a logarithmic scale.

    Past its end the evidence changes nothing any more (``_inputs``, ``Mixer.gate``); the odds keep their ratio.
    """
    stretch, total = _inputs(n0, n1)
    odds = np.rint((stretch + 9) * (1022 / 18)).astype(np.uint16)
    return odds << np.uint16(6) | np.minimum(63, np.rint(4 * np.log2(1 + total))).astype(np.uint16)


#: Stretched prediction and evidence of each state.
STRETCH = (np.arange(1 << 16) // 64 * (18 / 1022) - 9).astype(np.float32)
EVIDENCE = (2.0 ** (np.arange(1 << 16) % 64 / 4) - 1).astype(np.float32)


def log_counts(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, to a share of 0.0004 and without an end below 2**63."""
    return np.rint(1024 * np.log2(1 + n)).astype(np.uint16)


_PLAIN = (2.0 ** (np.arange(1 << 16) / 1024) - 1).astype(np.float32)


def plain_counts(n: np.ndarray) -> np.ndarray:
    return _PLAIN[n] if n.dtype == np.uint16 else n


def side_by_side(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Both counts of each entry as one number: one look into memory finds them."""
    return log_counts(n0).astype(np.uint32) | log_counts(n1).astype(np.uint32) << np.uint32(16)


def states_of(both: np.ndarray) -> np.ndarray:
    """The states of whole tables of ``side_by_side``, a slice at a time."""
    out = np.empty(both.shape, np.uint16)
    for o in range(len(out)):
        for s in range(0, out.shape[1], SLICE):
            part = both[o, s : s + SLICE]
            out[o, s : s + SLICE] = quantize(_PLAIN[part & np.uint32(0xFFFF)], _PLAIN[part >> np.uint32(16)])
    return out


class Mixer:
    """Gated weights and the adaptive probability map over quantized tables."""

    def __init__(self) -> None:
        self.weights = np.full((8 * 4, ORDERS), 0.35)
        centers = np.linspace(-8, 8, LEVELS)
        self.map = np.tile(1 / (1 + np.exp(-centers)), (256, 1))
        #: Bits that each gate's weights and each place of the map have learned from; mini-batches so far.
        self.used, self.hits, self.steps = np.zeros(len(self.weights)), np.zeros(self.map.shape), 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and map times their use, and their use, of which ``averaged`` makes one mixer."""
        use = np.concatenate([np.repeat(self.used, ORDERS), self.hits.ravel()])
        return np.concatenate([self.weights.ravel(), self.map.ravel()]) * use, use

    @classmethod
    def averaged(cls, sums: np.ndarray, use: np.ndarray) -> Mixer:
        """The mean of many mixers by use; what none has used stays as it is before training."""
        mixer = cls()
        flat = np.concatenate([mixer.weights.ravel(), mixer.map.ravel()])
        flat[use > 0] = sums[use > 0] / use[use > 0]
        mixer.weights, mixer.map = flat[: mixer.weights.size].reshape(-1, ORDERS), flat[mixer.weights.size :].reshape(256, LEVELS)
        return mixer

    def gate(self, bit: int, total: np.ndarray) -> np.ndarray:
        evidence = np.searchsorted([0.5, 4.0, 40.0], total[2])
        return bit * 4 + evidence

    def refine(self, dot: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(refined probability, mixed probability, nearest place in the map)."""
        dot = np.clip(dot, -11, 11)
        mixed = 1 / (1 + np.exp(-dot))
        at = np.clip((dot + 8) * (LEVELS - 1) / 16, 0, LEVELS - 1.001)
        low = at.astype(np.int64)
        share = at - low
        where = node * LEVELS + low
        flat = self.map.reshape(-1)
        refined = flat[where] * (1 - share) + flat[where + 1] * share
        return np.clip((mixed + refined) / 2, 1e-5, 1 - 1e-5), mixed, low + (share > 0.5)

    def learn(self, bit: int, x: np.ndarray, total: np.ndarray, node: np.ndarray, target: np.ndarray, rate: float) -> None:
        g = self.gate(bit, total) - bit * 4
        weights = self.weights[bit * 4 : bit * 4 + 4]
        _, mixed, near = self.refine((weights.astype(np.float32) @ x)[g, np.arange(len(g))], node)
        met = np.bincount(g, minlength=4)
        self.used[bit * 4 : bit * 4 + 4] += met
        weights += rate * (((g == np.arange(4)[:, None]) * (target - mixed).astype(np.float32)) @ x.T) / np.maximum(1, met)[:, None]
        where, flat = node * LEVELS + near, self.map.reshape(-1)
        hits = np.bincount(where, minlength=flat.size)
        self.hits += hits.reshape(self.map.shape)
        mean = np.bincount(where, weights=target, minlength=flat.size) / np.maximum(1, hits)
        flat += (mean - flat) * np.minimum(0.2, 0.02 * hits)
        np.clip(flat, 1e-4, 1 - 1e-4, out=flat)


def train_mixer(types: list[bytes], n: np.ndarray, both: np.ndarray, kinds: np.ndarray, batch: int = 1024, mixer: Mixer | None = None) -> Mixer:
    """Online, over mini-batches of words; each word's own counts are taken out of the tables for its own bits.

    ``both``: tables of ``side_by_side``. ``mixer`` learns on, if given.
    """
    mixer = Mixer() if mixer is None else mixer
    every = _weight(n).astype(np.float32)
    for at in range(0, len(types), batch):
        hashes, data, of = contexts(types[at : at + batch], kinds)
        own = every[at : at + batch][of]
        for bit, slots, target in bit_slots(hashes, data, both.shape[1]):
            found = np.stack([both[o].take(slots[o]) for o in range(ORDERS)])
            c0 = np.maximum(0, _PLAIN.take(found & np.uint32(0xFFFF)) - own * (1 - target))
            c1 = np.maximum(0, _PLAIN.take(found >> np.uint32(16)) - own * target)
            states = quantize(c0, c1)
            mixer.learn(bit, STRETCH.take(states), EVIDENCE.take(states), (1 << bit) | data >> (8 - bit), target, 0.2 / (1 + mixer.steps / 100))
        mixer.steps += 1
    return mixer


def spelling_log10(types: list[bytes], table: np.ndarray, mixer: Mixer, kinds: np.ndarray) -> np.ndarray:
    """log10 of the mixed probability of each type's spelling."""
    stretch = STRETCH.astype(np.float32)
    gates = np.searchsorted([0.5, 4.0, 40.0], EVIDENCE).astype(np.int64)
    weights = np.ascontiguousarray(mixer.weights.T.astype(np.float32))
    out = np.zeros(len(types))
    for at in range(0, len(types), 4096):
        hashes, data, of = contexts(types[at : at + 4096], kinds)
        bits = np.zeros(len(data))
        for bit, slots, target in bit_slots(hashes, data, table.shape[1]):
            states = [table[o].take(slots[o]) for o in range(ORDERS)]
            g = bit * 4 + gates.take(states[2])
            dot = stretch.take(states[0]) * weights[0].take(g)
            for o in range(1, ORDERS):
                dot += stretch.take(states[o]) * weights[o].take(g)
            p = mixer.refine(dot, (1 << bit) | data >> (8 - bit))[0]
            bits += np.log10(np.where(target == 1, p, 1 - p))
        out[at : at + 4096] = np.bincount(of, weights=bits, minlength=len(types[at : at + 4096]))
    return out


def pack_longs(values: np.ndarray) -> bytes:
    """Integers of 64 bits, bytes transposed so that small values compress."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_longs(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").ravel()


class Bucket:
    """The types of a bucket with their training tokens: the entries of ``lm_paths``.

    ``words`` are sorted; ``keys``, ascending, are a word's number times ``CODES`` and a code.
    """

    def __init__(self, words: list[bytes], keys: np.ndarray, n: np.ndarray) -> None:
        self.words, self.keys, self.n = words, keys, n
        self.word, code = keys // CODES, keys % CODES
        self.classes, self.previous = code // PREVIOUS, code % PREVIOUS
        #: Training tokens of each word, and the words' codes.
        self.c = np.bincount(self.word, weights=n, minlength=len(words)).astype(np.int64)
        self.codes = codes_of(words)

    @classmethod
    def gathered(cls, parts: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> Bucket:
        """The bucket of parts (words, entries, training tokens) of many blocks."""
        words = sorted(set().union(*(p[0] for p in parts)))
        number = {w: k for k, w in enumerate(words)}
        keys = np.concatenate([renumbered(own, entries, number) for own, entries, _ in parts])
        types, at = np.unique(keys, return_inverse=True)
        return cls(words, types, np.bincount(at, weights=np.concatenate([p[2] for p in parts]), minlength=len(types)).astype(np.int64))

    def by_kind(self, kinds: np.ndarray) -> np.ndarray:
        """Training tokens of each word in each kind."""
        flat = np.bincount(self.word * KINDS + kinds[self.classes], weights=self.n, minlength=len(self.words) * KINDS)
        return flat.reshape(-1, KINDS)

    def entries(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """codes, n, contexts and path ends, as ``lm_paths.nodes`` takes them."""
        return self.codes[self.word], self.n, context_ids(self.classes, self.previous, kinds), path_ends(self.codes, self.c > 0)[self.word]


def renumbered(words: list[bytes], entries: np.ndarray, number: dict[bytes, int]) -> np.ndarray:
    """A part's types with the numbers of a bucket's words."""
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))[entries // CODES] * CODES + entries % CODES


TYPES = "bucket int, words binary, keys binary, n binary, first bigint, sums binary, tokens binary, once binary, distinct bigint"


def _count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of a partition sorted by buckets: its types, and what they add to the corpus's facts."""
    for b, parts in _by_first(batches):
        own = Bucket.gathered([(unpack_types(d), unpack_ints(e), unpack_ints(n)) for d, e, n in parts])
        prefix = (own.codes >> np.uint64(64 - TOP)).astype(np.int64)[own.word]
        first, width = int(prefix.min()), int(prefix.max() - prefix.min()) + 1
        where = own.keys % CODES * width + prefix - first
        sums = np.bincount(where, weights=own.n, minlength=CODES * width).astype(np.int64)
        tokens = np.bincount(own.classes, weights=own.n, minlength=CLASSES).astype(np.int64)
        once = np.bincount(own.classes, weights=own.n * (own.c[own.word] == 1), minlength=CLASSES).astype(np.int64)
        columns = [pa.array([b], pa.int32()), pa.array([vocabulary.pack_types(own.words)], pa.binary()), *[pa.array([pack_longs(x)], pa.binary()) for x in (np.diff(own.keys, prepend=0), own.n)]]
        columns += [pa.array([first]), *[pa.array([pack_longs(x)], pa.binary()) for x in (sums, tokens, once)], pa.array([int((own.c > 0).sum())])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "words", "keys", "n", "first", "sums", "tokens", "once", "distinct"])


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition sorted by its first column, one list for each of its values."""
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


def spelled_words(bucket: Bucket, kinds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The known words of a bucket, each with a class byte of the kind that has most of its tokens, and their tokens."""
    byte_of = np.zeros(KINDS, np.int64)
    byte_of[kinds[::-1]] = np.arange(CLASSES)[::-1]
    most = byte_of[bucket.by_kind(kinds).argmax(axis=1)].tolist()
    known = np.flatnonzero(bucket.c > 0).tolist()
    return [bytes([48 + most[k]]) + bucket.words[k] for k in known], bucket.c[known]


def _fill_tables(buckets: Iterator[Bucket], kinds: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Bit counts of the partition's known words, by order and slice of the table."""
    tables = np.zeros((2, ORDERS, size), np.float32)
    flat, added = tables.reshape(-1), 0.0

    def flush() -> Iterator[pa.RecordBatch]:
        for o in range(ORDERS):
            for s in range(0, size, SLICE):
                part = tables[:, o, s : s + SLICE]
                if part.any():
                    yield _slice(o, s, part)
        tables.fill(0)

    for bucket in buckets:
        every, counts = spelled_words(bucket, kinds)
        for k in range(0, len(every), 20_000):
            types, n = every[k : k + 20_000], counts[k : k + 20_000]
            hashes, data, of = contexts(types, kinds)
            weight = _weight(n)[of].astype(np.float32)
            added += float(weight.sum())
            if added > EXACT:
                yield from flush()
                added = float(weight.sum())
            for _, slots, target in bit_slots(hashes, data, size):
                for o in range(ORDERS):
                    np.add.at(flat, (target * ORDERS + o) * size + slots[o], weight)
    yield from flush()


def _slice(o: int, s: int, part: np.ndarray) -> pa.RecordBatch:
    """One row of the shuffled tables: counts in sixteenths, 64 bits each, bytes transposed so that they compress."""
    packed = zstandard.compress(np.rint(part * 16.0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([s], pa.int32()), pa.array([packed], pa.binary())], names=["o", "s", "data"])


def _unpack_table(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T
    return (np.ascontiguousarray(raw).view("<u8").ravel().astype(np.float64) / 16).reshape(2, -1)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of equal slices, as ``log_counts``."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for o, s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = _unpack_table(data)
            sums[o, s] = sums[o, s] + part if (o, s) in sums else part
    for (o, s), part in sums.items():
        packed = zstandard.compress(log_counts(part).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([s], pa.int32()), pa.array([packed], pa.binary())], names=["o", "s", "data"])


@dataclass
class Model:
    """Kinds of classes, counts of the first bits by context, and the chance of a new word in each kind."""

    kinds: np.ndarray
    tops: list[list[np.ndarray]]
    new: np.ndarray


def chance_of_new(tokens: np.ndarray, once: np.ndarray) -> np.ndarray:
    """The share of training tokens whose word occurs nowhere else, which is new if they are left out; 1 without any."""
    return np.where(tokens > 0, (once + 0.5) / (tokens + 1), 1.0 if not tokens.any() else (once.sum() + 0.5) / (tokens.sum() + 1))


def _learn(buckets: Iterator[Bucket], both: np.ndarray, model: Model) -> Iterator[pa.RecordBatch]:
    """Sums over the partition's training words: of a mixer of paths and one of spellings that learned from all of them."""
    paths, spelling = PathMixer(), Mixer()
    for bucket in buckets:
        codes, n, ids, ends = bucket.entries(model.kinds)
        lm_paths.train(paths, codes, n, bucket.c[bucket.word], ids, ends, model.tops)
        types, counts = spelled_words(bucket, model.kinds)
        order = np.random.default_rng(1).permutation(len(types))
        train_mixer([types[k] for k in order.tolist()], counts[order], both, model.kinds, mixer=spelling)
    sums, use = (np.concatenate(x) for x in zip(paths.sums(), spelling.sums(), strict=True))
    some = np.flatnonzero(use)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some]), pa.array(use[some])], names=["i", "sum", "use"])


def token_log10(bucket: Bucket, model: Model, paths: PathMixer, table: np.ndarray, spelling: Mixer) -> np.ndarray:
    """log10 of each type's probability, given its class and previous word's class."""
    codes, n, ids, ends = bucket.entries(model.kinds)
    known = bucket.c[bucket.word] > 0
    with np.errstate(divide="ignore"):
        out = np.where(known, np.log10(1 - model.new)[ids[1]] + lm_paths.path_log10(paths, codes, n, ids, ends, model.tops), np.log10(model.new)[ids[1]])
    new = np.flatnonzero(~known)
    if len(new):
        # A spelling depends on the word and the kind only.
        pairs, first, at = np.unique(bucket.word[new] * KINDS + ids[1][new], return_index=True, return_inverse=True)
        marks = bucket.classes[new[first]].tolist()
        spelled = spelling_log10([bytes([48 + m]) + bucket.words[w] for m, w in zip(marks, (pairs // KINDS).tolist(), strict=True)], table, spelling, model.kinds)
        out[new] += spelled[at]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by seven."""
    shifted = x + 7
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    inverse = 1 / shifted
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260)))
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def adapted_log10(p_log10: np.ndarray, counts: np.ndarray, history: np.ndarray) -> np.ndarray:
    """By pairs of document and type: log10 of coding the type so often, each time with what the document has used before.

    ``history``: what each pair's words are added up in, numbered from 0; its own term comes with its first pair. In any
    order of the words the product is the same: (ALPHA p + used) / (ALPHA + all used) for each.
    """
    log = p_log10 * np.log(10) + np.log(ALPHA)
    out = log.copy()
    more = counts > 1
    a = np.exp(log[more])
    # Gamma(a + n) / Gamma(a) = a (a + 1) ... (a + n - 1); the first factor stays in the log domain.
    out[more] += log_gamma(a + counts[more]) - log_gamma(a + 1)
    size = np.bincount(history, weights=counts)
    first = np.full(len(size), -1)
    first[history[::-1]] = np.arange(len(history))[::-1]
    some = first >= 0
    out[first[some]] -= log_gamma(ALPHA + size[some]) - log_gamma(np.full(int(some.sum()), ALPHA))
    return out / np.log(10)


def _unpacked(words: bytes, keys: bytes, n: bytes) -> Bucket:
    return Bucket(unpack_types(words), np.cumsum(unpack_longs(keys)), unpack_longs(n))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield _unpacked(*(x.as_py() for x in row))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, block_bytes: int = vocabulary.BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of ``docs``.

    ``training``: the rows to learn from; by default those that are not held out by the crc32 of the id.
    """
    spark = docs.sparkSession
    training = ~held_out(id_col) if training is None else training
    blocks = text_blocks(docs, id_col, text_col, training, block_bytes)
    parts = blocks.where(F.col("kind") == PART)
    grouped = parts.select("bucket", "data", "entries", "counts").repartition("bucket").sortWithinPartitions("bucket")
    types = materialize(grouped.mapInArrow(lean(_count_types), TYPES), "types")

    # Facts of a fixed number: counts by class, and by class, class of the word before and first bits.
    by_class, distinct = np.zeros((2, CLASSES)), 0
    first_bits = np.zeros((CLASSES, PREVIOUS, 1 << TOP))
    for row in types.select("first", "sums", "tokens", "once", "distinct").toLocalIterator():
        sums = unpack_longs(row["sums"]).reshape(CLASSES, PREVIOUS, -1)
        first_bits[:, :, row["first"] : row["first"] + sums.shape[2]] += sums
        by_class += [unpack_longs(row["tokens"]), unpack_longs(row["once"])]
        distinct += row["distinct"]
    kinds = cluster_classes(first_bits.sum(axis=1))
    tokens, once = (np.bincount(kinds, weights=x, minlength=KINDS) for x in by_class)
    total = int(tokens.sum())
    facts = spark.sparkContext.broadcast(Model(kinds, lm_paths.top_tables(first_bits, kinds), chance_of_new(tokens, once)))

    size = table_slots(distinct)
    seen = types.select("words", "keys", "n")
    slices = seen.mapInArrow(lean(lambda it: _fill_tables(_buckets(it), kinds, size)), "o int, s int, data binary").repartition("o", "s").mapInArrow(_add_slices, "o int, s int, data binary")
    both = np.zeros((ORDERS, size), np.uint32)
    for row in slices.toLocalIterator():  # at most 4 bytes for each of MAX_SLOTS entries in each table
        n0, n1 = np.frombuffer(zstandard.decompress(bytes(row["data"])), np.uint16).reshape(2, -1).astype(np.uint32)
        both[row["o"], row["s"] : row["s"] + SLICE] = n0 | n1 << np.uint32(16)
    counted = spark.sparkContext.broadcast(both)

    @lean
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _learn(_buckets(batches), counted.value, facts.value)

    learned = seen.mapInArrow(learn, "i bigint, sum double, use double").groupBy("i").agg(F.sum("sum").alias("sum"), F.sum("use").alias("use")).collect()
    border = PathMixer().sums()[0].size
    sums, use = np.zeros((2, border + Mixer().sums()[0].size))
    for row in learned:  # one for each weight and place of the maps
        sums[row["i"]], use[row["i"]] = row["sum"], row["use"]
    paths, spelling = PathMixer.averaged(sums[:border], use[:border]), Mixer.averaged(sums[border:], use[border:])
    states = states_of(both)
    counted.unpersist()
    model = spark.sparkContext.broadcast((states, paths, spelling))

    def score(found: pa.Table, asked: pa.Table) -> pa.Table:
        """A bucket's types are scored once and looked up for each block."""
        table, path_mixer, spelling_mixer = model.value
        bucket = _unpacked(*(found[c][0].as_py() for c in ("words", "keys", "n")))
        p = token_log10(bucket, facts.value, path_mixer, table, spelling_mixer)
        # Single precision of p is enough, and compresses.
        rows = np.stack([bucket.c[bucket.word].astype("<f8"), p.astype(np.float32).astype("<f8"), bucket.previous.astype("<f8")], axis=1)
        number, values = {w: k for k, w in enumerate(bucket.words)}, []
        for data, entries in zip(asked["data"], asked["entries"], strict=True):
            keys = renumbered(unpack_types(data.as_py()), unpack_ints(entries.as_py()), number)
            values.append(zstandard.compress(rows[np.searchsorted(bucket.keys, keys)].tobytes(), 1))
        out = pa.table([asked["block"], asked["bucket"], pa.array(values, pa.binary())], names=["block", "bucket", "value"])
        give_back()
        return out

    by_bucket = types.select("bucket", "words", "keys", "n").groupBy("bucket").cogroup(parts.select("bucket", "block", "data", "entries").groupBy("bucket"))
    values = by_bucket.applyInArrow(score, "block bigint, bucket int, value binary")

    known = float(1 - chance_of_new(tokens.sum(keepdims=True), once.sum(keepdims=True))[0])
    often = float(np.log10(known / total)) if known > 0 else 0.0  # of a word that occurs once

    def combine(pairs: np.ndarray, counts: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        c, p, previous = pairs.T if pairs.shape[1] > 1 else np.zeros((3, 0))
        plain = np.where(c > 0, np.log10(np.maximum(c, 1)) + often, p)
        return [(c > 0) * counts, np.log10((c + 1) / (total + distinct + 1)) * counts, adapted_log10(p, counts, of * PREVIOUS + previous.astype(np.int64)), plain * counts]

    summed = sum_by_document(blocks, values, combine, "n_known bigint, base_score double, score double, plain double", ["n_tokens", "n_bytes"], id_col)
    best, gap = F.greatest("score", "plain"), -F.abs(F.col("score") - F.col("plain"))
    score_with_class = best + F.log10(1 + F.pow(F.lit(10.0), gap)) - float(np.log10(2 * CLASSES))
    bits = F.when(F.col("n_bytes") > 0, -score_with_class * float(np.log2(10)) / F.col("n_bytes"))
    return summed.select(id_col, "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", score_with_class.alias("score"), bits.alias("bits_per_byte"))
