"""Benchmark decontamination: rare seeds join passages to test items, Smith-Waterman alignment scores them.

Words are compared by their token: the first ``STEM`` letters, or the whole word if it is shorter. A seed is a pair of
tokens at most two words apart. The alignment gives equal words 2, words of an equal token 1, other pairs and gaps -1,
and passages whose score is at least ``THRESHOLD`` of a full copy's are reported.

No such passage is lost. If an item of n words scores a share t of 2n, then of the item's words at least ceil(t * n) - 1
begin a seed that the passage has, too: with P matched words, 2P - 2tn is left for mismatches and gaps, and two matched
words in a row that make no seed cost two of it. So a passage shares T = ceil(t * n) - 1 of an item's n - 1 places, and
k of any n - 1 - T + k places; those whose seeds are rarest in the corpus are taken, with k = T / 3. All shared places lie
on diagonals less than n apart.

1. Documents are read once: of each the seeds that some item may have (told by a bit field of bounded size) are written
   with a hash of the whole text, by which equal texts are one from here on.
2. Seeds are counted; each item keeps its rarest places. They join the documents' seeds (a second bit field leaves out
   what cannot join before it is shuffled); places are counted by text, item and diagonals, and passages with k of them
   are candidates.
3. Candidates are aligned, each distinct text once; documents and items join the matches by SHA-256 of their texts. The
   shorter hash of the first steps only finds candidates: texts that share it are aligned each.

Both sides of every join may be of any size; Catalyst broadcasts one only below its size threshold.

Defined results: null and empty texts match nothing; an item of two words needs both of them, and an item of a single
word is no passage and matches nothing; null ids are carried; repeated documents and equal items are reported each;
other columns are carried by ``drop_contaminated`` and not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.memory import lean
from tarn.llm.windows import mix
from tarn.plans.materialize import materialize

STEM = 5
#: The least share of a full copy's score.
THRESHOLD = 0.5
SAME, SIMILAR, OTHER, GAP = 2, 1, -1, 1
#: Bits of the field that tells seeds of items: 16 for each seed, but at most this many (32 MB).
MAX_BITS = 1 << 28
#: Distinct words whose hash a task remembers.
REMEMBERED = 1 << 18

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Tokens(dict):
    """The hash of each word's token; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word[:STEM].encode("utf-8", "surrogatepass"))
        return found

    def seeds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, seed) of each pair of tokens one or two words apart."""
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        first = mix(h)
        pairs = [first[:-gap] * np.uint64(0x9FB21C651E98DF25) + h[gap:] for gap in (1, 2) if len(h) > gap]
        places = [np.arange(len(h) - gap) for gap in (1, 2) if len(h) > gap]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), mix(np.concatenate(pairs)).view(np.int64)


def shared_places(n: int, threshold: float) -> tuple[int, int]:
    """(rarest places that an item of n words keeps, how many of them a passage must share)."""
    least = max(1, math.ceil(threshold * n - 1e-9) - 1)
    need = max(1, least // 3)
    return max(0, n - 1 - least + need), need


class Items:
    """Word and stem numbers of test items."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.number: dict[str, int] = {}
        stems: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            self.ids.append(item)
            self.words.append(np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int64))
        # The last entry stands for all other words.
        self.stem = np.array([stems.setdefault(w[:STEM], len(stems)) if len(w) >= STEM else -2 - k for k, w in enumerate(self.number)] + [-1], np.int64)
        self.stems = stems

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def stems_of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.stems.get(w[:STEM], -1) if len(w) >= STEM else -1 for w in words), np.int64, len(words))


def smith_waterman(item: np.ndarray, item_stem: np.ndarray, text: np.ndarray, text_stem: np.ndarray) -> tuple[int, int]:
    """(best local score, end of its match in ``text``), one row of the matrix at a time."""
    steps = GAP * np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word, stem in zip(item.tolist(), item_stem.tolist(), strict=True):
        pair = np.where(text == word, SAME, np.where((text_stem == stem) & (stem >= 0), SIMILAR, OTHER))
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + pair)
        row = np.maximum.accumulate(new + steps) - steps
        k = int(np.argmax(row))
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def best_passage(words: list[str], item: str, diagonals: list[int], threshold: float) -> tuple[float, int, int]:
    """(score, first word, end word) of the best passage near the groups of ``diagonals``; score 0 if none suffices."""
    items = Items([(None, item)])
    own = items.words[0]
    n, own_stem = len(own), items.stem[items.words[0]]
    spans: list[list[int]] = []
    for group in sorted(diagonals):
        # A group holds the diagonals from (group - 1) n to (group + 1) n; a path through it leaves it by n at most.
        low, high = max(0, (group - 2) * n), min(len(words), (group + 3) * n)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    best = (0.0, 0, 0)
    for low, high in spans:
        text, text_stem = items.numbers(words[low:high]), items.stems_of(words[low:high])
        # No alignment scores more than the item's words that the passage has allow.
        if SAME * int((np.isin(own, text) | (np.isin(own_stem, text_stem) & (own_stem >= 0))).sum()) < threshold * SAME * n:
            continue
        score, end = smith_waterman(own, own_stem, text, text_stem)
        if score >= threshold * SAME * n and score / (SAME * n) > best[0]:
            _, back = smith_waterman(own[::-1], own_stem[::-1], text[:end][::-1], text_stem[:end][::-1])
            best = (score / (SAME * n), low + end - back, low + end)
    return best


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _items(benchmark: DataFrame, threshold: float) -> DataFrame:
    """For each distinct item text: item, text, n, kept (how many rarest places), need, place and seed lists."""
    rows = benchmark.select(_hash(F.col("text")).alias("item"), "text").where(F.col("text").isNotNull()).dropDuplicates(["item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if len(words) > 1:
                    place, seed = tokens.seeds(words)
                    for column, value in zip(out, (item, text, len(words), *shared_places(len(words), threshold), place, seed), strict=True):
                        column.append(value)
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["item", "text", "n", "kept", "need", "place", "seed"])

    return materialize(rows.mapInArrow(run, "item binary, text string, n int, kept int, need int, place array<bigint>, seed array<bigint>"), "items")


def _bit_field(seeds: DataFrame) -> np.ndarray:
    """Bytes of flags by the seed's last bits; its size follows the number of seeds and is at most ``MAX_BITS`` bits."""
    many = seeds.agg(F.approx_count_distinct("seed")).first()[0]
    bits = min(MAX_BITS, 1 << max(10, (16 * many).bit_length()))
    bit = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = seeds.select(F.shiftright(bit, 5).alias("at"), F.expr(f"shiftleft(1L, cast((seed & {bits - 1}L) % 32 as int))").alias("flag")).groupBy("at").agg(F.bit_or("flag").alias("flags"))
    field = np.zeros(bits // 32, "<u4")
    for row in words.toLocalIterator():
        field[row["at"]] = row["flags"]
    return field.view(np.uint8)


SEEDS = "doc bigint, word array<bigint>, seed array<bigint>"


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _kept_seeds(docs: pa.Array, found: Iterable[tuple[np.ndarray, np.ndarray]], field: np.ndarray) -> pa.RecordBatch:
    """The places and seeds that the bit field knows, of each document that has any."""
    at, words, seeds = [], [], []
    last = np.int64(8 * len(field) - 1)
    for k, (place, seed) in enumerate(found):
        bit = seed & last
        known = np.flatnonzero(field[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        if len(known):
            at.append(k)
            words.append(place[known])
            seeds.append(seed[known])
    ends = pa.array(np.cumsum([0] + [len(w) for w in words]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (words, seeds)]
    return pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), *lists], names=["doc", "word", "seed"])


def _matches(docs: DataFrame, benchmark: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(hash of the text, hash of the item, score, first word, end word), written."""
    spark = docs.sparkSession
    items = _items(benchmark, threshold)
    places = items.select("item", "n", "kept", "need", F.inline(F.arrays_zip("place", "seed")))
    flags = spark.sparkContext.broadcast(_bit_field(places))
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @lean
    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, tokens = flags.value, Tokens()
        for batch in batches:
            found = (tokens.seeds(words_of(text.as_py())) for text in batch.column(1))
            yield _kept_seeds(batch.column(0), found, field)

    found = materialize(texts.mapInArrow(seeds_of, SEEDS), "seeds")
    counts = found.select(F.explode("seed").alias("seed")).groupBy("seed").agg(F.count("*").alias("often"))
    by_place = places.join(counts, "seed", "left").groupBy("item", "n", "kept", "need", "place").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"), F.collect_set("seed").alias("seeds"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "place"))
    rare = by_place.withColumn("rank", rank).where("rank <= kept").select("item", "n", "need", "place", F.explode("seeds").alias("seed"))

    rare = materialize(rare, "rare")
    rare_flags = spark.sparkContext.broadcast(_bit_field(rare))

    @lean
    def only_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, seeds = _lists(batch.column(1)), _lists(batch.column(2))
            yield _kept_seeds(batch.column(0), zip(words, seeds, strict=True), rare_flags.value)

    group = F.floor((F.col("word") - F.col("place")) / F.col("n"))
    near = found.mapInArrow(only_rare, SEEDS).select("doc", F.inline(F.arrays_zip("word", "seed")))
    met = near.join(rare, "seed").select("doc", "item", "need", "place", F.explode(F.array(group, group + 1)).alias("diagonals"))
    passages = met.distinct().groupBy("doc", "item", "need", "diagonals").agg(F.count("*").alias("shared")).where("shared >= need")
    wanted = passages.groupBy("doc", "item").agg(F.collect_set("diagonals").alias("diagonals")).join(items.select("item", F.col("text").alias("words")), "item")
    wanted = materialize(wanted.groupBy("doc").agg(F.collect_list(F.struct("item", "words", "diagonals")).alias("items")), "candidates")

    # Each distinct text once, whatever the number of its copies: they are combined before the shuffle.
    held = texts.join(wanted.select("doc"), "doc", "left_semi").withColumn("whole", _hash(F.col("text")))
    once = held.groupBy("whole").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))

    @lean
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, candidates in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for one in candidates:
                    best = best_passage(words, one["words"], one["diagonals"], threshold)
                    if best[0]:
                        out.append((doc, one["item"], *best))
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["doc", "item", "score", "first_word", "end_word"])

    aligned = once.join(wanted, "doc").select("whole", "text", "items").mapInArrow(align, "doc binary, item binary, score double, first_word bigint, end_word bigint")
    return materialize(aligned, "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, score, first_word, end_word): the best passage for each document and item that it holds."""
    matches = _matches(docs, benchmark, text_col, threshold)
    items = benchmark.select("item_id", _hash(F.col("text")).alias("item"))
    rows = docs.select(F.col(id_col).alias("_id"), _hash(F.col(text_col)).alias("doc"))
    return rows.join(matches, "doc").join(items, "item").select(F.col("_id").alias(id_col), "item_id", "score", "first_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    matches = _matches(docs, benchmark, text_col, threshold)
    key = "_text_hash"
    while key in docs.columns:
        key += "_"
    held = matches.select(F.col("doc").alias(key)).distinct()
    return docs.withColumn(key, _hash(F.col(f"`{text_col}`"))).join(held, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
