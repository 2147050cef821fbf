"""Known words as paths of bits, each bit predicted in several contexts at once.

A word's code is its hash; the codes of all known words are a binary trie. A word is coded from the root on, one bit at
each node that has words on both sides. Each context (``Contexts``) predicts the bit from its own counts of training
tokens on either side; the predictions are mixed in the logistic domain by weights that a gate chooses (depth of the
node, evidence, whether the document's kind knows one side only), and an adaptive map refines the result. Over all known words the probabilities sum to one.

Words are dealt to tasks by the first ``TOP`` bits of their codes: deeper nodes have all their words in one task, and
the counts of the nodes above (a fixed number of them) go to every task. So counts may grow with the corpus without an
end, and nothing that grows is collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

#: Classes of documents, kinds that these are gathered to (the last: of classes without training tokens), classes of
#: the word before.
CLASSES, KINDS, PREVIOUS = 64, 9, 8
#: Bits of the code by which words are dealt out.
TOP = 12
LEVELS = 24
#: Contexts: all tokens; the document's kind; its kind with the class of the word before.
SIZES = (1, KINDS, KINDS * PREVIOUS)
GATES, DEPTHS = 4 * 4 * 2, 4


def word_hash(word: bytes) -> int:
    """The first 32 bits of a word's code."""
    return zlib.crc32(word)


def codes_of(words: list[bytes]) -> np.ndarray:
    high = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    low = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))
    return high << np.uint64(32) | low


def context_ids(classes: np.ndarray, previous: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
    kind = kinds[classes]
    return [np.zeros(len(classes), np.int64), kind, kind * PREVIOUS + previous]


def top_tables(counts: np.ndarray, kinds: np.ndarray) -> list[list[np.ndarray]]:
    """By context and depth 0 to ``TOP``: training tokens below each node, from counts [class, previous, first bits]."""
    by_kind = np.zeros((KINDS, PREVIOUS, counts.shape[2]))
    np.add.at(by_kind, kinds, counts)
    wide = [counts.sum(axis=(0, 1))[None], by_kind.sum(axis=1), by_kind.reshape(KINDS * PREVIOUS, -1)]
    return [[w.reshape(len(w), 1 << d, -1).sum(axis=2, dtype=np.float64) for d in range(TOP + 1)] for w in wide]


def path_ends(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each word a depth below which no other known word shares its path; 0 for unknown words."""
    out = np.zeros(len(codes), np.int64)
    which = np.flatnonzero(known)
    order = which[np.argsort(codes[which])]
    c = codes[order]
    differ = c[1:] ^ c[:-1]
    # Common leading bits, one too many rather than too few where the logarithm is not exact.
    common = np.where(differ > 0, 64 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64), 64)
    out[order] = np.minimum(64, 1 + np.maximum(np.r_[0, common], np.r_[common, 0]))
    return out


def nodes(codes: np.ndarray, n: np.ndarray, ids: list[np.ndarray], ends: np.ndarray, tables: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, entries, their bits, tokens on the same side, tokens on the other side by context) of all coded bits.

    ``codes``, ``n``, ``ids``, ``ends``: by entry (a word in its contexts) its code, training tokens, contexts and the
    end of its path. All entries of words that share the first ``TOP`` bits must be given.
    """
    coded = np.flatnonzero(ends > 0)
    here = [t[0][i[coded], 0] for t, i in zip(tables, ids, strict=True)]
    for d in range(TOP):
        node = (codes[coded] >> np.uint64(63 - d)).astype(np.int64)
        below = [t[d + 1][i[coded], node] for t, i in zip(tables, ids, strict=True)]
        some = np.flatnonzero(here[0] - below[0] > 0)
        yield d, coded[some], node[some] & 1, np.stack([b[some] for b in below]), np.stack([(h - b)[some] for h, b in zip(here, below, strict=True)])
        here = below
    # Below the first bits only entries whose path goes on are kept at hand; ``place``: their numbers.
    place = coded[ends[coded] > TOP]
    kept = np.zeros(len(codes), bool)
    kept[place] = True
    full = [h[kept[coded]] for h in here]
    code, end, n = codes[place], ends[place], n[place].astype(float)
    ids = [i[place] for i in ids]
    orders = [np.lexsort((code, i)) for i in ids]
    for d in range(TOP, 64):
        live = end > d
        left = int(live.sum())
        if not left:
            return
        if left < 0.8 * len(live):
            number = np.cumsum(live) - 1
            orders = [number[o[live[o]]] for o in orders]
            place, code, end, n = place[live], code[live], end[live], n[live]
            ids, full, live = [i[live] for i in ids], [f[live] for f in full], live[live]
        node = (code >> np.uint64(63 - d)).astype(np.int64)
        same = []
        for o, i in zip(orders, ids, strict=True):
            at, context = node[o], i[o]
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (context[1:] != context[:-1])])
            out = np.empty(len(o))
            out[o] = np.repeat(np.add.reduceat(n[o], starts), np.diff(np.r_[starts, len(o)]))
            same.append(out)
        some = np.flatnonzero(live & (full[0] > same[0]))
        yield d, place[some], node[some] & 1, np.stack([s[some] for s in same]), np.stack([(f - s)[some] for f, s in zip(full, same, strict=True)])
        full = same


class PathMixer:
    """Gated weights and the adaptive map over the contexts' predictions."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, len(SIZES)), 0.3)
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, LEVELS))), (DEPTHS, 1))
        #: Tokens that each gate's weights and each place of the map have learned from.
        self.used, self.hits, self.steps = np.zeros(GATES), np.zeros(self.map.shape), 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and map times their use, and their use, of which ``averaged`` makes one mixer."""
        use = np.concatenate([np.repeat(self.used, len(SIZES)), self.hits.ravel()])
        return np.concatenate([self.weights.ravel(), self.map.ravel()]) * use, use

    @classmethod
    def averaged(cls, sums: np.ndarray, use: np.ndarray) -> PathMixer:
        """The mean of many mixers by use; what none has used stays as it is before training."""
        mixer = cls()
        flat = np.concatenate([mixer.weights.ravel(), mixer.map.ravel()])
        flat[use > 0] = sums[use > 0] / use[use > 0]
        mixer.weights, mixer.map = flat[: mixer.weights.size].reshape(mixer.weights.shape), flat[mixer.weights.size :].reshape(mixer.map.shape)
        return mixer

    @staticmethod
    def _inputs(same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions of the same side (of the other one: their negatives), and the evidence's class."""
        total = same + other
        x = np.log((same + 0.3) / (other + 0.3)) * np.minimum(1.0, 0.25 + total / 4)
        one_sided = np.minimum(same[1], other[1]) < 0.5
        return np.clip(x, -12, 12), np.searchsorted([0.5, 4.0, 40.0], total[-1]) * 2 + one_sided

    def _mix(self, d: int, x: np.ndarray, evidence: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(refined and mixed probability of the same side, gate, nearest place in the map)."""
        depth = min(d // 6, DEPTHS - 1)
        gate = depth * 8 + evidence
        dot = np.clip(np.einsum("fm,mf->m", x, self.weights[gate]), -14, 14)
        signed = np.where(bit, dot, -dot)
        at = np.clip((signed + 8) * (LEVELS - 1) / 16, 0, LEVELS - 1.001)
        low = at.astype(np.int64)
        share = at - low
        row = self.map[depth]
        refined = row[low] * (1 - share) + row[low + 1] * share
        mixed = 1 / (1 + np.exp(-dot))
        # Far out, where the map has no places, the mixed probability stands alone.
        inner = np.abs(signed) < 7
        both = np.where(inner, (mixed + np.where(bit, refined, 1 - refined)) / 2, mixed)
        return np.clip(both, 1e-7, 1 - 1e-7), mixed, gate, depth * LEVELS + low + (share > 0.5)

    def log10(self, d: int, bit: np.ndarray, same: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.log10(self._mix(d, *self._inputs(same, other), bit)[0])

    def learn(self, d: int, bit: np.ndarray, same: np.ndarray, other: np.ndarray, weight: np.ndarray) -> None:
        """One mini-batch of bits, ``weight`` tokens each."""
        rate = 1 / (1 + self.steps / 100)
        self.steps += 1
        x, evidence = self._inputs(same, other)
        _, mixed, gate, place = self._mix(d, x, evidence, bit)
        met = np.bincount(gate, weights=weight, minlength=GATES)
        error = weight * (1 - mixed)
        step = np.stack([np.bincount(gate, weights=error * row, minlength=GATES) for row in x], axis=1)
        self.weights += rate * step / np.maximum(met, 1e-9)[:, None]
        self.used += met
        flat, hits = self.map.reshape(-1), np.bincount(place, weights=weight, minlength=self.map.size)
        mean = np.bincount(place, weights=weight * bit, minlength=self.map.size) / np.maximum(hits, 1e-9)
        flat += (mean - flat) * np.minimum(0.2, hits * 0.002)
        np.clip(flat, 1e-6, 1 - 1e-6, out=flat)
        self.hits += hits.reshape(self.map.shape)


def train(mixer: PathMixer, codes: np.ndarray, n: np.ndarray, c: np.ndarray, ids: list[np.ndarray], ends: np.ndarray, tables: list[list[np.ndarray]], batch: int = 4096) -> None:
    """Learn from all training tokens of words that occur again, each token left out of the counts for its own bits."""
    # Entries without training tokens add nothing to any count.
    shuffled = np.random.default_rng(1).permutation(np.flatnonzero(n > 0))
    codes, n, c, ends = codes[shuffled], n[shuffled], c[shuffled], ends[shuffled]
    learns = c > 1
    for d, some, bit, same, other in nodes(codes, n, [i[shuffled] for i in ids], ends, tables):
        keep = learns[some]
        some, bit, same, other = some[keep], bit[keep], np.maximum(0, same[:, keep] - 1), other[:, keep]
        for k in range(0, len(some), batch):
            part = slice(k, k + batch)
            mixer.learn(d, bit[part], same[:, part], other[:, part], n[some[part]].astype(float))


def path_log10(mixer: PathMixer, codes: np.ndarray, n: np.ndarray, ids: list[np.ndarray], ends: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """log10 of each entry's probability among the known words; 0 for unknown words."""
    out = np.zeros(len(codes))
    for d, some, bit, same, other in nodes(codes, n, ids, ends, tables):
        out[some] += mixer.log10(d, bit, same, other)
    return out
