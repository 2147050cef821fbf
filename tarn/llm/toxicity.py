"""Toxicity by weak supervision.

Voters say toxic, clean, or abstain where a text is too short to tell. They are lexicons (words of abuse, one voter for
each language; words and word beginnings mined from one half of the labelled training rows, dealt into groups) and
patterns (abuse beside a pronoun, dense abuse, shouting, rows of exclamation marks). A generative label model has for
each class a probability of each vote given the vote of one other voter, the one it depends on most: correlations are
part of the likelihood, as a tree. It is estimated by expectation maximization over the other half of the labelled
rows, where the label is one more noisy voter, and over unlabelled training rows. Its posterior labels train a linear
classifier over mined features and votes, which scores every whole text.

Labels are read from training rows only: those whose crc32(doc_id as text) mod 5 is not 0. ``labels``, ``lang``,
``source`` and ``doc_id`` are no inputs of a score. Bounds: ``MAX_ROWS`` labelled rows and as many unlabelled ones, taken
by the order of a hash of the id, and ``MAX_FEATURES`` mined features.

Defined results: null and empty texts score by the bias and the absent votes alone; a null id counts as the empty
text for the split; conflicting labels of one id are separate rows; null labels are not read; without labels of both
kinds the fixed lexicon decides; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.memory import lean

MAX_ROWS, MAX_FEATURES = 20_000, 3000
#: Votes.
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
#: Words below which a voter that finds nothing abstains.
FEW = 20
#: Lexicon and pattern voters that are not mined.
FIXED = len(("en", "fr", "de", "es", "dense", "aimed", "shouting", "bangs"))
#: Groups that mined words, and word beginnings, are dealt into; each is two voters (any at all, and many).
GROUPS = 6
BEGINNINGS = (3, 4, 5, 6)
#: Words whose mined features a task remembers, at most.
CACHE = 300_000

# Words of abuse by language.
ABUSE_OF = {
    "en": frozenset(
        "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool filthy vermin garbage coward liar "
        "imbecile pig freak creep jerk bastard bitch crap damn shit fuck fucking asshole hate ugly retard".split()
    ),
    "fr": frozenset("connard salaud imbécile crétin débile merde ordure pourriture abruti minable".split()),
    "de": frozenset("arschloch dummkopf trottel abschaum scheiße schwein versager widerlich erbärmlich".split()),
    "es": frozenset("imbécil estúpido estúpida basura mierda cabrón gilipollas asqueroso patético escoria".split()),
}
ABUSE = frozenset().union(*ABUSE_OF.values())
_WORD = re.compile(r"[^\W\d_]+")
_AIMED = re.compile(r"\b(?:you|your|u|this|these|they|tu|vous|du|ihr|usted|eres)\b(?:\W+\w+){0,2}?\W+(\w+)", re.I)
_BANGS = re.compile(r"!{2,}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def features_of(word: str) -> list[str]:
    """A word, marked, and its beginnings."""
    return ["w:" + word, *[f"{n}:" + word[:n] for n in BEGINNINGS if len(word) >= n]]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Mined features with their voter groups, and the classifier's weights."""

    features: dict[str, int] = field(default_factory=dict)
    #: The voter group of each feature; -1: none.
    groups: list[int] = field(default_factory=list)
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    @property
    def n_voters(self) -> int:
        return FIXED + 2 * GROUPS * (1 + len(BEGINNINGS))

    def _numbers(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = tuple(self.features[f] for f in features_of(word) if f in self.features)
        return found

    def look(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the mined features in a text, their rates, its votes)."""
        whole = text or ""
        words = Counter(words_of(whole))
        n = words.total()
        fired = np.zeros(self.n_voters, bool)
        abuse = 0
        if not ABUSE.isdisjoint(words):
            for k, lexicon in enumerate(ABUSE_OF.values()):
                fired[k] = not lexicon.isdisjoint(words)
            abuse = sum(words[w] for w in ABUSE)
        fired[4] = abuse > 0.005 * n
        fired[5] = abuse > 0 and any(m.lower() in ABUSE for m in _AIMED.findall(whole))
        letters = sum(len(w) * k for w, k in words.items())
        fired[6] = letters > 0 and sum(map(str.isupper, whole)) > 0.5 * letters
        fired[7] = len(_BANGS.findall(whole)) > 0.02 * n > 0
        counts: Counter = Counter()
        for w, k in words.items():
            for f in self._numbers(w):
                counts[f] += k
        hits = np.zeros((self.n_voters - FIXED) // 2)
        for f, k in counts.items():
            if self.groups[f] >= 0:
                hits[self.groups[f]] += k
        fired[FIXED::2], fired[FIXED + 1 :: 2] = hits > 0, hits > 0.004 * n
        votes = np.where(fired, TOXIC, CLEAN if n >= FEW else ABSTAIN)
        numbers = np.fromiter(counts, np.int64, len(counts))
        rates = np.minimum(1.0, 60 * np.fromiter(counts.values(), float, len(counts)) / (n + 30))
        return numbers, rates, votes

    def inputs(self, numbers: np.ndarray, rates: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classifier's inputs: each feature's presence and rate, the votes, the bias."""
        m = len(self.features)
        fired = np.flatnonzero(votes == TOXIC)
        return np.r_[numbers, m + numbers, 2 * m + fired, 2 * m + len(votes)], np.r_[np.full(len(numbers), 0.3), rates, np.ones(len(fired) + 1)]

    def score(self, numbers: np.ndarray, rates: np.ndarray, votes: np.ndarray) -> float:
        if self.weights is None:
            return 0.9 if (votes[:4] == TOXIC).any() else 0.1
        where, values = self.inputs(numbers, rates, votes)
        return float(1 / (1 + np.exp(-np.clip(self.weights[where] @ values, -30, 30))))


@dataclass
class LabelModel:
    """A tree of voters for each of two classes.

    ``theta[c, j, v]``: the probability that voter j votes v in class c. ``parent[j]``: the voter that j depends on, -1
    for none. ``pairs[c, j, u, v]``: the probability that j votes v where its parent votes u. ``strength[j]``: the mutual
    information of j and its parent within the classes. ``accuracy``: how often given labels are right.
    """

    prior: float
    theta: np.ndarray
    parent: np.ndarray
    pairs: np.ndarray
    strength: np.ndarray
    accuracy: float

    def log_odds(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent.tolist()):
            t = np.log(self.theta[:, j] if p < 0 else self.pairs[:, j])
            ratio = t[1] - t[0]
            out += ratio[votes[:, j]] if p < 0 else ratio[votes[:, p], votes[:, j]]
        trust = np.log(self.accuracy / (1 - self.accuracy))
        return out + np.where(labels < 0, 0.0, np.where(labels > 0, trust, -trust))


def _estimate(one_hot: np.ndarray, weight: np.ndarray, posterior: np.ndarray, accuracy: float, smooth: float = 2.0) -> LabelModel:
    """The most likely model, given each row's weight and probability of class 1; the tree by mutual information."""
    n_voters, values = one_hot.shape[1] // 3, 3
    share = np.stack([1 - posterior, posterior]) * weight
    counts = np.stack([(one_hot * w[:, None]).T @ one_hot for w in share.astype(np.float32)]).astype(float)
    counts = counts.reshape(2, n_voters, values, n_voters, values)
    size = share.sum(axis=1)
    single = np.stack([[counts[c, j, :, j, :].diagonal() for j in range(n_voters)] for c in range(2)])
    theta = (single + smooth / values) / (size[:, None, None] + smooth)
    joint = counts / np.maximum(size, 1e-9)[:, None, None, None, None]
    expected = np.maximum(single[:, :, :, None, None] * single[:, None, None, :, :] / np.maximum(size, 1e-9)[:, None, None, None, None] ** 2, 1e-12)
    information = ((size / size.sum())[:, None, None, None, None] * joint * np.log(np.maximum(joint, 1e-12) / expected)).sum(axis=(0, 2, 4))
    np.fill_diagonal(information, 0)
    # An edge must pay for its eight parameters (Bayes' information criterion); the tree grows by its strongest edges.
    least = 4 * np.log(max(2.0, size.sum())) / max(1.0, size.sum())
    parent, strength = np.full(n_voters, -1), np.zeros(n_voters)
    best, source, left = np.full(n_voters, -1.0), np.full(n_voters, -1), np.ones(n_voters, bool)
    for _ in range(n_voters):
        j = int(np.argmax(np.where(left, best, -2)))
        if best[j] > least:
            parent[j], strength[j] = source[j], best[j]
        left[j] = False
        nearer = left & (information[j] > best)
        best[nearer], source[nearer] = information[j][nearer], j
    pairs = np.zeros((2, n_voters, values, values))
    for j, p in enumerate(parent.tolist()):
        if p >= 0:
            both = counts[:, p, :, j, :]
            pairs[:, j] = (both + smooth * theta[:, j, None, :]) / (both.sum(axis=2, keepdims=True) + smooth)
    prior = float(np.clip(size[1] / max(1e-9, size.sum()), 0.01, 0.99))
    return LabelModel(prior, theta, parent, pairs, strength, accuracy)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, LabelModel]:
    """(posterior of class 1 of each row, the model): expectation maximization over rows with and without labels.

    ``votes``: ABSTAIN, CLEAN or TOXIC by row and voter. ``labels``: 0, 1, or -1 where there is none. The first estimate
    is of the labelled rows, or without any of those where most voters that say something say toxic.
    """
    rows, at, times = np.unique(np.c_[votes, labels + 1].astype(np.int8), axis=0, return_inverse=True, return_counts=True)
    rows, labels_of, weight = rows[:, :-1].astype(np.int64), rows[:, -1].astype(np.int64) - 1, times.astype(float)
    one_hot = (rows[:, :, None] == np.arange(3)).reshape(len(rows), -1).astype(np.float32)
    known = labels_of >= 0
    if known.any():
        posterior, used = np.where(labels_of > 0, 0.95, 0.05), weight * known
    else:
        says = (rows == TOXIC).sum(axis=1) / np.maximum(1, (rows != ABSTAIN).sum(axis=1))
        posterior, used = np.where(says >= 0.5, 0.9, 0.1), weight
    accuracy = 0.95
    model = _estimate(one_hot, used, posterior, accuracy)
    for _ in range(rounds):
        posterior = 1 / (1 + np.exp(-np.clip(model.log_odds(rows, labels_of), -30, 30)))
        if known.any():
            right = np.where(labels_of > 0, posterior, 1 - posterior)
            accuracy = float(np.clip((right * weight)[known].sum() / weight[known].sum(), 0.7, 0.99))
        model = _estimate(one_hot, weight, posterior, accuracy)
    return posterior[at.ravel()], model


def _fit(indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, n_features: int, target: np.ndarray, epochs: int = 200, l2: float = 1e-4, rows: int = 4096) -> np.ndarray:
    """Logistic regression on sparse inputs, full batches with Adagrad steps; the classes weigh alike up to 4 to 1.

    Every row has an input, the bias. Gradients are added up over blocks of ``rows``.
    """
    weights, squares = np.zeros(n_features), np.full(n_features, 1e-8)
    share = np.clip(target.mean(), 0.01, 0.99)
    weight = 1 + target * (min(4.0, (1 - share) / share) - 1)
    for _ in range(epochs):
        gradient = l2 * weights
        for a in range(0, len(target), rows):
            b = min(a + rows, len(target))
            ends = indptr[a : b + 1]
            at, x = indices[ends[0] : ends[-1]], values[ends[0] : ends[-1]]
            z = np.add.reduceat(weights[at] * x, ends[:-1] - ends[0])
            error = weight[a:b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[a:b])
            gradient += np.bincount(at, weights=np.repeat(error, np.diff(ends)) * x, minlength=n_features) / len(target)
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(_toxic, _text, _id) of the documents of at most ``max_rows`` labels; the bound also bounds the broadcast."""
    picked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna().where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(max_rows)
    return docs.select(F.col("doc_id"), F.col("text").alias("_text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_toxic", "_text", "_id")


def unlabelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(_toxic: null, _text, _id) of at most ``max_rows`` training ids without a label; their labels are never read."""
    own = docs.select(F.col("doc_id").alias("_id")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    picked = own.join(labels.select(F.col("doc_id").alias("_id")), "_id", "left_anti").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    return docs.select(F.col("doc_id"), F.col("text").alias("_text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(F.lit(None).cast("int").alias("_toxic"), "_text", "_id")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Mine features, fit the label model and train the classifier."""
    rows = training_rows(docs, labels, max_rows)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {(half, y): Counter() for half in (0, 1) for y in (0, 1)}
        for batch in batches:
            for y, text, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = seen[half, int(y > 0)]
                found.update({f for w in set(words_of(text or "")) for f in features_of(w)})
                found[""] += 1
        names = sorted(set().union(*seen.values()))
        columns = [pa.array([seen[key][f] for f in names], pa.int64()) for key in ((0, 0), (0, 1), (1, 0), (1, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["feature", "a0", "a1", "b0", "b1"])

    # Rows of one half tell which words voters listen to; the label model is estimated on the other.
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    counted = rows.select("_toxic", "_text", half).mapInArrow(count, "feature string, a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    sums = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])
    counts = sums.withColumn("n0", F.col("a0") + F.col("b0")).withColumn("n1", F.col("a1") + F.col("b1"))
    totals = counts.where(F.col("feature") == "").first()
    model = Model()
    if totals is None or not totals["n0"] or not totals["n1"]:
        return model
    n0, n1 = totals["n0"], totals["n1"]

    def odds(of0: str, of1: str, all0: int, all1: int) -> Column:
        return F.log((F.col(of1) + 0.5) / (all1 + 1.0)) - F.log((F.col(of0) + 0.5) / (all0 + 1.0))

    least = 4 if n1 >= 200 else 2
    strong = counts.where((F.col("feature") != "") & (F.col("n0") + F.col("n1") >= least)).withColumn("strength", F.abs(odds("n0", "n1", n0, n1)) * F.sqrt(F.col("n0") / n0 + F.col("n1") / n1))
    strong = strong.withColumn("odds", odds("a0", "a1", totals["a0"], totals["a1"]))
    mined = strong.orderBy(F.desc("strength"), "feature").limit(MAX_FEATURES).collect()
    model.features = {r["feature"]: k for k, r in enumerate(mined)}
    kinds = ["w", *map(str, BEGINNINGS)]
    heard = max(2, least // 2)
    model.groups = [GROUPS * kinds.index(r["feature"][0]) + zlib.crc32(r["feature"].encode()) % GROUPS if r["odds"] > np.log(6) and r["a1"] >= heard else -1 for r in mined]

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.look(t) for t in batch.column(1).to_pylist()]
            packed = [pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in enumerate(("<i4", "<f4", "<i1"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[0:1], *batch.columns[2:4], *packed], names=["y", "half", "h", "numbers", "rates", "votes"])

    every = rows.unionByName(unlabelled_rows(docs, labels, max_rows)).select("_toxic", "_text", half, F.xxhash64("_id").alias("h"))
    looked = every.mapInArrow(look, "y int, half int, h bigint, numbers binary, rates binary, votes binary")
    # Documents that share an id share its hash: their order is that of what is learned from them, never chance.
    sample = looked.orderBy(F.col("y").isNull(), "h", "y", "votes", "numbers", "rates").limit(3 * max_rows).collect()
    votes = np.stack([np.frombuffer(r["votes"], np.int8) for r in sample])
    # Voters were mined from the labels of half 0, which therefore say nothing here.
    given = np.array([-1 if r["y"] is None or not r["half"] else int(r["y"] > 0) for r in sample])
    if not (given == 0).any() or not (given == 1).any():
        given = np.array([-1 if r["y"] is None else int(r["y"] > 0) for r in sample])
    _, labelling = label_model(votes, given)
    # The posterior of every row takes its label in, as one more vote of the accuracy that was learned.
    labelled = np.array([-1 if r["y"] is None else int(r["y"] > 0) for r in sample])
    posterior = 1 / (1 + np.exp(-np.clip(labelling.log_odds(votes.astype(np.int64), labelled), -30, 30)))
    rows_of = []
    for k, v in enumerate(votes):
        where, values = model.inputs(np.frombuffer(sample[k]["numbers"], "<i4").astype(np.int64), np.frombuffer(sample[k]["rates"], "<f4"), v)
        rows_of.append((where.astype(np.int32), values.astype(np.float32)))
        sample[k] = None  # its bytes are not needed any more
    indptr = np.r_[0, np.cumsum([len(x) for x, _ in rows_of])]
    n_inputs = 2 * len(model.features) + votes.shape[1] + 1
    model.weights = _fit(indptr, np.concatenate([x for x, _ in rows_of]), np.concatenate([v for _, v in rows_of]), n_inputs, posterior)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, score, predicted) for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_rows))
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            scores = np.array([fitted.score(*fitted.look(t.as_py())) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double, predicted int")
