"""Masked pseudo-likelihood scores of documents.

A word's conditional probability, given the ``REACH`` words on either side of
it, comes from a small network: the neighbours' vectors, each weighted by its
position, are added up; the sum is scored against the classes of the
vocabulary and then against the words of the right class (two softmaxes).  A
document's score is the sum of the logarithms of its words' probabilities.

Vocabulary: the lower-cased words that make up ``SHARE`` of all words or more, so
their number follows the corpus and is at most ``1 / SHARE``; classes and members
are its square root.  All other words share buckets by a checksum, whose
probability the network gives; a word's own part of its bucket comes from its
spelling: the product of its bytes' probabilities after the two before, counted
over all rare words of the corpus (three, two and no bytes mixed by ``MIX``), times
the number of buckets.  So a rare word of the corpus' languages scores far above
noise, which has the same buckets.

Training: in each of ``ROUNDS`` rounds every partition starts from the same weights
and trains in numpy on all of its documents, in each batch on another ``MASKED``-th
part of the positions, so that every word of every document is masked and
predicted once; the partitions' weights are averaged, by number of words, in a
tree of groups of ``FAN_IN``.  So the weights gathered grow with the number of
partitions, while what reaches the driver has the size of one model.

Defined results: a null or empty text has no words, the sum 0 and a null mean;
repeated rows are scored alike; an empty table gives an empty result and
untrained weights; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, ship, table
from .tokens import in_parts

SHARE = 5e-5
BUCKETS = 256  # the last words of the vocabulary: buckets of rare words
MIX = (0.75, 0.2, 0.05)
# Bound of a worker's cache of rare words.
CACHED_WORDS = 600_000
REACH = 2
WIDTH = 16
ROUNDS = 2
MASKED = 2  # one position in so many is masked and predicted, in each round
BATCH = 16_384  # words scored at once
STEP = 16_384  # masked words per training step
RATE = 0.1
FAN_IN = 32
SEED = 5
# Between these bounds the exponentials of single precision and their sums neither vanish nor overflow.
SAFE = 60.0


@dataclass
class Weights:
    """vectors: per word (the last for the outside of a text); place: per
    neighbour's position; top, top_bias: per class; leaf, leaf_bias: per class
    and member."""

    vectors: np.ndarray
    place: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    leaf: np.ndarray
    leaf_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.vectors, self.place, self.top, self.top_bias, self.leaf, self.leaf_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Weights(*out)


def fresh(words: int, seed: int = SEED) -> Weights:
    """Untrained weights for a vocabulary of ``words`` words and the buckets."""
    draw = np.random.default_rng(seed)
    small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
    classes = max(2, math.isqrt(words + BUCKETS - 1) + 1)
    members = -(-(words + BUCKETS) // classes)
    return Weights(small(words + BUCKETS + 1, WIDTH), 1 + small(2 * REACH, WIDTH), small(classes, WIDTH), np.zeros(classes, np.float32),
                   small(classes, members, WIDTH), np.zeros((classes, members), np.float32))


def soft(scores: np.ndarray, target: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each row's target, and (with ``slopes``) all probabilities."""
    if scores.size and not -SAFE < scores.min() <= scores.max() < SAFE:
        scores -= scores.max(axis=1, keepdims=True)
    chosen = scores[np.arange(len(scores)), target]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    if slopes:
        scores /= total[:, None]
    return chosen - np.log(total), scores


def predict(w: Weights, around: np.ndarray, target: np.ndarray, slopes: bool = False):
    """Log-probability of each target given the ids ``around`` it; with
    ``slopes`` the gradient of their negative sum too."""
    # every word's vector as it counts at each place; then one look-up per neighbour
    at_place = w.vectors * w.place[:, None, :]
    h = at_place[0].take(around[:, 0], axis=0)
    for k in range(1, len(at_place)):
        h += at_place[k].take(around[:, k], axis=0)
    kind, member = np.divmod(target, w.leaf.shape[1])
    logs, p = soft(h @ w.top.T + w.top_bias, kind, slopes)
    grad = [np.zeros_like(a) for a in w.arrays()] if slopes else None
    if slopes:
        p[np.arange(len(p)), kind] -= 1
        grad[2], grad[3], back = p.T @ h, p.sum(axis=0), p @ w.top
    order = np.argsort(kind.astype(np.int16), kind="stable")  # a radix sort; there are few classes
    cuts = np.searchsorted(kind[order], np.arange(len(w.top) + 1))
    own, mine = h.take(order, axis=0), member[order]  # sorted by class, so that a class is a slice
    more, extra = np.empty(len(order), logs.dtype), np.empty_like(own) if slopes else None
    for c in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[c], cuts[c + 1])
        more[part], p = soft(own[part] @ w.leaf[c].T + w.leaf_bias[c], mine[part], slopes)
        if slopes:
            p[np.arange(len(p)), mine[part]] -= 1
            grad[4][c], grad[5][c] = p.T @ own[part], p.sum(axis=0)
            extra[part] = p @ w.leaf[c]
    logs[order] += more
    if slopes:
        back[order] += extra
    if not slopes:
        return logs
    # per place the slopes of each word's rows are added up; both gradients follow from the sums
    for k, near in enumerate(around.T):
        order = np.argsort(near.astype(np.uint16) if len(w.vectors) < 1 << 16 else near, kind="stable")
        ids = near[order]
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ids, summed = ids[begin], np.add.reduceat(back.take(order, axis=0), begin, axis=0)
        grad[0][ids] += summed * w.place[k]
        grad[1][k] = (summed * w.vectors[ids]).sum(axis=0)
    return logs, grad


def windows(texts: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of several texts: ids around each (``outside`` beyond its
    text), its own id, and the number of its text."""
    gap = np.full(REACH, outside, np.int32)
    line = np.concatenate([gap] + [x for t in texts for x in (t, gap)]) if texts else gap
    sizes = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(of)) + REACH * (of + 1)
    around = np.stack([line[at + k] for k in range(-REACH, REACH + 1) if k], axis=1) if len(at) else np.zeros((0, 2 * REACH), np.int32)
    return around, line[at], of


def train(w: Weights, batches, offset: int, masked: int = MASKED, rate: float = RATE, step: int = STEP) -> tuple[Weights, int]:
    """Train on lists of id arrays; returns the weights and how many words they
    saw.  Adagrad; each batch takes every ``masked``-th position, from ``offset`` on."""
    w = Weights(*[a.copy() for a in w.arrays()])
    squares, seen = [np.full_like(a, 1e-2) for a in w.arrays()], 0
    for texts in batches:
        around, target, _ = windows(texts, len(w.vectors) - 1)
        chosen = np.arange(offset % masked, len(target), masked)
        seen += len(target)
        # neighbouring positions go to different steps
        steps = max(1, -(-len(chosen) // step))
        for s in range(steps):
            rows = chosen[s::steps]
            if not len(rows):
                continue
            _, grad = predict(w, around[rows], target[rows], slopes=True)
            for a, g, q in zip(w.arrays(), grad, squares, strict=True):
                g /= len(rows) ** 0.5
                q += g * g
                a -= rate * g / np.sqrt(q)
    return w, seen


class WordIds(dict):
    """Word -> id; words outside the vocabulary go to the buckets."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w.encode(), k) for k, w in enumerate(words))
        self.first_bucket = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.first_bucket + zlib.crc32(word) % BUCKETS


def word_counts(docs: DataFrame, flush_at: int = 600_000) -> DataFrame:
    """``word, n`` of all documents, summed in the task first."""
    ship(docs.sparkSession)

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update((t or "").encode().lower().split())
            if len(seen) > flush_at:
                yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())}).astype({"word": object, "n": "int64"})

    return table(docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame, share: float = SHARE) -> list[str]:
    """Words with at least ``share`` of all, the most frequent first: at most
    ``1 / share`` of them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.word for r in counts.where(F.col("n") >= F.lit(max(1.0, share * total))).orderBy(F.desc("n"), "word").collect()]


# A word's bytes follow two starts and end with an end mark.
START_MARK, END_MARK, SYMBOLS = 256, 257, 258


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all three neighbouring symbols of the words, and where each
    word's begin."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    line = np.full(int(sizes.sum()) + 2 * len(words), START_MARK, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64)
    body = np.ones(len(line), bool)
    for k in range(2):
        body[begin + k] = False
    body[begin + sizes + 1] = False
    line[body] = np.frombuffer(b"".join(words), np.uint8)
    line[begin + sizes + 1] = END_MARK
    code = (line[:-2] * SYMBOLS + line[1:-1]) * SYMBOLS + line[2:]
    inner = np.ones(len(code), bool)  # not across two words
    for k in (1, 2):
        at = begin[1:] - k
        inner[at] = False
    return code[inner], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


class Spelling:
    """Log-probabilities of rare words from counts of byte triples."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order].astype(np.float64)
        above = self.codes // SYMBOLS
        self.above, at = np.unique(above, return_inverse=True)
        self.above_counts = np.bincount(at, weights=self.counts, minlength=len(self.above))
        self.pairs = np.bincount(self.codes % SYMBOLS ** 2, weights=self.counts, minlength=SYMBOLS ** 2).reshape(SYMBOLS, SYMBOLS)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word's bytes and its end."""
        if not words:
            return np.zeros(0)
        code, begin = triples(words)
        code, at = np.unique(code, return_inverse=True)  # the same triples come again and again
        look = lambda keys, values, x: (np.where(keys[(i := np.minimum(np.searchsorted(keys, x), len(keys) - 1))] == x, values[i], 0.0)
                                        if len(keys) else np.zeros(len(x)))
        three, above = look(self.codes, self.counts, code), look(self.above, self.above_counts, code // SYMBOLS)
        two, row = self.pairs[code // SYMBOLS % SYMBOLS, code % SYMBOLS], self.pairs.sum(axis=1)[code // SYMBOLS % SYMBOLS]
        p = MIX[0] * three / np.maximum(above, 1) + MIX[1] * two / np.maximum(row, 1) + MIX[2] / (SYMBOLS - 1)
        return np.add.reduceat(np.log(p)[at], begin)


class Encoder:
    """Ids of words, and of rare words their part of the bucket (logarithm); both
    are found by one look-up per word in a cache, whose first entries are the
    vocabulary and which keeps at most ``CACHED_WORDS`` rare words."""

    def __init__(self, words: list[str], spelled: Spelling | None) -> None:
        self.known, self.spelled = WordIds(words), spelled
        self.place = {w.encode(): k for k, w in enumerate(words)}
        self.ids = np.arange(len(words), dtype=np.uint32)
        self.parts = np.zeros(len(words))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[float]]:
        cut = [(t or "").encode().lower().split() for t in texts]
        new = list(set().union(*cut).difference(self.place))
        start, room = len(self.ids), max(0, CACHED_WORDS + self.known.first_bucket - len(self.ids))
        ids = np.concatenate([self.ids, np.fromiter(map(self.known.__missing__, new), np.uint32, len(new))])
        own = np.zeros(len(new)) if self.spelled is None else np.minimum(0.0, self.spelled.of(new) + math.log(BUCKETS))
        parts = np.concatenate([self.parts, own])
        self.place.update(zip(new, range(start, start + len(new)), strict=True))
        find = self.place.__getitem__
        at = [np.fromiter(map(find, c), np.int64, len(c)) for c in cut]
        self.ids, self.parts = ids[:start + room], parts[:start + room]
        for w in new[room:]:
            del self.place[w]
        return [ids[a] for a in at], [float(parts[a].sum()) for a in at]


def spelling(counts: DataFrame, words: list[str]) -> Spelling:
    """All byte triples of all words outside the vocabulary, by how often they
    occur.  Words are UTF-8, so there are at most some millions of triples (under
    258 cubed in any case), however large the corpus: none is left out."""
    ship(counts.sparkSession)
    known = counts.sparkSession.sparkContext.broadcast(set(words))

    def count(batches):
        found: Counter = Counter()
        for pdf in batches:
            rare = [(w.encode(), n) for w, n in zip(pdf["word"], pdf["n"], strict=True) if w not in known.value]
            if rare:
                code, begin = triples([w for w, _ in rare])
                sizes = np.diff(np.append(begin, len(code)))
                kinds, at = np.unique(code, return_inverse=True)
                total = np.bincount(at, weights=np.repeat([float(n) for _, n in rare], sizes))
                for c, n in zip(kinds.tolist(), total.tolist(), strict=True):
                    found[c] += int(n)
        yield pd.DataFrame({"code": list(found), "n": list(found.values())}).astype("int64")

    summed = counts.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    return Spelling(found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def encoded(docs: DataFrame, words: list[str], spelled: Spelling | None = None) -> DataFrame:
    """``doc_id, ids, rare``: the word ids of each whole text, 32 bits each, and the
    sum of its rare words' parts of their buckets (0 without ``spelled``)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(words, spelled))

    def encode(texts):
        ids, rare = [], []
        for part in in_parts(texts):
            own, parts = shared.value.encode(texts[part])
            ids += [n.tobytes() for n in own]
            rare += parts
        return ids, rare

    return beside(docs, ["doc_id"], ["text"], "ids binary, rare double", encode)


def texts_of(column, at_once: int = 200_000):
    """Lists of id arrays with about ``at_once`` words each, and their rows."""
    texts, first, n = [], 0, 0
    for k, raw in enumerate(column):
        texts.append(np.frombuffer(raw, np.int32))
        n += len(texts[-1])
        if n >= at_once:
            yield texts, slice(first, k + 1)
            texts, first, n = [], k + 1, 0
    if texts:
        yield texts, slice(first, len(column))


PART = "slot long, words long, weights binary"


def averaged(parts: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """Mean of the partitions' weights by number of words.  Each task adds up
    at most ``fan_in`` of them; the driver gets one."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        total = np.zeros(len(pdf["weights"].iloc[0]) // 4, np.float64)
        for n, raw in zip(pdf["words"], pdf["weights"], strict=True):
            total += n * np.frombuffer(raw, np.float32).astype(np.float64)
        words = int(pdf["words"].sum())
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0] // fan_in], "words": [words], "weights": [(total / words).astype(np.float32).tobytes()]})

    last = parts.agg(F.max("slot")).first()[0]
    while last is not None:
        parts = table(parts.groupBy(F.floor(F.col("slot") / fan_in)).applyInPandas(add, PART), "weights")
        if last < fan_in:
            return np.frombuffer(parts.first().weights, np.float32)
        last //= fan_in
    return None


def fit(ids: DataFrame, words: int, *, rounds: int = ROUNDS, masked: int = MASKED, rate: float = RATE, step: int = STEP) -> Weights:
    """Train on all rows of ``ids``, of a vocabulary of ``words`` words."""
    ship(ids.sparkSession)
    weights = fresh(words)
    for k in range(rounds):
        start = ids.sparkSession.sparkContext.broadcast(weights)

        def learn(batches, start=start, k=k):
            chunks = (texts for pdf in batches for texts, _ in texts_of(pdf["ids"]))
            own, words = train(start.value, chunks, k, masked, rate, step)
            if words:
                yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "words": [words], "weights": [own.flat().tobytes()]})

        mean = averaged(table(ids.select("ids").mapInPandas(learn, PART), "trained-weights"))
        weights = weights if mean is None else weights.filled(mean)
    return weights


def score(ids: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_probability`` of all rows."""
    shared = ids.sparkSession.sparkContext.broadcast(weights)

    def scores(column, rare):
        w, sizes, sums = shared.value, [], []
        for texts, _ in texts_of(column):
            around, target, of = windows(texts, len(w.vectors) - 1)
            total = np.zeros(len(texts))
            for a in range(0, len(target), BATCH):
                logs = predict(w, around[a:a + BATCH], target[a:a + BATCH])
                total += np.bincount(of[a:a + BATCH], weights=logs, minlength=len(texts))
            sizes += map(len, texts)
            sums += total.tolist()
        sums = [x + y for x, y in zip(sums, rare, strict=True)]
        return sizes, sums, [x / n if n else None for x, n in zip(sums, sizes, strict=True)]

    return beside(ids, ["doc_id"], ["ids", "rare"], "n_words long, log_likelihood double, mean_log_probability double", scores)


def pseudo_likelihood(docs: DataFrame, **training) -> DataFrame:
    """Train on ``docs`` (``doc_id, text``) and score every one of them."""
    counts = word_counts(docs)
    words = vocabulary(counts)
    ids = table(encoded(docs, words, spelling(counts, words)), "word-ids")
    return score(ids, fit(ids, len(words), **training))
