"""Toxicity by maximum-scoring segments.

Tokens carry log-odds under Dirichlet priors; a linear scan finds every maximal segment of a text; segments are
significant by extreme-value statistics, whose tail probability, calibrated on labels, is the text's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, materialize, small_batches
from .decontam import _CLASS
from .folding import fold
from .hashing import SpanHasher, mix
from .packing import slices

#: The model is fitted on at most so many labelled rows of each class, those with the smallest hashes of their ids,
#: and of each of these texts on all its words. Bounds the fit, not the scoring.
TRAIN_ROWS = 5_000

#: Bytes of the word beginnings that are features too, as words of one stem differ in their ends.
PREFIXES = (6, 5, 4)
#: Standard errors taken off a log-odds before it counts; smallest prior count; prior tokens in all.
DOUBT, PRIOR, PRIOR_TOKENS = 3.0, 0.5, 1_000.0
#: Costs of a token that are tried; that with the likeliest labels in the cross-check is taken.
DRIFTS = (0.25, 0.5, 1.0, 2.0)
#: A segment is reported if fewer than so many are expected by chance in a text.
EXPECT = 0.05

SEGMENTS = "array<struct<start:bigint,end:bigint,score:double,expect:double>>"


@dataclass
class Words:
    """The words of many texts: text number, byte range in the text, hashes, hashes of their beginnings."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    begin: np.ndarray
    keys: list[np.ndarray]


class Splitter:
    def __init__(self) -> None:
        self.hasher = SpanHasher()

    def __call__(self, texts: list[bytes]) -> Words:
        folded = fold(texts)
        data, begin = folded.data, folded.begin
        kind = _CLASS[data] > 0
        before = np.concatenate([[False], kind[:-1]])
        start, stop = np.flatnonzero(kind & ~before), np.flatnonzero(~kind & before)
        sums = self.hasher.sums(data)
        keys = [self.hasher.spans(sums, start, stop)]
        for n in PREFIXES:
            # A beginning is another feature than the word of the same letters.
            keys.append(np.where(stop - start > n, self.hasher.spans(sums, start, np.minimum(stop, start + n)) ^ np.uint64(0x5851F42D4C957F2D), np.uint64(0)))
        return Words(np.searchsorted(begin, start, "right") - 1, folded.back[start], folded.back[stop], begin, keys)


@dataclass
class Lexicon:
    """Feature hashes, sorted, with their weights."""

    key: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def weights(self, words: Words) -> np.ndarray:
        """Each word's weight: the largest of its own and its beginnings'; 0 if it has none."""
        out = np.full(len(words.start), -np.inf)
        for key in words.keys:
            at = np.flatnonzero(self.seen[(key >> np.uint64(44)).astype(np.int64)])
            if len(at) and len(self.key):
                place = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
                out[at] = np.maximum(out[at], np.where(self.key[place] == key[at], self.weight[place], -np.inf))
        return np.where(np.isinf(out), 0, out)


@dataclass
class Features:
    """Each text's distinct features: feature hash and text number."""

    key: np.ndarray
    text: np.ndarray


@dataclass
class Hits:
    """The words with weight of many texts: text number, place in the text, weight; and each text's words."""

    text: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    size: np.ndarray


def features(words: Words) -> Features:
    """A feature counts once for each text, so that a text that repeats it does not make it certain."""
    key, text = [], []
    for k in words.keys:
        live = np.flatnonzero(k)
        once = live[np.unique(mix(k[live] + mix(words.text[live].astype(np.uint64))), return_index=True)[1]]
        key.append(k[once])
        text.append(words.text[once])
    return Features(np.concatenate(key), np.concatenate(text))


def log_odds(bad: Column, good: Column, n_bad: float, n_good: float, total: float) -> Column:
    """A feature's log-odds between the classes with Dirichlet priors, less DOUBT standard errors, towards 0.

    bad, good: texts of each class that hold it; n_bad, n_good: texts of each class; total: bad and good over all features.
    """
    prior = F.greatest(F.lit(PRIOR), F.lit(PRIOR_TOKENS / max(1.0, total)) * (bad + good))
    odds = F.log((bad + prior) / (n_bad + 2 * prior)) - F.log((good + prior) / (n_good + 2 * prior))
    doubt = DOUBT * F.sqrt(1 / (bad + prior) + 1 / (good + prior))
    return F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - doubt)


def hits(words: Words, known: Lexicon) -> Hits:
    weight = known.weights(words)
    at = np.flatnonzero(weight)
    size = np.bincount(words.text, minlength=len(words.begin) - 1)
    text = words.text[at]
    return Hits(text, at - (np.cumsum(size) - size)[text], weight[at], size)


def segments(score: list[float]) -> list[tuple[int, int, float]]:
    """(first, after last, score) of all maximal scoring segments, in linear time.

    Each candidate keeps the running sums before and after it; a new one is joined to the nearest earlier candidate
    that begins lower, if that one also ends lower than the new one.
    """
    found: list[list] = []  # first, after last, sum before, sum after, nearest earlier candidate that begins lower
    total = 0.0
    for i, s in enumerate(score):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = i, before
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            first, low = found[k][0], found[k][2]
            after = found[k][4]
            del found[k:]
            k = after
        found.append([first, i + 1, low, total, k])
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def found_in(h: Hits, drift: float) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(text number, its words, maximal segments as word places) of the texts that hold a word that gains."""
    gain = h.weight - drift
    hot = np.flatnonzero(gain > 0)
    # Running sums before each hot word: weights so far, less the drift of all words so far.
    before = (np.cumsum(h.weight) - h.weight)[hot] - drift * h.place[hot]
    gain, place = gain[hot], h.place[hot]
    cut = np.searchsorted(h.text[hot], np.arange(len(h.size) + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        at = slice(cut[k], cut[k + 1])
        flow = np.empty(2 * (cut[k + 1] - cut[k]) - 1)
        flow[::2] = gain[at]
        flow[1::2] = (before[at] - before[cut[k]])[1:] - (before[at] - before[cut[k]] + gain[at])[:-1]
        where = place[at]
        yield k, int(h.size[k]), [(int(where[a // 2]), int(where[(b - 1) // 2]) + 1, s) for a, b, s in segments(flow.tolist())]


@dataclass
class Model:
    words: Lexicon
    rate: float  # lambda of the extreme-value distribution
    scale: float  # its K
    drift: float
    a: float
    b: float

    def evidence(self, size: int, scores: list[float]) -> float:
        """-ln of the chance of segments like the best ones of a text, by sum statistics over any number of them."""
        x = sorted((self.rate * s - math.log(self.scale * max(1, size)) for s in scores), reverse=True)
        best = total = 0.0
        for r, v in enumerate(x, 1):
            if v <= 0 and r > 1:
                break
            total += v
            if total > 0:
                tail = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
                best = max(best, tail if r > 1 else total if total > 30 else -math.log(-math.expm1(-math.exp(-total))))
        return min(best, 60.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.a + self.b * evidence))))

    def expect(self, size: int, score: float) -> float:
        return self.scale * max(1, size) * math.exp(-min(700.0, self.rate * score))


@dataclass
class Measured:
    """Sample texts, scored by the lexicon of those on the other side: side, label, words, and the segments' scores for each drift."""

    side: np.ndarray
    toxic: np.ndarray
    size: np.ndarray
    scores: list[list[list[float]]]


def tail(gains: dict[float, float], top: float, size: np.ndarray, best: np.ndarray, drift: float) -> tuple[float, float]:
    """lambda and K from clean texts: lambda of their words' weights (and how often each comes), K from their best segments."""
    value, n = np.array([*gains, 0.0]), np.array([*gains.values(), max(1.0, size.sum() - sum(gains.values()))])
    # One weight of the largest size more than was seen.
    value, n = np.append(value, max(top, drift + 1)) - drift, np.append(n, 1.0)
    p = n / n.sum()
    if (p * value).sum() >= 0:
        value = value - (p * value).sum() - drift
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * value, 500))).sum() < 1 else (lo, mid)
    total = (size * np.exp(-lo * best)).sum()
    return lo, float(min(1.0, max(1e-9, len(size) / max(total, 1.0))))


def fit(known: Measured, gains: list[dict[float, float]], top: float, weights: tuple[float, float]) -> tuple[float, float, float, float, float]:
    """(lambda, K, drift, a, b) of the drift whose calibration makes the labels likeliest.

    gains: the weights of clean texts' words by side; weights: rows of each class (clean, toxic) that one text stands for.
    """
    row = np.where(known.toxic, weights[1], weights[0])
    row = row / row.mean()
    best = None
    for d, drift in enumerate(DRIFTS):
        most = np.array([max(s[d], default=0.0) for s in known.scores])
        evidence, tails = np.zeros(len(most)), []
        for side in (0, 1):
            clean = ~known.toxic & (known.side == side)
            m = Model(Lexicon(np.empty(0, np.uint64), np.empty(0)), *tail(gains[side], top, known.size[clean], most[clean], drift), drift, 0, 0)
            tails.append((m.rate, m.scale))
            for k in np.flatnonzero((known.side == side) & (most > 0)).tolist():
                evidence[k] = m.evidence(int(known.size[k]), known.scores[k][d])
        a, b = calibrate(evidence, known.toxic, row)
        p = np.clip(1 / (1 + np.exp(-np.clip(a + b * evidence, -40, 40))), 1e-9, 1 - 1e-9)
        loss = -(row * np.where(known.toxic, np.log(p), np.log1p(-p))).sum()
        if best is None or loss < best[0]:
            best = (loss, sum(t[0] for t in tails) / 2, sum(t[1] for t in tails) / 2, drift, a, b)
    return best[1:]


def calibrate(evidence: np.ndarray, toxic: np.ndarray, row: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the evidence, by Newton's method with a slight ridge."""
    x, beta = np.stack([np.ones(len(toxic)), evidence]), np.array([-2.0, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * (row * p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (row * (toxic - p)) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def held_out(key: Column) -> Column:
    """Whether a document's labels are kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    """Fit a model on the labelled documents that are not held out; None if a class is missing.

    Of several labels of one id the largest counts, of several texts the least. Two halves of the sample score each other for
    the calibration; the lexicon then comes from both. The texts stay on the executors: features are counted and
    weighed there, and the driver gets the features that weigh and each sample text's segment scores.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    own = known.groupBy().agg(F.sum("_toxic").alias("toxic"), F.count("*").alias("n")).first()
    if not own.n or not own.toxic or own.toxic == own.n:
        return None
    small_batches(docs.sparkSession)
    parts = [known.where(F.col("_toxic") == y).orderBy(F.xxhash64("_key"), "_key").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(materialize(parts[0].unionByName(parts[1]), "toxic-rows"))  # at most 2 * rows pairs of numbers
    sample = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(chosen, "_key")
    sample = sample.groupBy("_key").agg(F.min("_text").alias("text"), F.max("_toxic").alias("toxic"))
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("_key"), "_key")) % 2  # at most `rows` rows in each class
    sample = materialize(sample.withColumn("side", turn).drop("_key").repartition(max(1, min(64, 2 * rows // 100)), F.xxhash64("text")), "toxic-sample")
    sizes = {(r.side, r.toxic): r["count"] for r in sample.groupBy("side", "toxic").count().collect()}
    n = [[float(sizes.get((s, y), 0)) for y in (0, 1)] for s in (0, 1)]
    if not n[0][1] + n[1][1] or not n[0][0] + n[1][0]:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
        split = Splitter()
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                words = split(batch.column("text")[lo:hi].cast(pa.binary()).to_pylist())
                yield batch.column("side")[lo:hi].to_numpy(), batch.column("toxic")[lo:hi].to_numpy(), words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, toxic, words in cut(batches):
            f = features(words)
            each, place = np.unique(f.key, return_inverse=True)
            group = (2 * side + toxic)[f.text]
            held = [np.bincount(place, group == g, len(each)).astype(np.int64) for g in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), *map(pa.array, held)], ["key", "g0", "b0", "g1", "b1"])

    counts = sample.mapInArrow(lean(count), "key bigint, g0 bigint, b0 bigint, g1 bigint, b1 bigint").groupBy("key").agg(*(F.sum(c).cast("double").alias(c) for c in ("g0", "b0", "g1", "b1")))
    counts = materialize(counts, "toxic-counts")
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("g0", "b0", "g1", "b1"))).first()
    half = lambda s: log_odds(F.col(f"b{s}"), F.col(f"g{s}"), max(1.0, n[s][1]), max(1.0, n[s][0]), total[f"b{s}"] + total[f"g{s}"])
    both = log_odds(F.col("b0") + F.col("b1"), F.col("g0") + F.col("g1"), n[0][1] + n[1][1], n[0][0] + n[1][0], sum(total))
    # The lexicon for a side comes from the other one.
    weighed = counts.select("key", half(1).alias("w0"), half(0).alias("w1"), both.alias("w")).where("w0 <> 0 or w1 <> 0 or w <> 0").toArrow()
    found = weighed["key"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    lexicons = []
    for c in ("w0", "w1", "w"):
        w = weighed[c].to_numpy()[order]
        lexicons.append(Lexicon(found[order][w != 0], w[w != 0]))
    sent = docs.sparkSession.sparkContext.broadcast(lexicons[:2])
    schema = "side int, toxic int, size bigint, weight int, times bigint, scores array<array<double>>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows for how often each weight (in hundredths) comes in the clean ones."""
        for side, toxic, words in cut(batches):
            scores = [[[] for _ in DRIFTS] for _ in side]
            out: list[tuple] = []
            for s in (0, 1):
                h = hits(words, sent.value[s])
                for d, drift in enumerate(DRIFTS):
                    for k, _, segs in found_in(h, drift):
                        if side[k] == s:
                            scores[k][d] = [x for _, _, x in segs]
                clean = (side == s) & (toxic == 0)
                value, times = np.unique(np.round(100 * h.weight[clean[h.text]]).astype(int), return_counts=True)
                out += [(s, 0, None, int(v), int(t), None) for v, t in zip(value, times, strict=True)]
            size = np.bincount(words.text, minlength=len(side))
            out += [(int(s), int(y), int(z), None, None, x) for s, y, z, x in zip(side, toxic, size, scores, strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    measured = materialize(sample.mapInArrow(lean(measure), schema), "toxic-measured")
    texts = measured.where("size is not null").select("side", "toxic", "size", "scores").toArrow()
    gains: list[dict[float, float]] = [{}, {}]
    for r in measured.where("size is null").groupBy("side", "weight").agg(F.sum("times").alias("times")).collect():
        gains[r.side][r.weight / 100] = float(r.times)
    own_texts = Measured(texts["side"].to_numpy(), texts["toxic"].to_numpy() == 1, texts["size"].to_numpy(), texts["scores"].to_pylist())
    stands_for = ((own.n - own.toxic) / (n[0][0] + n[1][0]), own.toxic / (n[0][1] + n[1][1]))
    return Model(lexicons[2], *fit(own_texts, gains, max((float(x.weight.max(initial=0)) for x in lexicons[:2])), stands_for))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1), predicted (int) and the significant segments, as byte ranges, of every whole text.

    A null or empty text has no segments and the score of a text without evidence; without a model scores are 0.
    Repeated rows are scored as often as they come; whole texts of any length are scanned.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id bigint, score double, predicted int, segments {SEGMENTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, split = sent.value, Splitter()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expect", pa.float64())]))
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                n = hi - lo
                base = m.probability(0.0) if m else 0.0
                scores, spans = [base] * n, [[] for _ in range(n)]
                if m:
                    words = split([x or b"" for x in batch.column(1)[lo:hi].cast(pa.binary()).to_pylist()])
                    first = np.searchsorted(words.text, np.arange(n))
                    for k, size, found in found_in(hits(words, m.words), m.drift):
                        scores[k] = m.probability(m.evidence(size, [s for _, _, s in found]))
                        for a, b, s in found:
                            e = m.expect(size, s)
                            if e < EXPECT:
                                spans[k].append({"start": int(words.start[first[k] + a]), "end": int(words.stop[first[k] + b - 1]), "score": s, "expect": e})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "segments"]
                )

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), schema)
