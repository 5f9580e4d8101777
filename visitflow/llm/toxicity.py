"""Toxic passages by maximum-scoring segments over token log-odds.

* Words and their beginnings (``PREFIXES`` bytes) get the log-odds of their use in toxic against clean texts under
  Dirichlet priors, counted over different pairs of neighbours, so that copies of a text count once. Each scores the
  lower end of its credible interval, so rare ones score low; a word scores as the best of its beginnings or itself.
  They live in ``BUCKETS`` hash buckets: the model has a fixed size, whatever the vocabulary, and is broadcast.
* One linear scan over the word scores of a text (Ruzzo and Tompa) finds all maximal segments.
* The largest segment score of clean texts grows with the logarithm of their length and is Gumbel distributed; location
  and scale are fitted on clean training texts. A segment is significant when its p-value for a text of that length is
  at most ``SIGNIFICANT``. The standardised scores feed a logistic curve, which gives the probability of the label.

The model is fitted on at most ``LABELLED`` different labelled texts (those of lowest hash), a documented bound. Scores for the
fits of Gumbel and logistic curve come from a table learned on the other half of these rows.

Null and empty texts have no words and get the score of a text without any passage. Rows are judged one by one: repeated
rows get equal results. Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import Cache, text_slices, travels, written

travels(__name__)

BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
BLOCK = 1 << 13  # buckets that come to the driver as one array
PREFIXES = (4, 5, 6, 7, 8)
LABELLED = 10_000
PRIOR = 500.0  # pseudo-counts spread over the words as they occur in all training texts
FLAT = 1.0  # pseudo-counts of every word
CREDIBLE = 1.645  # deviations below the mean that a word's score lies
LEAST = 1.0  # a word of a lower score tells nothing
NEUTRAL, HIGHEST = -0.04, 8.0  # the score of such a word, so that a passage ends; the highest score
SIGNIFICANT = 1e-3
REJECT = 0.7

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32
    for c in range(256)
)
RESULT = "score double, passages array<struct<start:int,end:int,score:double,p_value:double>>"


@dataclass(frozen=True)
class Model:
    """Word scores by bucket, and the two curves: Gumbel (``base + slope * ln(words)``, ``scale``), logistic."""

    scores: np.ndarray
    base: float
    slope: float
    scale: float
    weight: float
    bias: float

    def standard(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (score - self.base - self.slope * np.log(np.maximum(words, 1))) / self.scale

    def probability(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        return _logistic(self.weight * np.minimum(self.standard(score, words), STANDARD_MOST) + self.bias)


STANDARD_MOST = 40.0


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def words_of(text: str | None) -> list[bytes]:
    """The words of the whole text, in order."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split() if text else []


def _features(word: bytes) -> list[int]:
    """Buckets of the word and of its beginnings, which end in a mark."""
    parts = [word, *(word[:n] + b"*" for n in PREFIXES if n < len(word))]
    return [zlib.crc32(part) & (BUCKETS - 1) for part in parts]


def word_scores(table: np.ndarray) -> Cache:
    return Cache(lambda word: float(max(table[b] for b in _features(word))))


def scores_of(words: list[bytes], known: Cache) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, ``end`` exclusive, in one pass over the positive words.

    Every proper part of a segment scores less than the whole: of equal segments the shorter ones are found.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, last with a lower start
    for i, right in zip(ups.tolist(), total[ups].tolist(), strict=True):
        left, start = right - float(scores[i]), i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, start, i + 1, j))
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - lo) for lo, r, s, e, _ in stack]


def _best(scores: np.ndarray) -> float:
    return max((s for *_, s in segments(scores)), default=0.0)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``text``, ``label`` and ``half`` of at most ``bound`` different labelled texts, those of lowest hash; written once.

    A row repeated in id and text counts once. The broadcast side holds at most ``bound`` rows of an id, a digest and a
    label, and so does what the fits bring to the driver.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label"))
    texts = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("digest"), "text")
    chosen = texts.select("id", "digest").join(known, "id").distinct().orderBy(
        F.xxhash64("id"), "id", "digest").limit(bound)
    half = F.pmod(F.xxhash64(F.md5("text")), F.lit(2)).cast("int")  # copies of a text share a half
    return written(texts.join(F.broadcast(chosen), ["id", "digest"]).dropDuplicates(["id", "digest"]).select(
        "text", "label", half.alias("half")), "toxic-labels")


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One number per different (kind of text, bucket, neighbours). Kind: 2 * half + label."""
    features, rest = Cache(_features), np.uint64(62 - BUCKET_BITS)
    for rows in batches:
        for low, high in text_slices(rows["text"].tolist()):
            found = [np.empty(0, np.uint64)]
            part = rows.iloc[low:high]
            for text, label, half in zip(part["text"], part["label"], part["half"], strict=True):
                words = words_of(text)
                buckets = [features[w] for w in words]
                many = [len(b) for b in buckets]
                own = np.array([b[0] for b in buckets], np.uint64)
                around = np.concatenate([[BUCKETS], own, [BUCKETS]]).astype(np.uint64)
                near = (around[:-2] * np.uint64(0x9E3779B97F4A7C15) + around[2:]) * np.uint64(0xD6E8FEB86659FD93)
                near = np.repeat(near >> np.uint64(BUCKET_BITS + 2), many)
                kind = np.uint64(2 * int(half) + int(label > 0))
                each = np.fromiter((x for b in buckets for x in b), np.uint64, sum(many))
                found.append(kind << np.uint64(62) | each << rest | near)
            yield pd.DataFrame({"place": np.unique(np.concatenate(found)).astype(np.int64)})


def _dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of each block of buckets as one array."""
    blocks: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, part in rows.groupby("block"):
            own = blocks.setdefault(int(block), np.zeros((4, BLOCK), "<i8"))
            own[part["kind"].to_numpy(), part["bucket"].to_numpy() - int(block) * BLOCK] = part["n"].to_numpy()
    yield pd.DataFrame({"block": list(blocks), "counts": [c.tobytes() for c in blocks.values()]})


def _log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The lower end of the log-odds of each bucket, from the numbers of different places that hold it."""
    both = toxic + clean
    prior = PRIOR * both / max(both.sum(), 1) + FLAT
    whole = prior.sum()
    odds = [np.log((n + prior) / (n.sum() + whole - n - prior)) for n in (toxic, clean)]
    deviation = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    low = odds[0] - odds[1] - CREDIBLE * deviation
    return np.where(low >= LEAST, np.minimum(low, HIGHEST), NEUTRAL).astype(np.float32)


def _gumbel(score: np.ndarray, words: np.ndarray) -> tuple[float, float, float]:
    """Location ``base + slope * ln(words)`` by least squares and scale by moments."""
    x = np.log(np.maximum(words, 1))
    slope = max(0.0, float(np.cov(x, score, bias=True)[0, 1] / x.var())) if len(x) > 1 and x.var() > 0 else 0.0
    rest = score - slope * x
    scale = max(float(rest.std()) * np.sqrt(6) / np.pi, 0.1) if len(rest) else 0.1
    return float(rest.mean()) - np.euler_gamma * scale if len(rest) else 0.0, slope, scale


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number with a weak prior, by Newton steps."""
    design = np.column_stack([x, np.ones_like(x)])
    at, ridge = np.zeros(2), np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = _logistic(design @ at)
        step = np.linalg.solve(
            design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ at
        )
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model | None:
    """The model from the given labels; the caller leaves out labels that must not be used. None: one kind is missing.

    The driver receives four numbers for each bucket, block by block, and one small row for each of at most ``bound`` texts.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels, bound)
    places = rows.mapInPandas(_places, "place bigint").distinct()
    kind = F.shiftrightunsigned("place", 62)
    bucket = F.shiftrightunsigned("place", 62 - BUCKET_BITS).bitwiseAND(F.lit(BUCKETS - 1).cast("bigint"))
    found = places.groupBy(kind.cast("int").alias("kind"), bucket.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    blocks = found.withColumn("block", F.floor(F.col("bucket") / BLOCK).cast("int")).repartition(
        BUCKETS // BLOCK, "block").mapInPandas(_dense, "block int, counts binary")
    counts = np.zeros((BUCKETS // BLOCK, 4, BLOCK))
    for row in blocks.toLocalIterator():
        counts[row["block"]] = np.frombuffer(row["counts"], "<i8").reshape(4, BLOCK)
    counts = counts.transpose(1, 0, 2).reshape(4, BUCKETS)
    kinds = counts.any(axis=1)
    if not ((kinds[0] or kinds[2]) and (kinds[1] or kinds[3])):
        return None
    # A half's texts are scored with the words of the other half; with a kind missing there, with those of both.
    apart = kinds.all()
    both = _log_odds(counts[1] + counts[3], counts[0] + counts[2])
    tables = [_log_odds(counts[3 - 2 * h], counts[2 - 2 * h]) if apart else both for h in (0, 1)]
    shipped = spark.sparkContext.broadcast(tables)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [word_scores(t) for t in shipped.value]
        for part in batches:
            words = [words_of(t) for t in part["text"]]
            best = [_best(scores_of(w, known[h])) for h, w in zip(part["half"], words, strict=True)]
            yield pd.DataFrame({"label": part["label"], "score": best, "words": [len(w) for w in words]})

    seen = rows.mapInPandas(measured, "label int, score double, words int").toPandas()
    shipped.unpersist()
    score, words, label = (seen[c].to_numpy(float) for c in ("score", "words", "label"))
    base, slope, scale = _gumbel(score[label == 0], words[label == 0])
    model = Model(both, base, slope, scale, 0.0, 0.0)
    weight, bias = _fit_logistic(np.minimum(model.standard(score, words), STANDARD_MOST), label)
    return Model(both, base, slope, scale, weight, bias)


def judged(model: Model | None, text: Column, docs: DataFrame) -> Column:
    """A struct for each whole text: ``score`` and its significant ``passages`` in word positions."""
    if model is None:
        return F.from_json(F.lit('{"score":0.0,"passages":[]}'), RESULT)
    shipped = docs.sparkSession.sparkContext.broadcast(astuple(model))

    @F.pandas_udf(RESULT)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*shipped.value)
        known = word_scores(m.scores)
        for part in texts:
            values, scores, passages = part.tolist(), [], []
            for low, high in text_slices(values):
                for value in values[low:high]:
                    words = words_of(value)
                    found = segments(scores_of(words, known))
                    best = max((s for *_, s in found), default=0.0)
                    scores.append(float(m.probability(np.array([best]), np.array([len(words)]))[0]))
                    kept = []
                    for start, end, s in found:
                        z = float(m.standard(np.array([s]), np.array([len(words)]))[0])
                        p = float(-np.expm1(-np.exp(-min(max(z, -30.0), 700.0))))
                        if p <= SIGNIFICANT:
                            kept.append({"start": start, "end": end, "score": s, "p_value": p})
                    passages.append(kept)
            yield pd.DataFrame({"score": scores, "passages": passages})

    return judge(text)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (the given row), ``score`` and ``passages``."""
    out = docs.select(F.struct("*").alias("row"), judged(model, F.col("text"), docs).alias("verdict"))
    return out.select("row", "verdict.score", "verdict.passages")


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows whose score stays below ``reject``, all columns."""
    return scored(docs, fit(docs, labels)).where(F.col("score") < reject).select("row.*")
