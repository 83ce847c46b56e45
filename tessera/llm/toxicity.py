"""Operator 9: toxicity from class-conditional Kneser-Ney models.

For each class, toxic and ordinary, two interpolated Kneser-Ney models give log-likelihoods of a text's expressions: one
over words, one over the characters in words (for words that the labels have not shown). Discounted class counts are
smoothed by backoff counts shared by both classes: numbers of distinct left contexts, counted over the two together.
The length-normalised log-likelihood ratio of the text, its strongest words and the number of strong ones go to a
logistic curve fitted on ratios from models that had not seen those texts (two folds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, fold, mix, release, slices, spread, table, word_hashes

#: The models learn from at most so many labelled texts of each class, those of least xxhash64(doc_id).
SAMPLE = 1500
DISCOUNT, ORDER, STRONG = 0.75, 6, 2.0
_EDGE = ".,;:!?\"'()[]{}*%$&#-_|"
N_FEATURES = 7
#: Words spelled out at a time.
PIECE = 20_000


class Table:
    """Sums by 64-bit key, in sorted arrays: small, and looked up in bulk. Keys that are absent have 0."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, inv = np.unique(keys, return_inverse=True)
        self.values = [np.bincount(inv.reshape(-1), v, len(self.keys)) for v in values]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys)) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return [np.where(hit, v[at], 0.0) for v in self.values]


class Spelled:
    """The characters of words, each as ^word$: ``grams[n - 1]`` hashes the n characters that end at a place."""

    def __init__(self, words: list[str]):
        lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        cp = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.starts = np.cumsum(lens) - lens
        self.owner = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        self.place = (np.arange(len(cp)) - self.starts[self.owner]).astype(np.int32)
        self.grams = [mix(cp)]
        with np.errstate(over="ignore"):
            for n in range(2, ORDER + 1):
                h = np.zeros_like(cp)
                h[n - 1 :] = mix(self.grams[-1][n - 1 :] * np.uint64(0x100000001B3) ^ cp[: max(0, len(cp) - n + 1)])
                self.grams.append(h)
        self.events = np.flatnonzero(self.place >= 1)
        full = np.minimum(self.place[self.events] + 1, ORDER)
        self.top, self.context = np.empty(len(full), np.uint64), np.empty(len(full), np.uint64)
        for n in range(2, ORDER + 1):
            at = full == n
            self.top[at], self.context[at] = self.grams[n - 1][self.events[at]], self.grams[n - 2][self.events[at] - 1]

    def lower(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of n and their contexts at places ``at``."""
        return self.grams[n - 1][at], self.grams[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)


class KneserNey:
    """P(event | context, class) = discounted class count + freed mass * shared backoff, down to uniform, for characters
    in words. The highest order has counts of each class, all lower orders the shared continuation counts: of how many
    distinct grams one longer, over both classes, a gram is the end."""

    def __init__(self, words: list[str], counts: list[np.ndarray]):
        tops: list[list] = [[] for _ in counts]
        longer: list[list] = [[] for _ in range(1, ORDER)]
        symbols = np.empty(0, np.uint64)
        for i in range(0, len(words), PIECE):  # in pieces, of which the distinct grams are kept
            s = Spelled(words[i : i + PIECE])
            symbols = np.union1d(symbols, s.grams[0])
            for c, out in zip(counts, tops, strict=True):
                w = c[i : i + PIECE][s.owner[s.events]].astype(np.float64)
                keys, first, inv = np.unique(s.top[w > 0], return_index=True, return_inverse=True)
                out.append((keys, s.context[w > 0][first], np.bincount(inv.reshape(-1), w[w > 0], len(keys))))
            for n, out in enumerate(longer, 1):
                at = np.flatnonzero(s.place >= n)
                at = at[np.unique(s.grams[n][at], return_index=True)[1]]
                out.append((s.grams[n][at], *s.lower(n, at)))
        self.top = []
        for out in tops:
            gram, context, w = (np.concatenate([*x, np.empty(0, d)]) for x, d in zip(zip(*out, strict=True) if out else ([], [], []), (np.uint64, np.uint64, float), strict=True))
            first = np.zeros(len(gram))
            first[np.unique(gram, return_index=True)[1]] = 1
            self.top.append((Table(gram, w), Table(context, w, first)))
        self.lower = []
        for out in longer:
            long, gram, context = (np.concatenate([*x, np.empty(0, np.uint64)]) for x in (zip(*out, strict=True) if out else ([], [], [])))
            at = np.unique(long, return_index=True)[1]
            gram, context = gram[at], context[at]
            first = np.zeros(len(at))
            first[np.unique(gram, return_index=True)[1]] = 1
            self.lower.append((Table(gram, np.ones(len(at))), Table(context, np.ones(len(at)), first)))
        self.floor = 1.0 / (len(symbols) + 1)

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | class 1) - log P(word | class 0) of each word."""
        if len(words) > PIECE:  # in pieces of bounded size
            return np.concatenate([self.ratios(words[i : i + PIECE]) for i in range(0, len(words), PIECE)])
        if not words:
            return np.empty(0)
        s = Spelled(words)
        _, first, inv = np.unique(s.top, return_index=True, return_inverse=True)
        at = s.events[first]
        p = np.full(len(at), self.floor)
        for n, (grams, contexts) in enumerate(self.lower, 1):
            gram, context = s.lower(n, at)
            (count,), (total, kinds) = grams.get(gram), contexts.get(context)
            ok = (total > 0) & (s.place[at] >= n - 1)
            of = np.maximum(total, 1)
            p = np.where(ok, np.maximum(count - DISCOUNT, 0) / of + DISCOUNT * kinds / of * p, p)
        logs = []
        for grams, contexts in self.top:
            (count,), (total, kinds) = grams.get(s.top[first]), contexts.get(s.context[first])
            of = np.maximum(total, 1)
            logs.append(np.log(np.where(total > 0, np.maximum(count - DISCOUNT, 0) / of + DISCOUNT * kinds / of * p, p)))
        each = (logs[1] - logs[0])[inv.reshape(-1)]
        return np.bincount(s.owner[s.events], each, len(words))


def expression(word: str) -> str:
    return word.strip(_EDGE)


class Ratios:
    """Log-likelihood ratios of expressions by the two models, from training texts of both classes, each an array of
    places in ``expressions``."""

    def __init__(self, texts: list[list[np.ndarray]], expressions: list[str]):
        v = len(expressions)
        counts, pairs = [], []
        for of in texts:
            flat = np.concatenate([*of, np.empty(0, np.int64)]).astype(np.int64)
            before = np.concatenate([*(np.append(v, x[:-1]) if len(x) else x for x in of), np.empty(0, np.int64)]).astype(np.int64)
            counts.append(np.bincount(flat, minlength=v))
            pairs.append(np.unique(before * v + flat))
        shared = np.bincount(np.union1d(*pairs) % max(v, 1), minlength=v)  # distinct words before it, over both classes
        total, n = max(1, int(shared.sum())), [max(1, int(c.sum())) for c in counts]
        freed = [DISCOUNT * max(1, np.count_nonzero(c)) / k for c, k in zip(counts, n, strict=True)]
        seen = np.array([w for w in np.flatnonzero(counts[0] + counts[1]).tolist() if expressions[w]], np.int64)
        p = [np.maximum(counts[c][seen] - DISCOUNT, 0) / n[c] + freed[c] * shared[seen] / total for c in (0, 1)]
        known = [expressions[w] for w in seen.tolist()]
        self.words = Table(word_hashes(pa.array(known, pa.string())), np.log(p[1] / p[0]))
        self.chars = KneserNey(known, [c[seen] for c in counts])

    def of(self, expressions: list[str]) -> np.ndarray:
        """(word ratio, character ratio) of each expression; of the empty one 0."""
        out = np.zeros((len(expressions), 2))
        full = [i for i, w in enumerate(expressions) if w]
        if full:
            words = [expressions[i] for i in full]
            out[full, 0] = self.words.get(word_hashes(pa.array(words, pa.string())))[0]
            out[full, 1] = self.chars.ratios(words)
        return out


def features(word_ratio: np.ndarray, char_ratio: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: means, strongest and log numbers of strong expressions of both ratios, and log of the length."""
    n = np.diff(starts)
    out = np.zeros((len(n), N_FEATURES))
    full = np.flatnonzero(n)
    if len(full):
        at = starts[:-1][full]
        for k, r in enumerate((word_ratio, char_ratio)):
            out[full, 3 * k] = np.add.reduceat(r, at) / n[full] * 10
            out[full, 3 * k + 1] = np.maximum.reduceat(r, at)
            out[full, 3 * k + 2] = np.log1p(np.add.reduceat((r > STRONG).astype(np.float64), at))
        out[full, 6] = np.log1p(n[full]) / 5
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) by Newton's method with a ridge penalty, on features scaled to unit deviation."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = ridge * np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1])


class Model:
    def __init__(self, texts: list[list[np.ndarray]], vocab: list[str]):
        """texts: the ordinary and the toxic training texts, each an array of places in ``vocab``."""
        self.rate = (len(texts[1]) + 0.5) / (len(texts[0]) + len(texts[1]) + 1)
        self.ratios = None
        if min(map(len, texts)) < 2:
            return
        places: dict[str, int] = {}
        to = np.array([places.setdefault(expression(w), len(places)) for w in vocab], np.int64)
        texts, expressions = [[to[x] for x in of] for of in texts], list(places)
        xs, ys = [], []
        for half in (0, 1):
            r = Ratios([t[1 - half :: 2] for t in texts], expressions).of(expressions)
            release()
            for label in (0, 1):
                for t in texts[label][half::2]:
                    xs.append(features(r[t, 0], r[t, 1], np.array([0, len(t)]))[0])
                    ys.append(label)
        self.w = logistic(np.array(xs), np.array(ys, float))
        self.ratios = Ratios(texts, expressions)

    def scores(self, w: Words) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(w.starts) - 1, self.rate)
        r = self.ratios.of([expression(x) for x in w.vocab.to_pylist()])[w.ids]
        x = features(r[:, 0], r[:, 1], w.starts)
        return np.where(np.diff(w.starts) > 0, 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -35, 35))), self.rate)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, of: int = 3, out: int = 1) -> Model:
    """Learns from labels (doc_id, toxic 0/1) of rows whose crc32(doc_id as text) mod ``of`` is not ``out``, at most
    ``sample`` of each class. Rows with a null doc_id or label, or without a text, teach nothing."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id"), of) != out).distinct()
    picked = [ids.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * sample rows
    got = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").toPandas()
    split: list[list[np.ndarray]] = [[], []]
    w = Words(pa.array(got["text"], pa.string()))
    for i, toxic in enumerate(got["toxic"]):
        split[toxic].append(w.ids[w.starts[i] : w.starts[i + 1]])
    vocab = w.vocab.to_pylist()
    del got, w
    release()
    model = Model(split, vocab)
    del split, vocab
    release()
    return model


_OUT = "doc_id bigint, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, sample: int = SAMPLE, of: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null texts and texts without words score the share of toxic training texts. If either class has fewer than two training texts,
    every score is the smoothed share of toxic ones. Repeated rows score alike. Labels, languages and sources are no
    input; other columns are ignored. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample, of=of, out=out))  # bounded by the sample
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), of) == out).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            s = shared.value.scores(Words(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, _OUT)


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns stay. Nothing speaks against null texts and
    texts without words, which stay, nor against any if either class has fewer than two training texts. Repeated rows
    fare alike. An empty table gives an empty table."""
    shared, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            w = Words(b.column(at))
            judged = (np.diff(w.starts) > 0) & (shared.value.ratios is not None)
            yield b.filter(pa.array(~judged | (shared.value.scores(w) < threshold)))

    return docs.mapInArrow(run, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of the whole ``documents`` table, learnt from ``labels``."""
    return toxicity(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels"))
