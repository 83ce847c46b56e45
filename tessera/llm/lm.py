"""Operator 2: language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Texts are handled in groups of about GROUP_TOKENS tokens. A group asks for the counts of its distinct n-grams, packed by
hash range; one task a range adds up the training counts of all groups and answers each group. Hot n-grams cost one
entry a group, so no range grows with their frequency. Weights per context-frequency bucket come from EM over held-out
groups of the training rows, whose own counts are kept apart (deleted); the driver sees only a histogram of bounded
size. In the last pass each group meets its answers and scores its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, crc, materialise, mix, pack, partitions, release, slices, spread, steps, sums, table, unpack

GROUP_TOKENS = 1_000_000
#: Context-frequency buckets: 0 for none, else 1 + floor(log2(count)).
BUCKETS = 48
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Of the EM histogram: bits a cell, and cells an axis.
STEP, CELLS = 0.5, 96
#: In place of a hash range: a group's texts, and a range's totals.
TEXTS, TOTALS = -1, -2


class Group:
    """Some whole texts as word-hash sequences, each followed by END."""

    def __init__(self, ids: list, train: np.ndarray, hashes: np.ndarray, lens: np.ndarray):
        self.ids, self.train, self.lens = ids, train, lens
        self.uni, self.tok = np.unique(hashes, return_inverse=True)
        self._finish()

    def _finish(self) -> None:
        starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        h = self.uni[self.tok]
        before = np.empty_like(h)
        before[1:], before[starts] = h[:-1], BEGIN
        with np.errstate(over="ignore"):
            self.bi, self.pair = np.unique(mix(before * np.uint64(0x100000001B3) ^ mix(h)), return_inverse=True)
        self.starts, self.of = starts, np.repeat(np.arange(len(self.lens)), self.lens)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the distinct words and bigrams."""
        w = self.train[self.of].astype(np.float64)
        return tuple(np.bincount(i, w, n).astype(np.int64) for i, n in ((self.tok, len(self.uni)), (self.pair, len(self.bi))))

    def name(self) -> int:
        x = xxhash.xxh64(self.uni.tobytes())
        x.update(self.tok.astype(np.int32).tobytes())
        x.update(repr((self.ids, self.lens.tolist())).encode())
        return np.int64(np.uint64(x.intdigest())).item()

    def packed(self) -> bytes:
        known = np.array([i is not None for i in self.ids], np.int64)
        return pack(known, np.array([i or 0 for i in self.ids], np.int64).view(np.uint64), self.train.astype(np.int64), self.lens.astype(np.int64), steps(self.uni), self.tok.astype(np.int64))

    @classmethod
    def unpacked(cls, blob: bytes) -> Group:
        known, ids, train, lens, uni, tok = unpack(blob)
        g = cls.__new__(cls)
        g.ids = [int(i) if k else None for i, k in zip(ids.view(np.int64), known, strict=True)]
        g.train, g.lens, g.uni, g.tok = train.astype(bool), lens.astype(np.int64), sums(uni), tok.astype(np.int64)
        g._finish()
        return g


def _grouped(batches: Iterator[pa.RecordBatch], of: int, out: int, em_of: int) -> Iterator[tuple[bool, Group]]:
    """(whether its rows are held out for EM, group). EM rows have groups of their own."""
    open_: dict[bool, list] = {True: [], False: []}

    def close(em: bool) -> Group:
        got = open_[em]
        open_[em] = []
        lens = np.array([len(h) for _, _, h in got], np.int64)
        return Group([i for i, _, _ in got], np.array([t for _, t, _ in got]), np.concatenate([h for _, _, h in got]), lens)

    size = {True: 0, False: 0}
    for b in slices(batches, 1):
        w = Words(b.column(1))
        h = w.hashes()
        for i, doc in enumerate(b.column(0).to_pylist()):
            r = crc(doc)
            train = r % of != out
            em = train and (r // of) % em_of == 0
            open_[em].append((doc, train, np.append(h[w.starts[i] : w.starts[i + 1]], END)))
            size[em] += len(open_[em][-1][2])
            if size[em] >= GROUP_TOKENS:
                size[em] = 0
                yield em, close(em)
    for em in open_:
        if open_[em]:
            yield em, close(em)
    release()


def _ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n equal hash ranges in a sorted array."""
    tops = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, tops), [len(sorted_hashes)]])


_ASK = "bucket int, name bigint, em boolean, payload binary"


def _ask(of: int, out: int, em_of: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for em, g in _grouped(batches, of, out, em_of):
            (cu, cb), name = g.counts(), g.name()
            u, b = _ranges(g.uni, buckets), _ranges(g.bi, buckets)
            begins = int(g.train.sum())
            rows = [(k, name, em, pack(steps(g.uni[u[k] : u[k + 1]]), cu[u[k] : u[k + 1]], steps(g.bi[b[k] : b[k + 1]]), cb[b[k] : b[k + 1]], np.array([begins if k == 0 else 0]))) for k in range(buckets)]
            k, n, e, p = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(e, pa.bool_()), pa.array(p, pa.binary())], names=["bucket", "name", "em", "payload"])

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """All requests of a hash range: the sums (without and with the EM groups' counts) for each group, and totals."""
    got = [unpack(p) for p in rows["payload"]]
    em = rows["em"].to_numpy(bool)
    out, stats = [], {}
    totals = []
    for at in (0, 2):
        h = [sums(g[at]) for g in got]
        n = np.array([len(x) for x in h])
        distinct, inv = np.unique(np.concatenate(h), return_inverse=True)
        c = np.concatenate([g[at + 1] for g in got]).astype(np.float64)
        held = np.repeat(em, n)
        main, every = (np.bincount(inv, w, len(distinct)).astype(np.int64) for w in (np.where(held, 0, c), c))
        cuts = np.concatenate([[0], np.cumsum(n)])
        totals.append([(main[inv[i:j]], every[inv[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)])
        if at == 0:
            stats = {"n_main": main.sum(), "n_all": every.sum(), "v_main": (main > 0).sum(), "v_all": (every > 0).sum()}
    begins = np.array([int(g[4][0]) for g in got])
    stats |= {"s_main": begins[~em].sum(), "s_all": begins.sum()}
    for i, name in enumerate(rows["name"]):
        (um, ua), (bm, ba) = totals[0][i], totals[1][i]
        out.append((rows["bucket"].iloc[0], name, bool(em[i]), pack(ua, ua - um, ba, ba - bm)))
    out.append((TOTALS, 0, False, np.array([stats[k] for k in ("n_main", "n_all", "v_main", "v_all", "s_main", "s_all")], np.int64).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "name", "em", "payload"])


def _texts(of: int, out: int, em_of: int, only_em: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for em, g in _grouped(batches, of, out, em_of):
            if em or not only_em:
                yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([g.name()], pa.int64()), pa.array([em]), pa.array([g.packed()], pa.binary())], names=["bucket", "name", "em", "payload"])

    return run


def _meet(rows: pd.DataFrame, buckets: int) -> Iterator[tuple[Group, list[np.ndarray]]]:
    """Each group of a name with its answers in hash order: word and bigram counts over all and over main groups."""
    answers = rows[rows["bucket"] >= 0].drop_duplicates("bucket").sort_values("bucket")
    if len(answers) != buckets:
        raise RuntimeError("a group of texts has no counts: the input changed between two reads of it; materialise it first")
    got = [unpack(p) for p in answers["payload"]]
    ua, ue, ba, be = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(4))
    for p in rows.loc[rows["bucket"] < 0, "payload"]:
        yield Group.unpacked(p), [ua, ua - ue, ba, ba - be]


def _parts(g: Group, uni: np.ndarray, bi: np.ndarray, begins: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Per token: context bucket, and the bigram, unigram and uniform estimates."""
    c = uni[g.tok]
    ctx = np.empty_like(c)
    ctx[1:], ctx[g.starts] = c[:-1], begins
    bucket = np.where(ctx > 0, 1 + np.frexp(np.maximum(ctx, 1).astype(np.float64))[1] - 1, 0)
    p2 = np.where(ctx > 0, bi[g.pair] / np.maximum(ctx, 1), 0.0)
    return np.minimum(bucket, BUCKETS - 1), p2, c / max(n, 1), 1.0 / (v + 1)


def _histogram(st: dict, buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for g, (_, um, _, bm) in _meet(rows, buckets):
            b, p2, p1, p0 = _parts(g, um, bm, st["s_main"], st["n_main"], st["v_main"])
            r2, r1 = p2 / p0, p1 / p0
            q2, q1 = (np.where(r > 0, np.clip(np.round(np.log2(np.maximum(r, 1e-300)) / STEP) + CELLS // 2, 1, CELLS - 1), 0).astype(np.int64) for r in (r2, r1))
            cell = (b * CELLS + q2) * CELLS + q1
            ids, inv = np.unique(cell, return_inverse=True)
            frames.append(pd.DataFrame({"cell": ids, "n": np.bincount(inv), "r2": np.bincount(inv, r2), "r1": np.bincount(inv, r1)}))
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"cell": [], "n": [], "r2": [], "r1": []})

    return run


def weights(hist: pd.DataFrame, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per bucket by EM on a histogram of likelihood ratios to the uniform
    estimate. Each bucket starts from the weights of all, counted as two tokens, so empty buckets have those."""

    def em(h: pd.DataFrame, prior: np.ndarray, strength: float) -> np.ndarray:
        n = h["n"].to_numpy(np.float64)
        r = np.stack([h["r2"] / n, h["r1"] / n, np.ones(len(h))], axis=1) if len(h) else np.empty((0, 3))
        lam = prior.copy()
        for _ in range(rounds):
            post = r * lam
            post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
            lam = (post * n[:, None]).sum(axis=0) + strength * prior
            lam /= lam.sum()
        return np.maximum(lam, 1e-9) / np.maximum(lam, 1e-9).sum()

    every = em(hist, np.full(3, 1 / 3), 1.0)
    bucket = hist["cell"].to_numpy(np.int64) // (CELLS * CELLS)
    return np.stack([em(hist[bucket == b], every, 2.0) for b in range(BUCKETS)])


def _score(st: dict, lam: np.ndarray, buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frames = []
        n, v = st["n_all"], st["v_all"]
        for g, (ua, _, ba, _) in _meet(rows, buckets):
            b, p2, p1, p0 = _parts(g, ua, ba, st["s_all"], n, v)
            w = lam[b]
            w = np.where((b == 0)[:, None], np.stack([np.zeros(len(w)), w[:, 1] / (w[:, 1] + w[:, 2]), w[:, 2] / (w[:, 1] + w[:, 2])], axis=1), w)
            score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            c = ua[g.tok]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            add = lambda x: np.add.reduceat(x, g.starts)
            frames.append(pd.DataFrame({"doc_id": pd.array(g.ids, "Int64"), "held_out": ~g.train, "n_tokens": g.lens, "n_known": add((c > 0).astype(np.int64)), "train_tokens": n, "base_score": add(base), "score": add(score)}))
        return pd.concat(frames, ignore_index=True)

    return run


_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, of: int = 5, out: int = 1, em_of: int = 10) -> DataFrame:
    """Scores each whole text; learns from the rows whose crc32(id as text) mod ``of`` is not ``out``.

    Tokens: words of the text with A-Z lower-cased, then one end token. Of the training rows one in ``em_of`` (by the same
    crc32) is held out for EM, and counted again for the final model. base_score: add-half unigram. score: log10 of the
    interpolated model, which sums to one over the training vocabulary and one unknown word. Null or empty text: the end
    token alone. Null id: counts as the empty text in the crc32. Repeated rows are counted and scored each. Other columns
    are ignored. No training rows: N = 0, all estimates uniform. An empty table gives an empty table. ``docs`` must read
    the same on each scan (a table does); if it does not, the job fails rather than give wrong counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions(spark)
    asked = rows.mapInArrow(_ask(of, out, em_of, n), _ASK)
    answers = materialise(asked.groupBy("bucket").applyInPandas(_answer, _ASK))
    total = answers.where(F.col("bucket") == TOTALS).select("payload").collect()  # one row a hash range
    st = dict(zip(("n_main", "n_all", "v_main", "v_all", "s_main", "s_all"), np.sum([np.frombuffer(r[0], np.int64) for r in total], axis=0).tolist() if total else [0] * 6, strict=True))
    answers = answers.where("bucket >= 0")
    held = rows.mapInArrow(_texts(of, out, em_of, True), _ASK).union(answers.where("em"))
    hist = held.groupBy("name").applyInPandas(_histogram(st, n), "cell bigint, n bigint, r2 double, r1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.sum("r1").alias("r1"))
    lam = weights(hist.toPandas())  # at most BUCKETS * CELLS ** 2 cells
    every = rows.mapInArrow(_texts(of, out, em_of, False), _ASK).union(answers)
    return every.groupBy("name").applyInPandas(_score(st, lam, n), _OUT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = spread(docs)
    return lm_scores(docs if dealt is docs else materialise(dealt))  # a shuffle may read in another order each time
