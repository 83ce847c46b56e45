"""Operator 7: benchmark passages in training texts, found by spaced seeds and verified with substitutions allowed.

A mask such as 11011 hashes the marked positions of a token window and ignores the others, so a replaced word spoils
only the masks that mark it. MASKS find every overlap of ten words or more with at most a fifth replaced, and whole items
of four to nine words with at most a fifth replaced, those of five with MASKS_OF_5 (tests enumerate this). Shorter items
have no word to spare and are found as they stand. The test items' hashes go to the tasks in blocks of bounded size; each
task joins its texts' hashes with them and checks the aligned words around each hit, so texts are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, materialise, mix, slices, spread, table

MASKS = ("1111", "11011", "110101", "1010011", "1001101", "11001001")
#: Besides, for items of five words, with the second or the fourth replaced.
MASKS_OF_5 = ("10111", "11101")
#: Words of items broadcast at once (8 bytes a word, 12 a seed and mask: about 40 MB).
BLOCK_WORDS = 500_000
#: An overlap needs as many aligned words, or the whole item if that is shorter.
MIN_WORDS = 10
_FILTER_BITS = 22


def _keys(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        x = np.full(n, np.uint64(salt))
        for i, m in enumerate(mask):
            if m == "1":
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(x)


class Index:
    """Seeds of one block of items: (item_id, word hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.tables = []
        masks = [(m, 4, None) for m in MASKS] + [(m, 5, 5) for m in MASKS_OF_5] + [("1" * n, n, n) for n in (1, 2, 3)]
        for salt, (mask, least, most) in enumerate(masks):
            used = [k for k, (_, h) in enumerate(items) if least <= len(h) <= (most or len(h)) and len(mask) <= len(h)]
            if not used:
                continue
            keys = [_keys(items[k][1], mask, salt) for k in used]
            n = [len(k) for k in keys]
            key, of, at = np.concatenate(keys), np.repeat(np.array(used), n), np.concatenate([np.arange(k) for k in n])
            o = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((mask, salt, key[o], of[o], at[o], seen))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item index, first word of the item in the texts' coordinates), each diagonal once."""
        found = []
        for mask, salt, key, of, at, seen in self.tables:
            k = _keys(h, mask, salt)
            pos = np.flatnonzero(seen[(k >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(key, k[pos], "left"), np.searchsorted(key, k[pos], "right")
            n = hi - lo
            if n.sum():
                p, first = np.repeat(pos, n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                j = first + np.arange(n.sum())
                found.append(np.stack([of[j], p - at[j]]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


def best_run(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """[start, end) of the longest run, earliest first, that starts and ends on an equal place and of which percent are
    equal; (0, 0) if no place is."""
    if not equal.any():
        return 0, 0
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    low = np.minimum.accumulate(np.where(equal, gain[:-1], np.iinfo(np.int64).max))  # the first start at or under a height has the longest run to an end at or over it
    ends = np.flatnonzero(equal) + 1
    start = np.searchsorted(-low, -gain[ends], side="left")
    k = int(np.argmax(ends - start))
    return int(start[k]), int(ends[k])


def runs(equal: np.ndarray, percent: int, least: int) -> Iterator[tuple[int, int]]:
    """The best run, then those of what it leaves on either side, as long as they have ``least`` places."""
    todo = [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least or 100 * np.count_nonzero(equal[lo:hi]) < percent * least:
            continue
        i, j = best_run(equal[lo:hi], percent)
        if j - i >= least:
            yield lo + i, lo + j
            todo += [(lo, lo + i), (lo + j, hi)]


def _overlaps(h: np.ndarray, starts: np.ndarray, index: Index, percent: int) -> Iterator[tuple]:
    """(text, item_id, start, end, item_start, equal) in words, for a batch's concatenated texts."""
    of, diag = index.hits(h)
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)  # by text and item: start, -end, -equal, item_start
    for k, d in zip(of.tolist(), diag.tolist(), strict=True):
        item = index.items[k][1]
        # a diagonal may cross text borders: each text that it meets is checked
        first = int(np.searchsorted(starts, max(d, 0), side="right")) - 1
        last = int(np.searchsorted(starts, min(d + len(item), len(h)) - 1, side="right")) - 1
        for t in range(first, last + 1):
            lo, hi = max(d, int(starts[t])), min(d + len(item), int(starts[t + 1]))
            if hi - lo < min(MIN_WORDS, len(item)):
                continue
            equal = h[lo:hi] == item[lo - d : hi - d]
            if len(item) >= MIN_WORDS:
                some = runs(equal, percent, MIN_WORDS)
            else:
                some = [(0, len(item))] if 100 * np.count_nonzero(equal) >= percent * len(item) else []
            for i, j in some:
                found[t, k].append((lo - int(starts[t]) + i, int(starts[t]) - lo - j, -int(np.count_nonzero(equal[i:j])), lo - d + i))
    for (t, k), rows in sorted(found.items()):
        upto = -1
        for start, end, equal, at in sorted(rows):
            if -end > upto:  # not within an overlap of the item that starts no later
                upto = -end
                yield t, index.items[k][0], start, -end, at, -equal


def _blocks(items: DataFrame, id_col: str, text_col: str, least_words: int) -> Iterator[Index]:
    """The items in blocks of bounded size, read one block at a time; a longer item is a block of its own."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in items.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        h = Words(pa.array([row[1]])).hashes()
        if len(h) < max(1, least_words):
            continue
        if held and size + len(h) > BLOCK_WORDS:
            yield Index(held)
            held, size = [], 0
        held.append((row[0], h))
        size += len(h)
    if held:
        yield Index(held)


def _each(sc, blocks: Iterator[Index], step, close) -> None:
    """``step(shared)`` for each block; ``close`` ends a block's work before the next block is read, if there is one."""
    shared = None
    for index in blocks:
        if shared is not None:
            close()
            shared.destroy()
        shared = sc.broadcast(index)
        step(shared)


_OUT = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, item_start bigint, equal_words bigint, similarity double"


def _find(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4 << 20):
            w, ids = Words(b.column(1)), b.column(0).to_pylist()
            rows = [(ids[t], item, i, j, at, n, n / (j - i)) for t, item, i, j, at, n in _overlaps(w.hashes(), w.starts, shared.value, percent)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, percent: int = 80, least_words: int = 1) -> DataFrame:
    """One row for each overlap of a text with a test item: ids, words [start_word, end_word) of the text, the word of
    the item that it starts with, equal words, similarity = equal / aligned.

    Words have A-Z lower-cased. An overlap aligns MIN_WORDS words or more, percent of them equal, from an equal word to an
    equal word, and may be a part of the item; an item of fewer words is aligned as a whole. Items under ``least_words``
    words are left out. On one alignment the longest overlap comes first (of equal ones the earliest), then what is left
    before and after it; an overlap within another of the same text and item is no row, of equal ones that with more equal
    words is, then that earlier in the item. The masks find all of this from 80 percent up; below, some may be missed.
    Null or empty texts and items have no overlap. Texts and single words may be of any length. Repeated rows of either
    table give repeated rows. Null ids are carried as null. Other columns are ignored. Empty tables give an empty table.
    """
    sc, done, now = docs.sparkSession.sparkContext, [], []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _each(sc, _blocks(items, item_id, item_text, least_words), lambda shared: now.append(rows.mapInArrow(_find(shared, percent), _OUT)), lambda: done.append(materialise(now.pop())))
    parts = done + now
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], _OUT)
    for part in parts[1:]:
        out = out.union(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, percent: int = 80, least_words: int = 1) -> DataFrame:
    """``docs`` without the rows whose text overlaps a test item (as in ``leaks``). All columns stay, null texts and
    empty ones too, and repeated rows fare alike."""
    at, sc, left = docs.columns.index(text_col), docs.sparkSession.sparkContext, [docs]

    def step(shared) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, at, 4 << 20):
                w = Words(b.column(at))
                keep = np.ones(b.num_rows, bool)
                for found in _overlaps(w.hashes(), w.starts, shared.value, percent):
                    keep[found[0]] = False
                yield b.filter(pa.array(keep))

        left.append(left.pop().mapInArrow(run, docs.schema))

    _each(sc, _blocks(items, item_id, item_text, least_words), step, lambda: left.append(materialise(left.pop())))
    return left[0]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the whole ``documents`` table with all of ``benchmark``, 80 % equal words."""
    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
