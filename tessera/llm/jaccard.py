"""Operator 8: exact similarity join on word n-gram sets, size-aware: light sets by subsets, heavy sets by inverted lists.

Light sets (few shingles) enumerate every subset of the sizes an overlap can have: two of them are linked exactly when
they share one. Heavy sets would have too many subsets. They fall into size bands; in a band, sets that reach the
threshold differ in at most D shingles, so of K parts of the shingle space at least K - D agree. Each part's content keys
an inverted list. With lists ordered by length, sets that agree on K - D of theirs share one among the D + 1 shortest of
both, so only those are scanned: a set of which D + 1 lists hold nothing else has no partner, and passages that many
texts quote make no candidates. Candidates are grouped by components and checked against their whole sets in blocks of
bounded size. The boundary is where enumerating subsets gets dearer than lists plus checks. Texts with equal sets form
one class and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Words, bounded_broadcast, groups, materialise, mix, pack, partitions, release, slices, spread, steps, sums, table, unpack, unused
from tessera.llm.components import components

#: Parts beyond the D + 1 that must be scanned: one in so many of them, and this many more.
SPARE_ONE_IN, SPARE = 4, 2
#: Of a block in the check of heavy candidates.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1_000_000
#: Hubs of a component, and of a block of it.
HUBS, BLOCK_HUBS = 64, 8
#: Sizes from which a set is never light: its subsets would be thousands.
MOST_LIGHT = 32
#: Subset hashes that a task packs at once, and blocks of a packed row, which are read one after the other.
FLUSH, BLOCKS = 4_000_000, 4


def overlap(n1: int, n2: int, percent: int) -> int:
    """Least intersection with which sets of n1 and n2 reach percent/100 of their union."""
    return -(-percent * (n1 + n2) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of shared subsets that decide a pair of which one set has n elements."""
    partners = range(-(-percent * n // 100), n * 100 // percent + 1)
    return sorted({o for p in partners if (o := overlap(n, p, percent)) <= min(n, p)})


class Plan:
    """Boundary between light and heavy sets, and the heavy sets' bands, for one threshold."""

    def __init__(self, percent: int, sizes: dict[int, int] | None = None):
        """sizes: how many sets have each size; without them every size counts alike."""
        self.percent = percent
        self.light = self._boundary(sizes)
        self.heavy_from = max(1, -(-percent * (self.light + 1) // 100))  # partners of heavy sets go on the lists too
        self.starts = [self.heavy_from]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 100 // percent)))

    def _boundary(self, sizes: dict[int, int] | None) -> int:
        """The greatest size of a light set: that with the fewest hashes of subsets, and of parts from heavy_from on."""
        subsets, parts = [0], [0]
        while len(subsets) <= MOST_LIGHT:
            n = len(subsets)
            many = sizes.get(n, 0) if sizes is not None else 1
            subsets.append(many * sum(comb(n, t) for t in subset_sizes(n, self.percent)))
            parts.append(many * 2 * self._parts(self._differ(n)))
        heavy_from = lambda light: max(1, -(-self.percent * (light + 1) // 100))
        cost = [sum(subsets[: light + 1]) + sum(parts[heavy_from(light) :]) for light in range(MOST_LIGHT)]
        return cost.index(min(cost))

    def _differ(self, smaller: int) -> int:
        """Most elements in which two sets at the threshold differ, the smaller having ``smaller``: union <= smaller / t."""
        return (100 - self.percent) * smaller // self.percent

    @staticmethod
    def _parts(differ: int) -> int:
        return differ + 1 + (differ + 1) // SPARE_ONE_IN + SPARE

    def instances(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, those not scanned) of a heavy set of n shingles: its own band, and the one below as the larger."""
        j = int(np.searchsorted(self.starts, n, side="right")) - 1
        out = []
        for i in (j, j - 1):
            if i >= 0:
                d = self._differ(self.starts[i + 1] - 1)
                out.append((i, self._parts(d), self._parts(d) - d - 1))
        return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word-hash sequence; fewer words: the whole sequence as one."""
    n = len(h)
    if n == 0:
        return h
    w = min(n, k)
    with np.errstate(over="ignore"):
        x = np.full(n - w + 1, np.uint64(w))
        for i in range(w):
            x = mix(x * np.uint64(0x100000001B3) ^ h[i : n - w + 1 + i])
    return np.unique(x)


def set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].view(np.int64))


def signatures(s: np.ndarray, plan: Plan) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Subset hashes and sizes as a light set; list keys and tags as a heavy one: 1 for the band below, 2 for an empty part."""
    n = len(s)
    with np.errstate(over="ignore"):
        m = mix(s ^ np.uint64(0xD6E8FEB86659FD93))
        light, sizes, heavy, tags = ([np.empty(0, t)] for t in (np.uint64, np.uint8, np.uint64, np.uint8))
        if n <= plan.light:
            whole = m.sum(dtype=np.uint64)
            for t in subset_sizes(n, plan.percent):
                gone = np.array([m[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), n - t)], np.uint64) if t < n else np.zeros(1, np.uint64)
                light.append(mix((whole - gone) ^ np.uint64(t << 48)))
                sizes.append(np.full(len(gone), t, np.uint8))
        if n >= plan.heavy_from:
            for below, (band, k, _) in enumerate(plan.instances(n)):
                part = (mix(s) % np.uint64(k)).astype(np.int64)
                sums, used = np.zeros(k, np.uint64), np.bincount(part, minlength=k)
                np.add.at(sums, part, m)
                heavy.append(mix(sums ^ mix(np.uint64(band + 1) * np.uint64(1 << 32) + np.arange(k, dtype=np.uint64))))
                tags.append((below + 2 * (used == 0)).astype(np.uint8))
    return (np.concatenate(light), np.concatenate(sizes)), (np.concatenate(heavy), np.concatenate(tags))


_PRINTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = Words(b.column(1))
            h = w.hashes()
            sets = [shingle_set(h[i:j], k) for i, j in zip(w.starts, w.starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], schema=_PRINTS)

    return run


def _packed(light: bool, held: list[tuple], buckets: int) -> Iterator[tuple]:
    """(bucket, light, keys, blocks) from (key, set size, hashes, tags): one row a hash range, sorted, with its sets' keys
    and sizes once and BLOCKS parts of the range."""
    keys, n = np.array([x[0] for x in held], np.int64).view(np.uint64), np.array([x[1] for x in held], np.int64)
    of = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
    sig = np.concatenate([x[2] for x in held])
    o = np.argsort(sig)
    sig, of = sig[o], of[o]
    tags = np.concatenate([x[3] for x in held])[o]
    place = (sig >> np.uint64(32)) * np.uint64(buckets)  # its upper half is the bucket, its lower half the place in it
    cell = ((place >> np.uint64(32)) * np.uint64(BLOCKS) + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(BLOCKS) >> np.uint64(32))).astype(np.int64)
    cuts = np.searchsorted(cell, np.arange(buckets * BLOCKS + 1))
    for bucket in range(buckets):
        at = cuts[bucket * BLOCKS : (bucket + 1) * BLOCKS + 1]
        if at[0] == at[-1]:
            continue
        known, first, inv = np.unique(keys[of[at[0] : at[-1]]], return_index=True, return_inverse=True)
        inv = inv.reshape(-1)
        blocks = [pack(steps(sig[i:j]), inv[i - at[0] : j - at[0]], tags[i:j]) for i, j in zip(at, at[1:], strict=False)]
        yield bucket, light, pack(steps(known), n[of[at[0] : at[-1]][first]]), blocks


_LISTS = "bucket int, light boolean, keys binary, blocks array<binary>"


def _lists(plan: Plan, k: int, buckets: int):
    """Texts to their sets' subset hashes, packed by hash range; copies within a task are listed once."""

    def batch(held: dict) -> pa.RecordBatch:
        rows = [r for light in held if held[light] for r in _packed(light, held[light], buckets)]
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "light", "keys", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: dict = {True: [], False: []}
        size = 0
        for b in slices(batches, 0):
            w = Words(b.column(0))
            h = w.hashes()
            for i, j in zip(w.starts, w.starts[1:], strict=False):
                s = shingle_set(h[i:j], k)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                for kind, (x, tags) in zip((True, False), signatures(s, plan), strict=True):
                    if len(x):
                        held[kind].append((key, len(s), x, tags))
                        size += len(x)
                if size >= FLUSH:
                    yield batch(held)
                    held, size = {True: [], False: []}, 0
        yield batch(held)

    return run


_STARS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int32()), ("shared", pa.binary())])


def _stars(percent: int, buckets: int):
    """Per partition, which holds whole lists: the members of a list of subsets hang on its least set, links that hold by
    the sizes alone (a, b). Heavy lists of two sets or more go back to their sets, packed by range of the sets' keys
    (bucket, shared). Rows stay packed; one block of them is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {True: [], False: []}
        for b in batches:
            for light, keys, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[light].append((keys, blocks))
        for light, rows in held.items():
            for i in range(BLOCKS if rows else 0):
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for keys, blocks in rows:
                    steps_, of, tags = unpack(blocks[i])
                    known, n = unpack(keys)
                    of = of.astype(np.int64)
                    for c, v in zip(cols, (sums(steps_), sums(known)[of], n.astype(np.int64)[of], tags.astype(np.int64)), strict=True):
                        c.append(v)
                sig, key, n, tag = (np.concatenate(c) for c in cols)
                if not len(sig):
                    continue
                o = np.lexsort((key, n, sig))  # a set's key goes with its size, so copies of a set are neighbours
                again = np.concatenate([[False], (sig[o][1:] == sig[o][:-1]) & (key[o][1:] == key[o][:-1])])
                sig, key, n, tag = (x[o][~again] for x in (sig, key, n, tag))
                start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                length = np.diff(np.append(start, len(sig)))
                head = np.repeat(start, length)
                if light:  # the list's least set links all that reach the threshold with this overlap
                    k = key.view(np.int64)
                    ok = (head != np.arange(len(sig))) & (percent * (n + n[head]) <= (100 + percent) * tag)
                    e = np.unique(np.stack([np.minimum(k, k[head])[ok], np.maximum(k, k[head])[ok]]), axis=1)
                    none = pa.nulls(e.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1]), none.cast(pa.int32()), none.cast(pa.binary())], schema=_STARS)
                    continue
                length = np.repeat(length, length)
                use = np.flatnonzero(length > 1)
                use = use[np.argsort(key[use], kind="stable")]
                head, length, n, tag, low, key = key[head[use]], length[use], n[use], tag[use], (sig[use] & np.uint64(0xFFFF)).astype(np.uint16), key[use]
                bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                out = []
                for j in np.flatnonzero(np.diff(cuts)):
                    x = slice(cuts[j], cuts[j + 1])
                    known, first, of = np.unique(key[x], return_index=True, return_inverse=True)
                    heads, on = np.unique(head[x], return_inverse=True)
                    out.append((int(j), pack(steps(known), n[x][first], of.reshape(-1), steps(heads), on.reshape(-1), length[x], tag[x], low[x])))
                none = pa.nulls(len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], schema=_STARS)
        held.clear()
        cols = sig = key = n = tag = head = length = low = bucket = o = again = out = None  # the last block
        release()

    return run


def _candidates(plan: Plan):
    """Per partition, which has all lists that sets share with others: each set hangs on the first set of those lists that
    are among its D + 1 shortest. Lists of one set come first and were not sent; lists of empty parts come last; equal
    places are all taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for b in batches:
            for blob in b.column(0).to_pylist():
                known, n, of, heads, on, length, tag, low = unpack(blob)
                of, tag = of.astype(np.int64), tag.astype(np.uint64)
                order = (tag >> np.uint64(1)) << np.uint64(63) | length.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64)
                for c, v in zip(cols, (sums(known)[of], n.astype(np.int64)[of], sums(heads)[on.astype(np.int64)], (tag & np.uint64(1)).astype(np.int64), order), strict=True):
                    c.append(v)
        if not cols[0]:
            return
        key, n, head, below, order = (np.concatenate(c) for c in cols)
        o = np.lexsort((order, below, key))
        key, n, head, below, order = (x[o] for x in (key, n, head, below, order))
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (below[1:] != below[:-1])]))
        length = np.diff(np.append(start, len(key)))
        kinds, of = np.unique(n[start] * 2 + below[start], return_inverse=True)
        spare = np.array([plan.instances(int(x) // 2)[int(x) % 2][2] for x in kinds])[of.reshape(-1)]
        take = length - spare
        last = order[start + np.maximum(take, 1) - 1]
        ok = np.repeat(take > 0, length) & (order <= np.repeat(last, length)) & (key != head)
        e = np.unique(np.stack([key[ok].view(np.int64), head[ok].view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])
        release()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            w = Words(b.column(0))
            h = w.hashes()
            want, comp, blocks = (b.column(i).to_pylist() for i in (1, 2, 3))
            out: dict = {"key": [], "comp": [], "blocks": [], "shingles": []}
            for i in range(b.num_rows):
                s = shingle_set(h[w.starts[i] : w.starts[i + 1]], k)
                if len(s) and set_key(s) == want[i]:
                    for c, v in zip(out, (want[i], comp[i], blocks[i], s.tobytes()), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("comp", pa.int64()), ("blocks", pa.int64()), ("shingles", pa.binary())]))

    return run


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs at the threshold, by scanning inverted lists: long lists as a matrix product, short ones pair by pair.
    right None: within left. Only a spanning set of links is needed, so the caller may merge as it goes."""
    both = left if right is None else left + right
    nl, sizes = len(left), np.array([len(s) for s in both])
    flat, owner = np.concatenate(both), np.repeat(np.arange(len(both)), sizes)
    _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    rows, cols = (np.arange(nl), np.arange(nl)) if right is None else (np.arange(nl), np.arange(nl, len(both)))
    meet = np.zeros((len(rows), len(cols)), np.float32)
    dense = np.flatnonzero(count > 24)
    for at in range(0, len(dense), 2048):
        ids = dense[at : at + 2048]
        where = np.full(len(count), -1, np.int64)
        where[ids] = np.arange(len(ids))
        use = where[inv] >= 0
        x = np.zeros((len(both), len(ids)), np.float32)
        x[owner[use], where[inv[use]]] = 1
        meet += x[rows] @ x[cols].T
    rest = (count[inv] > 1) & (count[inv] <= 24)
    o = np.lexsort((owner[rest], inv[rest]))
    li, lo = inv[rest][o], owner[rest][o]
    for gap in range(1, 24):
        same = np.flatnonzero(li[gap:] == li[:-gap])
        if not len(same):
            break
        a, b = lo[same], lo[same + gap]  # a < b
        if right is None:
            np.add.at(meet, (a, b), 1)
        else:
            use = (a < nl) & (b >= nl)
            np.add.at(meet, (a[use], b[use] - nl), 1)
    total = sizes[rows][:, None] + sizes[cols][None, :]
    ok = (100 + percent) * meet.astype(np.int64) >= percent * total
    if right is None:
        ok = np.triu(ok, 1)
    for a, b in zip(*np.nonzero(ok), strict=True):
        yield int(a), int(cols[b])


def _verify(percent: int):
    """Per (comp, lo, hi): links (a, b) between its sides, or within its one side where lo is hi; there also the hubs
    (a, a) of its largest groups, with how many links they have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["comp", "lo", "hi"]):
            g = g.drop_duplicates(["key", "side"])
            sets, keys = [np.frombuffer(x, np.uint64) for x in g["shingles"]], g["key"].to_numpy()
            one = g["lo"].iloc[0] == g["hi"].iloc[0]
            side = g["side"].to_numpy()
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            root, degree = list(range(len(g))), [0] * len(g)

            def find(x, root=root):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            order = l if one else np.concatenate([l, r])
            out = []
            if (one and len(l) > 1) or (not one and len(l) and len(r)):
                for a, b in links_between([sets[i] for i in l], None if one else [sets[i] for i in r], percent):
                    degree[order[a]] += 1
                    degree[order[b]] += 1
                    x, y = find(order[a]), find(order[b])
                    if x != y:
                        root[x] = y
                        out.append((keys[order[a]], keys[order[b]], 0))
            if one and out:
                best: dict[int, list[int]] = {}
                for i in range(len(g)):
                    best.setdefault(find(i), []).append(i)
                for members in sorted(best.values(), key=lambda m: -len(m))[:BLOCK_HUBS]:
                    hub = max(members, key=lambda i: degree[i])
                    out.append((keys[hub], keys[hub], degree[hub]))
            yield pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")
        release()

    return run


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all of ``sets`` (comp, blocks, key, shingles) that links join, within each comp."""
    parts = partitions(sets.sparkSession)

    def check(rows: DataFrame) -> DataFrame:
        return materialise(rows.repartition(parts, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInPandas(_verify(percent), "a bigint, b bigint, links bigint"))

    def rows(df: DataFrame, lo, hi, side) -> DataFrame:
        as_long = lambda c: F.lit(c).cast("bigint") if isinstance(c, int) else c.cast("bigint")
        return df.select("comp", as_long(lo).alias("lo"), as_long(hi).alias("hi"), (F.lit(side) if isinstance(side, int) else side).alias("side"), "key", "shingles")

    def times(df: DataFrame, n: str, name: str) -> DataFrame:
        return df.where(f"{n} > 0").select("*", F.explode(F.expr(f"sequence(0L, {n} - 1L)")).alias(name))

    sets = sets.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    first = check(rows(sets, F.col("own"), F.col("own"), 0))
    out = first.where("a <> b").select("a", "b")
    large = sets.where("blocks > 1")
    if large.limit(1).count() == 0:
        return out
    top = Window.partitionBy("comp").orderBy(F.desc("links"), "key")
    hubs = first.where("a = b").select(F.col("a").alias("key"), "links").join(large, "key").withColumn("place", F.row_number().over(top)).where(F.col("place") <= HUBS)
    second = check(rows(large, F.col("own"), -1, 0).union(rows(times(materialise(hubs), "blocks", "to"), F.col("to"), -1, 1)))
    out = out.union(second.where("a <> b").select("a", "b"))
    sub = large.select("comp", "blocks", "key").join(components(out).withColumnRenamed("node", "key"), "key", "left").select("comp", "blocks", "key", F.coalesce("root", "key").alias("sub"))
    sub = materialise(sub)
    count = sub.groupBy("comp", "blocks", "sub").agg(F.count("*").alias("n")).groupBy("comp", "blocks").agg(F.sum("n").alias("m"), F.max(F.struct("n", "sub")).alias("top"))
    core = materialise(count.select("comp", F.col("top.sub").alias("core"), F.ceil(F.col("blocks") * (F.col("m") - F.col("top.n")) / F.col("m")).cast("bigint").alias("left")))
    large = large.join(sub.select("key", "sub"), "key").join(core, "comp").where("left > 0").withColumn("of", F.pmod(F.xxhash64("key", F.lit(1)), F.col("left")))
    rest = large.where("sub <> core")
    across = rows(times(rest, "blocks", "to"), -2 - F.col("of"), F.col("to"), 0).union(rows(times(large.where("sub = core"), "left", "to"), -2 - F.col("to"), F.col("own"), 1))
    among = rows(times(rest, "left", "to"), F.least("of", "to"), F.greatest("of", "to"), F.when(F.col("of") <= F.col("to"), 0).otherwise(1))
    third = check(across.union(among))
    return out.union(third.where("a <> b").select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles (A-Z lower-cased;
    with fewer words the whole sequence; no words or null text: the empty set, linked with nothing). component_id is the
    least id reachable by links, itself included. Repeated rows each get a row and are linked by their equal sets. A row
    with a null id takes part and gets the least non-null id of its component, else null. Texts and words may be of any
    length. Other columns are ignored, whatever their names. An empty table gives an empty table. Sets are identified by
    64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialise(rows.mapInArrow(_fingerprints(k), "doc_id bigint, n bigint, key bigint"))
    parts = partitions(spark)
    sizes = prints.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()  # MOST_LIGHT rows at most
    plan = Plan(percent, {r["n"]: r["count"] for r in sizes})
    lists = rows.select("text").mapInArrow(_lists(plan, k, parts), _LISTS).repartitionById(parts, F.col("bucket"))
    stars = materialise(lists.select("light", "keys", "blocks").mapInArrow(_stars(percent, parts), "a bigint, b bigint, bucket int, shared binary"))
    links = stars.where("shared is null").select("a", "b")
    back = stars.where("shared is not null").select("bucket", "shared").repartitionById(parts, F.col("bucket"))
    near = components(back.select("shared").mapInArrow(_candidates(plan), "a bigint, b bigint"))
    near = materialise(near)
    classes = prints.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    found = materialise(classes.join(bounded_broadcast(near, broadcast_rows).withColumnRenamed("node", "key"), "key").select("key", "first_id", "n", F.col("root").alias("comp")))
    sizes = found.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    blocks = sizes.select("comp", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("bigint").alias("blocks"))
    found = materialise(found.join(blocks, "comp").where("n > 0").select(F.col("first_id"), "key", "comp", "blocks"))
    texts = rows.join(bounded_broadcast(found, broadcast_rows), rows.doc_id.eqNullSafe(found.first_id)).select("text", "key", "comp", "blocks")
    sets = texts.mapInArrow(_sets(k), "key bigint, comp bigint, blocks bigint, shingles binary")
    checked = _linked(materialise(sets), percent)

    roots = components(links.union(checked))
    labelled = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first_id", "copies", F.coalesce("root", "key").alias("root"))
    labelled = labelled.where("copies > 1 or root <> key or first_id is null").union(classes.join(roots.where("node = root").select(F.col("node").alias("key")), "key", "left_semi").where("copies = 1").select("key", "first_id", "copies", F.col("key").alias("root"))).distinct()
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "root").select("key", "component_id")
    return prints.select("doc_id", "n", "key").join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` (doc_id, text, any other columns, which stay) with one row of each component: that of its least doc_id.

    doc_id names a document: rows that repeat id and text count as one. Rows with a null id stay, as do texts without
    words.
    """
    found = materialise(jaccard_components(docs, k=k, percent=percent))
    name = unused("gone__", docs.columns)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    left = docs.join(bounded_broadcast(gone, broadcast_rows), F.col("doc_id") == F.col(name), "left_anti")
    again = materialise(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name))
    if again.isEmpty():
        return left
    on = F.col("doc_id") == F.col(name)
    again = bounded_broadcast(again, broadcast_rows)
    return left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's join over the whole ``documents`` table: 3-word shingles, 90 %."""
    return jaccard_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS sh FROM w
), c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh
), t AS (SELECT rep, n, unnest(sh) AS x FROM c
), l AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(root.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) LEFT JOIN root ON root.rep = c.rep
"""
