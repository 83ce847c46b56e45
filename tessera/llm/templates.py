"""Operator 3: lines that recur across documents, found by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens and its leading tokens, with tokens that hold a digit as ``<*>``. In a
leaf, a position at which more than MAX_CHILDREN tokens occur is a variable field too, as long as the line keeps most of
its tokens (tokens that hold a digit need one word to three of them); the line with its variable fields as ``<*>`` is its
template. A template that recurs in many documents is boilerplate and its lines are dropped.

Copies of a document are one document. A carrier has SEEDS cores, least hashes of the shingles of its other lines, which
copies share; near copies differ in a core now and then (in one of five at 80 % of common shingles), and other documents
share one where it lies in boilerplate. A template has enough distinct documents by any of three measures, which copies
neither reach nor spoil: the effective number of its cores (one over the sum of squared shares, as for species: a group
of near copies counts about one and a half, many groups count each); its roots, carriers that are the first to have each
of their cores, less CHANCE times those that near copies alone let expect; or its distinct cores, if they are more in
number and in proportion to its carriers than near copies have.

The statistics of a leaf are sums that combine in any order, so no leaf is gathered anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, bounded_broadcast, materialise, mix, slices, spread, table, unused

FIELD = "<*>"
DEPTH, MAX_CHILDREN, KEEP, FIELDS_A_WORD = 3, 8, 0.6, 3
#: Distinct documents that a template needs, from LONG tokens on LONG_DOCS; least tokens of a line.
MIN_DOCS, LONG, LONG_DOCS, MIN_TOKENS = 10, 20, 3, 2
#: Cores of a carrier, two to a column; how often expected chance roots are taken off; distinct cores of all carriers.
SEEDS, CHANCE, CORES = 6, 3.0, 0.25
#: Templates whose carriers are compared, broadcast at most.
CANDIDATES = 1_000_000
#: Ways that a common line is split where the named lines are too many to broadcast.
SALTS = 16
#: Dropped lines' hashes broadcast at most (8 bytes each); beyond it each document gets its own list by a join.
BROADCAST = 2_000_000
_VARIABLE = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_SPACE, _ODD = re.compile(r"[\x20\x09-\x0D]+"), ("  ", "\t", "\r", "\x0b", "\x0c")


def masked(line: str) -> str:
    """The line's tokens by single spaces, those with a digit as FIELD if a word (another token, with a letter) is left to
    every FIELDS_A_WORD of them: a line of figures with a unit is no template."""
    if any(c in line for c in _ODD):
        line = _SPACE.sub(" ", line)
    line = line.strip(" ")
    if any(c in line for c in "0123456789"):
        m = _VARIABLE.sub(FIELD, line)
        tokens = m.split(" ")
        if tokens.count(FIELD) <= FIELDS_A_WORD * sum(any(c.isalpha() for c in t) for t in tokens):
            return m
    return line


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(m: str) -> int:
    return _signed(xxhash.xxh64_intdigest(m.encode("utf-8", "surrogatepass")))


def leaf_hash(m: str, depth: int) -> int:
    return line_hash(f"{m.count(' ') + 1} {' '.join(m.split(' ', depth)[:depth])}")


def doc_key(doc_id, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=(doc_id or 0) & 0xFFFFFFFFFFFFFFFF))


def _least(lines: list[str]) -> np.ndarray:
    """SEEDS hashes of each line, each the least of its shingles of five words; the greatest for a line without words."""
    w = Words(pa.array(lines, pa.string()))
    h, n = w.hashes(), np.diff(w.starts)
    full = np.flatnonzero(n)
    line = np.repeat(np.arange(len(n)), n)
    x = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(5):
            m = len(h) - i
            if m > 0:
                same = line[:m] == line[i:]  # shingles end with their line
                x[:m] = np.where(same, mix(x[:m] * np.uint64(0x100000001B3) ^ h[i:]), x[:m])
    tail = np.arange(len(h)) > np.maximum(w.starts[1:] - 5, w.starts[:-1])[line]
    out = np.full((SEEDS, len(n)), _MOST)
    for seed in range(SEEDS if len(full) else 0):
        with np.errstate(over="ignore"):
            y = mix(x * np.uint64(2 * seed + 0x9E3779B97F4A7C15))
        y[tail] = _MOST
        out[seed, full] = np.minimum.reduceat(y, w.starts[full])
    return out


def _cores(least: np.ndarray, leaf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document (its lines from ``starts`` on) and seed: the least hash, its leaf, and the least of another leaf's
    lines, else the first. So what a line judged has left of the document is one of the two."""
    first = np.minimum.reduceat(least, starts, axis=1)
    n = np.diff(np.append(starts, least.shape[1]))
    at_first = least == np.repeat(first, n, axis=1)
    of = np.minimum.reduceat(np.where(at_first, leaf, np.iinfo(np.int64).max), starts, axis=1)
    second = np.minimum.reduceat(np.where(leaf == np.repeat(of, n, axis=1), _MOST, least), starts, axis=1)
    return first, of, np.where(second == _MOST, first, second)


_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_CORES = [f"c{i}" for i in range(SEEDS // 2)]


def _lines(depth: int, min_tokens: int, with_text: bool):
    names = ["doc", "leaf", "line", "masked"] if with_text else ["doc", "leaf", "line", "tokens", "copy", *_CORES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            if not texts:
                continue
            split = [t.split("\n") for t in texts]
            known: dict[str, tuple[int, int, int]] = {}
            leaves, rows = [], []  # the leaf of every line; (document, key, leaf, line, tokens or text) of those judged
            for d, (doc, text, lines) in enumerate(zip(b.column(0).to_pylist(), texts, split, strict=True)):
                key, seen = doc_key(doc, text), set()
                for line in lines:
                    m = masked(line)
                    if (got := known.get(m)) is None:
                        got = known[m] = leaf_hash(m, depth), line_hash(m), m.count(" ") + 1
                    leaves.append(got[0])
                    if m not in seen and got[2] >= min_tokens:
                        seen.add(m)
                        rows.append((d, key, got[0], got[1], m if with_text else got[2]))
            of, key, leaf, line, last = list(zip(*rows, strict=True)) if rows else [[]] * 5
            cols = [pa.array(key, pa.int64()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(last, pa.string() if with_text else pa.int64())]
            if not with_text:
                at, mine = np.array(of, np.int64), np.array(leaf, np.int64)
                starts = np.cumsum([0, *map(len, split)])[:-1]
                first, own, second = _cores(_least([x for s in split for x in s]), np.array(leaves, np.int64), starts)
                core = np.where(own[:, at] == mine, second[:, at], first[:, at]) >> np.uint64(32)
                cols.append(pa.array(np.array([line_hash(t) for t in texts], np.int64)[at]))
                cols += [pa.array((core[i] << np.uint64(32) | core[i + 1]).view(np.int64)) for i in range(0, SEEDS, 2)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def recurring(docs: DataFrame, *, depth: int = DEPTH, max_children: int = MAX_CHILDREN, keep: float = KEEP, min_docs: int = MIN_DOCS, long: int = LONG, long_docs: int = LONG_DOCS, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(lines by document: doc, leaf, line, tokens, copy, cores; recurring ones: line, template, docs), from ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = rows.mapInArrow(_lines(depth, min_tokens, False), ", ".join(f"{c} bigint" for c in ["doc", "leaf", "line", "tokens", "copy", *_CORES]))
    by_line = materialise(lines.groupBy("leaf", "line", "tokens", "copy", *_CORES).agg(F.count("*").alias("n")))  # a row for each line and distinct carrier
    fewest = F.when(F.col("tokens") >= long, min(min_docs, long_docs)).otherwise(min_docs)
    leaves = by_line.groupBy("leaf", "tokens").agg(F.count("*").alias("n"), F.min("line").alias("a"), F.max("line").alias("b")).where(F.col("n") >= fewest).where("a <> b").select("leaf")
    leaves = materialise(leaves)
    texts = rows.mapInArrow(_lines(depth, min_tokens, True), "doc bigint, leaf bigint, line bigint, masked string").join(bounded_broadcast(leaves, BROADCAST), "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("masked").alias("masked"))
    texts = materialise(texts)
    tokens = texts.select("leaf", "line", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    wide = tokens.where(F.col("at") >= depth).groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).groupBy("leaf", "at").agg(F.count("*").alias("kinds")).where(F.col("kinds") > max_children).groupBy("leaf").agg(F.sort_array(F.collect_set("at")).alias("fields"))  # at most a row's positions
    named = texts.join(wide, "leaf").withColumn("t", F.expr(f"transform(split(masked, ' '), (x, i) -> if(array_contains(fields, i), '{FIELD}', x))"))
    named = materialise(named.where(F.expr(f"size(filter(t, x -> x <> '{FIELD}')) >= {keep} * size(t)")).select(F.col("line").alias("l"), F.xxhash64("leaf", F.array_join("t", " ")).alias("named")))
    # a common line has a row a carrier: the few named lines go out whole, or, where they are many, once for each salt
    if named.limit(CANDIDATES + 1).count() <= CANDIDATES:
        known = by_line.join(F.broadcast(named), by_line.line == named.l, "left")
    else:
        salted = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        known = by_line.join(salted, (by_line.line == salted.l) & (F.pmod(by_line.copy, F.lit(SALTS)) == salted.salt), "left")
    known = known.select("line", F.coalesce("named", "line").alias("template"), "tokens", "copy", *_CORES, "n")
    carriers = known.groupBy("template", "tokens", "copy", *_CORES).agg(F.sum("n").alias("n"))
    often = materialise(carriers.groupBy("template", "tokens").agg(F.sum("n").alias("docs"), F.count("*").alias("texts")).where(F.col("texts") >= fewest))
    some = carriers.join(bounded_broadcast(often.select("template"), CANDIDATES), "template", "left_semi")
    each = F.array(*(x for c in _CORES for x in (F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(0xFFFFFFFF))))
    held = some.select("template", F.col("copy").alias("who"), F.posexplode(each).alias("seed", "core"))
    groups = held.groupBy("template", "seed", "core").agg(F.min("who").alias("who"), F.count("*").alias("m"))
    alone = [F.count_if((F.col("seed") == i) & (F.col("m") == 1)).alias(f"a{i}") for i in range(SEEDS)]
    tops = groups.groupBy("template", "who").agg(F.count("*").alias("k"), F.sum(F.col("m").cast("double") * F.col("m")).alias("squares"), *alone)
    told = tops.groupBy("template").agg(F.count_if(F.col("k") == SEEDS).alias("roots"), F.sum("k").alias("kinds"), F.sum("squares").alias("squares"), *(F.sum(f"a{i}").alias(f"a{i}") for i in range(SEEDS)))
    chance = F.col("texts").cast("double")
    for i in range(SEEDS):
        chance = chance * F.col(f"a{i}") / F.col("texts")
    effective = F.col("texts").cast("double") * F.col("texts") * SEEDS / F.col("squares")
    distinct = F.col("kinds") / SEEDS >= F.greatest(F.lit(float(min_docs)), CORES * F.col("texts"))
    often = often.join(told, "template").where((effective >= fewest) | (F.col("roots") - CHANCE * chance >= fewest) | distinct)
    return lines, known.select("line", "template").distinct().join(often.select("template", "docs"), "template")


def _rewrite(at: int, shared, listed: int | None, dropped: list | None):
    """Batches with recurring lines left out of column ``at``; a text of which nothing is left is a dropped row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            lists = b.column(listed).to_pylist() if listed is not None else None
            out, keep = [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                gone = set(lists[i] or ()) if lists is not None else shared.value
                if text is None or not gone:
                    new = text
                else:
                    lines = text.split("\n")
                    left = [x for x in lines if line_hash(masked(x)) not in gone]
                    new = text if len(left) == len(lines) else "\n".join(left)
                out.append(new)
                keep.append(not (text and text.strip() and not new.strip()))
            cols = [pa.array(out, b.schema.field(at).type) if k == at else b.column(k) for k in range(b.num_columns) if k != listed]
            names = [f.name for k, f in enumerate(b.schema) if k != listed]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return run


def without_recurring_lines(docs: DataFrame, *, broadcast: int = BROADCAST, **options) -> DataFrame:
    """``docs`` (doc_id, text, any other columns, which stay) with the lines of recurring templates left out of text.

    A document counts once for a template, however many rows or near copies repeat it. A row of which no word is left
    goes; null texts and texts without words stay as they are. Lines end at \\n and may be of any length; order and all
    other lines are kept as they are. Repeated rows fare alike; null doc_ids count as 0. Ties do not arise: a template
    goes or stays as a whole. Other columns may have any name. An empty table gives an empty table.
    """
    lines, often = recurring(docs, **options)
    often = materialise(often.select("line"))
    at, sc = docs.columns.index("text"), docs.sparkSession.sparkContext
    if often.limit(broadcast + 1).count() <= broadcast:
        shared = sc.broadcast({r[0] for r in often.toLocalIterator()})
        return docs.mapInArrow(_rewrite(at, shared, None, None), docs.schema)
    where, doc, gone = docs.columns.index("doc_id"), unused("doc__", docs.columns), unused("gone__", docs.columns)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [doc_key(d, t or "") for d, t in zip(b.column(where).to_pylist(), b.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int64())], names=[*b.schema.names, doc])

    lists = lines.join(often, "line").select("doc", "line").distinct().groupBy("doc").agg(F.collect_list("line").alias(gone))  # at most a document's lines
    schema = T.StructType([*docs.schema.fields, T.StructField(doc, T.LongType())])
    with_lists = docs.mapInArrow(keyed, schema).join(lists.withColumnRenamed("doc", doc), doc, "left").select(*docs.columns, gone)
    return with_lists.mapInArrow(_rewrite(at, None, len(docs.columns), None), docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of all ``documents`` that keep a word, recurring lines left out of text."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", (F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).cast("bigint").alias("n_lines"))
    out = without_recurring_lines(docs)
    left = F.when(F.col("text") == "", F.when(F.col("n_lines") > 1, F.lit(0)).otherwise(F.col("n_lines"))).otherwise(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))
    return out.select("doc_id", "text", "n_lines", (F.col("n_lines") - left).cast("bigint").alias("n_dropped"))
