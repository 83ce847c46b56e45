"""Operator 4: secrets in texts. DataFrame and SQL functions only.

Three fixed kinds are found by patterns. A further kind, ``markov``, is any other long run of key characters that a
character Markov model of random strings explains better than one of ordinary identifiers: the log-likelihood ratio is
summed over the run's character pairs, from a table trained on labelled samples. Work on a text is linear in its length
and in the length of its runs; places are running sums, taken in blocks of about the root of the number of matches.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, spread, table

#: Fixed patterns and least lengths (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge, and what the ratio must reach in all and a character.
RUN, RATIO, RATIO_PER_CHAR = r"[A-Za-z0-9+/_=-]{16,}", 12.0, 0.6
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents (of least xxhash64(doc_id)) whose words are the samples of ordinary identifiers.
SAMPLE_DOCS = 2000
_SIDE = len(SYMBOLS) + 1  # and the start of a string


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples (text, label): 1 random strings made from hashes by rule, in hex, base64 and upper-case forms; 0
    ordinary identifiers from a bounded sample of documents, what the fixed patterns match removed: words of eight key
    characters or more, and every fifth pair of neighbouring words as snake_case, camelCase, CONSTANT_CASE, kebab-case and path/parts."""
    n = docs.sparkSession.range(3000)
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    random = n.select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(b64, 1, 40), F.upper(F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 20)))).alias("text"), F.lit(1).alias("label"))
    ids = docs.where("text is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # as many rows as the limit
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    every = lambda p: F.regexp_extract_all("plain", F.lit(p), F.lit(0))
    some = some.select(plain.alias("plain"))
    forms = [lambda a, b: F.concat(a, F.lit("_"), b), lambda a, b: F.concat(a, F.initcap(b)), lambda a, b: F.upper(F.concat(a, F.lit("_"), b)), lambda a, b: F.concat(a, F.lit("-"), b), lambda a, b: F.concat(a, F.lit("/"), b)]

    def joined(words, a, i):  # from every fifth word on, each form in turn
        a, b, out, of = F.lower(a), F.lower(F.get(words, i + 1)), F.when(i % 5 != 0, None), F.floor(i / 5) % len(forms)
        for k, f in enumerate(forms):
            out = out.when(of == k, f(a, b))
        return out

    pairs = let(every("[A-Za-z]{3,}"), lambda w: F.filter(F.transform(w, lambda a, i: joined(w, a, i)), lambda x: x.isNotNull()))
    words = some.select(F.explode(F.concat(every("[A-Za-z0-9+/_=-]{8,}"), pairs)).alias("text"), F.lit(0).alias("label"))
    return random.union(words)


def _codes(run):
    """Places of the run's characters in SYMBOLS, from 1; 0 for others. Splitting once keeps it linear."""
    places = {c: i for i, c in enumerate(SYMBOLS, 1)}
    table_ = F.expr(f"array({','.join(str(places.get(chr(c), 0)) for c in range(128))})")
    return F.transform(F.split(run, ""), lambda c: F.coalesce(F.get(table_, F.ascii(c)), F.lit(0)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair, flattened: previous symbol * SIDE + symbol.

    Characters outside SYMBOLS are left out. Pairs are smoothed by their symbol's frequency in the class, symbols by one
    more count. Null and empty samples teach nothing. At most 2 * SIDE ** 2 rows of counts come to the driver."""
    codes = labelled.where("text <> ''").select("label", F.filter(_codes(F.col("text")), lambda c: c > 0).alias("c"))
    pairs = codes.select("label", F.explode(let(F.col("c"), lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, 0).otherwise(F.get(cs, i - 1)) * _SIDE + c))).alias("x"))
    rows = pairs.groupBy("label", "x").count().select("label", F.floor(F.col("x") / _SIDE).alias("p"), (F.col("x") % _SIDE).alias("n"), "count").collect()
    logs = []
    for label in (0, 1):
        got = {(r["p"], r["n"]): r["count"] for r in rows if r["label"] == label}
        single = [1.0] * _SIDE
        total = [0.0] * _SIDE
        for (p, n), k in got.items():
            single[n] += k
            total[p] += k
        single[0] = 0.0
        of = sum(single)
        logs.append([math.log((got.get((p, n), 0) + 20 * single[n] / of) / (total[p] + 20)) if n else 0.0 for p in range(_SIDE) for n in range(_SIDE)])
    return [b - a for a, b in zip(*logs, strict=True)]


def _running(values, op):
    """Running values of ``op`` (over ints, from 0) along an array, in blocks of about the root of its size."""

    def blocks(a):
        b = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / b).cast("int")), lambda k: F.slice(a, k * b + 1, b))

    def within(block, head):
        start = F.struct(head.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda s, x: let(op(s["at"], x), lambda v: F.struct(v.alias("at"), F.array_append(s["out"], v).alias("out")))
        return F.aggregate(block, start, step, lambda s: s["out"])

    fold = lambda a: F.aggregate(a, F.lit(0), op)
    over = lambda bs: let(F.transform(bs, fold), lambda tops: F.flatten(F.transform(bs, lambda x, k: within(x, fold(F.slice(tops, F.lit(1), k))))))
    return let(values, lambda a: F.when(F.size(a) > 0, let(blocks(a), over)).otherwise(F.expr("cast(array() as array<int>)")))


def _spans(matches, pieces, kind: str, ratios=None):
    """Structs (start, place, stop, kind, text, ratio) of matches, from the pieces between them; lengths count code points.

    What a lambda looks up is bound by ``let``: the optimizer may put a column's expression into the lambda, once an element."""
    stops = _running(F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.length(m) + F.length(p)), lambda a, x: a + x)
    spans = lambda ends, r=None: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.get(ends, i).alias("stop"), F.lit(kind).alias("kind"), m.alias("text"), (F.lit(0.0) if r is None else F.get(r, i)).alias("ratio")))
    none = F.expr("cast(array() as array<struct<start:int,place:int,stop:int,kind:string,text:string,ratio:double>>)")
    bound = let(stops, lambda ends: spans(ends) if ratios is None else let(ratios, lambda r: spans(ends, r)))
    return F.when(F.size(matches) > 0, bound).otherwise(none)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def scan(docs: DataFrame, table_: list[float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov, found) for each row of ``docs``.

    base_sha256: of the three fixed kinds' spans, kind:start:end in code points by start, then kind. spans: all, joined
    likewise; a markov span never overlaps a fixed one. found: the strings, in the order of spans. Null text: empty, so
    no spans and the hash of the empty string. Texts and runs may be of any length. Repeated rows give repeated rows, null
    ids stay null, other columns are ignored, an empty table gives an empty table.
    """
    t = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    every = lambda p, g: F.regexp_extract_all("t", F.lit(p), F.lit(g))
    t = t.select("doc_id", "t", every(ASSIGN, 0).alias("ma"), every(ACCESS, 0).alias("mk"), every(HEX, 0).alias("mh"), every(RUN, 0).alias("mr"))
    cut = lambda m, p: F.when(F.size(m) > 0, F.split("t", p, -1))
    t = t.select("*", F.when(F.size("ma") > 0, every(ASSIGN, 2)).alias("va"), cut("ma", ASSIGN).alias("pa"), cut("mk", ACCESS).alias("pk"), cut("mh", HEX).alias("ph"), cut("mr", RUN).alias("pr"))
    llr = F.expr(f"cast(split('{' '.join(map(repr, table_))}', ' ') as array<double>)")
    pairs = lambda cs: F.aggregate(F.transform(cs, lambda c, i: F.get(llr, F.when(i == 0, 0).otherwise(F.get(cs, i - 1)) * _SIDE + c)), F.lit(0.0), lambda a, x: a + x)
    t = t.withColumn("lr", F.transform("mr", lambda r: let(_codes(r), pairs)))
    t = t.select("doc_id", "va", _spans(F.col("ma"), F.col("pa"), "assign").alias("sa"), _spans(F.col("mk"), F.col("pk"), "access").alias("sk"), _spans(F.col("mh"), F.col("ph"), "hex").alias("sh"), _spans(F.col("mr"), F.col("pr"), "markov", F.col("lr")).alias("sr"))
    t = t.withColumn("sa", F.when(F.size("sa") > 0, let(F.col("va"), lambda v: F.filter("sa", lambda s, i: F.length(F.get(v, i)) >= ASSIGN_LEAST))).otherwise(F.col("sa")))
    t = t.select("doc_id", "sa", "sk", "sh", F.array_sort(F.concat("sa", "sk", "sh", F.filter("sr", lambda s: (s["ratio"] >= RATIO) & (s["ratio"] >= RATIO_PER_CHAR * (s["stop"] - s["start"]))))).alias("all_"))
    # a fixed span that starts no later reaches into a run, or the next one starts in it
    reach = _running(F.transform("all_", lambda s: F.when(s["place"] < 3, s["stop"]).otherwise(0)), lambda a, x: F.greatest(a, x))
    far = 2**31 - 1
    ahead = F.reverse(_running(F.reverse(F.transform("all_", lambda s: F.when(s["place"] < 3, far - s["start"]).otherwise(0))), lambda a, x: F.greatest(a, x)))
    free = lambda r, a: F.filter("all_", lambda s, i: (s["place"] < 3) | (F.get(r, i) <= s["start"]) & (far - F.get(a, i) >= s["stop"]))
    some = F.exists("all_", lambda s: s["place"] == 3)
    t = t.withColumn("all_", F.when(some, let(reach, lambda r: let(ahead, lambda a: free(r, a)))).otherwise(F.col("all_")))
    n = lambda c: F.size(c).cast("bigint")
    base = F.filter("all_", lambda s: s["place"] < 3)
    return t.select("doc_id", n("sa").alias("n_assign"), n("sk").alias("n_access"), n("sh").alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined("all_").alias("spans"), n(F.filter("all_", lambda s: s["place"] == 3)).alias("n_markov"), F.transform("all_", lambda s: s["text"]).alias("found"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scan of every whole text of ``documents``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scan(docs, train(samples(docs))).drop("found")
