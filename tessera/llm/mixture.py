"""Operator 5: a mix of sources to target weights along a time-varying curriculum. DataFrame functions only.

Targets: sources share all words by weight; none goes over ``cap`` times its size, and the excess is shared again by
weight (water filling over the table of sources). Each source's documents form a ring in hash order, and the mix takes
its target in words from the start of the ring, going round as often as needed and cutting the last document. A source's
weight changes over training time t in [0, 1] as target * (1 + slope * (1 - 2t)); its integral, the demand up to t, is
inverted for the first word of each round of a document to place it in training, and documents are range-sorted by the
first of these positions (``passes`` has a row for each).
Running sums are taken within hash buckets of a source and over the buckets, so a hot source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, table

WEIGHTS = (5, 2, 1)
#: How much more than on average a source is wanted at the start (and less at the end), by place like the weights.
SLOPES = (0.5, 0.0, -0.5)
#: Hex digits of the hash that make a bucket: 16 ** 3 buckets a source.
DIGITS = 3


def _targets(sources: DataFrame, weights: tuple, slopes: tuple, cap: int) -> DataFrame:
    """(source, source_size) with target, weight and slope. One row a source, however many documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    s = sources.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", pick(weights).cast("double")).withColumn("slope", pick(slopes).cast("double"))
    s = s.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("share", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("ratio") < F.col("share"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "place", "share"))).over(every)["share"]
    return s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.coalesce(level, F.lit(0.0)))).select("source", "source_size", "target", "slope")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, cap: int = 3, keep: tuple = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position, passes, positions) and the ``keep`` columns, sorted by position.

    size: words of the text, null 0. target: the source's, in words; taken: the words that the mix takes of the document,
    repeats counted; a source's sum is its target rounded. passes: how many times the document is begun; positions: where
    in [0, 1) each pass begins, in order; position: the first of them. What is not taken has position null, no passes and
    comes last. A made column whose name is also a kept one's is called mix_ and its name, as often as it takes. The null source is a source,
    the last one. The order in a ring is by a hash of id and text, then id and size; rows equal in all have
    interchangeable places. Null and empty texts, and so tables without any word: targets 0, nothing taken. An empty
    table gives an empty table. Reruns agree.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source_"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.md5(text.cast("binary")).alias("text_"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = rows.withColumn("hash", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text_").cast("binary"))).withColumn("bucket", F.substring("hash", 1, DIGITS)).drop("text_")
    buckets = rows.groupBy("source_", "bucket").agg(F.sum("size").alias("words"))
    sources = buckets.groupBy(F.col("source_").alias("source")).agg(F.sum("words").alias("source_size"))
    upto = Window.partitionBy("source_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = buckets.select("source_", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0).cast("bigint")).alias("start"))
    t = _targets(sources, weights, slopes, cap)
    plan = start.join(t, start.source_.eqNullSafe(t.source)).select(F.col("source_").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target", "slope")
    ring = Window.partitionBy("source_", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(ring), F.lit(0).cast("bigint")))
    out = rows.join(plan, F.col("source_").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    out = out.withColumn("before", F.col("start") + F.col("inside")).withColumn("demand", F.round("target").cast("bigint"))
    some = F.greatest(F.col("source_size"), F.lit(1))
    out = out.withColumn("rounds", F.floor(F.col("demand") / some).cast("bigint"))
    rest = F.col("demand") - F.col("rounds") * F.col("source_size") - F.col("before")
    out = out.withColumn("part", F.least(F.greatest(rest, F.lit(0).cast("bigint")), F.col("size")))
    out = out.withColumn("taken", F.col("rounds") * F.col("size") + F.col("part"))
    out = out.withColumn("passes", F.when(F.col("size") > 0, F.col("rounds") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(0).cast("bigint"))

    def when(k):  # the demand up to the k-th pass, as a share, inverted
        u, a = (F.col("before") + k * F.col("source_size")) / F.col("demand"), F.col("slope")
        return F.when(a == 0, u).otherwise(((1 + a) - F.sqrt((1 + a) * (1 + a) - 4 * a * u)) / (2 * a))

    out = out.withColumn("positions", F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1), when)).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    made = ("size", "source_size", "target", "taken", "position", "passes", "positions")
    taken = ["doc_id", *keep]
    for c in made:
        name = c
        while name.lower() in {x.lower() for x in taken}:
            name = f"mix_{name}"
        taken.append(name)
    named = [F.col(c).alias(name) for c, name in zip(made, taken[-len(made) :], strict=True)]
    return out.orderBy(F.col("position").asc_nulls_last(), "hash").select("doc_id", *named, *(F.col(f"kept_{c}").alias(c) for c in keep if c != "doc_id"))


def passes(mixed: DataFrame) -> DataFrame:
    """A row for each pass of each document that ``mix`` takes, range-sorted by ``at``, where in training it begins; with
    ``pass``, from 0, and all columns of ``mixed`` but positions."""
    return mixed.select(*(c for c in mixed.columns if c != "positions"), F.posexplode("positions").alias("pass", "at")).orderBy("at", "doc_id", "pass")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's mix of the whole ``documents`` table; position_2 and position_3 are those of further passes."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "passes", *(F.get("positions", F.lit(k - 1)).alias(f"position_{k}") for k in (2, 3)))  # no document exceeds three times its size


ORACLE = r"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM r GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST([0.5, 0.0, -0.5][place % 3 + 1] AS DOUBLE) AS slope, CAST(source_size * 3 AS DOUBLE) AS most FROM s),
v AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share
  FROM w WINDOW p AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT share AS level FROM v WHERE NOT most / weight < share ORDER BY most / weight, place LIMIT 1),
t AS (SELECT source, source_size, slope, CASE WHEN most / weight < share THEN most ELSE weight * (SELECT level FROM l) END AS target FROM v),
d AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.slope, CAST(round(t.target) AS BIGINT) AS demand,
  CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, demand // greatest(source_size, 1) AS rounds FROM d),
g AS (SELECT *, least(greatest(demand - rounds * source_size - before, 0), size) AS part FROM f),
h AS (SELECT *, rounds * size + part AS taken, CASE WHEN size > 0 THEN rounds + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS passes FROM g),
k AS (SELECT *, CAST(before AS DOUBLE) / CAST(demand AS DOUBLE) AS u1, CAST(before + source_size AS DOUBLE) / CAST(demand AS DOUBLE) AS u2, CAST(before + 2 * source_size AS DOUBLE) / CAST(demand AS DOUBLE) AS u3 FROM h)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN passes > 0 THEN CASE WHEN slope = 0 THEN u1 ELSE ((1 + slope) - sqrt((1 + slope) * (1 + slope) - 4 * slope * u1)) / (2 * slope) END END AS position,
  CAST(passes AS BIGINT) AS passes,
  CASE WHEN passes > 1 THEN CASE WHEN slope = 0 THEN u2 ELSE ((1 + slope) - sqrt((1 + slope) * (1 + slope) - 4 * slope * u2)) / (2 * slope) END END AS position_2,
  CASE WHEN passes > 2 THEN CASE WHEN slope = 0 THEN u3 ELSE ((1 + slope) - sqrt((1 + slope) * (1 + slope) - 4 * slope * u3)) / (2 * slope) END END AS position_3 FROM k
"""
