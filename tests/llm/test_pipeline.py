"""The pipeline on planted rows: each stage catches what it is for and leaves the rest."""

import random

import corpus_pipeline
import pytest
from test_operators import docs, prose


def test_pipeline(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(i, "\n".join(prose(rnd, 40) for _ in range(3))) for i in range(300)]
    labels = [(i, 0) for i in range(300)]
    rows += [(1000 + i, prose(rnd, 50) + f" vile nasty {prose(rnd, 9)} awful") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(50)]
    rows += [(2000 + i, rows[i][1]) for i in range(20)]  # exact copies
    near = [(2100 + i, rows[i][1] + " tail") for i in range(20, 40)]
    rows += near
    item = prose(rnd, 30)
    rows += [(3000 + i, f"{prose(rnd, 40)} {item} {prose(rnd, 40)}") for i in range(5)]
    rows = [(i, t + "\nAll rights reserved by the owners of this site") if 0 <= i < 40 else (i, t) for i, t in rows]
    docs(spark, [*rows, (None, None), (5000, "")]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert set(range(300)) | {None, 5000} == ids
    assert not any("All rights" in (r["text"] or "") for r in out)
    assert len(out) == len(ids) and all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, stage):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = stage[1](spark, df, "/root/testdata/sf0.001")
    assert out.dtypes == df.dtypes and 0 < out.count() <= df.count()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_hard_tables(spark, tmp_path, stage):
    """Empty tables, nulls in every column, repeated rows, long texts and words, and columns with the names of made ones."""
    rnd = random.Random(3)
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rnd, 20)), (2, None), (3, ""), (None, "q r s t u v")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ", size string, source_size int, target double, taken string, position string, passes int, positions string, gone__ int, doc__ string, key int, comp int, mix_size int"
    more = ("s", 1, 0.5, "t", "p", 2, "q", 3, "d", 4, 5, 6)
    long = prose(rnd, 30_000, 10**6)
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, None), (None, "a null id is here"), (5, long), (6, "x" * 200_000 + "\n" * 9000 + "y"), (7, "one"), (8, "it repeats as it is"), (8, "it repeats as it is"), (9, "\U0001f600 ü")]
    rows = [(i, t, None if i == 7 else "en", None if i in (2, 5) else "s", len(t or ""), *more) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra)
    out = stage[1](spark, df, str(tmp_path))
    assert set(df.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    kept = sorted(map(repr, (tuple(r[c] for c in df.columns) for r in out.collect())))
    want = sorted(map(repr, map(tuple, df.collect())))
    if stage[0] == "n-gram Jaccard join":
        want = sorted(map(repr, set(map(tuple, df.collect()))))
    assert kept == want
    none = stage[1](spark, df.where("false"), str(tmp_path))
    assert none.count() == 0 and set(df.columns) <= set(none.columns)
