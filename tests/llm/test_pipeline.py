"""The pipeline's stages against brute-force versions, and the registered queries."""

import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from weft.llm import common, decontaminate, lines
from weft.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    from tests.llm.test_operators import dedup_by_force, groups_by_force

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(90)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, DIR)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert set(after) == {d for d, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "line_dedup":
            want = dedup_by_force([(d, r["text"]) for d, r in before.items()], lines.MIN_CHARS, lines.TAU, lines.EXACT_CHARS)
            left = {d: t for (d, old), t in want.items() if t == old or t.strip()}
            assert {d: r["text"] for d, r in after.items()} == left and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_dedup":
            group = groups_by_force([(d, r["text"]) for d, r in before.items()], 5, 80)
            assert set(after) == {d for d, c in group.items() if d == c}
        else:
            items = [decontaminate.folded(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            hit = lambda t: any(decontaminate.nearest(decontaminate.masks(i), len(i), decontaminate.folded(t)) <= decontaminate.budget(i) for i in items)
            assert set(after) == {d for d, r in before.items() if not hit(r["text"])}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert out.filter("NOT parity OR NOT round_trip OR n_tokens <> size(tokens)").count() == 0 and out.count() == docs.count()


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == docs.columns
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "n_tokens", F.xxhash64("text", "tokens")).collect())
    assert key(got) == key(docs)


def test_stages_take_odd_and_empty_tables(spark):
    from tests.llm.test_operators import LONG

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Some text here", "en", "s", 14), (3, "Some text here", "en", "s", 14), (None, "Other text", None, "s", 10), (5, LONG, "en", "s", len(LONG))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DIR)
        assert docs.count() == (4 if df.count() else 0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_registered_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    # a missing integer is NaN or NA, which equals nothing
    rows = lambda pdf: collections.Counter(tuple(None if pd.isna(v) else v for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(SQL[name]).df())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_language_stage_keeps_the_stated_languages(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de", "fr"))
    got = corpus_pipeline.identify_language(spark, docs, DIR)
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    kept = {r["doc_id"]: r["lang"] for r in got.collect()}
    assert set(kept.values()) == {"de", "fr"} and sum(true[d] == x for d, x in kept.items()) > 0.95 * len(kept)
    assert len(kept) > 0.9 * sum(x in ("de", "fr") for x in true.values())


def test_run_leaves_one_table(spark, tmp_path, monkeypatch):
    """Scratch tables go as soon as nothing reads them; the last stage's input stays."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, DIR).count() > 0
    assert [p.name.split("-")[0] for p in (tmp_path / "weft").iterdir() if p.is_dir()] == ["decontamination"]
