"""Searches in the stored block index against BM25 of all pairs."""

import random

from pyspark.sql import functions as F

from weft.operators import blocks, lexical, ranking


def corpus(spark, n=600):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(200)]
    odds = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(rng.choices(vocab, odds, k=rng.randint(1, 80)))) for i in range(n)]
    docs += [(n + i, t) for i, (_, t) in enumerate(docs[:20])] + [(5000, None), (5001, "")]
    queries = [(q, " ".join(rng.choices(vocab, odds if q % 2 else None, k=rng.randint(1, 9)))) for q in range(12)]
    queries += [(90, "unknown"), (91, None), (92, "w0 w0 w0 w199"), (93, "w0")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def test_search_equals_all_pairs(spark, tmp_path):
    docs, queries = corpus(spark)
    tokens = F.split(F.coalesce("text", F.lit("")), " ")
    tokens = F.filter(tokens, lambda t: t != "")
    posts = lexical.postings(docs, tokens)
    path = str(tmp_path / "index")
    blocks.save(posts, lexical.corpus(docs, posts), path)
    whole = lexical.bm25(docs, queries, tokens, tokens).withColumn("score", F.round("score", 6))
    for k in (1, 5, 700):
        want = ranking.top_k(whole, ["query"], "score", "doc", k).select("query", "doc", "score", "rank")
        got = blocks.top_k(spark, path, queries, tokens, k).select("query", "doc", "score", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_negative_weights(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b " + ("c " if i % 3 else "") + "a " * (i % 4)) for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a c"), (2, "a b c"), (3, "b")], "query_id long, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    posts = lexical.postings(docs, tokens)
    blocks.save(posts, lexical.corpus(docs, posts), str(tmp_path / "index"))
    whole = lexical.bm25(docs, queries, tokens, tokens).withColumn("score", F.round("score", 6))
    assert whole.agg(F.min("score")).first()[0] < 0
    want = ranking.top_k(whole, ["query"], "score", "doc", 6).select("query", "doc", "score", "rank")
    got = blocks.top_k(spark, str(tmp_path / "index"), queries, tokens, 6).select("query", "doc", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_thresholds_leave_postings_out(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("often "), F.repeat(F.lit("filler "), (F.col("id") % 40).cast("int")), F.lit("u"), F.col("id").cast("string"), F.lit(" "), F.when(F.col("id") % 50 == 0, "rare rare").otherwise("")).alias("text"))
    queries = spark.createDataFrame([(1, "often rare")], "query_id long, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    posts = lexical.postings(docs, tokens)
    path = str(tmp_path / "index")
    blocks.save(posts, lexical.corpus(docs, posts), path)
    work = blocks.Search(spark, path, lexical.query_terms(queries, tokens), 10).work()
    assert work["postings"] == 4080 and work["essential"] <= 80 and 10 <= work["candidates"] <= 80


def test_both_ways_of_scoring_agree(spark, tmp_path, monkeypatch):
    docs, queries = corpus(spark, 300)
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")
    for name, some in (("some", docs), ("none", docs.filter("doc_id >= 5000"))):
        path = str(tmp_path / name)
        blocks.save(lexical.postings(some, tokens), lexical.lengths(some, tokens), path)
        found = []
        for most, cells in ((blocks.MAX_HEADS, 1 << 20), (blocks.MAX_HEADS, 40), (-1, 40)):
            monkeypatch.setattr(blocks, "MAX_HEADS", most)
            monkeypatch.setattr(blocks.scoring, "CELLS", cells)
            found.append(sorted(map(tuple, blocks.top_k(spark, path, queries, tokens, 5).collect())))
        assert found[0] == found[1] == found[2] and bool(found[0]) == (name == "some")


def test_each_posting_travels_once(spark, tmp_path, monkeypatch):
    """Words and postings don't travel to make an index, and of a search's postings each travels once, whatever the queries that ask for it."""
    monkeypatch.setattr(lexical, "SMALL_BYTES", -1)
    docs, queries = corpus(spark)
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")
    posts = lexical.postings(docs, tokens)
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    blocks.save(posts, lexical.lengths(docs, tokens), str(tmp_path))
    found = blocks.Search(spark, str(tmp_path), lexical.query_terms(queries, tokens), 5).best(6)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
