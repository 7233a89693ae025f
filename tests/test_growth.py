"""Plans and parts of queries that must not gather what grows with the tables."""

import random
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.operators import batches, chunking, evidence, lexical, routing, segmentation
from weft.plans import catalog
from weft.plans.catalog import table
from weft.plans import routing as routes

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joined_words_are_not_sent_to_all(spark):
    df = spark.createDataFrame([(1, ["abcabd", "xab"])], "id int, runs array<string>")
    words = segmentation.Lexicon(spark.createDataFrame([("abc", -1), ("ab", -2), ("abd", -3)], "word string, weight long"), -9)
    for sent in (-1, 18):  # no word goes as a trie, then the one of two letters
        out = segmentation.segment(df, "runs", words, sent_bytes=sent)
        assert "Broadcast" not in plan(out)
        assert out.first()["words"] == [["abc", "abd"], ["x", "ab"]]


def test_words_of_a_lexicon_are_counted_once(spark):
    words = segmentation.lexicon(spark.createDataFrame([("ab", 1), ("ab", 2), ("c", 1)], "word string, count long"))
    assert "Aggregate" not in plan(words.rows) and words.rows.count() == 2


def test_runs_are_shuffled_by_their_list_only(spark):
    df = spark.createDataFrame([(1, ["abcabd", "xab"])], "id int, runs array<string>")
    words = segmentation.Lexicon(spark.createDataFrame([("abc", -1), ("ab", -2), ("abd", -3)], "word string, weight long"), -9)
    assert plan(segmentation.segment(df, "runs", words, sent_bytes=18)).count("Exchange") <= 7  # lists (read twice), pieces, words, edges, paths, rows


def test_map_lets_few_other_pieces_through(monkeypatch):
    monkeypatch.setattr(segmentation, "MAP_BITS", 1 << 16)
    hashes = np.random.default_rng(7).integers(0, 1 << 63, 22_000).astype(np.uint64)
    bits = np.zeros(segmentation.MAP_BITS // 8, np.uint8)
    for k in range(segmentation.PROBES):  # as full as the whole map is of eight million words
        at = segmentation._place(hashes[:2000], k)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    held = segmentation._held(bits, hashes)
    assert set(range(2000)) <= set(held.tolist()) and len(held) < 2000 + 20


def test_phrases_leave_in_parts():
    texts = pd.Series(["a" * (lexical.PART // 2)] * 8 + [None, ""])
    parts = list(lexical.in_parts(iter([texts])))
    assert len(parts) >= 4 and pd.concat(parts).equals(texts)


def test_trees_are_built_once(spark):
    assert "InPandas" not in plan(catalog.QUERIES["tree_traversal"](spark, DIR))


def test_routing_sends_no_side_to_all(spark):
    asked = table(spark, DIR, "part").select(F.col("p_partkey").alias("q"))
    none = asked.withColumn("product", F.lit("x")).withColumn("length", F.lit(1))
    named = none.withColumn("alias", F.lit("x")).withColumn("exact", F.lit(True))
    out = routing.route(asked, none, asked.withColumn("product", F.lit("x")), none, none.drop("length"), named, none.select("q", "product", F.lit(1).alias("votes")), [])
    assert "Broadcast" not in plan(out)


def test_questions_and_their_phrases_are_not_sent_to_all(spark):
    assert "BuildLeft" not in plan(catalog.QUERIES["route_cascade"](spark, DIR))  # the questions are on the left of each join


def test_long_dimensions_send_no_side_to_all(spark, monkeypatch):
    make = catalog.QUERIES["alias_match"]
    want = make(spark, DIR).collect()
    monkeypatch.setattr(routing, "MAX_DIMENSION_BYTES", 0)
    got = make(spark, DIR)
    assert "Broadcast" not in plan(got) and sorted(got.collect()) == sorted(want)


def test_name_patterns_are_asked_where_the_name_stands(spark):
    assert "Contains(__said" in plan(routing.display_matches(routes.questions(spark, DIR), routes.names(spark, DIR)))


def test_texts_go_to_workers_in_bounded_batches(spark):
    docs = table(spark, DIR, "documents").select("source", "doc_id", "text")
    for make in (lambda: evidence.passages(docs, "source", "doc_id", "text"), lambda: chunking.spans(docs, "text", lambda t: chunking.byte_pieces(t, 600))):
        spark.conf.set(batches.CONF, 64 << 20)
        make()
        assert int(spark.conf.get(batches.CONF).rstrip("b")) <= batches.BYTES


def test_resampled_means_are_those_of_python():
    for values in ([1.0, -1.0, 0.0, 1.0, 0.0], [random.Random(3).random() for _ in range(77)]):
        rng = random.Random(11)
        want = [statistics.fmean(rng.choices(values, k=len(values))) for _ in range(40)]
        assert evidence.resampled_means(np.array(values), 40, 11) == want


def test_submissions_name_their_patterns_once(spark):
    assert plan(catalog.QUERIES["submission_format"](spark, DIR)).count("regexp_replace") < 100
