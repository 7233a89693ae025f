"""Queries against their SQL on rows that the given tables hold rarely or not at all."""

import duckdb
import pandas as pd

from weft.plans import catalog


def same(spark, folder, name, **tables):
    db = duckdb.connect()
    for t, rows in tables.items():
        db.register("given", rows)
        db.execute(f"COPY given TO '{folder}/{t}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    return {r[0]: r for r in got}


def said(texts):
    return pd.DataFrame([(c, t, "user", x) for c, turns in enumerate(texts) for t, x in enumerate(turns)], columns=["conv_id", "turn", "role", "text"])


def test_best_evidence_takes_ascii_edges(spark, tmp_path):
    same(spark, tmp_path, "best_evidence", conversations=said([["noé", "x", "y"], ["não no", "éno", "中no中", "x"], ["nó", "x"]]))


def test_qualifier_spans_take_ascii_edges_and_digits(spark, tmp_path):
    texts = ["éif", "if中", "٣ 4", "in case", "in \f case", "towardſ x", "ıf", "nó", "unleſs it", "plain"]
    assert len(same(spark, tmp_path, "qualifier_spans", conversations=said([[t] for t in texts]))) == 7


def test_contact_redaction_takes_ascii_edges_blanks_and_no_words(spark, tmp_path):
    texts = ["mail a@b.coé", "éa@b.com", "中13912345678中", "http://a\x0bb c", "400\x0b123\x0b1234", "HTTPſ://x y", "a@K.Kſ", "call 12315 官网", "0571-12345678é", ""]
    same(spark, tmp_path, "contact_redaction", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))


def test_words_by_ascii_edges_elsewhere(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": range(5), "text": ["中if中", "éunless", "token中: abcdefghijklmn", "é10.1.2.3", "for\x0ba type"]})
    same(spark, tmp_path, "condition_index", documents=docs)
    same(spark, tmp_path, "publishing_scan", documents=docs)
    same(spark, tmp_path, "section_flags", pages=pd.DataFrame({"page_id": [1, 2], "url": ["éindex", "中notice中"], "html": ["", ""]}))


def test_media_limits_round_prices(spark, tmp_path):
    prices = [1000.0, 1000.5, 1001.5, 999.5, 1000.4, 1000.6]
    part = pd.DataFrame({"p_partkey": range(6), "p_size": pd.array([30] * 6, "int32"), "p_retailprice": prices})
    same(spark, tmp_path, "media_limits", part=part)


def test_scenes_round_times_by_their_exact_value(spark, tmp_path):
    ms = [62500, 187500, 500, 1500, 1814400062500, 3000000]
    at = (pd.Timestamp("2024-01-01") + pd.to_timedelta(ms, unit="us")).astype("datetime64[us]")
    same(spark, tmp_path, "expanded_scenes", events=pd.DataFrame({"event_id": range(6), "user_id": [1] * 6, "ts": at, "event_type": ["view"] * 6, "value": [1.0] * 6, "props": ["{}"] * 6}))


def test_ids_that_repeat(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": pd.array([1, 1, 2, 3, None], "Int64"), "text": ["a b b", "b c a", "a c", "", "b b"]})
    items = pd.DataFrame({"item_id": [7], "text": ["b c"]})
    for name in ("tfidf_terms", "stored_topk"):
        (tmp_path / name).mkdir()
        assert same(spark, tmp_path / name, name, documents=docs, benchmark=items)
