"""Best paths against all ways to part a run; the trie and the join against each other."""

import itertools
import random

from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import segmentation
from weft.operators.segmentation import Lexicon, best_path


def every_path(run, weights, unknown):
    """All ways to part a run into known words and single characters; the best by weight, few words, long last words."""
    found = []
    for cuts in itertools.product((False, True), repeat=max(len(run) - 1, 0)):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
        words = [run[a:b] for a, b in zip([0, *ends], ends)]
        if all(w in weights or len(w) == 1 for w in words):
            score = sum(weights.get(w, unknown) for w in words)
            found.append((score, -len(words), tuple(len(w) for w in reversed(words)), words))
    return max(found)[3] if found and run else []


def edges_of(run, weights):
    return sorted(((a, b, weights[run[a:b]]) for a in range(len(run)) for b in range(a + 1, len(run) + 1) if run[a:b] in weights), key=lambda e: e[1])


def test_best_path_equals_all_paths():
    rng = random.Random(3)
    for _ in range(400):
        weights = {"".join(rng.choices("ab", k=rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(rng.randint(0, 8))}
        run = "".join(rng.choices("abc", k=rng.randint(0, 11)))
        assert best_path(run, edges_of(run, weights), -6) == every_path(run, weights, -6), (run, weights)


def test_inner_words_come_first():
    weights = {"中华": -2, "华人": -2, "人民": -2, "共和": -2, "共和国": -2, "中华人民共和国": -1}
    run = "中华人民共和国好"
    assert best_path(run, edges_of(run, weights), -9) == ["中华人民共和国", "好"]
    assert best_path(run, edges_of(run, weights), -9, search=True) == ["中华", "华人", "人民", "共和", "共和国", "中华人民共和国", "好"]


def words_table(spark):
    return segmentation.lexicon(spark.createDataFrame([("重新", 5), ("启动", 7), ("重新启动", 2), ("设备", 9), ("设备", 1), ("动设", 1), ("", 4), ("零", 0), (None, 3)], "word string, count long"))


def test_lexicon_weights(spark):
    words = words_table(spark)
    got = {r["word"]: r["weight"] for r in words.rows.collect()}
    assert set(got) == {"重新", "启动", "重新启动", "设备", "动设"}  # no empty word, none counted less than once
    assert got["设备"] == -917 and words.unknown == got["动设"] == -3219  # 10 and 1 of 25


def test_trie_and_join_give_the_same(spark):
    rng = random.Random(5)
    lists = [["重新启动设备", "设备"], [], None, ["", None, "重"], ["x" * 3000 + "设备" * 900], ["重新启动设备", "设备"]]
    lists += [["".join(rng.choices("重新启动设备零x", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 4))] for _ in range(40)]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lists)], "id long, runs array<string>, words string")
    words = words_table(spark)
    by_trie, by_join = (segmentation.segment(df, "runs", words, out="parts", search=s, sent_bytes=n) for s, n in ((True, 1 << 20), (True, 0)))
    assert by_trie.columns == ["id", "runs", "words", "parts"] and sorted(by_join.columns) == sorted(by_trie.columns)
    a, b = ({r["id"]: r["parts"] for r in d.collect()} for d in (by_trie, by_join))
    assert a == b and len(a) == len(lists)
    assert a[0] == [["重新", "启动", "重新启动", "设备"], ["设备"]] and a[1] == [] and a[2] is None and a[3] == [[], [], ["重"]]


def test_words_put_together_again(spark):
    df = spark.createDataFrame([(1, ["重新启动设备零x", "动设备"])], "id long, runs array<string>")
    assert segmentation.segment(df, "runs", words_table(spark)).select(F.transform("words", lambda w: F.array_join(w, ""))).first()[0] == ["重新启动设备零x", "动设备"]


def test_empty_lexicon_and_empty_table(spark):
    none = Lexicon(words_table(spark).rows.filter("false"), -1)
    df = spark.createDataFrame([(1, ["ab", ""])], "id long, runs array<string>")
    assert segmentation.segment(df, "runs", none).first()["words"] == [["a", "b"], []]
    assert segmentation.segment(df, "runs", none, sent_bytes=-1).first()["words"] == [["a", "b"], []]
    assert segmentation.segment(df.filter("false"), "runs", words_table(spark)).count() == 0


def test_mixed_words(spark):
    df = spark.createDataFrame([(1, "按住 E-20 重新启动设备 e-20 Reset!"), (2, None), (3, "plain Words"), (4, "")], "id long, text string")
    got = {r["id"]: r["tokens"] for r in segmentation.mixed_words(df, "text", words_table(spark)).collect()}
    assert got[1] == ["按", "住", "重新", "重新", "启动", "启动", "重新启动", "重新", "新启", "启动", "设备", "设备", "e-20", "reset"]
    assert got[2] == got[4] == []
    plain = df.select(tx.mixed_tokens(F.col("text"))).collect()
    assert got[3] == plain[2][0]  # without ideographs both ways are one
