"""The token-group join, the prefix trie and the ranked search against brute force, SQL and awkward inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import blockmax, tokengroups, trie
from weft.llm.words import WordHasher

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# token-group join


def shingled(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def joined(docs, width, percent):
    """Smallest id reachable from each id."""
    sets = [(i, shingled(t, width)) for i, t in docs if i is not None]
    best = {i: i for i, _ in sets}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                best[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def families(seed=5, n=40):
    """Near copies in chains, exact copies, a passage that all share, short texts and texts without words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=12))
    docs = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.randint(3, 90))
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.6 and len(base) > 4:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocab)
            text = " ".join(base)
            docs.append(text.upper() if rng.random() < 0.2 else text + (" " + passage if rng.random() < 0.5 else ""))
    return [(i, t) for i, t in enumerate([*docs, *docs[:20], "", None, " \n", "one", "ONE", "two words"])]


@pytest.mark.parametrize("most,group,rare", [(tokengroups.MAX_COMMON, 32, 16), (0, 2, 2), (tokengroups.MAX_COMMON, 3, 1)])
def test_join_equals_brute_force(spark, monkeypatch, most, group, rare):
    monkeypatch.setattr(tokengroups, "GROUP", group)
    monkeypatch.setattr(tokengroups, "RARE", rare)
    docs = families()
    got = tokengroups.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), width=3, percent=70, max_common=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == joined(docs, 3, 70)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingled(t, 3)) for i, t in docs}


def test_join_of_many_nodes_and_common_tokens_shuffles_prefixes_only(spark, monkeypatch):
    monkeypatch.setattr(tokengroups, "RARE", 2)
    monkeypatch.setattr(tokengroups, "MAX_BROADCAST", 0)
    cuts, whole = [], tokengroups.matrix
    monkeypatch.setattr(tokengroups, "matrix", lambda cut, *more: cuts.append(cut) or whole(cut, *more))
    docs = families()
    got = tokengroups.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), width=3, percent=70, max_common=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == joined(docs, 3, 70)
    assert "Exchange" not in cuts[0]._jdf.queryExecution().executedPlan().toString()  # neither texts nor sets travel to be put in order
    size = {i: len(shingled(t, 3)) for i, t in docs}
    lengths = {r["id"]: len(r["prefix"]) // 8 for r in cuts[0].collect()}
    assert lengths == {i: tokengroups.prefix_length(np.array([n]), 70)[0] for i, n in size.items() if n}


def test_most_common_tokens_by_whole_classes(spark):
    hot = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 6), (5, 9)], "token long, class int")
    taken = {n: sorted(r["token"] for r in tokengroups.most_common(hot, n).collect()) for n in (0, 1, 2, 3, 4, 5)}
    assert taken == {0: [], 1: [5], 2: [5], 3: [3, 4, 5], 4: [3, 4, 5], 5: [1, 2, 3, 4, 5]}
    assert tokengroups.most_common(hot.filter("false"), 3).count() == 0


def test_join_threshold_is_inclusive(spark):
    a = [f"a{i}" for i in range(20)]
    docs = [(1, " ".join(a)), (2, " ".join(a[:17])), (3, " ".join(a[:16]))]  # 17 of 20 and 16 of 20 words in common
    got = tokengroups.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), width=1, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1}  # 3 by way of 2: 16 of 17
    got = tokengroups.similar_documents(spark.createDataFrame([docs[0], docs[2]], "doc_id long, text string"), width=1, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 3: 3}


def test_join_opens_qualifying_groups_only():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    near, far = a[:190], np.unique(np.concatenate([a[:100], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    assert tokengroups.qualifying([near, far], a, [len(a)], 85) == [0]
    assert tokengroups.qualifying([a], np.unique(np.concatenate([near, far])), [100, 190], 85) == [0]


def test_hot_family_needs_few_comparisons(spark, monkeypatch):
    """Near copies: groups are compared with one group each, then nothing is left to compare."""
    seen = []
    whole = tokengroups.outer_links

    def counted(pairs, groups, percent):
        seen.append(pairs.count())
        return whole(pairs, groups, percent)

    monkeypatch.setattr(tokengroups, "outer_links", counted)
    monkeypatch.setattr(tokengroups, "GROUP", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(200):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    got = tokengroups.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), width=4, percent=85).collect()
    assert {r["component_id"] for r in got} == {0}
    assert seen[0] < 200 and seen[1] == 0


def test_join_takes_odd_rows(spark):
    schema = "doc_id long, text string, n_shingles string, component_id string, gid string"
    long = "word " * 60_000 + "end"
    same = "alpha beta gamma delta epsilon zeta"
    docs = [(1, None), (2, ""), (3, "\t \n"), (4, long), (5, same), (5, same), (None, same), (6, same.upper()), (9, "x y z u v"), (9, same + " eta"), (8, long)]
    got = tokengroups.similar_documents(spark.createDataFrame([(*d, "c", "c", "c") for d in docs], schema), width=4, percent=85)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (8, 2, 4), (5, 3, 5), (5, 3, 5), (6, 3, 5), (9, 2, 9), (9, 4, 9), (None, 3, None)]
    assert found == sorted(want, key=repr)
    one = spark.createDataFrame([(9, "x y z u v"), (9, same), (7, "x y z u v"), (11, same)], "doc_id long, text string")
    assert {r["component_id"] for r in tokengroups.similar_documents(one, width=4).collect()} == {7}  # an id's rows are one node
    assert tokengroups.similar_documents(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        tokengroups.similar_documents(one, percent=40)


# prefix trie


def by_hand(turns, every=20, most=4):
    convs = collections.defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(math.fmod(c, every))
        seqs[c] = convs.get(base, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out, leaves, saved, children = set(), {}, {}, collections.Counter(k[:-1] for k in members if k)
    for k in sorted(members, key=len, reverse=True):
        below = [x for x in leaves if len(x) == len(k) + 1 and x[:-1] == k]
        leaves[k] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = sum(saved[x] for x in below) + (len(members[k]) - 1) * words
        ends = ",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k))
        out.add((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def built(spark, turns, schema="conv_id long, turn long, role string, text string", **how):
    return trie.trie(*trie.rebuilt(trie.numbered(spark.createDataFrame(turns, schema)), **how))


@pytest.mark.parametrize("broadcast,run,piece", [(trie.MAX_BROADCAST, 4096, 1 << 16), (0, 3, 10)])
def test_trie_equals_brute_force(spark, monkeypatch, broadcast, run, piece):
    for name, value in (("MAX_BROADCAST", broadcast), ("RUN", run), ("PIECE", piece)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(8)
    turns = []
    for c in [*range(60), *range(400, 430), 7_000_000_123, -7, -41]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            turns.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello there", "a  b\tc", "ok", ""])))
    turns += [(500 + k, t, "user", f"turn {t}") for k in range(12) for t in range(8)]  # copies
    turns += [(c, None, None, None) for c in (3, 601, 601)] + [(601, 2, "b", "x"), (601, 2, "a", "y"), (601, 2, "a", "y")]
    rng.shuffle(turns)
    got = [tuple(r) for r in built(spark, turns).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(turns)


def test_trie_rounds_stop_where_sequences_differ(spark, monkeypatch):
    """Equal long conversations retire together: rounds follow shared turns of different ones only."""
    turns = [(c, t, "user", f"say {t} {c // 100}") for c in (1, 2, 3, 101, 102) for t in range(300)]
    made = []
    whole = trie.materialize
    monkeypatch.setattr(trie, "materialize", lambda df, name, **k: made.append(name) or whole(df, name, **k))
    got = trie.trie(trie.numbered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), spark.createDataFrame([(c,) for c in (1, 2, 3, 101, 102)], "conv_id long"))
    assert made.count("split") <= 1
    top = got.filter("depth = 0").first()
    assert (top["n_convs"], top["n_leaves"], top["n_children"], top["saved_tokens"]) == (5, 2, 2, 3 * 300 * (2 + 1))
    assert got.count() == 601


def test_trie_takes_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, pos string, digest string, n_leaves string"
    turns = [(4, 0, "user", "word " * 50_000), (4, 0, "user", "word " * 50_000), (None, 1, "user", "x"), (24, 0, None, "  é")]
    got = built(spark, [(*t, "c", "c", "c") for t in turns], schema)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {tuple(r) for r in got.collect()} == by_hand(turns)
    assert built(spark, [], schema).count() == 0
    lone = [(5, t, "user", "hi") for t in range(4)]
    assert {tuple(r) for r in built(spark, lone).collect()} == by_hand(lone)


# ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs if i is not None]
    n_docs, total = sum(1 for _, t in texts if t), sum(len(t) for _, t in texts)
    df = collections.Counter(w for _, t in texts for w in set(t))
    wanted = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, t in texts:
            tf, score = collections.Counter(t), 0
            for w in terms & set(t):
                m = 100 - 90 + (90 * len(t) * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, weights, k=rng.randint(1, 120)))) for i in range(n)]
    docs += [(n + i, t) for i, (_, t) in enumerate(docs[:30])]  # ties
    items = [(i, " ".join(rng.choices(vocab, weights if i % 2 else None, k=rng.randint(1, 12)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("block,shard,most,item_bytes", [(128, 10**6, 10**6, 8 << 20), (8, 900, 10**6, 300), (16, 5000, 0, 8 << 20)])
def test_search_equals_brute_force(spark, monkeypatch, block, shard, most, item_bytes):
    monkeypatch.setattr(blockmax, "BLOCK", block)
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    if block == 128:
        got = blockmax.rank(d, q, max_terms=most)
    else:
        terms = blockmax.item_terms(q)
        only = np.sort(np.array([r[0] for r in terms.select("term").distinct().collect()], np.int64).view(np.uint64)) if most else None
        # the block size is read in the tasks, so here the shards are read in this process
        index = blockmax.build_index(d, only, shard_terms=shard)
        got = blockmax.search(index, terms, item_bytes=item_bytes)
    assert sorted(tuple(r) for r in got.collect()) == ranked(docs, items)


def coded(docs, block):
    """A shard of all documents, made in this process."""
    words = WordHasher()
    terms, n = words([t for _, t in docs])
    ids, owner = np.array([i for i, _ in docs]), np.repeat(np.arange(len(n)), n)
    return blockmax.Shard(*blockmax.encode(ids, n, terms, owner, int((n > 0).sum()), int(n.sum()))), words


@pytest.mark.parametrize("block", [8, 32, 128])
def test_blocks_give_back_postings(monkeypatch, block):
    monkeypatch.setattr(blockmax, "BLOCK", block)
    docs, _ = corpus(n=900)
    shard, words = coded(docs, block)
    shard.unpack(np.arange(len(shard.last)))
    counts = {i: collections.Counter(TERM.findall(t)) for i, t in docs}
    names = {int(words([w])[0][0]): w for w in {w for c in counts.values() for w in c}}
    at = 0
    for h, df in zip(shard.terms.tolist(), shard.lay.df.tolist(), strict=True):
        place = shard.doc[at : at + df]
        assert (np.diff(place) > 0).all()
        found = {int(shard.ids[p]): int(w) for p, w in zip(place, shard.worth[at : at + df], strict=True)}
        m = dict(zip(shard.ids.tolist(), shard.m.tolist(), strict=True))
        assert found == {i: 1_000_000_000 * c[names[h]] // (1000 * c[names[h]] + 8 * m[i]) for i, c in counts.items() if names[h] in c}
        at += df
    for b in range(len(shard.last)):
        s = slice(shard.lay.at[b], shard.lay.at[b] + shard.lay.counts[b])
        assert (shard.doc[s][0], shard.doc[s][-1], shard.worth[s].max()) == (shard.first[b], shard.last[b], shard.most[b])


def test_blocks_below_the_threshold_stay_packed():
    rng = random.Random(4)
    docs = [(i, " ".join(["often"] * rng.randint(1, 3) + ["filler"] * rng.randint(20, 200) + (["rare"] * 3 if i % 1000 == 7 else []))) for i in range(20_000)]
    shard, words = coded(docs, 128)
    terms = np.sort(words(["often", "rare"])[0])
    weights = np.where(terms == words(["rare"])[0][0], 7000, 3)
    item = blockmax.Item(1, terms, weights, 1)
    shard.search(item, 10)
    assert sorted(item.doc.tolist())[:3] and all(i % 1000 == 7 for i in item.doc)
    mine = np.isin(shard.lay.list_of, np.searchsorted(shard.terms, terms))
    assert 0 < shard.open[mine].sum() < 0.3 * mine.sum()


def test_search_takes_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! --"), (4, "word " * 100_000), (5, "Apple PIE"), (5, "apple pie"), (None, "apple"), (6, "äpfel apple 😀x"), (7, "apple\u0000pie")]
    items = [(1, "apple pie!"), (1, "Äpfel äpfel"), (2, None), (3, ""), (4, "unknown"), (None, "apple"), (5, "word 😀x")]
    d = spark.createDataFrame([(*x, "c", "c") for x in docs], "doc_id long, text string, score string, terms string")
    q = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, rank string")
    assert sorted(tuple(r) for r in blockmax.rank(d, q).collect()) == ranked(docs, items)
    assert blockmax.rank(d, q, k=2).count() == len(ranked(docs, items, 2))
    assert sorted(tuple(r) for r in blockmax.rank(d, q, k=30).collect()) == ranked(docs, items, 30)
    assert blockmax.rank(d.limit(0), q).count() == 0
    assert blockmax.rank(d, q.limit(0)).count() == 0
    assert blockmax.rank(d, q).columns == ["item_id", "rank", "doc_id", "score"]


def test_clashing_columns_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 9)], "doc_id long, text string, id long").withColumn("gid", F.lit(1))
    assert tokengroups.similar_documents(docs).count() == 1
