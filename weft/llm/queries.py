"""The registered queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import blockmax, chat, decontaminate, html_text, language_id, lines, neardup, pii, spm, tokengroups, topk, trie, wavelet
from weft.llm.common import scratch_path, table, tokenizer_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.filter(~language_id.held_out()).select("text", "lang"))
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet shards and read back from them."""
    path = scratch_path(spark, "shards")
    wavelet.write_shards(wavelet.build_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")), path)
    return wavelet.read_documents(wavelet.read_shards(spark, path))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: counts, crc32 of the ids, parity and round trip."""
    found = spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    crc = F.crc32(F.to_json("tokens").cast("binary"))
    return found.select("doc_id", "n_tokens", crc.alias("tokens_crc32"), "parity", "round_trip")


def op4_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document: counts, length and crc32 of its text."""
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with the fewest edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), in_words=True)


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds control strings, as formatted in windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L conv_id, t turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.digests(chat.windows(turns.unionByName(odd)))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard of 0.8 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base patterns and what the skip-chain field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for each vector whose id is divisible by 100."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard of 0.85 or more."""
    return tokengroups.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each with its first turns from the one its number rounds down to."""
    return trie.trie(*trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations"))))


def op13_blockmax_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return blockmax.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_wrapper_html": op4_wrapper_html,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_windows": op7_chat_windows,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_pii_crf": op9_pii_crf,
    "op10_maxscore_topk": op10_maxscore_topk,
    "op11_token_groups": op11_token_groups,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_blockmax_wand": op13_blockmax_wand,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op7_chat_windows": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
          UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        e AS (
          SELECT *, '<s>[INST]' || regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')
            || '[/INST]' || regexp_replace(regexp_replace(replace(body, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') || '</s>' AS shown FROM t),
        k AS (SELECT *, CAST(ceil(strlen(shown) / 4) AS BIGINT) AS tokens FROM e),
        p AS (
          SELECT *, row_number() OVER w AS pos, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
            first_value(CASE WHEN role = 'system' THEN shown END) OVER w AS sys, first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER w AS sys_tokens
          FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)),
        c AS (SELECT *, upto - tokens AS since, greatest(2048 - 256 - sys_tokens, 512) AS step FROM p),
        g AS (SELECT *, floor((upto - 1) / step) * 2 + CAST(since >= floor((upto - 1) / step) * step AS INTEGER) AS part FROM c),
        o AS (
          SELECT *, coalesce(lag(part) OVER (PARTITION BY conv_id ORDER BY pos) <> part, FALSE) AS opens,
            sum(CASE WHEN pos > 1 OR sys IS NULL THEN length(shown) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY since RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING) AS history FROM g)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
          length(coalesce(string_agg(body, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_chars,
          sha256(coalesce(string_agg(body, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(length(shown) + CASE WHEN opens THEN coalesce(length(sys), 0) + coalesce(history, 0) ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id
    """,
    "op8_hyperminhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS d, doc_id AS o FROM n UNION SELECT r.d, e.b FROM r JOIN e ON r.o = e.a),
        m AS (SELECT d, min(o) AS o FROM r GROUP BY d)
        SELECT n.doc_id, n.n AS n_shingles, m.o AS component_id, m.o = n.doc_id AS kept FROM n JOIN m ON m.d = n.doc_id
    """,
    "op10_maxscore_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
    "op11_token_groups": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS d, doc_id AS o FROM n UNION SELECT r.d, e.b FROM r JOIN e ON r.o = e.a)
        SELECT n.doc_id, n.n AS n_shingles, m.o AS component_id FROM n JOIN (SELECT d, min(o) AS o FROM r GROUP BY d) m ON m.d = n.doc_id
    """,
    "op12_prefix_trie": r"""
        WITH RECURSIVE t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
        crc AS (
          SELECT conv_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM k
          UNION ALL
          SELECT conv_id, s, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
          FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS v FROM crc WHERE i < 8 * length(s))),
        h AS (
          SELECT k.conv_id, k.conv_id - k.conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h FROM k JOIN crc ON crc.conv_id = k.conv_id AND crc.i = 8 * length(k.s)),
        g AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN k b ON b.conv_id = h.base),
        r AS (
          SELECT g.conv_id, t.pos, role, body FROM g JOIN t ON t.conv_id = g.base AND t.pos <= g.taken
          UNION ALL SELECT g.conv_id, t.pos - g.h + g.taken, role, body FROM g JOIN t ON t.conv_id = g.conv_id AND t.pos > g.h),
        p AS (
          SELECT conv_id, 0 AS d, '' AS prefix, 0 AS words FROM g
          UNION ALL
          SELECT conv_id, pos, string_agg(sha256(length(role) || ':' || role || body), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
            len(list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '')) FROM r),
        n AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM p GROUP BY d, prefix),
        z AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
        e AS (
          SELECT p.d, p.prefix, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ends FROM p JOIN z ON z.conv_id = p.conv_id AND z.d = p.d GROUP BY p.d, p.prefix),
        up AS (
          SELECT n.conv_id, n.d, q.conv_id AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1 JOIN n q ON q.d = p.d AND q.prefix = p.prefix),
        c AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM up GROUP BY parent, d - 1),
        a AS (
          SELECT p.d, p.prefix, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
          FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN c ON c.conv_id = n.conv_id AND c.d = n.d GROUP BY p.d, p.prefix)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.parent AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, a.leaves AS n_leaves, a.saved AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
        FROM n JOIN a ON a.d = n.d AND a.prefix = n.prefix LEFT JOIN up ON up.conv_id = n.conv_id AND up.d = n.d
        LEFT JOIN c ON c.conv_id = n.conv_id AND c.d = n.d LEFT JOIN e ON e.d = n.d AND e.prefix = n.prefix
    """,
    "op13_blockmax_wand": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents WHERE doc_id IS NOT NULL),
        i AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        s AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
        o AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
        p AS (SELECT doc_id, term, n, count(*) AS tf FROM o WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term, n),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
        x AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * p.n * s.n) // s.l)) AS impact FROM p, s),
        c AS (SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN x USING (term) GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM c WHERE score > 0)
        SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
    """,
}
