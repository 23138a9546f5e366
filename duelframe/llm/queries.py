"""The registered queries of the operators, each over its whole table, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import attention, chat, jaccard, middle, mixing, passages, pieces, quality, secrets, tokens, trie, urls, vectors
from duelframe.llm.common import table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of pages whose number is labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return urls.judge(pages, pages.join(toxic, "page_id", "left_semi").select("url"), RULES)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with up to three turns of the one whose number is the next lower multiple of 20."""
    turns = trie.turns_in_order(table(spark, sf_dir, "conversations"))
    return trie.nodes(*trie.branched(turns, every=20, heads=3, taken=F.crc32(F.col("conv_id").cast("string")) % 4))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    text = middle.restored(F.col("output"), F.col("form"))
    parts = [F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars")]
    return made.select("doc_id", "n", "form", *parts, F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vector_near_duplicates, op2_token_counts, op3_quality_rules, op4_secret_scan, op5_chat_perspectives,
        op6_url_filter, op7_sentence_pieces, op8_jaccard_join, op9_repeated_passages, op10_source_mix, op11_prefix_trie, op12_fill_in_middle, op13_quality_classifier,
    )
}

SQL: dict[str, str] = {
    "op1_vector_near_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        fit AS (
            SELECT vec_id, label, e FROM v
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
              AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0
        ),
        link AS (
            SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
            ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
        ),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM fit UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(low.c, v.vec_id) AS component_id,
               coalesce(v.vec_id = coalesce(low.c, v.vec_id), TRUE) AS kept
        FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op5_chat_perspectives": r"""
        WITH said AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
                   CASE WHEN conv_id IS NULL THEN [turn::VARCHAR, coalesce(role, 'unknown'), coalesce(text, '')] END AS alone
            FROM conversations
        ),
        named AS (SELECT DISTINCT conv_id, alone, speaker AS perspective FROM said WHERE speaker <> 'system'),
        shown AS (
            SELECT s.*, n.perspective,
                   CASE WHEN s.speaker = n.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS shown_as,
                   CASE WHEN s.speaker = n.perspective THEN '<|assistant|>' || chr(10) WHEN s.speaker = 'system' THEN '<|system|>' || chr(10)
                        ELSE '<|user:' || s.speaker || '|>' || chr(10) END AS header
            FROM said s JOIN named n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.alone IS NOT DISTINCT FROM n.alone
        ),
        cut AS (SELECT *, header || text || '<|end|>' || chr(10) AS segment FROM shown),
        placed AS (
            SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS ends FROM cut
            WINDOW w AS (PARTITION BY conv_id, alone, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, perspective, position, turn, speaker, shown_as, segment, ends - length(segment) AS starts, ends,
               CASE WHEN shown_as = 'assistant' THEN ends - length(segment) + length(header) END AS mask_starts,
               CASE WHEN shown_as = 'assistant' THEN ends END AS mask_ends
        FROM placed""",
    "op6_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
        ),
        p AS (
            SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                   list_sort([x FOR x IN string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&')
                       IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)')]) AS query
            FROM cut
        ),
        c AS (
            SELECT page_id, host, path, CASE WHEN host <> '' THEN
                regexp_replace(regexp_replace(host, '^.*@|:(80|443)$', '', 'g'), '^www\.', '') || regexp_replace(path, '/+$', '')
                || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
            FROM p
        ),
        listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM c
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
               WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g
            FROM d WHERE w IS NOT NULL
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, low.c AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id""",
    "op10_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
        t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM s),
        k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM s),
        w AS (SELECT *, CAST(1 + turn % 3 AS BIGINT) AS weight FROM k),
        l AS (
            SELECT *, row_number() OVER o AS place,
                   total - CAST(coalesce(sum(3 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
                   CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS opened
            FROM w, t WINDOW o AS (ORDER BY CAST(3 * n AS DOUBLE) / weight, turn)
        ),
        f AS (SELECT place AS p, rest AS r, opened AS o FROM l WHERE rest * weight <= 3 * n * opened ORDER BY place LIMIT 1),
        a AS (SELECT source, n, CASE WHEN place < p THEN CAST(3 * n AS DOUBLE) ELSE CAST(r AS DOUBLE) * weight / o END AS target FROM l, f),
        c AS (
            SELECT d.*, a.n, a.target, e.e * 1152921504606846976 + CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || e.e), 1, 15) AS BIGINT) AS pos
            FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source, (SELECT unnest([0, 1, 2])::BIGINT AS e) e
        ),
        v AS (SELECT source, pos, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY pos) AS BIGINT) / target AS finish FROM c WHERE target > 0),
        q AS (SELECT source, pos, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, pos) AS run FROM v),
        z AS (SELECT source, max(pos) AS final FROM q, t WHERE run <= total GROUP BY source)
        SELECT c.doc_id, c.size, c.n AS source_size, c.target, CAST(c.size * count(*) FILTER (WHERE c.pos <= z.final) AS BIGINT) AS taken
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, pos) AS copy FROM c) c LEFT JOIN z ON c.source IS NOT DISTINCT FROM z.source
        GROUP BY c.doc_id, c.source, c.size, c.n, c.target, c.copy""",
    "op11_prefix_trie": r"""
        WITH RECURSIVE steps AS (
            SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
        ),
        code AS (SELECT i, c FROM steps WHERE k = 8),
        own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        ids AS (SELECT DISTINCT conv_id FROM own),
        crc AS (
            SELECT conv_id, 1 AS i, 4294967295::BIGINT AS c FROM ids
            UNION ALL
            SELECT crc.conv_id, crc.i + 1, xor(crc.c // 256, code.c) FROM crc
            JOIN code ON code.i = xor(crc.c % 256, ascii(substr(crc.conv_id::VARCHAR, crc.i, 1)))
            WHERE crc.i <= length(crc.conv_id::VARCHAR)
        ),
        h AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crc WHERE i = length(conv_id::VARCHAR) + 1),
        rebuilt AS (
            SELECT h.conv_id, 0 AS part, place, role, text FROM h JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20 AND b.place <= h.h
            UNION ALL
            SELECT h.conv_id, 1, place, role, text FROM h JOIN own o ON o.conv_id = h.conv_id AND o.place > h.h
        ),
        turns AS (
            SELECT conv_id, row_number() OVER w AS depth, md5(role || chr(1) || text) AS t,
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
        ),
        prefixes AS (
            SELECT conv_id, depth, words, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM turns
            UNION ALL SELECT conv_id, 0, 0, '' FROM ids
        ),
        last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
        nodes AS (
            SELECT node, min(p.conv_id) AS conv_id, min(p.depth) AS depth, count(*) AS n_convs, min(words) AS words,
                   sha256(coalesce(string_agg(CASE WHEN l.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
            FROM prefixes p JOIN last l ON l.conv_id = p.conv_id GROUP BY node
        ),
        up AS (SELECT node, CASE WHEN depth > 0 THEN substr(node, 1, 32 * (depth - 1)::INT) END AS parent FROM nodes),
        children AS (SELECT parent, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY parent),
        above AS (
            SELECT substr(a.node, 1, 32 * d.d::INT) AS node, sum((a.n_convs - 1) * a.words) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
            FROM nodes a LEFT JOIN children c ON c.parent = a.node, LATERAL (SELECT unnest(range(a.depth + 1)) AS d) d GROUP BY 1
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN up u ON u.node = n.node LEFT JOIN nodes p ON p.node = u.parent
        LEFT JOIN children c ON c.parent = n.node JOIN above a ON a.node = n.node""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        h AS (
            SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
            FROM d
        ),
        f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
