"""The registered query of each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, lines, mixing, packing, phrases, quality, secrets, simhash, substrings, trie, vectors
from .common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # four in ten documents share a short line with another; 20 words first seen in one document, or 40 in several, aren't chance
    return substrings.repeated_spans(table(spark, sf_dir, "documents"), 20)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(turns))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 4)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), 30, 2000, 80)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.without_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 10, 1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.grafted(trie.sequences(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_embedding_dedup, op2_secret_scan, op3_best_fit_packing, op4_quality, op5_html_extraction, op6_nearest_neighbours, op7_substring_dedup, op8_chat_format, op9_source_mix, op10_simhash_dedup, op11_collocations, op12_line_dedup, op13_conversation_trie]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    vectors_sql = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
            n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS r FROM v
                WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0)"""
    return {
        "op1_embedding_dedup": f"""
            WITH RECURSIVE {vectors_sql},
            p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.95),
            c AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node WHERE c.root < p.b),
            m AS (SELECT node AS vec_id, min(root) AS component_id FROM c GROUP BY node)
            SELECT vec_id, count(p.a) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN p ON p.a = vec_id GROUP BY vec_id, component_id""",
        "op5_html_extraction": """
            WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
            b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '</?(?:p|h1|br|div|ul|li)(?:\\s[^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
            c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM b)
            SELECT page_id, url, text, length(text) AS n_chars FROM c""",
        "op6_nearest_neighbours": f"""
            WITH {vectors_sql},
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20""",
        "op8_chat_format": """
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e AS (SELECT *, regexp_replace(role, '\\\\|<(\\||/?s>|<?/?SYS|</SYS)|\\[(/?INST\\])', '\\0', 'g') AS r FROM t)
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                CAST(sum(8 + length(role) + 8 + length(text) + 7
                    + len(regexp_extract_all(role || ' ' || text, '\\\\|<[|]|</?s>|<<SYS|<SYS|</SYS|</<?SYS|\\[/?INST\\]'))) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op11_collocations": """
            WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
            p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
            i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w),
            g AS (SELECT lang, unnest([w[i:i], w[i:i + 1], w[i:i + 2], w[i:i + 3]]) AS g, unnest([1, 2, 3, 4]) AS m, len(w) - i + 1 AS room FROM i),
            f AS (SELECT lang, g, m, count(*) AS f FROM g WHERE m <= room GROUP BY ALL),
            n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
            c AS (SELECT * FROM f WHERE m >= 2 AND f >= 30),
            s AS (SELECT lang, f, g, m, unnest([2, 3]) AS k FROM c WHERE m > 2),
            inside AS (SELECT lang, list_slice(g, b, b + k - 1) AS g, max(f) AS most FROM (SELECT *, unnest(generate_series(1, m - k + 1)) AS b FROM s WHERE k < m) GROUP BY ALL),
            kept AS (SELECT c.* FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.g = c.g WHERE NOT coalesce(100 * CAST(i.most AS HUGEINT) >= 80 * CAST(c.f AS HUGEINT), false)),
            cuts AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM kept),
            sc AS (SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
                FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, c.m)),
            best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM sc) WHERE o = 1),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
            SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
        "op12_line_dedup": """
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
            l AS (SELECT r, doc_id, unnest(x) AS line, unnest(generate_series(1, len(x))) AS i FROM d),
            k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
            m AS (SELECT r, doc_id, i, line, key IN (SELECT key FROM hot) AS gone FROM k)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
            FROM m GROUP BY r, doc_id""",
        "op13_conversation_trie": """
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
            s AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS x FROM t GROUP BY conv_id),
            h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM s),
            c AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.x, []), 1, h), list_slice(h.x, h + 1, len(h.x))) AS x FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 100),
            d AS (SELECT conv_id, x, unnest(generate_series(0, len(x))) AS depth FROM c),
            p AS (SELECT conv_id, depth, len(x) = depth AS ends, CASE WHEN depth > 0 THEN length(x[depth].text) ELSE 0 END AS chars,
                md5(CAST(to_json(list_slice(x, 1, depth)) AS VARCHAR)) AS k, CASE WHEN depth > 0 THEN md5(CAST(to_json(list_slice(x, 1, depth - 1)) AS VARCHAR)) END AS up FROM d),
            n AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k, depth),
            m AS (SELECT n.*, coalesce(o.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT up, count(*) AS n_children FROM n GROUP BY up) o ON o.up = n.k),
            a AS (SELECT p.k, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.chars) AS BIGINT) AS saved_tokens
                FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.k)
            SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
            FROM m JOIN a ON a.k = m.k LEFT JOIN n o ON o.k = m.up""",
    }
