"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm import (
    bpe,
    conversation_repair,
    exact_dedup,
    filter_audit,
    packing,
    pii,
    positional_index,
    quality,
    sharding,
    shingle_join,
    topk,
    toxicity,
    warc,
)
from visitlens.llm.common import table, work_folder


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, members = work_folder(spark, "warc-whole"), work_folder(spark, "warc-members")
    warc.write_archives(table(spark, sf_dir, "pages"), whole)
    warc.normalise(spark, whole, members)
    rows = warc.read_records(spark, members)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detected(table(spark, sf_dir, "documents"))
    counts = [f"n_{kind}" for kind in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    tokens = bpe.encoded(docs, path, public_tokenizers.PATTERN, with_decoded=True)
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored(docs, toxicity.fit(docs, labels))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = positional_index.contaminated(docs, benchmark)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands beside the package and imports from it

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_quality,
    op2_warc,
    op3_pii,
    op4_bpe,
    op5_jaccard,
    op6_exact_dedup,
    op7_packing,
    op8_toxicity,
    op9_topk,
    op10_sharding,
    op11_conversation_repair,
    op12_decontamination,
    op13_filter_audit,
    pipeline,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _ALL}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
        )
        SELECT page_id,
               CAST(strlen(payload) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER)
                                >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k
            FROM conversations
        ), hashed AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(
                list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1),
                    lambda i: [ord(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                                    ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 20 AS fate
            FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                        ELSE text END AS text,
                   unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed WHERE fate <> 0
        ), placed AS (
            SELECT *, left(role, 1) AS initial,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char
            FROM damaged
        ), seen AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed
        ), faults AS (
            SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN again THEN 'duplicate'
                           WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
            FROM seen
        ), counted AS (
            SELECT conv_id, max(i) AS n,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id
        ), grammar(state, initial, next) AS (
            VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
        ), inserts(state, times, next, lines) AS (
            VALUES (0, 0, 0, []), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []),
                   (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
                   (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:'])
        ), search AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit,
                   CAST([] AS VARCHAR[]) AS lines
            FROM counted
          UNION ALL
            SELECT conv_id, i, n, state, cost, audit, lines FROM (
                SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best
                FROM (
                    SELECT s.conv_id, s.i + 1 AS i, s.n,
                           CASE WHEN e.edit = 'D' THEN p.next ELSE g.next END AS state,
                           s.cost + 3 * p.times + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                               + CASE WHEN e.edit IN ('K', 'R') AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
                           s.audit || repeat('I', p.times) || coalesce(e.edit, '') AS audit,
                           s.lines || p.lines || CASE e.edit
                               WHEN 'K' THEN [f.role || ':' || f.text]
                               WHEN 'R' THEN [CASE g.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text]
                               ELSE [] END AS lines
                    FROM search s
                    JOIN inserts p ON p.state = s.state
                    LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
                    JOIN (VALUES ('K'), ('R'), ('D'), (NULL)) e(edit) ON (e.edit IS NULL) = (s.i = s.n)
                    LEFT JOIN grammar g ON g.state = p.next
                        AND ((e.edit = 'K' AND g.initial = f.initial) OR (e.edit = 'R' AND g.initial IN ('u', 'a')))
                    WHERE s.i <= s.n
                      AND CASE WHEN e.edit IS NULL THEN p.next IN (0, 3)
                               WHEN e.edit = 'D' THEN true
                               ELSE f.fault NOT IN ('blank', 'duplicate') AND g.state IS NOT NULL END
                )
            ) WHERE best = 1
        ), solved AS (
            SELECT conv_id, arg_min(audit, (cost, audit)) AS audit, min(cost) AS cost,
                   arg_min(lines, (cost, audit)) AS lines
            FROM search WHERE i = n + 1 GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_decontamination": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
        ), b AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS width,
                   array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS words
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), places AS (
            SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i
            FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width
        ), found AS (
            SELECT p.r, p.i, p.width, x.item
            FROM places p JOIN windows x
              ON x.width = p.width AND x.words = array_to_string(list_slice(p.w, p.i, p.i + p.width - 1), ' ')
        ), hit AS (
            SELECT r, count(DISTINCT i) AS n_hit
            FROM (SELECT r, unnest(range(i, i + width)) AS i FROM found) GROUP BY r
        ), items AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op13_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), told AS (
            SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), failed AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
                          CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                          CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)
                               THEN 'C' ELSE '' END,
                          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                          CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
            FROM t LEFT JOIN told USING (doc_id)
        ), counts AS (
            SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
        ), orders AS (
            SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order
            FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
            JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)
        ), steps AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS own, left(filter_order, step - 1) AS before
            FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), met AS (
            SELECT *, contains(fails, own) AS hit, translate(before, fails, '') <> before AS earlier
            FROM counts, steps
        ), totals AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0) AS kept,
                   coalesce(sum(n) FILTER (hit AND NOT earlier), 0) AS removed,
                   coalesce(sum(n) FILTER (hit AND earlier), 0) AS redundant,
                   coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (hit AND NOT earlier), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (hit AND NOT earlier), 0) AS toxic_lost
            FROM met GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM totals""",
}
