"""Queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import (
    decontaminate, exact_dedup, html_text, line_dedup, manifest, minhash, piece_bpe, quality, repair, shards, token_blocks, token_counts, url_filter,
)
from strandweave.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", rf"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g') AS n FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
        doc_id = min(doc_id) OVER g AS kept, sha256(n) AS text_sha256
    FROM t WINDOW g AS (PARTITION BY n)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op2_url_filter", """
    WITH p AS (SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(h, q, verdict) AS (VALUES """ + ", ".join(str(r) for r in URL_RULES) + """),
        m AS (SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
            FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL)
    SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
    FROM p LEFT JOIN m USING (page_id, host, path)""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op4_line_dedup", rf"""
    WITH d AS (SELECT *, row_number() OVER () AS rn FROM documents),
        l AS (SELECT rn, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rn) >= 10),
        m AS (SELECT k.*, common.key IS NOT NULL AS dropped FROM k LEFT JOIN common ON k.key = common.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM m GROUP BY rn, doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op8_minhash", rf"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT rn, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE
            list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM w),
        g AS (SELECT rn, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS h FROM s),
        c AS (SELECT a.rn AS x, b.rn AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM g a JOIN g b ON a.h = b.h AND a.rn <> b.rn GROUP BY ALL),
        l AS (SELECT x, y FROM c WHERE 100 * i >= 80 * (nx + ny - i)),
        r AS (SELECT rn AS x, rn AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(t.doc_id) AS component_id, s.doc_id = min(t.doc_id) AS kept
    FROM s JOIN r ON s.rn = x JOIN s t ON t.rn = y GROUP BY s.rn, s.doc_id""")
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op3_token_blocks")
def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_blocks.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_blocks.read_documents(spark, path)


@query("op9_sentence_pieces")
def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tolerance=0.2)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer, _ = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), scorer).select("doc_id", "bad_score", "toxic_score", "keep")


def mail_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a fixed word in place of mail addresses."""
    edits, end = [], 0
    at = text.find("@")
    while at >= 0:
        start, stop = at, at + 1
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "._+-"):
            start -= 1
        while stop < len(text) and (text[stop].isalnum() or text[stop] in "._-"):
            stop += 1
        if start < at and stop > at + 1:
            edits.append((start, stop, "[mail]"))
        end = stop
        at = text.find("@", end)
    return edits


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.recounted(docs, public_tokenizers.path("byte_bpe_50k.json"), mail_edits)
    return counted.drop("text")


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


#: One row with the 256 steps of CRC-32 as the list ``steps``, by the rule of its polynomial.
CRC_STEPS = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), i)) AS steps"


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text in SQL; ``steps`` of :data:`CRC_STEPS` must be in scope."""
    codes = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce({codes}, lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT))"


def _leaf_sql(text: str) -> str:
    texts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


@query("op12_manifest", f"""
    WITH RECURSIVE given AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
            CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS copy
            FROM documents, ({CRC_STEPS})),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM given),
        low AS (SELECT source, 0 AS level, r AS i, n, leaf AS h FROM leaves
            UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, level, i // 3, n),
        subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS m FROM low WHERE n = 1),
        high AS (SELECT 0 AS level, s AS i, m AS n, subroot AS h FROM subs
            UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 3, n),
        docs AS (SELECT l.*, s, subroot FROM leaves l JOIN subs ON l.source IS NOT DISTINCT FROM subs.source),
        runs AS (SELECT s, r, 0 AS part, level, i, (r // (3::BIGINT ** level)::BIGINT) AS own, h FROM docs JOIN low
                ON low.source IS NOT DISTINCT FROM docs.source AND low.n > 1 AND low.i // 3 = docs.r // (3::BIGINT ** (level + 1))::BIGINT
            UNION ALL SELECT s, r, 1, level, i, (s // (3::BIGINT ** level)::BIGINT), h FROM docs JOIN high
                ON high.n > 1 AND high.i // 3 = docs.s // (3::BIGINT ** (level + 1))::BIGINT),
        steps AS (SELECT s, r, part, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), '') AS b,
            coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > own), '') AS a FROM runs GROUP BY s, r, part, level),
        paths AS (SELECT s, r, list({{'b': b, 'a': a}} ORDER BY part, level) AS path, string_agg(b || a, '' ORDER BY part, level) AS siblings FROM steps GROUP BY s, r),
        folded AS (SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
            list_reduce(coalesce(path, []), lambda x, p: {{'b': sha256(p.b || x.b || p.a), 'a': ''}}, {{'b': copy, 'a': ''}}).b AS folded_root
            FROM docs LEFT JOIN paths USING (s, r))
    SELECT *, folded_root = root AS verified FROM folded""")
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.without_newlines())


SHARDS = 40


@query("op13_shards", f"""
    WITH RECURSIVE rows AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size,
            {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, ({CRC_STEPS})),
        groups AS (SELECT t, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, sha256(t)) AS k FROM rows GROUP BY t),
        sums AS (SELECT *, sum(bytes) OVER (ORDER BY k DESC)::BIGINT AS left_over FROM groups),
        single AS (SELECT coalesce(min(k) FILTER (WHERE NOT (k < {SHARDS} AND bytes * ({SHARDS} + 1 - k) > left_over)), max(k) + 1) - 1 AS own FROM sums),
        start AS (SELECT own, (left_over + {SHARDS} - own - 1) // ({SHARDS} - own) AS least FROM single JOIN sums ON k = own + 1),
        pack AS (SELECT slack, own AS k, list_transform(range({SHARDS} - own), lambda i: (least + (1::BIGINT << slack) - 1)::BIGINT) AS gaps, NULL::BIGINT AS bin
                FROM start, (SELECT unnest(range(48)) AS slack)
            UNION ALL SELECT slack, k, list_transform(gaps, lambda x, i: CASE WHEN i = place THEN x - bytes ELSE x END), place
                FROM (SELECT slack, s.k, gaps, bytes, list_position(gaps, list_min(list_filter(gaps, lambda x: x >= bytes))) AS place
                    FROM pack JOIN sums s ON s.k = pack.k + 1) WHERE place IS NOT NULL),
        best AS (SELECT min(slack) AS slack FROM pack WHERE k = (SELECT max(k) FROM groups)),
        placed AS (SELECT t, (CASE WHEN k <= own THEN k - 1 ELSE own + bin - 1 END)::INT AS shard FROM groups CROSS JOIN single
            LEFT JOIN (SELECT k, bin FROM pack JOIN best USING (slack) WHERE bin IS NOT NULL) USING (k))
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, sha256(t)) - 1 AS slot,
        NULL::INT AS grown_shard FROM rows JOIN placed USING (t)""")
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"), SHARDS)


def _step_sql(cost: str, letter: str, *froms: str) -> str:
    """The least of stacks after an edit, or of given ones (letter empty)."""
    return ", ".join(f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}}" for x in froms)


_NEVER = "{'c': 1000000000, 'a': ''}"


@query("op11_repair", rf"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations, ({CRC_STEPS})),
        ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
        d AS (SELECT g, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
            CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) FROM k JOIN ids ON k.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE code <> 0),
        o AS (SELECT g, turn, role, text, role[1] AS c, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i,
            row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?]{SPACE}*$') THEN 't' ELSE '-' END AS fault, lag(c) OVER (PARTITION BY g ORDER BY i) AS p FROM o),
        dp AS (SELECT g, 0 AS i, {{'c': 0, 'a': ''}} AS e, {_NEVER} AS s, {{'c': 2, 'a': 'I'}} AS u, {{'c': 4, 'a': 'II'}} AS h FROM ids
            UNION ALL SELECT g, i, e, s, u2, list_min([h1, {_step_sql("2", "I", "u2")}]) FROM (
                SELECT *, list_min([u1, {_step_sql("2", "I", "e", "s", "h1")}]) AS u2 FROM (
                    SELECT dp.g, f.i, {_step_sql("3", "D", "e")} AS e,
                        list_min([{_step_sql("3", "D", "s")}, CASE WHEN fault IN ('t', '-') AND c = 's' THEN {_step_sql("(fault = 't')::INT", "K", "e")} ELSE {_NEVER} END]) AS s,
                        list_min([{_step_sql("3", "D", "u")}] || CASE WHEN fault NOT IN ('t', '-') THEN []
                            WHEN c = 'u' THEN [{_step_sql("(fault = 't')::INT", "K", "e", "s", "h")}] ELSE [{_step_sql("2 + (fault = 't')::INT", "R", "e", "s", "h")}] END) AS u1,
                        list_min([{_step_sql("3", "D", "h")}] || CASE WHEN fault NOT IN ('t', '-') THEN []
                            WHEN c = 'a' THEN [{_step_sql("(fault = 't')::INT", "K", "u")}] ELSE [{_step_sql("2 + (fault = 't')::INT", "R", "u")}] END) AS h1
                    FROM dp JOIN f ON dp.g = f.g AND f.i = dp.i + 1))),
        best AS (SELECT g, arg_max(list_min([e, h]), i) AS b FROM dp GROUP BY g),
        letters AS (SELECT g, unnest(string_split(b.a, '')) AS letter, generate_subscripts(string_split(b.a, ''), 1) AS pos FROM best WHERE b.a <> ''),
        placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY g ORDER BY pos) AS i FROM letters),
        kept AS (SELECT l.g, letter, pos, role, text, c, row_number() OVER (PARTITION BY l.g ORDER BY pos) AS j,
            first_value(letter = 'K' AND c = 's') OVER (PARTITION BY l.g ORDER BY pos) AS led FROM placed l LEFT JOIN f ON f.g = l.g AND f.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
        texts AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS t FROM kept GROUP BY g),
        counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
            count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM ids JOIN best USING (g) LEFT JOIN counts USING (g) LEFT JOIN texts USING (g)""")
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
