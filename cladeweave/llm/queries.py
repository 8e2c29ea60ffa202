"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.llm import chat, decontaminate, exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, merkle, quality, sentencepiece_codec, token_store, toxicity, warc
from cladeweave.llm.shared import read_table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100).drop("kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, read_table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_html_extract": op6_html_extract,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_store": op8_token_store,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_warc": op11_warc,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

OP3_SQL = r"""
WITH normalised AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), grouped AS (
    SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM normalised GROUP BY body
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM normalised n JOIN grouped g ON n.body = g.body
"""

OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS l FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(l) >= 4 THEN list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM pairs JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * i >= 85 * (a.n + b.n - i)
), reach AS (
    SELECT doc_id, doc_id AS r FROM documents
    UNION
    SELECT reach.doc_id, e.y FROM reach JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) e ON reach.r = e.x
)
SELECT m.doc_id, coalesce(sizes.n, 0) AS n_shingles, m.component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m LEFT JOIN sizes ON m.doc_id = sizes.doc_id
"""

_CONTROL_SQL = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[ROLE=", "[/ROLE]"))
OP5_SQL = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(x) + (length(x) - length(replace(x, chr(92), ''))) + {_CONTROL_SQL}
        + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 19 ELSE 16 + length(r) END AS n FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
    CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# DuckDB's sha1 is hex; five bits at a time are the digits of base 32.
OP11_SQL = r"""
WITH body AS (
    SELECT page_id, coalesce(html, '') AS b FROM pages
), first AS (
    SELECT b, min(page_id) AS f FROM body GROUP BY b
), hashed AS (
    SELECT x.page_id, strlen(x.b) AS payload_bytes, first.f, sha1(x.b) AS h FROM body x JOIN first ON x.b = first.b
), bits AS (
    SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS z FROM hashed
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * z[5 * i + 1]::INT + 8 * z[5 * i + 2]::INT + 4 * z[5 * i + 3]::INT + 2 * z[5 * i + 4]::INT + z[5 * i + 5]::INT]), '') AS payload_digest,
    CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM bits
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


# One tree of all: group trees above the leaves, then the tree of groups ('' stands for it); CRC-32 bit by bit.
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, {_field_sql('source')} AS g, source, {_leaf_sql('text')} AS leaf, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 AS fold
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS row_no FROM leaves
), lower_tree AS (
    SELECT g, 0 AS lv, idx, leaf AS d FROM placed
    UNION ALL
    SELECT g, lv + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM lower_tree) WHERE n > 1 GROUP BY g, lv, idx // 16
), ends AS (
    SELECT g, max(lv) AS lv, arg_max(d, lv) AS subroot FROM lower_tree GROUP BY g
), ranked AS (
    SELECT e.*, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS idx FROM ends e JOIN (SELECT DISTINCT g, source FROM leaves) s ON e.g = s.g
), upper_tree AS (
    SELECT 0 AS lv, idx, subroot AS d FROM ranked
    UNION ALL
    SELECT lv + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM upper_tree) WHERE n > 1 GROUP BY lv, idx // 16
), top AS (
    SELECT max(lv) AS lv, arg_max(d, lv) AS root FROM upper_tree
), runs AS (
    SELECT g, lv, idx // 16 AS up, list(d ORDER BY idx) AS run FROM lower_tree GROUP BY g, lv, idx // 16
    UNION ALL
    SELECT NULL, lv, idx // 16, list(d ORDER BY idx) FROM upper_tree GROUP BY lv, idx // 16
), climb AS (
    SELECT row_no, p.g, false AS above, 0 AS lv, p.idx, CASE WHEN fold = 0 AND lowered IS NOT NULL THEN lowered ELSE leaf END AS acc, '' AS proof FROM placed p
    UNION ALL
    SELECT c.row_no, CASE WHEN c.lv < e.lv AND NOT c.above THEN c.g END, c.above OR c.lv >= e.lv, CASE WHEN c.above OR c.lv < e.lv THEN c.lv + 1 ELSE 0 END, CASE WHEN c.above OR c.lv < e.lv THEN c.idx // 16 ELSE e.idx END,
        CASE WHEN c.above OR c.lv < e.lv THEN sha256(array_to_string(list_transform(r.run, lambda x, i: CASE WHEN i = 1 + c.idx % 16 THEN c.acc ELSE x END), '')) ELSE c.acc END,
        CASE WHEN c.above OR c.lv < e.lv THEN c.proof || array_to_string(list_filter(r.run, lambda x, i: i <> 1 + c.idx % 16), '') ELSE c.proof END
    FROM climb c LEFT JOIN ranked e ON c.g = e.g JOIN runs r ON r.g IS NOT DISTINCT FROM c.g AND r.lv = c.lv AND r.up = c.idx // 16 CROSS JOIN top
    WHERE NOT (c.above AND c.lv >= top.lv)
)
SELECT p.doc_id, p.leaf, e.subroot, top.root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = top.root AS verified
FROM climb c JOIN placed p ON c.row_no = p.row_no JOIN ranked e ON e.g = p.g CROSS JOIN top WHERE c.above AND c.lv = top.lv
"""

OP13_SQL = """
WITH quantised AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
    FROM quantised a JOIN quantised b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), best AS (
    SELECT anchor_id, other_id AS positive_id, own, score AS positive_score FROM scores WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT b.anchor_id, b.positive_id, CAST(row_number() OVER (PARTITION BY b.anchor_id, b.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, b.positive_score, s.score AS negative_score
FROM best b JOIN scores s ON s.anchor_id = b.anchor_id AND s.label <> b.own AND 30 * b.positive_score <= 100 * s.score AND 100 * s.score <= 90 * b.positive_score
QUALIFY row_number() OVER (PARTITION BY b.anchor_id, b.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""

ORACLES: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op5_chat_format": OP5_SQL,
    "op11_warc": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}
