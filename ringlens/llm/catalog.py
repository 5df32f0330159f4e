"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringlens.llm import bpe, chat, decontaminate, embed, mixing, omh, shards, simhash, substring, toxicity, trie, whiten, wrappers
from ringlens.llm.common import read


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprints(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(read(spark, sf_dir, "pages"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(read(spark, sf_dir, "documents"))


#: The contract's own conversation: both texts hold the template's marks.
MARKED = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(own)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read(spark, sf_dir, "embeddings"))


_OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said AS (
  SELECT *, length(role) + length(text) + 4 + 2 + 9
    + CASE WHEN regexp_matches(text, '\\(###|</turn>)')
             OR strpos(text || chr(10) || '</turn>' || chr(10), chr(10) || '</turn>' || chr(10)) <= length(text)
        THEN length(regexp_replace(text, '(###|</turn>)', '\1x', 'g')) - length(text) ELSE 0 END AS chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, true AS identical
FROM said GROUP BY conv_id
"""

#: CRC-32 of the decimal id is written out bit by bit: DuckDB has no function for it.
_OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT c, count(*) AS n FROM t GROUP BY c),
ids AS (
  SELECT counts.c, least(h, coalesce(base.n, 0)) AS kept, h, counts.c - counts.c % 5 AS opens FROM (
    SELECT c, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], range(8)),
        lambda v, step: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h
    FROM counts) counts LEFT JOIN counts base ON base.c = counts.c - counts.c % 5),
r AS (
  SELECT ids.c, pos, role, txt FROM ids JOIN t ON t.c = ids.opens AND t.pos <= h
  UNION ALL SELECT ids.c, pos - h + kept, role, txt FROM ids JOIN t ON t.c = ids.c AND t.pos > h),
p AS (
  SELECT c, 0 AS depth, '' AS key, 0 AS size FROM ids
  UNION ALL SELECT c, pos, string_agg(md5(length(role) || ':' || role || txt), '') OVER (PARTITION BY c ORDER BY pos), strlen(txt) FROM r),
chained AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS up, max(depth) OVER (PARTITION BY c) AS last FROM p),
node AS (SELECT key, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = last), '')) AS ends_sha256 FROM chained GROUP BY key, depth),
kids AS (SELECT up AS key, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
sums AS (
  SELECT p.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.size) AS saved_tokens
  FROM node LEFT JOIN kids USING (key) JOIN p ON p.c = node.conv_id AND p.depth <= node.depth GROUP BY p.key)
SELECT node.conv_id, node.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN node above ON above.key = node.up
"""

_OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[s + 1 : s + least(len(ws), 10)], ' ') AS win
  FROM i, unnest(range(CASE WHEN len(ws) > 0 THEN greatest(len(ws) - 9, 1) ELSE 0 END)) t(s)),
dw AS (
  SELECT rid, s, w, array_to_string(ws[s + 1 : s + w], ' ') AS win
  FROM d, (SELECT DISTINCT w FROM iw), unnest(range(len(ws) - w + 1)) t(s)),
m AS (SELECT rid, s, w, item_id FROM dw JOIN iw USING (w, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + w)) t(p) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_simhash": op2_simhash,
    "op3_wrappers": op3_wrappers,
    "op4_multi_index": op4_multi_index,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_substring": op7_substring,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_shards": op10_shards,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_decontamination": op12_decontamination,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op8_chat": _OP8_SQL, "op11_prefix_trie": _OP11_SQL, "op12_decontamination": _OP12_SQL}
