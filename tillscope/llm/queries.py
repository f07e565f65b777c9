"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bytepairs,
    forest,
    htmltext,
    languages,
    packing,
    prefixes,
    quality,
    repair,
    simhash,
    templates,
    toolcalls,
    trie,
    urls,
)

URL_RULES = (
    ("com", "/", urls.ALLOW),
    ("example.com", "/en/", urls.BLOCK),
    ("www.example.com", "/en/", urls.ALLOW),
    ("net", "/es/", urls.BLOCK),
    ("net", "/fr/", urls.BLOCK),
)
SEQUENCE, END = 4096, 1
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKEN_LIMIT = 512
#: Rebuilt conversations share up to so many turns with the first of their hundred.
MOST_SHARED = 5
TOOL = "answer"
TOOL_SCHEMAS = {
    TOOL: {"prompt": {"type": "string", "least": 1}, "turn": {"type": "integer", "least": 0}}
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(documents, shingle=3, distance=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).drop("url")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    linked = toolcalls.link(*toolcalls.calls_of(turns, TOOL), TOOL_SCHEMAS)
    return linked.select(
        "call_id",
        "state",
        "n_results",
        "depth",
        "valid",
        F.array_join("errors", "; ").alias("errors"),
        F.length("json").cast("bigint").alias("json_chars"),
        F.md5("json").alias("json_md5"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def pack_documents(documents: DataFrame) -> DataFrame:
    return packing.best_fit(packing.pieces(documents, WORDS, SEQUENCE, END), SEQUENCE)


def language_model(spark: SparkSession, sf_dir: str) -> dict:
    """Prototypes from the labelled documents that are not held out."""
    labelled = _table(spark, sf_dir, "documents").where(~languages.held_out(F.col("doc_id")))
    return languages.train(labelled)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = languages.held_out(F.col("doc_id")).alias("held_out")
    judged = languages.predict(documents, language_model(spark, sf_dir))
    return judged.select("doc_id", held_out, "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), carried=["doc_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefixes.token_counts(documents, BYTES, TOKEN_LIMIT).drop("text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = templates.drop_recurring(_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.length("text").cast("bigint").alias("n_chars_left"),
        F.md5("text").alias("text_md5"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytepairs.round_trip(documents, RANKS, public_tokenizers.PATTERN).drop("text")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.main_text(pages).drop("html")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = trie.placed(_table(spark, sf_dir, "conversations"))
    base = F.col("conv") - F.col("conv") % 100
    shared = F.crc32(F.col("conv").cast("string")) % (MOST_SHARED + 1)
    rebuilt = trie.rebuilt(turns, conversations, base, shared, MOST_SHARED)
    return trie.digested(trie.blocks(*rebuilt)).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(_table(spark, sf_dir, "conversations"))
    return repair.audits(repair.repair(damaged, present=F.col("present")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_simhash_near_dedup,
        op2_url_filter,
        op3_embedding_near_dedup,
        op4_tool_call_linking,
        op5_best_fit_packing,
        op6_language_id,
        op7_quality_rules,
        op8_token_counts,
        op9_line_dedup,
        op10_byte_bpe,
        op11_html_extraction,
        op12_conversation_prefix_trie,
        op13_conversation_repair,
    )
    return {query.__name__: query for query in own}


UPPER_TO_LOWER = f"'{urls.UPPER}', '{urls.LOWER}'"

OP2_SQL = f"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), {UPPER_TO_LOWER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (
           PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC
         ) AS place
  FROM split JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{urls.ALLOW}') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""

OP4_SQL = f"""
WITH calls AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text AS prompt
  FROM conversations WHERE role = 'user'),
texts AS (
  SELECT conv_id || '-' || (turn - 1) AS call_id, text AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
results AS (
  SELECT call_id, min(content) AS content, sum(n_results)::BIGINT AS n_results FROM texts GROUP BY 1),
gaps AS (
  SELECT *, CASE WHEN turn - lag(turn) OVER (
      PARTITION BY conv_id, turn % 2 ORDER BY turn) = 2 THEN 0 ELSE 1 END AS starts
  FROM calls),
chains AS (
  SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM gaps),
ordered AS (
  SELECT call_id, turn, prompt,
         row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS depth
  FROM chains),
linked AS (
  SELECT coalesce(o.call_id, r.call_id) AS call_id, o.call_id IS NOT NULL AS is_call,
         r.call_id IS NOT NULL AS has_result, coalesce(n_results, 0) AS n_results, depth, prompt,
         CASE WHEN prompt = '' THEN 'prompt is too small' ELSE '' END AS wrong,
         '{{"arguments":' || coalesce('{{"prompt":' || to_json(prompt) || ',"turn":' || turn || '}}', 'null')
           || ',"id":' || to_json(coalesce(o.call_id, r.call_id))
           || ',"name":' || CASE WHEN o.call_id IS NULL THEN 'null' ELSE '"{TOOL}"' END
           || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}}' AS json
  FROM ordered o FULL JOIN results r ON o.call_id = r.call_id),
further AS (
  SELECT t.call_id, t.n_results, o.depth, o.call_id IS NOT NULL AS is_further,
         '{{"arguments":null,"id":' || to_json(t.call_id) || ',"name":null,"result":'
           || to_json(t.content) || '}}' AS json
  FROM texts t JOIN results r ON t.call_id = r.call_id AND t.content > r.content
  LEFT JOIN (SELECT DISTINCT call_id, depth FROM ordered) o ON o.call_id = t.call_id)
SELECT call_id, CASE WHEN is_further THEN '{toolcalls.FURTHER}' ELSE '{toolcalls.NO_CALL}' END AS state,
       n_results, depth, false AS valid,
       CASE WHEN is_further THEN 'further result' ELSE 'no call' END AS errors,
       length(json) AS json_chars, md5(json) AS json_md5
FROM further
UNION ALL
SELECT call_id,
       CASE WHEN NOT is_call THEN '{toolcalls.NO_CALL}' WHEN has_result THEN '{toolcalls.LINKED}'
            ELSE '{toolcalls.NO_RESULT}' END AS state,
       n_results, depth, is_call AND wrong = '' AS valid,
       CASE WHEN is_call THEN wrong ELSE 'no call' END AS errors,
       length(json) AS json_chars, md5(json) AS json_md5
FROM linked
"""


#: For pages whose main text is one article of h1, p, br and inline elements, as the given ones.
OP11_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(
    regexp_replace(article, '</?(h1|p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS marked
  FROM inner_html),
decoded AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(marked,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded
"""

OP12_SQL = f"""
WITH numbered AS (
  SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn_,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn_ ORDER BY place) AS turns FROM numbered GROUP BY c),
crc AS (
  SELECT c, xor(list_reduce(
    [4294967295] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))),
    4294967295) % {MOST_SHARED + 1} AS h
  FROM own),
rebuilt AS (
  SELECT own.c, coalesce(base.turns[1:h], []) || own.turns[h + 1:] AS turns
  FROM own JOIN crc USING (c) LEFT JOIN own base ON base.c = own.c - own.c % 100),
prefixes AS (
  SELECT c, depth, turns[1:depth] AS prefix, len(turns) = depth AS ends
  FROM rebuilt, unnest(range(len(turns) + 1)) AS d(depth)),
nodes AS (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(length(prefix[depth].text), 0) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth),
families AS (
  SELECT p.prefix, p.depth, count(k.depth) AS n_children
  FROM nodes p LEFT JOIN nodes k ON k.depth = p.depth + 1 AND k.prefix[1:p.depth] = p.prefix
  GROUP BY ALL),
subtrees AS (
  SELECT t.prefix, t.depth, count(*) FILTER (n_children = 0) AS n_leaves,
         sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
  FROM nodes t JOIN nodes b ON b.prefix[1:t.depth] = t.prefix AND b.depth >= t.depth
  JOIN families f ON f.prefix = b.prefix
  GROUP BY t.prefix, t.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, f.n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM nodes n JOIN families f ON f.prefix = n.prefix JOIN subtrees s ON s.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1] AND n.depth > 0
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are held against brute force in tests."""
    return {
        "op2_url_filter": OP2_SQL,
        "op4_tool_call_linking": OP4_SQL,
        "op11_html_extraction": OP11_SQL,
        "op12_conversation_prefix_trie": OP12_SQL,
    }
