"""Registered queries of the operators, and their SQL where SQL can express them."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm import (
    exact_dedup,
    hilbert_sharding,
    html_text,
    language_id,
    learned_rules,
    multi_index,
    ngram_join,
    piece_lattice,
    preference_pairs,
    prefix_trie,
    source_mixing,
    token_alignment,
    warc_archive,
)
from photocat.llm.common import Scratch, read_table

SHARDS = 24
# The vocabulary file; any SentencePiece model does.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_LEVEL = os.environ.get("BYTE_LEVEL_MODEL", "/opt/tokenizers/byte_bpe_50k.json")
MIX = {"domain": {"src0": 4, "src1": 2}, "lang": {"en": 3, "de": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 7


def op1_block_rules_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_text.extract(pages, columns=["page_id", "url"]).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars")
    )


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs.pairs_from_neighbours(read_table(spark, sf_dir, "conversations"))

    def spans(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    return pairs.withColumns(
        {"chosen_spans": spans("chosen_spans"), "rejected_spans": spans("rejected_spans")}
    )


def op3_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    encoded = piece_lattice.encode(docs, PIECES, columns=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").alias("n_pieces"),
        F.md5(F.array_join("ids", " ")).alias("ids_md5"),
        "score",
        F.transform("other_ways", lambda w: w["score"]).alias("other_scores"),
        "restored",
    )


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return source_mixing.mix(docs, MIX_SHARE, MIX, MIX_EPOCHS, MIX_SEED).drop("text_hash")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return hilbert_sharding.assign_shards(docs, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_groups(read_table(spark, sf_dir, "embeddings"))


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archive").path("warc")
    warc_archive.write_archive(read_table(spark, sf_dir, "pages"), path)
    return warc_archive.read_records(spark, path).select(
        F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs, teach=~language_id.held_out("doc_id"))
    apart = docs.select("doc_id", "text", language_id.held_out("doc_id").alias("held_out"))
    return language_id.predict(apart, model, ["doc_id", "held_out"])


def op9_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ngram_join.jaccard_groups(docs, k=4, num=85, den=100)


def op10_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.text_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = learned_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*base, "base_failed", "kept")


def op12_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    documents, _ = token_alignment.align(docs, BYTE_LEVEL, PIECES, columns=["doc_id"])
    return documents


def op13_lcp_range_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.sequences(read_table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.trie(prefix_trie.with_shared_heads(convs))
    return nodes.drop("first_row", "last_row")


QUERIES = {
    f.__name__: f
    for f in (
        op1_block_rules_html,
        op2_preference_format,
        op3_nbest_pieces,
        op4_hierarchical_mixing,
        op5_hilbert_sharding,
        op6_inverted_multi_index,
        op7_content_addressed_warc,
        op8_hierarchical_language_id,
        op9_heavy_light_jaccard,
        op10_block_naming_dedup,
        op11_learned_rules,
        op12_identity_alignment,
        op13_lcp_range_trie,
    )
}

def _divided(table: str, path: list, level: str) -> str:
    """SQL of one level of the budget tree: children in the order in which they fill up."""
    parents = path[:-1]
    keys = ", ".join(path)
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    weight = "CASE " + level + "".join(f" WHEN '{v}' THEN {w}" for v, w in MIX.get(level, {}).items()) + " ELSE 1 END"
    weight = weight if MIX.get(level) else "1"
    given = f"JOIN {table} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {table}"
    return f"""
        SELECT {keys}, (CASE WHEN fills THEN cap ELSE (given - sum(CASE WHEN fills THEN cap ELSE 0 END) OVER ({over}))
                   * weight // sum(CASE WHEN fills THEN 0 ELSE weight END) OVER ({over}) END)::HUGEINT AS given
        FROM (SELECT *, cap * (sum(weight) OVER ({over}) - before_weight) <= (given - before_cap) * weight AS fills
              FROM (SELECT *, coalesce(sum(cap) OVER w, 0) AS before_cap, coalesce(sum(weight) OVER w, 0) AS before_weight
                    FROM (SELECT {keys}, (sum(size) * {MIX_EPOCHS})::HUGEINT AS cap, any_value(given)::HUGEINT AS given,
                                 ({weight})::HUGEINT AS weight
                          FROM leaf {given} GROUP BY {keys})
                    WINDOW w AS ({over} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


MIX_SQL = f"""
    WITH d AS (
        SELECT doc_id, substr(coalesce(source, ''), 1, 4) AS domain, coalesce(lang, '') AS lang,
               coalesce(source, '') AS source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
        FROM documents
    ), leaf AS (
        SELECT domain, lang, source, sum(n_tokens) AS size FROM d GROUP BY ALL
    ), root AS (
        SELECT floor(coalesce(sum(size), 0)::DOUBLE * {MIX_SHARE})::HUGEINT AS given FROM leaf
    ), domains AS ({_divided("root", ["domain"], "domain")}
    ), langs AS ({_divided("domains", ["domain", "lang"], "lang")}
    ), sources AS ({_divided("langs", ["domain", "lang", "source"], "source")}
    ), bought AS (
        SELECT domain, lang, source, given AS leaf_budget,
               CASE WHEN size > 0 THEN given // size ELSE 0 END AS epochs,
               CASE WHEN size > 0 THEN given % size ELSE 0 END AS rest
        FROM leaf JOIN sources USING (domain, lang, source)
    ), placed AS (
        SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
                      ORDER BY md5(concat_ws(':', '{MIX_SEED}', epochs, coalesce(doc_id::VARCHAR, '')))
                      ROWS UNBOUNDED PRECEDING) AS upto
        FROM d JOIN bought USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, n_tokens, leaf_budget::BIGINT AS leaf_budget,
           (epochs + CASE WHEN upto <= rest AND epochs < {MIX_EPOCHS} THEN 1 ELSE 0 END)::INTEGER AS copies
    FROM placed WHERE epochs + CASE WHEN upto <= rest AND epochs < {MIX_EPOCHS} THEN 1 ELSE 0 END > 0"""

PAIR_SQL = """
    WITH t AS (
        SELECT conv_id, role, text, row_number() OVER (
                   PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), cut AS (
        SELECT conv_id, max(pos) AS last_pos FROM t WHERE role = 'assistant' GROUP BY conv_id
    ), answer AS (
        SELECT conv_id, last_pos, text, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n
        FROM cut JOIN t USING (conv_id) WHERE pos = last_pos
    ), other AS (
        SELECT a.conv_id, a.last_pos, b.text AS other FROM answer a JOIN answer b ON b.i = (a.i + 1) % a.n
    ), sides AS (
        SELECT conv_id, pos, last_pos, role, text AS chosen, CASE WHEN pos = last_pos THEN other ELSE text END AS rejected
        FROM t JOIN other USING (conv_id) WHERE pos <= last_pos
    ), parted AS (
        SELECT *, coalesce(min(CASE WHEN chosen IS DISTINCT FROM rejected THEN pos END) OVER (PARTITION BY conv_id) - 1,
                           last_pos) AS n_common
        FROM sides
    ), rendered AS (
        SELECT *, '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
               coalesce(chosen, '') || '<|im_end|>' AS chosen_said, coalesce(rejected, '') || '<|im_end|>' AS rejected_said
        FROM parted
    ), placed AS (
        SELECT *, coalesce(sum(CASE WHEN pos > n_common THEN length(head) + length(chosen_said) + 1 END) OVER w, 0) AS c_at,
               coalesce(sum(CASE WHEN pos > n_common THEN length(head) + length(rejected_said) + 1 END) OVER w, 0) AS r_at
        FROM rendered
        WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
    SELECT conv_id, any_value(n_common)::INTEGER AS n_common,
           coalesce(string_agg(head || chosen_said || chr(10), '' ORDER BY pos) FILTER (pos <= n_common), '') AS prompt,
           coalesce(string_agg(head || chosen_said || chr(10), '' ORDER BY pos) FILTER (pos > n_common), '') AS chosen,
           coalesce(string_agg((c_at + length(head))::BIGINT || '-' || (c_at + length(head) + length(chosen_said))::BIGINT,
                               ',' ORDER BY pos) FILTER (pos > n_common AND role = 'assistant'), '') AS chosen_spans,
           coalesce(string_agg(head || rejected_said || chr(10), '' ORDER BY pos) FILTER (pos > n_common), '') AS rejected,
           coalesce(string_agg((r_at + length(head))::BIGINT || '-' || (r_at + length(head) + length(rejected_said))::BIGINT,
                               ',' ORDER BY pos) FILTER (pos > n_common AND role = 'assistant'), '') AS rejected_spans
    FROM placed GROUP BY conv_id"""

TRIE_SQL = """
    WITH keyed AS (
        SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words,
               sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM keyed
    ), ids AS (
        SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT) AS codes
        FROM (SELECT DISTINCT conv_id FROM own)
    ), heads AS (
        SELECT conv_id, xor(list_reduce([4294967295] || codes, lambda crc, code:
                   list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 4 AS h
        FROM ids
    ), built AS (
        SELECT heads.conv_id, pos, k, words FROM heads JOIN own ON own.conv_id = heads.conv_id - heads.conv_id % 20 AND pos <= h
        UNION ALL SELECT conv_id, pos, k, words FROM heads JOIN own USING (conv_id) WHERE pos > h
    ), placed AS (
        SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM built
    ), chain AS (
        SELECT conv_id, depth, words,
               string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path
        FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM heads
    ), node AS (
        SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM chain GROUP BY ALL
    ), kids AS (
        SELECT depth - 1 AS depth, left(path, (depth - 1) * 64) AS path, count(*) AS n_children FROM node WHERE depth > 0
        GROUP BY ALL
    ), full_node AS (
        SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, path)
    ), above AS (
        SELECT n_convs, words, n_children, path AS whole, unnest(range(0, depth + 1)) AS depth FROM full_node
    ), sub AS (
        SELECT depth, left(whole, depth * 64) AS path, sum((n_convs - 1) * words) AS saved_tokens,
               count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves
        FROM above GROUP BY ALL
    ), ends AS (
        SELECT depth, path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
        FROM chain JOIN (SELECT conv_id, max(depth) AS depth FROM chain GROUP BY conv_id) USING (conv_id, depth)
        GROUP BY ALL
    )
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children,
           n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM full_node n JOIN sub USING (depth, path) LEFT JOIN ends USING (depth, path)
    LEFT JOIN node up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.path = left(n.path, (n.depth - 1) * 64)"""

SQL = {
    "op13_lcp_range_trie": TRIE_SQL,
    "op2_preference_format": PAIR_SQL,
    "op4_hierarchical_mixing": MIX_SQL,
    "op7_content_addressed_warc": f"""
        WITH r AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), g AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM r
        )
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('{warc_archive.BASE32}',
                   ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)),
                   '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM g""",
    "op10_block_naming_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)""",
}
