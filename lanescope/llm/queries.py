"""The registered queries of the operators: thin digests of their results over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (auction_repair, bloom_cascade, bpe_lexicon, cross_entropy, dimension_scan, hnsw, icws, line_dedup, packing,
               piece_merges, prefix_trie, sequence_sql, weak_labels, zstd_shards)
from .common import binary_file, read, small_side, stored, text_file

WORD_BPE, BYTE_BPE, PIECE_BPE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_bpe_lexicon(spark, sf_dir):
    """Every document encoded and decoded (word_bpe_49k)."""
    coded = bpe_lexicon.encode(read(spark, sf_dir, "documents"), text_file(WORD_BPE), decoded=True)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids (byte_bpe_50k, end id 1)."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), text_file(BYTE_BPE), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op7_zstd_shards(spark, sf_dir):
    """All documents written to shard files (word_bpe_49k, end id 2) and read back."""
    docs = zstd_shards.round_trip(read(spark, sf_dir, "documents"), text_file(WORD_BPE), 2)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_dedup(spark, sf_dir):
    """Every document with the lines that remain."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    kept = line_dedup.deduplicated(docs, report="dropped")
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_weak_labels(spark, sf_dir):
    """Every document with its weak label's posterior, its score and the decision."""
    scored = weak_labels.score(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return scored.select("doc_id", "quality.posterior", "quality.score", "quality.keep")


def op9_icws_minhash(spark, sf_dir):
    """Every document with its group of near-duplicates."""
    return icws.groups(read(spark, sf_dir, "documents")).drop("text_md5")


#: (verdict, host, path beginning)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op10_bloom_cascade(spark, sf_dir):
    """Every page's url judged by the rules."""
    return bloom_cascade.judge(read(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT u.page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS rn
  FROM urls u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND rn = 1
"""
def op2_cross_entropy(spark, sf_dir):
    """Every document scored: documents labelled good and not toxic are the target."""
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    target = stored(labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("target_id")).distinct(), "lm-target")
    docs = docs.select("doc_id", "text").join(small_side(target), F.col("doc_id") == F.col("target_id"), "left")
    return cross_entropy.score(docs, F.col("target_id").isNotNull())


def op5_dimension_scan(spark, sf_dir):
    """The 20 nearest rows, by inner product, of every row whose vec_id is divisible by 20."""
    return dimension_scan.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_hnsw(spark, sf_dir):
    """Every vector with its links of cosine 0.98 or more inside its label, and their components."""
    return hnsw.links(read(spark, sf_dir, "embeddings"))


def damaged(conversations):
    """The rows of op11 with faults that follow from crc32(``conv_id:turn``) % 20."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(null("conv_id"), F.lit(":"), null("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", null("role").alias("role"), null("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_auction_repair(spark, sf_dir):
    """Every conversation, damaged by a fixed rule, with its faults and its cheapest repair."""
    conversations = read(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    audited = stored(auction_repair.audits(rows), "audits")
    digests = auction_repair.digests(auction_repair.repaired(rows, audited))
    ids = conversations.select("conv_id").distinct()
    found = ids.join(audited.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    found = found.join(digests.withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    return found.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_piece_rounds(spark, sf_dir):
    """Every document encoded and decoded (piece_bpe_32k)."""
    coded = piece_merges.encode(read(spark, sf_dir, "documents"), binary_file(PIECE_BPE), decoded=True)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_prefix_trie(spark, sf_dir):
    """The trie of all conversations, each rebuilt with some first turns of the conversation it shares them with."""
    convs, rows = prefix_trie.prefixes(
        read(spark, sf_dir, "conversations"), base=lambda c: c - c % 20,
        shared=lambda c: F.crc32(c.cast("string").cast("binary")) % 4, most_shared=3)
    return prefix_trie.trie(convs, rows).drop("digest", "parent")


QUERIES = {f.__name__: f for f in (
    op1_bpe_lexicon, op2_cross_entropy, op3_line_dedup, op4_packing, op5_dimension_scan, op6_weak_labels,
    op7_zstd_shards, op8_hnsw, op9_icws_minhash, op10_bloom_cascade, op11_auction_repair, op12_piece_rounds,
    op13_prefix_trie)}
#: The others have no SQL form; tests/llm compares them with brute-force versions.
ORACLE = {"op10_bloom_cascade": OP10_SQL, "op11_auction_repair": sequence_sql.OP11, "op13_prefix_trie": sequence_sql.OP13}
