"""The registered queries of the operators: name -> function of (spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import collocations, exact_dedup, fuzzy_lines, language, mixing, ngrams, page_text, pieces, prefix_trie, repeats, simhash, topk, units
from eventloom.llm.common import documents
from eventloom.session import tune

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(documents(tune(spark), sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(tune(spark), sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(tune(spark), sf_dir), PIECES)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(tune(spark), sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.substring_dedup(documents(tune(spark), sf_dir))
    return found.select("doc_id", "n_units", "n_removed", "spans", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(tune(spark), sf_dir))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(tune(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/embeddings.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(tune(spark), sf_dir), PIECES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(tune(spark), sf_dir))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_dedup(documents(tune(spark), sf_dir), short=fuzzy_lines.SHORT)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(tune(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/conversations.parquet"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(tune(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/pages.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(tune(spark), sf_dir))


QUERIES = {f.__name__: f for f in (op1_ngram_scores, op2_mix_sources, op3_piece_coding, op4_suffix_dedup, op5_line_hashing, op6_exact_dedup, op7_top_k, op8_language, op9_simhash, op10_fuzzy_lines, op11_prefix_trie, op12_page_text, op13_collocations)}

SQL = {
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # crc32 bit by bit; a node is the list of its turns, and its subtree the nodes that start with that list
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) i,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY i) xs FROM t GROUP BY c),
crc AS (
  SELECT c, xs, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))) % 4 h
  FROM own),
conv AS (SELECT k.c, coalesce(b.xs[1:h], []) || k.xs[h + 1:] p FROM crc k LEFT JOIN own b ON b.c = k.c - k.c % 20),
member AS (SELECT c, p[1:d] q, d, len(p) n FROM (SELECT c, p, unnest(range(len(p) + 1)) d FROM conv)),
node AS (
  SELECT q, d, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) ends_sha256,
    coalesce(len(regexp_extract_all(any_value(q)[-1].t, '[^\\x20\\x09-\\x0D]+')), 0) w
  FROM member GROUP BY q, d),
child AS (SELECT q[1:d - 1] q, count(*) k FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(k, 0) k FROM node LEFT JOIN child ON child.q = node.q),
below AS (
  SELECT q, sum((k = 0)::INT) n_leaves, sum((n_convs - 1) * w) saved
  FROM (SELECT q[1:u] q, k, n_convs, w FROM (SELECT *, unnest(range(d + 1)) u FROM full_node)) GROUP BY q)
SELECT n.conv_id, n.d depth, up.conv_id parent_conv_id, n.n_convs, n.k n_children, b.n_leaves::BIGINT n_leaves, b.saved::BIGINT saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON b.q = n.q LEFT JOIN node up ON n.d > 0 AND up.q = n.q[1:n.d - 1]""",
    "op13_collocations": """
WITH piece AS (
  SELECT coalesce(lang, 'und') lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') w
  FROM documents),
size AS (SELECT lang, sum(len(w)) n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') phrase, count(*) f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) i FROM piece, (SELECT unnest([1, 2, 3]) m)) GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT g.lang, g.phrase, g.f a, k, l.f l, r.f r, (1000000::HUGEINT * g.f * g.f) // (l.f::HUGEINT * r.f) score
  FROM (SELECT *, string_split(phrase, ' ') w, unnest(range(1, m)) k FROM gram WHERE m > 1) g
  JOIN gram l ON l.lang = g.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN gram r ON r.lang = g.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
least AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') phrase, max(f) f FROM gram, (SELECT unnest([1, 2]) i) WHERE m = 3 GROUP BY ALL),
kept AS (SELECT x.* FROM least x LEFT JOIN longer o ON o.lang = x.lang AND o.phrase = x.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT n, score::BIGINT score FROM ranked JOIN size USING (lang) WHERE rank <= 2000""",
}
