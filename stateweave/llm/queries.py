"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    from .bpe import encode_documents

    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, digests=True)


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and hidden-Markov scores of every document."""
    from .hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the label model's verdict on every document."""
    from .quality import judge_documents

    return judge_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 50-byte strings."""
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the unigram model."""
    import public_tokenizers

    from .trie_tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in every document; the masked text by its digest."""
    from .secret_scan import corpus_forest, scan_secrets

    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, corpus_forest(docs))
    return found.select("doc_id", "n_candidates", "n_secrets", "max_probability", F.expr("transform(findings, f -> f.begin)").alias("begins"), F.sha2("masked", 256).alias("masked_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    from .vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from .probminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each with the opening of the first of its five."""
    from .conversation_trie import conversation_trie

    conv = F.col("conv")
    return conversation_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 5, opening=F.crc32(conv.cast("string")) % 9, most=8)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links between 4-word shingle sets."""
    from .token_groups import similar_sets

    return similar_sets(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document in the Merkle tree of its language, checked against a tampered leaf."""
    from .merkle import manifest

    docs = table(spark, sf_dir, "documents")
    out = manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, when=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# what SQL can say of queries that it can't express whole ----------------------------------------------------------


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that ``op6_licenses`` finds."""
    return op6_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def hmm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts and base scores of ``op8_hmm``."""
    return op8_hmm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of ``op9_mixing``, and what the mix takes of each source."""
    mix = op9_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return mix.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"), F.sum("taken").alias("taken"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op10_quality``."""
    return op10_quality(spark, sf_dir).drop("kept", "quality")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe, "op2_suffix_dedup": op2_suffix_dedup, "op3_token_counts": op3_token_counts, "op4_secrets": op4_secrets, "op5_nearest": op5_nearest, "op6_licenses": op6_licenses,
    "op7_near_duplicates": op7_near_duplicates, "op8_hmm": op8_hmm, "op9_mixing": op9_mixing, "op10_quality": op10_quality, "op11_prefix_trie": op11_prefix_trie, "op12_ngram_join": op12_ngram_join, "op13_manifest": op13_manifest, "pipeline": pipeline,
    "licenses_base": licenses_base, "hmm_base": hmm_base, "mixing_targets": mixing_targets, "quality_base": quality_base,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


def _leaf(n_chars: str) -> str:
    """SQL for the digest of a document whose ``n_chars`` is the given expression."""
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Where SQL can express a query.
ORACLES: dict[str, str] = {
    "op5_nearest": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_prefix_trie": rf"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.replace("doc_id", "conv_id")} % 9 AS h, list(turn ORDER BY i) AS turns FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(o.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns FROM c LEFT JOIN c o ON o.conv_id = c.base),
x AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
g AS (SELECT list_slice(turns, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends FROM x GROUP BY 1, 2),
k AS (SELECT g.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM g c WHERE c.depth = g.depth + 1 AND list_slice(c.path, 1, g.depth) = g.path) AS n_children FROM g LEFT JOIN g p ON p.depth = g.depth - 1 AND p.path = list_slice(g.path, 1, g.depth - 1))
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
  CAST(coalesce(sum((b.n_convs - 1) * strlen(b.path[b.depth].t)), 0) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM k a JOIN k b ON b.depth >= a.depth AND list_slice(b.path, 1, a.depth) = a.path GROUP BY ALL""",
    "op12_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, words, min(doc_id) OVER (PARTITION BY words) AS rep FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM m WHERE doc_id = rep AND len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT rep AS node, rep AS other FROM m UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN m.doc_id ELSE component_id END AS component_id FROM m JOIN c ON rep = node LEFT JOIN n ON n.doc_id = rep""",
    "op13_manifest": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf("n_chars")} AS leaf, {_leaf(f"(n_chars + CASE WHEN coalesce({_CRC32} % 7 = 0, false) THEN 1 ELSE 0 END)")} AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
v AS (SELECT 0 AS k, g, i, n, leaf AS h FROM l UNION ALL SELECT k + 1, g, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM v WHERE n > 1 GROUP BY k, g, i // 2),
p AS (SELECT g, h AS subroot, k AS height, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM v WHERE n = 1),
w AS (SELECT 0 AS k, i, n, subroot AS h FROM p UNION ALL SELECT k + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM w WHERE n > 1 GROUP BY k, i // 2),
s AS (SELECT l.g, l.i, v.k, CASE WHEN l.i >> v.k & 1 = 1 THEN 'l' ELSE 'r' END || coalesce(o.h, '') AS x FROM l JOIN v ON v.g = l.g AND v.i = l.i >> v.k AND v.n > 1 LEFT JOIN v o ON o.g = v.g AND o.k = v.k AND o.i = xor(v.i, 1)),
u AS (SELECT p.g, w.k, CASE WHEN p.i >> w.k & 1 = 1 THEN 'l' ELSE 'r' END || coalesce(o.h, '') AS x FROM p JOIN w ON w.i = p.i >> w.k AND w.n > 1 LEFT JOIN w o ON o.k = w.k AND o.i = xor(w.i, 1)),
a AS (SELECT g, i, list(x ORDER BY k) AS x FROM s GROUP BY 1, 2), b AS (SELECT g, list(x ORDER BY k) AS x FROM u GROUP BY 1),
r AS (SELECT l.*, p.subroot, (SELECT h FROM w WHERE n = 1) AS root, list_concat(coalesce(a.x, []), coalesce(b.x, [])) AS path FROM l JOIN p USING (g) LEFT JOIN a ON a.g = l.g AND a.i = l.i LEFT JOIN b ON b.g = l.g),
z AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) AS proof_sha256,
  list_reduce(path, lambda h, x: sha256(CASE WHEN x[1] = 'l' THEN x[2:] || h ELSE h || x[2:] END), coalesce(other, leaf)) AS folded_root FROM r)
SELECT *, folded_root = root AS verified FROM z""",
    "op7_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, words, min(doc_id) OVER (PARTITION BY words) AS rep FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM m WHERE doc_id = rep AND len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE CAST(common AS DOUBLE) / (x.n + y.n - common) >= 0.8),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT rep AS node, rep AS other FROM m UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id FROM m JOIN c ON rep = node""",
    "licenses_base": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
x AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS i FROM w),
y AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT unnest(['gnu general public license', 'apache license', 'cc by', 'mit license']) AS k, unnest(['gpl', 'apache', 'cc-by', 'mit']) AS label),
f AS (SELECT doc_id, i AS place, label FROM y JOIN p ON a || ' ' || b = k OR a || ' ' || b || ' ' || c || ' ' || d = k)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN f ON w.doc_id = f.doc_id GROUP BY w.doc_id, words""",
    "hmm_base": rf"""
WITH t AS (SELECT doc_id, coalesce({_CRC32} % 5 = 1, false) AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), ' ') AS tokens FROM documents),
x AS (SELECT doc_id, held_out, unnest(tokens) AS token FROM t),
c AS (SELECT token, count(*) AS c FROM x WHERE NOT held_out GROUP BY 1),
k AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score
FROM x LEFT JOIN c USING (token), k GROUP BY 1, 2""",
    "mixing_targets": rf"""
WITH d AS (SELECT source, count(*) AS n, CAST(sum(len({_WORDS})) AS BIGINT) AS size FROM documents GROUP BY 1),
g AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 1.5 * sum(size) OVER () AS total FROM d),
o AS (SELECT *, 2.0 * size / w AS ratio, row_number() OVER (ORDER BY 2.0 * size / w, source NULLS LAST) AS i FROM g),
q AS (SELECT *, (total - coalesce(sum(2.0 * size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
z AS (SELECT coalesce((SELECT level FROM q WHERE level <= ratio ORDER BY i LIMIT 1), (SELECT max(ratio) FROM q)) AS level)
SELECT source, n, size, size AS source_size, round(least(2.0 * size, w * z.level), 6) AS target, CAST(round_even(least(2.0 * size, w * z.level), 0) AS BIGINT) AS taken FROM q, z""",
    "quality_base": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS k, unnest(range(1, len(words) - 3)) AS i FROM t),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times FROM w),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM k WHERE times > 1) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM l LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c""",
}
