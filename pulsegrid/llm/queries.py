"""Registered queries of the training-data operators: ``opN_<name>(spark, sf_dir)`` and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import load
from .exact_dedup import exact_dedup
from .license_scan import licence_scan
from .line_dedup import line_dedup
from .merkle import document_manifest
from .mixing import mix
from .prefix_forest import search as forest_search
from .quality import classify, train
from .simhash import as_hex, near_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .topk import search
from .vector_codes import ROUNDS, compress

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(load(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all ``documents`` in windows of 20 words: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all ``documents``: doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all ``documents`` by block naming: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup(load(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents`` by source: doc_id, size, source_size, target, taken."""
    mixed = mix(load(spark, sf_dir, "documents"))
    rows = mixed.rows.withColumn("own", F.col("pattern")[0])
    found = rows.join(mixed.sources, F.col("own").eqNullSafe(F.col("source")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup of all ``documents``: doc_id, fingerprint, component_id."""
    out = near_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all ``documents``: doc_id, n_paragraphs, n_notices, families, licence, score."""
    return licence_scan(load(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of 50-byte strings of ``documents`` that smaller ids have: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(load(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from ``labels`` that aren't held out: doc_id, held_out, score, predicted."""
    docs = load(spark, sf_dir, "documents")
    return classify(docs, train(docs, load(spark, sf_dir, "labels")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every 100th vector of ``embeddings`` with all others: query_id, rank, vec_id, score."""
    vectors = load(spark, sf_dir, "embeddings")
    return search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings``: vec_id, code, error, label_error, codebooks_sha256."""
    return compress(load(spark, sf_dir, "embeddings"))[0]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all ``documents``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return document_manifest(load(spark, sf_dir, "documents"))


def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector of ``embeddings`` among all others: query_id, rank, vec_id, score."""
    return forest_search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _code_sql() -> str:
    """op11: the rounds one after another; distances are whole numbers that doubles hold exactly."""
    near = """a{r} AS MATERIALIZED (
          SELECT vec_id, label, p, x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) * 16 + k) AS best
          FROM v JOIN b{r} USING (p) GROUP BY ALL)"""
    move = """b{s} AS MATERIALIZED (
          SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (
            SELECT p, k, list(f ORDER BY j) AS c FROM (
              SELECT p, best % 16 AS k, j, floor(sum(x[j]) / count(*)) AS f FROM a{r}, generate_series(1, (SELECT max(len(x)) FROM v)) g(j) GROUP BY ALL)
            GROUP BY ALL) n ON b.p = n.p AND b.k = n.k)"""
    parts = ["""w AS (SELECT vec_id, label, [floor(4096 * CAST(x AS DOUBLE)) for x in embedding] AS e, len(embedding) // 8 AS size
                      FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
             "v AS MATERIALIZED (SELECT vec_id, label, p, e[p * size + 1 : (p + 1) * size] AS x FROM w, range(8) g(p))",
             "b0 AS MATERIALIZED (SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM v) t WHERE k < 16)"]
    for r in range(ROUNDS):
        parts += [near.format(r=r), move.format(r=r, s=r + 1)]
    parts.append(near.format(r=ROUNDS))
    parts.append(f"""books AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in c], ','), ',' ORDER BY p, k)) AS sha FROM b{ROUNDS})""")
    parts.append(f"""codes AS (SELECT vec_id, label, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error
                              FROM a{ROUNDS} GROUP BY ALL)""")
    return "WITH " + ",\n        ".join(parts) + """
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM codes, books"""


def _merkle_sql() -> str:
    """op12: trees level by level, then every leaf's way up; the low bit of CRC32 bit by bit."""
    own = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = "sha256(" + " || ".join(own.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
    left, right = "array_to_string(kids[1:i % 3], '')", "array_to_string(kids[i % 3 + 2:], '')"

    def grow(name: str, base: str) -> str:
        return f"""{name} AS ({base} UNION ALL
          SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 3, n)"""

    def climb(name: str, base: str) -> str:
        return f"""{name} AS ({base} UNION ALL
          SELECT rid, w.g, w.lvl + 1, i // 3, sha256({left} || own || {right}), proof || {left} || {right}
          FROM {name} w JOIN runs r ON w.g = r.g AND w.lvl = r.lvl AND w.i // 3 = r.run)"""

    def last(name: str) -> str:
        return f"(SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) AS k FROM {name}) WHERE k = 1"

    return f"""
        WITH RECURSIVE crc AS (
          SELECT *, list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST((ord(c) >> k) & 1 AS BIGINT) for k in range(8)]
                      for c in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)) & 1 = 1 AS even
          FROM documents),
        hashed AS (
          SELECT doc_id, source, {leaf.format(t="text")} AS leaf,
                 CASE WHEN even THEN {leaf.format(t="replace(text, chr(10), '')")} ELSE {leaf.format(t="text")} END AS changed FROM crc),
        leaves AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
                 dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER () AS rid FROM hashed),
        {grow("tree", "SELECT g, 0 AS lvl, i, n, leaf AS digest FROM leaves")},
        subroots AS (SELECT g, digest FROM tree WHERE n = 1),
        {grow("top", "SELECT CAST(-1 AS BIGINT) AS g, 0 AS lvl, g AS i, (SELECT count(*) FROM subroots) AS n, digest FROM subroots")},
        runs AS (SELECT g, lvl, i // 3 AS run, list(digest ORDER BY i) AS kids FROM (SELECT * FROM tree UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY ALL),
        {climb("walk", "SELECT rid, g, 0 AS lvl, i, changed AS own, '' AS proof FROM leaves")},
        {climb("up", "SELECT rid, CAST(-1 AS BIGINT) AS g, 0 AS lvl, g AS i, own, proof FROM " + last("walk"))},
        ends AS (SELECT * FROM {last("up")})
        SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = t.digest AS verified
        FROM leaves l JOIN ends e USING (rid) JOIN subroots s ON l.g = s.g, (SELECT digest FROM top WHERE n = 1) t"""


ORACLES = {
    "op11_vector_codes": _code_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op9_exact_topk": """
        WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e
                   FROM embeddings WHERE len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_line_dedup": """
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
}

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_substring_dedup, op3_line_dedup, op4_mix_sources, op5_simhash_near_dedup,
                                   op6_license_scan, op7_suffix_array_dedup, op8_quality_classifier,
                                   op9_exact_topk, op10_exact_dedup, op11_vector_codes, op12_merkle_manifest, op13_prefix_forest)}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
