"""The registered queries of the operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the licenses found, how many places hold one, and the best containment (0 without any)."""
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select(
        "doc_id",
        F.array_join(names, ",").alias("licenses"),
        F.size("licenses").alias("n_places"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_frequent_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs, outputs=("n_lines", "n_dropped", "kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import tokenize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
        keep=("doc_id",),
    )


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4, bits=64)


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_embedding import compared_with_next

    return compared_with_next(table(spark, sf_dir, "documents"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = mix(docs, target_entropy_share=0.95, max_repeats=2.0)
    return drawn.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_place").alias("place"), F.col("_weight").alias("weight"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, depth=200, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import learn, predict
    from .toxicity import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return predict(docs, model, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, remainder, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = fit(docs, labels)
    return score(docs, model, cut=0.7, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; the tampered ones are versions, whose root differs."""
    from .merkle import versions

    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = versions(
        docs,
        fields=("doc_id", "source", "lang", "n_chars", "text"),
        group="lang",
        order="doc_id",
        changed=tampered,
        changes={"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1},
    )
    digests = {"leaf": "leaf", "subroot": "subroot", "root": "root", "folded_root": "version_root"}
    proof = F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256")
    shown = {name: F.lower(F.hex(of)).alias(name) for name, of in digests.items()}
    verified = (F.col("version_root") == F.col("root")).alias("verified")
    return made.select("doc_id", shown["leaf"], shown["subroot"], shown["root"], proof, shown["folded_root"], verified)


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tree_bpe import tokenize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


def op13_blas_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .blas_rank import rank

    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM pairs QUALIFY rank <= 20
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs
), keyed AS (
  SELECT r, doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT r, doc_id, i, line, keeper IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS dropped
  FROM keyed LEFT JOIN hot USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

#: crc32 of the decimal id, bit by bit; then level by level: the nodes, each leaf's siblings, and the fold of the tampered leaves.
OP11_SQL = """
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER () AS r,
         doc_id IS NOT NULL AND xor(list_reduce(
           list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT),
           lambda c, b: list_reduce(range(8)::BIGINT[], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)),
           4294967295::BIGINT), 4294967295::BIGINT) % 7 = 0 AS tampered
  FROM documents
), texts AS (
  SELECT r, doc_id, lang, tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars,
         coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS more_chars,
         coalesce(strlen(text) || ':' || text, '-') AS body
  FROM rows
), leaves AS (
  SELECT r, doc_id, tampered, sha256(head || chars || body) AS leaf, sha256(head || more_chars || body) AS changed,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || chars || body)) - 1 AS pos
  FROM texts
), nodes AS (
  SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2
), upper AS (
  SELECT 0 AS level, g AS pos, h, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM upper WHERE n > 1 GROUP BY level, pos // 2
), heights AS (
  SELECT g, max(level) AS height FROM nodes GROUP BY g
), steps AS (
  SELECT l.r, s.level, s.h, s.pos < (l.pos >> s.level) AS before
  FROM leaves l JOIN nodes s ON s.g = l.g AND s.pos = xor(l.pos >> s.level, 1) AND s.n > 1
  UNION ALL
  SELECT l.r, t.height + s.level, s.h, s.pos < (l.g >> s.level)
  FROM leaves l JOIN heights t ON t.g = l.g JOIN upper s ON s.pos = xor(l.g >> s.level, 1) AND s.n > 1
), fold AS (
  SELECT r, 0::BIGINT AS level, changed AS h FROM leaves WHERE tampered
  UNION ALL
  SELECT f.r, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.before THEN s.h || f.h ELSE f.h || s.h END)
  FROM fold f JOIN leaves l ON l.r = f.r JOIN heights t ON t.g = l.g LEFT JOIN steps s ON s.r = f.r AND s.level = f.level
  WHERE f.level < t.height + (SELECT max(level) FROM upper)
), proofs AS (
  SELECT r, sha256(string_agg(h, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY r
)
SELECT l.doc_id, l.leaf, sub.h AS subroot, root.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       coalesce(f.h, root.h) AS folded_root, coalesce(f.h, root.h) = root.h AS verified
FROM leaves l JOIN nodes sub ON sub.g = l.g AND sub.n = 1 JOIN upper root ON root.n = 1
JOIN heights t ON t.g = l.g LEFT JOIN proofs p ON p.r = l.r
LEFT JOIN fold f ON f.r = l.r AND f.level = t.height + (SELECT max(level) FROM upper)
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
), asked AS (
  SELECT i, term, count(*) AS q FROM (SELECT i, unnest(terms) AS term FROM items) GROUP BY i, term
), corpus AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus
), norms AS (
  SELECT r, doc_id, 25 + (75 * len(terms) * n) // l AS m FROM docs, corpus WHERE len(terms) > 0
), scores AS (
  SELECT i, r, any_value(doc_id) AS doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN norms USING (r) GROUP BY i, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN items USING (i) WHERE score > 0 QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_edit_embedding": op2_edit_embedding,
        "op3_temperature_mixing": op3_temperature_mixing,
        "op4_repeats": op4_repeats,
        "op5_language_mixture": op5_language_mixture,
        "op6_license_scan": op6_license_scan,
        "op7_line_dedup": op7_line_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_maxscore_topk": op10_maxscore_topk,
        "op11_merkle_versions": op11_merkle_versions,
        "op12_tree_bpe": op12_tree_bpe,
        "op13_blas_rank": op13_blas_rank,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op10_maxscore_topk": OP10_SQL, "op11_merkle_versions": OP11_SQL, "op13_blas_rank": OP13_SQL}
