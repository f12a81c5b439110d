"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import quality, toxicity
from rankloom.llm.common import read_table
from rankloom.llm.conversation_repair import repair
from rankloom.llm.encoder import tokenizer_path
from rankloom.llm.exact_dedup import exact_dedup
from rankloom.llm.impact_index import rank_documents
from rankloom.llm.langid import fit, fold, identify
from rankloom.llm.mixing import mix
from rankloom.llm.packing import pack_documents
from rankloom.llm.rp_forest import near_vectors
from rankloom.llm.simhash import simhash_groups
from rankloom.llm.token_counts import apply_edits, redactions, token_trees
from rankloom.llm.token_file import encode_corpus
from rankloom.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as patched frame-of-reference shards and read back."""
    return encode_corpus(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), 2)


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents."""
    return exact_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 4096 tokens."""
    pieces = pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate groups of all documents."""
    return simhash_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all embeddings at cosine 0.9 or more."""
    return near_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in seekable Zstandard bundles and read back."""
    return archive_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from two thirds of them."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from four fifths of the labels."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"), fold("id", 5) != 0)
    return toxicity.score_toxicity(docs, lexicon).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of all documents in a mix of their sources, weighted by size to the power 0.7."""
    mixed = mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("block", "slot", "release", "deadline", "at")])


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after redaction, from trees of which only the edited regions are encoded again."""
    path = tokenizer_path("byte_bpe_50k.json")
    trees = token_trees(redactions(read_table(spark, sf_dir, "documents", "doc_id", "text")), path, edits_col="edits")
    return apply_edits(trees, path).select(F.col("id").alias("doc_id"), "n_tokens_before", "n_edits", "n_tokens", "encoded_chars", F.size("leaf_chars").alias("n_leaves"))


ORACLES["op2_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
"""

ORACLES["op5_warc"] = """
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(payload), (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages) p WINDOW w AS (PARTITION BY payload)
"""


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from three quarters of the labels."""
    stats = quality.document_statistics(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    model = quality.fit(stats, read_table(spark, sf_dir, "labels", "doc_id", "quality"), fold("id", 4) != 2)
    return quality.score_quality(stats, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "difference")


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item, from a bit-sliced impact index of all documents."""
    return rank_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLES["op12_lexical_search"] = r"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, unnest(terms) AS term FROM items),
scores AS (SELECT q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (d), whole GROUP BY q, item_id, d, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of all conversations, after planted damage."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return repair(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), fault)


ORACLES["op13_conversation_repair"] = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)) AS t),
src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT k, turn, role, text, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS fault FROM src, crc),
damaged AS (SELECT k, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE fault <> 0),
seq AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS pos, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
seen AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY pos) AS prev FROM seq),
marked AS (SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated FROM seen),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                  count(*) FILTER (truncated) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY k),
inserts(state, here, edits, cost, lines) AS (VALUES
  (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 2, ['user:']), (1, 3, 'II', 4, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 2, ['assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 2, ['user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
step(k, pos, state, best) AS (
  SELECT DISTINCT k, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM src
  UNION ALL
  SELECT k, pos, state, min(best) FROM (
    SELECT s.k, m.pos, CASE e WHEN 'D' THEN i.here WHEN 'R' THEN (CASE i.here WHEN 2 THEN 3 ELSE 2 END) ELSE (CASE m.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END) END AS state,
           {'cost': s.best.cost + i.cost + (CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END) + (CASE WHEN m.truncated AND e <> 'D' THEN 1 ELSE 0 END), 'audit': s.best.audit || i.edits || e,
            'lines': s.best.lines || i.lines || (CASE e WHEN 'D' THEN [] WHEN 'R' THEN [(CASE i.here WHEN 2 THEN 'assistant:' ELSE 'user:' END) || m.text] ELSE [m.role || ':' || m.text] END)} AS best
    FROM step s JOIN marked m ON m.k = s.k AND m.pos = s.pos + 1 JOIN inserts i ON i.state = s.state CROSS JOIN (VALUES ('D'), ('R'), ('K')) v(e)
    WHERE e = 'D' OR (NOT m.blank AND NOT m.duplicate AND (e = 'R' OR (m.initial = 's' AND i.here = 0) OR (m.initial = 'u' AND i.here <> 2) OR (m.initial = 'a' AND i.here = 2)))
  ) GROUP BY k, pos, state),
ended AS (SELECT s.k, min({'cost': s.best.cost + i.cost, 'audit': s.best.audit || i.edits, 'lines': s.best.lines || i.lines}) AS best
          FROM step s LEFT JOIN counts c USING (k) JOIN inserts i ON i.state = s.state AND i.here IN (0, 3) WHERE s.pos = coalesce(c.n, 0) GROUP BY s.k)
SELECT s.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       e.best.cost AS cost, e.best.audit AS audit, sha256(array_to_string(e.best.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM src) s JOIN ended e USING (k) LEFT JOIN counts c USING (k)
"""
