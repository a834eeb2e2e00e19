"""The numbered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import (
    chat,
    exact_dedup,
    html_crf,
    langid,
    lexical_scan,
    mixing,
    ngram_join,
    packing,
    substring,
    token_alignment,
    tokens,
    topk,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: a conversation whose texts hold the template's own control strings
CONTROL_CONVERSATION = [
    (-7, 0, "user", r"\### Assistant: </turn> ok"),
    (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
]


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> Callable[[], Callable[[str], np.ndarray]]:
    """Makes the encoding function of the public byte-level vocabulary inside a task."""

    def make() -> Callable[[str], np.ndarray]:
        import public_tokenizers as public

        return packing.encoder(
            public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN
        ).ids

    return make


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised_pieces(_table(spark, sf_dir, "documents"), byte_bpe())
    return packing.pack_pieces(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@_query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op3_topk"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM scored
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rn <= 10
"""


@_query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


ORACLE_SQL["op5_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * overlap >= 90 * (x.n + y.n - overlap)
), r AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLE_SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS level,
         (SELECT sum(size) FROM d)::DOUBLE * 1.5::DOUBLE AS budget FROM s
), f AS (
  SELECT *,
    level * sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    + coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    <= budget AS is_full
  FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN most ELSE weight * (
      (budget - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())
      / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target
  FROM f
), q AS (
  SELECT d.*, e.epoch, t.source_size, t.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY e.epoch, md5('17-' || e.epoch || '-' || d.doc_id || '-1')
                    ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM d CROSS JOIN (VALUES (0), (1)) e(epoch) JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(sum(least(size, greatest(0, CAST(round(target) AS BIGINT) - ahead))) AS BIGINT) AS taken
FROM q GROUP BY ALL
"""


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))


@_query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.format_digests(given.unionByName(control))


ORACLE_SQL["op8_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(role) + 15 + length(
    regexp_replace(text, '(\\*)(### (?:System|User|Assistant|@[^\s:]*): |</turn>)', '\\\1\2', 'g'))) AS BIGINT)
    AS formatted_chars
FROM rows GROUP BY conv_id
"""


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL["op9_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@_query
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50)


ORACLE_SQL["op10_substring"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS path
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)
), m AS (
  SELECT path, min(doc_id) AS least FROM s GROUP BY path
), g AS (
  SELECT DISTINCT doc_id, i + k AS pos
  FROM (SELECT s.doc_id, s.i FROM s JOIN m USING (path) WHERE s.doc_id > m.least) CROSS JOIN range(50) t(k)
), p AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(r.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS kept
  FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
) k USING (doc_id)
"""


@_query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(_table(spark, sf_dir, "pages"))


@_query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL
), n AS (
  SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM f CROSS JOIN s GROUP BY term, docs
), m AS (
  SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n CROSS JOIN s
), i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM p WHERE score > 0
)
SELECT item_id, CAST(rn AS INTEGER) AS rank, doc_id, score FROM r WHERE rn <= 10
"""


def both_tokenizers() -> tuple[str, str]:
    """The files of the byte-level and the piece vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@_query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(_table(spark, sf_dir, "documents"), both_tokenizers)


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
