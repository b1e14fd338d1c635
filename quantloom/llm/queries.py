"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, common, html_text, jaccard, katz, packing, quality, roles, sstable, topk, toxicity, tput, vector_packing

Query = Callable[[SparkSession, str], DataFrame]


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10).drop("evaluated")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 5 is not 1, and scores every row."""
    return katz.katz_scores(common.table(spark, sf_dir, "documents"), common.crc32_mod("doc_id", 5) != 1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(common.table(spark, sf_dir, "documents"))


def op4_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "sstables")
    sstable.write_tables(common.table(spark, sf_dir, "documents"), path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return sstable.read_tables(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(common.table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode, then decode of its ids, each whole text; only digests leave the task."""
    vocabulary = "byte_bpe_50k.json"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(vocabulary)
        decimal = np.array([str(i) for i in range(coder.merges.size)], object)
        for batch in common.chunks(batches, "text"):
            offsets, ids = coder.encode(batch.column("text"))
            words = decimal[ids].tolist()
            of_ids = [hashlib.sha256(",".join(words[a:b]).encode()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            of_text = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(offsets, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, and scores every row."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.crc32_mod("doc_id", 4) == 2
    model = toxicity.sample_and_train(docs, labels, ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op10_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.repair(common.table(spark, sf_dir, "conversations"))


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=10)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of a document bear loss; at most 64 pieces in a sequence."""
    return vector_packing.pack(common.table(spark, sf_dir, "documents"), size=4096, max_segments=64)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents"), least=100, most=5, top=2000)


QUERIES: dict[str, Query] = {
    "op1_pivot_top_k": op1_pivot_top_k,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_quality_rules": op3_quality_rules,
    "op4_sstable_shards": op4_sstable_shards,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_block_rules": op7_block_rules,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_crf_toxicity": op9_crf_toxicity,
    "op10_role_repair": op10_role_repair,
    "op11_tput_search": op11_tput_search,
    "op12_vector_packing": op12_vector_packing,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_pivot_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10""",
    "op3_quality_rules": quality.oracle_sql(),
    "op5_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    "op11_tput_search": """
WITH term AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS t
  FROM documents WHERE text IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM term GROUP BY 1), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY 1, 2),
idf AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY 1),
asked AS (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS t
  FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN idf USING (t) JOIN tf USING (t) JOIN n USING (doc_id), total GROUP BY 1, 2
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_collocations": """
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), g AS (
  SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w), (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE i + k - 1 <= len(ws)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
cut AS (
  SELECT lang, k, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS x, array_to_string(string_split(phrase, ' ')[c+1:k], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM f WHERE k > 1)
), s AS (
  SELECT cut.lang, cut.k, cut.phrase, cut.a, p.a AS l, q.a AS r, n.n, ((1000::HUGEINT * cut.a * n.n) // (p.a::HUGEINT * q.a))::BIGINT AS score, c
  FROM cut JOIN f p ON p.lang = cut.lang AND p.phrase = x JOIN f q ON q.lang = cut.lang AND q.phrase = y JOIN n ON n.lang = cut.lang
), low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i+m-1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM f WHERE k > 2)) GROUP BY 1, 2
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 100 * a
) WHERE rank <= 2000""",
}
