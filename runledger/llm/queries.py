"""The named queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bpe, embeddings, exact, langid, mixing, quality, runs, sharding, simhash, spelling, suffixes, toxicity, urlfilter
from runledger.llm.common import id_remainder, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
SLOTS = 65_537
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder(5) == 0
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, net, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", toxicity.predicted().cast("int").alias("predicted")
    )


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, keep=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder(5) == 0
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder(4) == 2
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, net, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", quality.accepted().cast("int").alias("predicted")
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.word_runs(table(spark, sf_dir, "documents"), repeat=True)


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents"), every=spelling.DAMAGE))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_suffix_dedup, op3_toxicity, op4_bpe_roundtrip, op5_language, op6_exact_dedup,
        op7_embedding_dedup, op8_sharding, op9_quality, op10_mix_sources,
        op11_word_runs, op12_url_filter, op13_spelling_variants,
    )
}

EXACT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), ranked AS (
  SELECT doc_id, bare,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(body) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY bare) AS group_size
  FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked
"""

EMBEDDING_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
), roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.x = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""


def _sharding_sql() -> str:
    """The lookup table stands as one text; its filling is tested against a plain replay in the tests."""
    filled = ",".join(map(str, sharding.lookup_table(SHARDS, SLOTS)))
    return f"""
WITH filled AS (SELECT string_split('{filled}', ',') AS shards),
slots AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot
  FROM documents
)
SELECT doc_id, slot, 'shard-' || lpad(shards[slot + 1], 3, '0') AS shard FROM slots, filled
"""


def _draw_sql(seed: str) -> str:
    name = f"{seed} || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_key || ':' || nth"
    return f"CAST('0x' || substr(md5({name}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0"


MIXING_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(text, '')) AS text_key, row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS nth
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM sizes GROUP BY source
), capped AS (SELECT *, source_size::DOUBLE * 3 AS most FROM totals),
running AS (
  SELECT *,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0.0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM capped
  WINDOW before AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), share AS (SELECT min_by(level, most / weight) AS share FROM running WHERE level * weight <= most),
targets AS (
  SELECT source, source_size, least(most, coalesce(share * weight, most)) AS target,
    CASE WHEN source_size > 0 THEN least(most, coalesce(share * weight, most)) / source_size ELSE 0.0 END AS rate
  FROM running, share
), rated AS (
  SELECT s.doc_id, s.size, s.text_key, s.nth, t.* FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), seeds AS (
  SELECT source, k, abs(sum(size * (floor(rate) + ({_draw_sql('k')} < rate - floor(rate))::INT)::BIGINT) - first(target)) AS off
  FROM rated, range(16) r(k) GROUP BY source, k
), chosen AS (SELECT source, arg_min(k, (off, k)) AS k FROM seeds GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
  (r.size * (floor(rate) + ({_draw_sql('c.k')} < rate - floor(rate))::INT)::BIGINT)::BIGINT AS taken
FROM rated r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source
"""

ORACLES = {
    "op6_exact_dedup": EXACT_SQL,
    "op7_embedding_dedup": EMBEDDING_SQL,
    "op8_sharding": _sharding_sql(),
    "op10_mix_sources": MIXING_SQL,
}
