"""Dataset splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import datasets as D
from runledger.plans import views as V
from runledger.plans.registry import query

N = 7
_ORDERED = "SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents"
_ASSIGNED = f"""
    SELECT 'FULL_REPLICATION' AS policy, doc_id, n_chars, CAST(unnest(range(0, {N})) AS INTEGER) AS shard FROM documents UNION ALL
    SELECT 'RANGE_SHARDING', doc_id, n_chars, CAST(o * {N} // n AS INTEGER) FROM ({_ORDERED}) UNION ALL
    SELECT 'HASH_SHARDING', doc_id, n_chars, CAST(CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % {N} AS INTEGER) FROM documents UNION ALL
    SELECT 'ROUND_ROBIN', doc_id, n_chars, CAST(o % {N} AS INTEGER) FROM ({_ORDERED})"""


def _assigned(spark, d, policy):
    docs = V.documents(spark, d).select("doc_id", "n_chars")
    return D.assign_shards(docs, N, policy, "doc_id").withColumn("policy", F.lit(policy))


def _all_policies(spark, d):
    parts = [_assigned(spark, d, p) for p in D.SHARDING_POLICIES]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("D01_assign_shards", _ASSIGNED)
def assign_shards(spark, d):
    return _all_policies(spark, d)


@query(
    "D02_shard_balance",
    f"""SELECT policy, count(*) AS n_shards, min(r) AS min_n_rows, max(r) AS max_n_rows, sum(r) / count(*) AS mean_n_rows,
               max(r) * count(*) / CAST(sum(r) AS DOUBLE) AS skew_n_rows, min(b) AS min_n_bytes, max(b) AS max_n_bytes,
               sum(b) / count(*) AS mean_n_bytes, max(b) * count(*) / CAST(sum(b) AS DOUBLE) AS skew_n_bytes
        FROM (SELECT policy, shard, count(*) AS r, CAST(sum(n_chars) AS BIGINT) AS b FROM ({_ASSIGNED}) GROUP BY 1, 2) GROUP BY policy""",
)
def shard_balance(spark, d):
    out = None
    for policy in D.SHARDING_POLICIES:
        row = D.shard_balance(_assigned(spark, d, policy), "n_chars").withColumn("policy", F.lit(policy))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "D03_dataset_slice",
    f"""WITH s AS (SELECT *, CAST(ceil(n * 2 / 7) AS BIGINT) AS a, CAST(ceil(n * 3 / 7) AS BIGINT) AS z FROM ({_ORDERED}))
        SELECT doc_id, source, o - a AS position, o = z - 1 AS is_last FROM s WHERE o >= a + 10 AND o < z""",
)
def dataset_slice(spark, d):
    return D.dataset_slice(V.documents(spark, d).select("doc_id", "source"), "doc_id", 2, 7, offset=10)


@query("D04_global_ordinal", f"SELECT doc_id, o AS ordinal, n AS n_rows FROM ({_ORDERED})")
def global_ordinal(spark, d):
    return D.global_ordinal(V.documents(spark, d).select("doc_id"), ["doc_id"], D.key_slice("doc_id", 256))


@query(
    "D05_make_batches",
    """SELECT doc_id, o // 32 AS batch, o % 32 AS place FROM (
         SELECT doc_id, row_number() OVER (ORDER BY sha256('17|' || doc_id), doc_id) - 1 AS o, count(*) OVER () AS n FROM documents)
       WHERE o // 32 < n // 32""",
)
def make_batches(spark, d):
    return D.make_batches(V.documents(spark, d).select("doc_id"), "doc_id", 32, seed=17)


@query(
    "D07_loss_curve",
    """WITH b AS (SELECT run_id, (step - 1) // 50 AS block, count(*) AS n, max(step) AS step, avg(loss) AS m, max(ts) AS until,
                  min(ts) AS since, min(step) AS first FROM train_steps GROUP BY 1, 2),
            s AS (SELECT run_id, min(since) AS start, min(first) AS step0 FROM b GROUP BY 1)
       SELECT run_id, step, round(m, 6) AS mean_loss,
              round((step - step0 + 1) / ((epoch_us(until) - epoch_us(start)) / 1000000.0::DOUBLE), 9) AS steps_per_s
       FROM b JOIN s USING (run_id) WHERE n = 50""",
)
def loss_curve(spark, d):
    curve = D.loss_curve(V.train_steps(spark, d))
    return curve.withColumns({"mean_loss": F.round("mean_loss", 6), "steps_per_s": F.round("steps_per_s", 9)})


def dataset_requests(spark, d):
    lang = F.col("lang")
    return V.documents(spark, d).select(
        F.concat_ws("-", "source", "lang").alias("dataset_id"),
        F.when(lang == "en", F.concat(F.lit("s3://data/"), "source")).alias("uri"),
        F.when(lang == "en", "HASH_SHARDING").when(lang == "de", "CUSTOM").alias("sharding_policy"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "n_chars",
    ).groupBy("dataset_id", "uri", "sharding_policy").agg(F.sum("n_chars").alias("total_size_bytes")).withColumn(
        "metadata", F.lit(None).cast("map<string,string>")
    )


REQUESTS_SQL = """
    SELECT source || '-' || lang AS dataset_id, CASE WHEN lang = 'en' THEN 's3://data/' || source ELSE '' END AS uri,
           CASE lang WHEN 'en' THEN 'HASH_SHARDING' WHEN 'de' THEN 'CUSTOM' ELSE 'RANGE_SHARDING' END AS sharding_policy,
           CAST(sum(n_chars) AS BIGINT) AS total_size_bytes FROM documents GROUP BY ALL"""


@query("D08_register_datasets", f"SELECT * FROM ({REQUESTS_SQL}) WHERE sharding_policy <> 'CUSTOM'")
def register_datasets(spark, d):
    return D.register_datasets(dataset_requests(spark, d))[0].drop("metadata")


@query("D08_rejected_datasets", f"SELECT * FROM ({REQUESTS_SQL}) WHERE sharding_policy = 'CUSTOM'")
def rejected_datasets(spark, d):
    return D.register_datasets(dataset_requests(spark, d))[1].drop("metadata")
