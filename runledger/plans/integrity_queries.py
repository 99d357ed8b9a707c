"""Payload integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import integrity as I
from runledger.plans import views as V
from runledger.plans.registry import query
from runledger.sources.objects import split_composite_id

SIZE = 1000

_CHUNKS = f"""
    SELECT checkpoint_id, shard_id, o AS "offset", octet_length(payload) AS n, hex(payload) AS h,
           hex(payload)[o * 2 + 1 : (o + {SIZE}) * 2] AS part, o + {SIZE} >= octet_length(payload) AS is_last
    FROM (SELECT *, unnest(range(0, octet_length(payload), {SIZE})) AS o FROM payloads)"""
_KEYS = """
    SELECT run_id || '/' || checkpoint_id || '/sha256-' || sha256(payload)[1:16] || '-' || shard_id || '.bin' AS key,
           run_id || '/' || checkpoint_id || '/' || shard_id || '.sha256' AS sidecar, shard_id FROM payloads"""
_LATEST = """
    SELECT checkpoint_id, shard_id, arg_max(size_bytes, (uploaded_at, part_no, host_no, size_bytes)) AS size_bytes,
           arg_max(sha256, (uploaded_at, part_no, host_no, size_bytes)) AS sha256, max(uploaded_at) AS uploaded_at,
           count(*) - 1 AS superseded FROM shards GROUP BY checkpoint_id, shard_id"""


def _chunks(spark, d):
    return I.chunk_payload(V.payloads(spark, d).select("checkpoint_id", "shard_id", "payload"), "payload", SIZE)


def plain_latest(spark, d, of=None):
    """Newest uploads as ``plain_shards``; names stand for ranks, so that digests can follow later. ``of``: the checkpoints (checkpoint_id) that count, else all."""
    plain = V.plain_shards(spark, d)
    shards = V.named_shards(plain if of is None else plain.join(of, "checkpoint_id", "left_semi")).drop("sha256")
    return I.latest_shard_upload(shards, ["part_no", "host_no", "size_bytes"])


def latest(spark, d):
    return V.named_shards(plain_latest(spark, d)).select(
        "checkpoint_id", "shard_id", "size_bytes", "sha256", "uploaded_at", "part_no", "host_no", "superseded"
    )


@query(
    "I01_chunk_payload",
    f"""SELECT checkpoint_id, shard_id, "offset", octet_length(unhex(part)) AS n_bytes, sha256(unhex(part)) AS sha256, is_last
        FROM ({_CHUNKS})""",
)
def chunk_payload(spark, d):
    return I.add_digest(_chunks(spark, d), "data").drop("data")


@query(
    "I02_assemble_chunks",
    f"""SELECT checkpoint_id, shard_id, "offset" // 1073741824 AS piece,
               sha256(unhex(string_agg(part, '' ORDER BY "offset"))) AS sha256,
               CAST(sum(sum(octet_length(unhex(part)))) OVER whole AS BIGINT) AS total_bytes,
               CAST(sum(count(*)) OVER whole AS BIGINT) AS n_chunks
        FROM ({_CHUNKS}) GROUP BY checkpoint_id, shard_id, "offset" // 1073741824
        WINDOW whole AS (PARTITION BY checkpoint_id, shard_id)""",
)
def assemble_chunks(spark, d):
    return I.add_digest(I.assemble_chunks(_chunks(spark, d))).drop("payload", "n_bytes")


def _damaged(spark, d):
    """Toxic documents lost their second chunk, and those of low quality misreport their lengths."""
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("shard_id"), "quality", "toxic")
    lost = F.coalesce((F.col("toxic") == 1) & (F.col("offset") == SIZE), F.lit(False))
    return (
        _chunks(spark, d)
        .withColumn("n_bytes", F.octet_length("data").cast("long"))
        .join(labels, "shard_id", "left")
        .where(~lost)
        .select(
            "checkpoint_id", "shard_id", "offset", "is_last",
            (F.col("n_bytes") + F.when(F.col("quality") == 0, 7).otherwise(0)).alias("n_bytes"),
        )
    )


@query(
    "I03_check_chunk_sequence",
    f"""WITH k AS (SELECT checkpoint_id, shard_id, "offset", is_last,
                          octet_length(unhex(part)) + CASE WHEN quality = 0 THEN 7 ELSE 0 END AS n
                   FROM ({_CHUNKS}) LEFT JOIN (SELECT doc_id AS shard_id, quality, toxic FROM labels) USING (shard_id)
                   WHERE NOT coalesce(toxic = 1 AND "offset" = {SIZE}, false)),
            o AS (SELECT *, coalesce(lag("offset" + n) OVER w, 0) AS expected, lead("offset") OVER w AS nxt FROM k
                  WINDOW w AS (PARTITION BY checkpoint_id, shard_id ORDER BY "offset")),
            g AS (SELECT checkpoint_id, shard_id, count(*) AS n_chunks, count(*) FILTER ("offset" > expected) AS gaps,
                  count(*) FILTER ("offset" < expected) AS "overlaps", count(*) FILTER (is_last) AS last_flags,
                  count(*) FILTER (is_last AND nxt IS NULL) AS closed FROM o GROUP BY 1, 2)
        SELECT checkpoint_id, shard_id, n_chunks, gaps, "overlaps", last_flags, CASE WHEN gaps > 0 THEN 'gap' WHEN "overlaps" > 0
               THEN 'overlap' WHEN last_flags = 0 THEN 'missing_last' WHEN last_flags > 1 THEN 'multiple_last'
               WHEN closed = 0 THEN 'last_not_final' ELSE 'ok' END AS verdict FROM g""",
)
def check_chunk_sequence(spark, d):
    return I.check_chunk_sequence(_damaged(spark, d), 64 * SIZE)


@query("I04_add_digest", "SELECT shard_id, sha256(payload) AS sha256, octet_length(payload) AS n_bytes FROM payloads")
def add_digest(spark, d):
    return I.add_digest(V.payloads(spark, d)).select("shard_id", "sha256", "n_bytes")


@query("I05_content_key", f"SELECT shard_id, key FROM ({_KEYS})")
def content_key(spark, d):
    digested = I.add_digest(V.payloads(spark, d))
    return digested.select("shard_id", I.content_key(*[F.col(c) for c in ("run_id", "checkpoint_id", "shard_id", "sha256")]).alias("key"))


@query(
    "I06_plan_uploads",
    f"""SELECT DISTINCT key, 'shard' AS kind FROM ({_KEYS}) WHERE shard_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT DISTINCT sidecar, 'checksum' FROM ({_KEYS})""",
)
def plan_uploads(spark, d):
    digested = I.add_digest(V.payloads(spark, d)).drop("payload")
    labelled = V.table(spark, d, "labels").select(F.col("doc_id").alias("shard_id"))
    stored = digested.join(labelled, "shard_id", "left_semi").select(
        I.content_key(*[F.col(c) for c in ("run_id", "checkpoint_id", "shard_id", "sha256")]).alias("key")
    )
    return I.plan_uploads(digested, stored)


@query(
    "I07_dedup_report",
    """SELECT sha256(payload) AS sha256, count(*) AS copies, max(octet_length(payload)) AS n_bytes,
              CAST(sum(octet_length(payload)) - max(octet_length(payload)) AS BIGINT) AS saved_bytes FROM payloads GROUP BY 1""",
)
def dedup_report(spark, d):
    return I.dedup_report(I.add_digest(V.payloads(spark, d)).drop("payload"))


@query(
    "I08_verify_shards",
    """WITH s AS (SELECT checkpoint_id, shard_id, CASE checkpoint_id WHEN 'de' THEN encode(text || 'x') WHEN 'fr' THEN encode(reverse(text))
                   ELSE payload END AS payload
                  FROM payloads JOIN (SELECT doc_id AS shard_id, text FROM documents) USING (shard_id)
                  WHERE shard_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
            m AS (SELECT checkpoint_id, shard_id, sha256(payload) AS listed, octet_length(payload) AS size FROM payloads
                  WHERE size >= 300),
            n AS (SELECT checkpoint_id, shard_id, sha256(payload) AS noted FROM payloads
                  WHERE shard_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
       SELECT checkpoint_id, shard_id, CASE WHEN listed IS NULL AND payload IS NULL THEN 'orphan_sidecar' WHEN listed IS NULL THEN 'unlisted' WHEN payload IS NULL THEN 'missing_object'
              WHEN octet_length(payload) <> m.size THEN 'size_mismatch' WHEN sha256(payload) <> listed THEN 'digest_mismatch'
              WHEN noted IS NULL THEN 'missing_sidecar' WHEN sha256(payload) <> noted THEN 'digest_mismatch' ELSE 'ok' END AS status
       FROM m FULL JOIN s USING (checkpoint_id, shard_id) FULL JOIN n USING (checkpoint_id, shard_id)""",
)
def verify_shards(spark, d):
    payloads = V.payloads(spark, d)
    labels = V.table(spark, d, "labels")

    def labelled(quality: int):
        return labels.where(F.col("quality") == quality).select(F.col("doc_id").alias("shard_id"))

    text = F.decode("payload", "UTF-8")
    stored = payloads.join(labelled(0), "shard_id", "left_anti").withColumn(
        "payload",
        F.when(F.col("checkpoint_id") == "de", F.encode(F.concat(text, F.lit("x")), "UTF-8"))
        .when(F.col("checkpoint_id") == "fr", F.encode(F.reverse(text), "UTF-8"))
        .otherwise(F.col("payload")),
    )
    digested = I.add_digest(payloads)
    manifest = digested.where("size >= 300").select("checkpoint_id", "shard_id", "sha256", F.col("n_bytes").alias("size_bytes"))
    sidecars = digested.join(labelled(1), "shard_id", "left_anti").select("checkpoint_id", "shard_id", "sha256")
    return I.verify_shards(stored, manifest, sidecars)


@query(
    "I09_audit_manifests",
    """WITH a AS (SELECT checkpoint_id, count(*) AS actual_shards, CAST(sum(size_bytes) AS BIGINT) AS actual_bytes FROM shards GROUP BY 1)
       SELECT checkpoint_id, checkpoint_id % 7 + 1 AS num_shards, total_bytes, coalesce(actual_shards, -1) AS actual_shards,
              coalesce(actual_bytes, -1) AS actual_bytes,
              CASE WHEN actual_shards IS NULL THEN 'no_shards'
                   WHEN checkpoint_id % 7 + 1 = actual_shards AND total_bytes = actual_bytes THEN 'ok'
                   WHEN total_bytes = actual_bytes THEN 'count_mismatch'
                   WHEN checkpoint_id % 7 + 1 = actual_shards THEN 'bytes_mismatch' ELSE 'both_mismatch' END AS verdict
       FROM checkpoints LEFT JOIN a USING (checkpoint_id)""",
)
def audit_manifests(spark, d):
    declared = V.checkpoints(spark, d).withColumn("num_shards", F.col("checkpoint_id") % 7 + 1)
    return I.audit_manifests(declared, V.shards(spark, d)).na.fill(-1, ["num_shards", "total_bytes", "actual_shards", "actual_bytes"])


@query("I10_latest_shard_upload", _LATEST)
def latest_shard_upload(spark, d):
    return latest(spark, d).drop("part_no", "host_no")


@query(
    "I11_split_composite_id",
    """SELECT id, CASE WHEN instr(id, '/') > 0 THEN split_part(id, '/', 1) ELSE id END AS run_id,
              CASE WHEN instr(id, '/') > 0 THEN substr(id, instr(id, '/') + 1) ELSE id END AS checkpoint_id
       FROM (SELECT key AS id FROM objects UNION ALL SELECT name FROM runs)""",
)
def split_composite(spark, d):
    ids = V.objects(spark, d).select(F.col("key").alias("id")).unionByName(V.runs(spark, d).select(F.col("name").alias("id")))
    return split_composite_id(ids, "id")


@query(
    "I12_shard_status",
    f"""SELECT q.checkpoint_id, q.shard_id, l.sha256 IS NOT NULL AS is_present, coalesce(l.size_bytes, 0) AS size_bytes,
               coalesce(l.sha256, '') AS sha256
        FROM (SELECT checkpoint_id, 'rank-' || (checkpoint_id % 7 + 1) AS shard_id FROM checkpoints) q
        LEFT JOIN ({_LATEST}) l USING (checkpoint_id, shard_id)""",
)
def shard_status(spark, d):
    asked = V.checkpoints(spark, d).select(
        "checkpoint_id", F.concat(F.lit("rank-"), F.col("checkpoint_id") % 7 + 1).alias("shard_id")
    )
    return I.shard_status(asked, latest(spark, d))
