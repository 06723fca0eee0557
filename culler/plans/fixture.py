"""Entries and states derived from `orders`, in Spark and in SQL; they reach every branch of the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culler import schemas

def key():
    return F.col("o_orderkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, K = orders(spark, sf_dir), key()
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"))
    o = o.join(first, "o_custkey")
    text = F.lit(None).cast("string")
    id_ = F.concat(F.lit("f"), K)
    return o.select(
        K.alias("line_no"),
        F.when(K == F.col("first_key"), "ASLI").otherwise("DUP").alias("role"),
        F.col("o_custkey").cast("string").alias("grp"),
        id_.alias("id"),
        F.when(K % 53 != 0, F.concat(F.lit("p"), F.col("o_custkey") % 20)).alias("parent"),
        F.lit("exact").alias("match"),
        F.when(K % 41 != 0, F.md5(id_)).alias("b3"),
        F.when(K % 37 != 0, F.floor("o_totalprice").cast("string")).alias("size"),
        text.alias("w"),
        text.alias("h"),
        F.concat(F.lit("order "), K).alias("name"),
    )


def _parents(gone):
    K = key()
    p = F.concat(F.lit("p"), F.col("o_custkey") % 20)
    return F.when(gone, F.array().cast("array<string>")).when(K % 31 == 0, F.array(p, F.lit("pX"))).otherwise(F.array(p))


def state(spark: SparkSession, sf_dir: str, later: bool = False, fatal_at: int | None = None) -> DataFrame:
    """Snapshot of the store; later: as found at execution; fatal_at: the key whose call fails for all."""
    K = key()
    id_, size = F.concat(F.lit("f"), K), F.floor("o_totalprice")
    err = F.when(K % 19 == 0, "fatal:http_404:").when(K % 101 == 0, "fatal:http_403:")
    if later:
        err = F.when(K % 61 == 0, "recoverable:http_500:").otherwise(err)
    if fatal_at is not None:
        err = F.when(K == fatal_at, "fatal_global:http_401:").otherwise(err)
    may = K % 11 != 0
    return orders(spark, sf_dir).select(
        id_.alias("id"),
        err.alias("err"),
        F.concat(F.lit("order "), K).alias("name"),
        _parents((K % 29 == 0) | ((K % 67 == 0) if later else F.lit(False))).alias("parents"),
        (K % 2 == 0).alias("owned_by_me"),
        F.struct(may.alias("can_remove_children"), may.alias("can_edit")).alias("capabilities"),
        F.md5(id_).alias("md5"),
        F.when(K % 47 != 0, F.when(K % 17 == 0, size + 1).otherwise(size).cast("string")).alias("size"),
        (K % 23 == 0).alias("trashed"),
        F.lit("image/jpeg").alias("mime_type"),
        F.lit(None).cast("string").alias("view_link"),
        F.when(K % 43 != 0, F.concat(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))).alias("created_time"),
        F.when(K % 59 != 0, F.when(K % 13 == 0, "changed").otherwise(F.md5(id_))).alias("cur_b3"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).filter(key() % 71 == 0).select(F.concat(F.lit("f"), key()).alias("id"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir, later=True).select("id", F.explode("parents").alias("parent"))


assert schemas.STATUS_LABEL  # the SQL below names the same statuses


def sql(fatal_at: int | None = None) -> str:
    fatal = f"WHEN k = {fatal_at} THEN 'fatal_global:http_401:' " if fatal_at is not None else ""
    return f"""
f AS (SELECT o_orderkey AS k, 'f' || o_orderkey AS id, o_custkey::VARCHAR AS grp, 'p' || (o_custkey % 20) AS p, floor(o_totalprice)::BIGINT AS sz,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'ASLI' ELSE 'DUP' END AS role,
  strftime(o_orderdate::DATE, '%Y-%m-%d') || 'T00:00:00.000Z' AS day FROM orders),
e AS (SELECT k, id, grp, role, CASE WHEN k % 53 <> 0 THEN p END AS parent, CASE WHEN k % 37 <> 0 THEN sz END AS size, CASE WHEN k % 41 <> 0 THEN md5(id) END AS b3, 'order ' || k AS name,
  CASE {fatal}WHEN k % 19 = 0 THEN 'fatal:http_404:' WHEN k % 101 = 0 THEN 'fatal:http_403:' END AS err, k % 23 = 0 AS trashed,
  CASE WHEN k % 29 = 0 THEN 0 WHEN k % 31 = 0 THEN 2 ELSE 1 END AS parents, CASE WHEN k % 47 <> 0 THEN CASE WHEN k % 17 = 0 THEN sz + 1 ELSE sz END END AS cur,
  CASE WHEN k % 59 <> 0 THEN CASE WHEN k % 13 = 0 THEN 'changed' ELSE md5(id) END END AS cur_b3, k % 11 <> 0 AS may, CASE WHEN k % 43 <> 0 THEN day END AS created,
  CASE WHEN k % 61 = 0 THEN 'recoverable:http_500:' WHEN k % 19 = 0 THEN 'fatal:http_404:' WHEN k % 101 = 0 THEN 'fatal:http_403:' END AS err2,
  CASE WHEN k % 29 = 0 OR k % 67 = 0 THEN 0 WHEN k % 31 = 0 THEN 2 ELSE 1 END AS parents2, p AS home FROM f)"""


def verify_sql(strict: bool, fatal_at: int | None = None) -> str:
    unsure = "WHEN b3 IS NULL THEN 'skip_strict_need_b3' WHEN cur_b3 IS NULL THEN 'skip_b3_unavailable' WHEN cur_b3 <> b3 THEN 'skip_changed_b3'" if strict else "WHEN size IS NULL OR cur IS NULL THEN 'skip_unverifiable_need_strict'"
    return f"""{sql(fatal_at)},
v AS (SELECT *, CASE WHEN role = 'ASLI' THEN 'skip_asli' WHEN parent IS NULL THEN 'skip_no_parent_in_report' WHEN err LIKE '%http_404%' THEN 'skip_not_found'
  WHEN err IS NOT NULL THEN 'error_meta:' || err WHEN trashed THEN 'skip_trashed' WHEN parents = 0 THEN 'skip_already_out'
  WHEN size IS NOT NULL AND cur IS NOT NULL AND size <> cur THEN 'skip_changed_size' {unsure} WHEN NOT may THEN 'skip_no_permission' ELSE 'ready' END AS st FROM e),
anchor AS (SELECT DISTINCT grp FROM v WHERE role = 'ASLI' AND parent IS NOT NULL AND err IS NULL AND NOT trashed AND parents > 0 AND NOT (size IS NOT NULL AND cur IS NOT NULL AND size <> cur)),
r AS (SELECT k, row_number() OVER (PARTITION BY grp ORDER BY coalesce(created, '{schemas.NEVER}'), id, k) AS rn FROM v WHERE st = 'ready' AND grp NOT IN (SELECT grp FROM anchor)),
p AS (SELECT v.*, CASE WHEN r.rn = 1 THEN 'skip_group_survivor' ELSE st END AS status FROM v LEFT JOIN r USING (k))"""


def execute_sql() -> str:
    return f"""{verify_sql(False)},
x AS (SELECT k, grp, id, parent, name, home, parents2, CASE WHEN k % 71 = 0 THEN 'resumed' WHEN err2 IS NOT NULL THEN 'error_remove:meta ' || err2 WHEN parents2 = 0 THEN 'skip_already_out'
  WHEN parents2 = 2 THEN 'skip_multi_parent' ELSE 'removed' END AS result FROM p WHERE status = 'ready')"""


def updates(spark: SparkSession, sf_dir: str, fatal_at: int | None = None) -> DataFrame:
    """What the store said to removals: some fail for a while, and one for all."""
    K = key()
    err = F.when(K % 83 == 0, "recoverable:http_503:busy")
    if fatal_at is not None:
        err = F.when(K == fatal_at, "fatal_global:http_403:quotaExceeded").otherwise(err)
    return orders(spark, sf_dir).select(F.concat(F.lit("f"), K).alias("id"), F.concat(F.lit("p"), F.col("o_custkey") % 20).alias("parent"), err.alias("err")).filter("err IS NOT NULL")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, attempts): key % 7 passing failures (of every third key exceptions), then success, or an error for good."""
    K, none = key(), F.lit(None).cast("string")
    passing = F.when(K % 3 == 0, F.struct(F.lit(None).cast("int").alias("code"), none.alias("reason"), F.lit("timeout").alias("exc"))).otherwise(F.struct(F.lit(503).alias("code"), F.lit("busy").alias("reason"), none.alias("exc")))
    end = F.struct(F.when(K % 5 >= 3, 404).alias("code"), F.when(K % 5 >= 3, "gone").alias("reason"), none.alias("exc"))
    return orders(spark, sf_dir).select(K.alias("k"), F.concat(F.array_repeat(passing, (K % 7).cast("int")), F.array(end)).alias("attempts"))


COPY = 1_000_000_000  # ids of the copies that the detection has to find


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, every seventh faint, and a copy of each: two neighbours exchanged in every third, the others brighter."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    e = e.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, x * 0.0625).otherwise(x)))
    v = F.col("embedding")
    swapped = F.concat(F.slice(v, 1, 9), F.array(v[10], v[9]), F.slice(v, 12, 1000))
    copy = e.select((F.col("vec_id") + COPY).alias("vec_id"), F.when(F.col("vec_id") % 3 == 0, swapped).otherwise(F.transform(v, lambda x: x * 1.125)).alias("embedding"))
    return e.unionByName(copy)


VECTORS = f"""e0 AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 0.0625) ELSE embedding::DOUBLE[] END AS v FROM embeddings),
e AS (SELECT vec_id, v FROM e0 UNION ALL SELECT vec_id + {COPY}, CASE WHEN vec_id % 3 = 0 THEN v[1:9] || [v[11], v[10]] || v[12:] ELSE list_transform(v, lambda x: x * 1.125) END FROM e0)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations, and a copy of each conversation: some without later turns, some with other texts in between."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    other = F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 3 == 0), F.concat(F.lit("x "), "text")).otherwise(F.col("text"))
    return c.unionByName(c.filter("conv_id % 4 > 0 OR turn < 3").select((F.col("conv_id") + COPY).alias("conv_id"), "turn", other.alias("text")))


CLIPS = f"t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id + {COPY}, turn, CASE WHEN turn > 0 AND (conv_id + turn) % 3 = 0 THEN 'x ' || text ELSE text END FROM conversations WHERE conv_id % 4 > 0 OR turn < 3)"
