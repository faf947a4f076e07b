"""Data-quality check queries: each returns violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.operators import checks as C
from platewright.operators import metrics as M
from platewright.operators.stability import scratch_path, stable
from platewright.plans import views as V
from platewright.plans.metric_queries import metrics_sql
from platewright.plans.registry import query
from platewright.sources import tables as S


@query(
    "chk_1",
    """SELECT c AS "column", (SELECT count(*) FROM part) AS n_rows FROM (VALUES ('p_missing'), ('p_other')) AS t(c)""",
)
def chk_1(spark, sf):
    part = V.table(spark, sf, "part")
    gone = C.missing_columns(part, ["p_partkey", "p_missing", "p_size", "p_other"])
    return gone.withColumn("n_rows", part.agg(F.count(F.lit(1))).scalar())


@query(
    "chk_2",
    """SELECT k, count(*) AS n, CASE WHEN k IS NULL THEN 'null' ELSE 'duplicate' END AS problem FROM
    (SELECT CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS k FROM orders) GROUP BY 1 HAVING k IS NULL OR count(*) > 1""",
)
def chk_2(spark, sf):
    k = F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("k")
    return C.key_violations(V.table(spark, sf, "orders").select(k), ["k"])


@query("chk_3", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_full_match(p_name, '[A-Za-z0-9_-]+')")
def chk_3(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", "p_name")
    return C.pattern_violations(part, "p_name", "[A-Za-z0-9_-]+")


@query(
    "chk_4",
    """SELECT 'a' AS "column", count(*) AS n_text, count_if(k > 90)::BIGINT AS n_unparsed, 0::BIGINT AS n_infinite FROM v_well WHERE k >= 5
    UNION ALL SELECT 'b', count(*), 0, count_if(k <= 10)::BIGINT FROM v_well""",
)
def chk_4(spark, sf):
    w = V.wells(spark, sf)
    k = F.col("k").cast("string")
    texts = w.select(
        F.when(F.col("k") < 5, "").when(F.col("k") > 90, F.concat(k, F.lit("x"))).otherwise(
            F.concat(k, F.lit(",5"))
        ).alias("a"),
        F.when(F.col("k") <= 10, "Infinity").otherwise(k).alias("b"),
    )
    return C.numeric_parse_audit(texts, ["a", "b"])


@query(
    "chk_5",
    "SELECT variant_id FROM (SELECT l_orderkey AS variant_id, CASE WHEN l_linenumber > 2 THEN l_quantity END AS value FROM lineitem) GROUP BY 1 HAVING count(value) = 0",
)
def chk_5(spark, sf):
    line = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("variant_id"),
        F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("value"),
    )
    return C.without_measurement(line, "variant_id", "value")


@query("chk_6", "SELECT vec_id FROM embeddings WHERE vec_id % 9 IN (0, 4) OR vec_id % 50 = 7")
def chk_6(spark, sf):
    """Planted NULL, NaN and infinite entries must all be found."""
    bad = (
        F.when(F.col("vec_id") % 9 == 0, F.lit(float("nan")))
        .when(F.col("vec_id") % 9 == 4, F.lit(float("-inf")))
        .when(F.col("vec_id") % 50 == 7, F.lit(None))
        .otherwise(F.lit(0.0))
    )
    vec = F.concat(F.col("embedding").cast("array<double>"), F.array(bad))
    planted = V.table(spark, sf, "embeddings").select("vec_id", vec.alias("vec"))
    return C.bad_vectors(planted, "vec").select("vec_id")


@query("chk_7", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) < 5")
def chk_7(spark, sf):
    return C.small_groups(V.table(spark, sf, "lineitem"), ["l_orderkey"], 5)


@query("chk_8", "SELECT DISTINCT l_partkey + l_linenumber AS p_partkey FROM lineitem WHERE l_partkey + l_linenumber NOT IN (SELECT p_partkey FROM part)")
def chk_8(spark, sf):
    asked = V.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") + F.col("l_linenumber")).alias("p_partkey")
    )
    return C.unknown_ids(asked, V.table(spark, sf, "part"), "p_partkey")


@query(
    "chk_9",
    """SELECT model, count(*) AS n_rows, count(DISTINCT key) AS n_keys, (SELECT count(DISTINCT key) FROM v_pred) - count(DISTINCT key) AS n_missing,
    (SELECT count(DISTINCT key) FROM v_pred) = count(DISTINCT key) AND count(*) = count(DISTINCT key) AS complete FROM v_pred GROUP BY 1""",
)
def chk_9(spark, sf):
    return C.model_coverage(V.predictions(spark, sf), "model", "key")


@query(
    "chk_10",
    """SELECT model, max(abs(observed - round(observed, 1))) AS max_difference, max(abs(observed - round(observed, 1))) <= 1e-10 AS agrees
    FROM v_pred GROUP BY 1""",
    "max_difference",
)
def chk_10(spark, sf):
    p = V.predictions(spark, sf)
    truth = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.round(F.col("o_totalprice") / F.lit(1000.0), 1).alias("observed"),
    )
    return C.agreement(p, truth, ["key"], ["model"], "observed", 1e-10)


@query(
    "chk_11",
    """SELECT candidate_id, lower(array_to_string(pocket, '')) || (CASE WHEN m1 % 5 = 0 THEN 'x' ELSE ' ' END) AS declared FROM v_cand WHERE m1 % 5 = 0""",
)
def chk_11(spark, sf):
    c = V.candidates(spark, sf)
    tail = F.when(F.col("m1") % 5 == 0, "x").otherwise(" ")
    declared = c.withColumn("declared", F.concat(F.lower(F.array_join("pocket", "")), tail))
    return C.mismatches(declared, F.col("declared"), F.array_join("pocket", "")).select(
        "candidate_id", "declared"
    )


@query("chk_12", "SELECT model, key, predicted - 100 AS observed FROM v_pred WHERE predicted - 100 <= 0", "observed")
def chk_12(spark, sf):
    p = V.predictions(spark, sf).select("model", "key", (F.col("predicted") - 100).alias("observed"))
    return C.non_positive(p, "observed")


_NUMS = """SELECT model || '.' || stat AS name, num FROM (UNPIVOT (SELECT model, mae, rmse, r2, pearson FROM ({m})) ON mae, rmse, r2, pearson INTO NAME stat VALUE num)"""


@query(
    "chk_13",
    f"""WITH a AS ({_NUMS.format(m=metrics_sql())}), b AS ({_NUMS.format(m=metrics_sql('(SELECT * FROM v_pred WHERE mutation_order > 0)'))})
    SELECT name, a.num AS value, b.num AS reference, CASE WHEN a.num IS NULL THEN 'missing' WHEN b.num IS NULL THEN 'new'
    WHEN abs(a.num - b.num) > 0.01 * greatest(1, abs(b.num)) THEN 'FAIL' ELSE 'PASS' END AS status
    FROM (SELECT * FROM a WHERE name <> 'A.r2') a FULL JOIN (SELECT * FROM b WHERE name <> 'R.mae') b USING (name)""",
    "value reference",
)
def chk_13(spark, sf):
    p = V.predictions(spark, sf)
    stats = ["mae", "rmse", "r2", "pearson"]
    now = M.long_values(M.regression_metrics(p, ["model"]), ["model"], stats)
    saved = M.long_values(
        M.regression_metrics(p.where(F.col("mutation_order") > 0), ["model"]), ["model"], stats
    )
    return C.drift(now.where(F.col("name") != "A.r2"), saved.where(F.col("name") != "R.mae"), 0.01)


@query(
    "chk_14",
    """SELECT 'left_only' AS side, vec_id FROM embeddings WHERE label < 5 AND vec_id < 100 UNION ALL
    SELECT 'right_only', vec_id FROM embeddings WHERE label >= 5 AND vec_id >= 100""",
)
def chk_14(spark, sf):
    from platewright.operators.reshape import one_sided_keys

    e = V.table(spark, sf, "embeddings")
    a = e.where((F.col("label") >= 5) | (F.col("vec_id") < 100)).where(
        (F.col("label") < 5) | (F.col("vec_id") < 100)
    )
    b = e.where(F.col("label") >= 5)
    return one_sided_keys(a, b, ["vec_id"])


@query(
    "chk_15",
    """SELECT * FROM (VALUES ('altered', FALSE, TRUE), ('gone', FALSE, FALSE), ('kept', TRUE, TRUE), ('new', FALSE, TRUE))
    AS t(name, ok, hashed)""",
)
def chk_15(spark, sf):
    """Stored checksums against files: one file changed since, one is gone, one is not expected, one is as it was.

    Whole files are hashed as rows of the binary source, which takes files up to 2 GB.
    """
    part = V.table(spark, sf, "part")
    path = scratch_path(spark, "checksums")

    def write(name, rows):
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    def files():
        found = spark.read.format("binaryFile").load(f"{path}/*/part-*.parquet")
        return found.withColumn("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))

    for name in ("altered", "gone", "kept"):
        write(name, part)
    stored = stable(files().select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256")))
    write("altered", part.withColumn("p_size", F.col("p_size") + 1))
    write("new", part)
    audit = C.checksum_audit(files().where(F.col("path") != "gone"), stored)
    return audit.select("name", "ok", (F.coalesce(F.length("actual"), F.lit(0)) == 64).alias("hashed"))


@query(
    "joi_12",
    """SELECT count(*) AS n, (SELECT count(*) FROM orders) AS n_left, TRUE AS one_to_one FROM orders JOIN
    (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def joi_12(spark, sf):
    from platewright.operators.relate import one_to_one

    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    lines = (
        V.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
    joined, ok = one_to_one(orders, lines, ["key"])
    n_left = orders.agg(F.count(F.lit(1))).scalar()
    return joined.agg(F.count(F.lit(1)).alias("n")).withColumn("n_left", n_left).withColumn("one_to_one", ok)


