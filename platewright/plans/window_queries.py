"""Window, top-k, set, reshape and filter queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewright.operators import folds, metrics as M, ranking as R, reshape as S
from platewright.plans import views as V
from platewright.plans.metric_queries import metrics_sql
from platewright.plans.registry import query


@query(
    "win_1",
    """SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank,
    row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS global_rank FROM part""",
    "p_retailprice",
)
def win_1(spark, sf):
    part = V.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    order = [("p_retailprice", True), ("p_partkey", False)]
    within = R.row_positions(part, ["p_type"], order, "rank").drop("total")
    overall = R.row_positions(part, [], order, "global_rank").select("p_partkey", "global_rank")
    return within.join(overall, "p_partkey")


@query(
    "win_2",
    """SELECT p_brand, p_type, p_size, p_partkey, p_retailprice FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_retailprice DESC, p_partkey) = 1""",
    "p_retailprice",
    "p_size",
)
def win_2(spark, sf):
    part = V.table(spark, sf, "part").drop("p_name")
    return R.keep_first(
        part, ["p_brand", "p_type", "p_size"], [("p_retailprice", True), ("p_partkey", False)]
    )


@query(
    "win_3",
    """SELECT model, key, rank() OVER (PARTITION BY model ORDER BY observed) + (count(*) OVER (PARTITION BY model, observed) - 1) / 2.0 AS rank_observed,
    rank() OVER (PARTITION BY model ORDER BY sd) + (count(*) OVER (PARTITION BY model, sd) - 1) / 2.0 AS rank_sd FROM v_pred""",
    "rank_observed rank_sd",
)
def win_3(spark, sf):
    p = V.predictions(spark, sf).select("model", "key", "observed", "sd")
    ranked = R.average_ranks(p, ["model"], {"observed": "rank_observed", "sd": "rank_sd"})
    return ranked.select("model", "key", "rank_observed", "rank_sd")


@query(
    "win_4",
    """SELECT model, key, row_number() OVER (PARTITION BY model ORDER BY sd, key) - 1 AS ordinal FROM v_pred""",
)
def win_4(spark, sf):
    p = V.predictions(spark, sf).select("model", "key", "sd")
    pos = R.row_positions(p, ["model"], [("sd", False), ("key", False)])
    return pos.select("model", "key", (F.col("pos") - 1).alias("ordinal"))


@query(
    "win_5",
    """WITH p AS (SELECT model AS family, mutation_order AS test, exp(-avg(sd) / 2 - mutation_order) AS p FROM v_pred GROUP BY 1, 2),
    s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p AS step FROM p)
    SELECT family, test, p, least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING)) AS p_holm FROM s""",
    "p p_holm",
    "test",
)
def win_5(spark, sf):
    """p-values are made from the prediction table: one per (model, order)."""
    tests = (
        V.predictions(spark, sf)
        .groupBy(F.col("model").alias("family"), F.col("mutation_order").alias("test"))
        .agg(F.avg("sd").alias("m"))
        .select("family", "test", F.exp(-F.col("m") / 2 - F.col("test")).alias("p"))
    )
    return S.holm(tests, ["family"], "p", "test")


@query(
    "win_6",
    """SELECT l_partkey, sum(loo) AS total, count(loo) AS n FROM (SELECT l_partkey, CASE WHEN count(*) OVER w > 1 THEN
    (sum(l_quantity) OVER w - l_quantity) / (count(*) OVER w - 1) END AS loo FROM lineitem WINDOW w AS (PARTITION BY l_partkey)) GROUP BY 1""",
    "total",
)
def win_6(spark, sf):
    line = V.table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    loo = folds.leave_one_out_mean(line, ["l_partkey"], "l_quantity", "loo")
    return loo.groupBy("l_partkey").agg(F.sum("loo").alias("total"), F.count("loo").alias("n"))


@query(
    "win_7",
    """WITH m AS (SELECT mutation_order, model, avg(abs(observed - predicted)) AS mae, sqrt(avg((observed - predicted) ** 2)) AS rmse
    FROM v_pred GROUP BY 1, 2) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY mutation_order ORDER BY mae, rmse, model) = 1""",
    "mae rmse",
    "mutation_order",
)
def win_7(spark, sf):
    m = M.regression_metrics(V.predictions(spark, sf), ["mutation_order", "model"])
    return S.best_by(
        m.select("mutation_order", "model", "mae", "rmse"), ["mutation_order"], ["mae", "rmse"], "model"
    )


@query(
    "win_8",
    """SELECT p_type, p_partkey, rank AS panel_rank, 'generated' AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY p_type
    ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 6 UNION ALL
    SELECT p_type, p_partkey, rank + 6, 'control' FROM (SELECT *, row_number() OVER (PARTITION BY p_type
    ORDER BY p_retailprice, p_partkey) AS rank FROM part) WHERE rank <= 2""",
)
def win_8(spark, sf):
    from platewright.operators.selection import append_controls

    part = V.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    top = R.top_per_group(part, ["p_type"], [("p_retailprice", True), ("p_partkey", False)], 6)
    low = R.top_per_group(part, ["p_type"], [("p_retailprice", False), ("p_partkey", False)], 2)
    return append_controls(top, low, ["p_type"]).select("p_type", "p_partkey", "panel_rank", "bucket")


@query(
    "win_9",
    """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS x FROM part""",
)
def win_9(spark, sf):
    part = V.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    pos = R.row_positions(part, ["p_brand"], [("p_size", False), ("p_partkey", False)])
    return pos.select("p_brand", "p_partkey", (F.col("pos") - 1).alias("x"))


@query(
    "win_10",
    """WITH v AS (SELECT model, avg(predicted) AS v FROM v_pred GROUP BY 1)
    SELECT model, v AS value, avg((predicted <= v)::INT) AS share_at_or_below FROM v_pred JOIN v USING (model) GROUP BY 1, 2""",
    "value share_at_or_below",
)
def win_10(spark, sf):
    from platewright.operators.stats import share_at_or_below

    p = V.predictions(spark, sf)
    points = p.groupBy("model").agg(F.avg("predicted").alias("value"))
    return share_at_or_below(p, points, ["model"], "predicted", "value")


@query(
    "top_1",
    """SELECT p_type, n AS shortlist_size, p_partkey, rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type
    ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), (VALUES (20::BIGINT), (25), (30)) AS s(n) WHERE rank <= n""",
)
def top_1(spark, sf):
    from platewright.operators.selection import shortlists

    part = V.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    out = shortlists(part, ["p_type"], [("p_retailprice", True), ("p_partkey", False)], [20, 25, 30])
    return out.select("p_type", "shortlist_size", "p_partkey", "rank")


@query(
    "top_2",
    """SELECT p_type, avg(p_retailprice) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY p_type
    ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 10 GROUP BY 1""",
    "top_mean",
)
def top_2(spark, sf):
    part = V.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    top = R.top_per_group(part, ["p_type"], [("p_retailprice", True), ("p_partkey", False)], 10)
    return top.groupBy("p_type").agg(F.avg("p_retailprice").alias("top_mean"))


@query(
    "top_3",
    """(SELECT 'largest' AS which, model, key, abs(observed - predicted) AS error FROM v_pred ORDER BY error DESC, key, model LIMIT 5)
    UNION ALL (SELECT 'smallest', model, key, abs(observed - predicted) AS error FROM v_pred ORDER BY error, key, model LIMIT 1)""",
    "error",
)
def top_3(spark, sf):
    p = V.predictions(spark, sf).select("model", "key", M.abs_error().alias("error"))
    largest = p.orderBy(F.desc("error"), "key", "model").limit(5)
    smallest = p.orderBy("error", "key", "model").limit(1)
    return S.stack_tables({"largest": largest, "smallest": smallest}, "which")


@query(
    "top_4",
    """WITH d AS (SELECT o_orderpriority AS class, o_custkey AS item, avg(abs(observed - a) - abs(observed - r)) AS delta
    FROM v_paired JOIN orders ON key = o_orderkey GROUP BY 1, 2) SELECT class, item, delta, 'improvement' AS kind FROM d
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY delta DESC, item) <= 3 UNION ALL
    SELECT class, item, delta, 'deterioration' FROM d QUALIFY row_number() OVER (PARTITION BY class ORDER BY delta, item) <= 3""",
    "delta",
)
def top_4(spark, sf):
    orders = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("class"),
        F.col("o_custkey").alias("item"),
    )
    delta = F.abs(F.col("observed") - F.col("a")) - F.abs(F.col("observed") - F.col("r"))
    d = V.paired(spark, sf).join(orders, "key").groupBy("class", "item").agg(F.avg(delta).alias("delta"))
    up = R.top_per_group(d, ["class"], [("delta", True), ("item", False)], 3).drop("rank")
    down = R.top_per_group(d, ["class"], [("delta", False), ("item", False)], 3).drop("rank")
    return S.stack_tables({"improvement": up, "deterioration": down}, "kind")


@query(
    "top_5",
    f"""WITH m AS ({metrics_sql('v_pred', 'mutation_order')}) SELECT mutation_order, CASE WHEN mutation_order <> 3 THEN mae END AS mae,
    pearson FROM m ORDER BY mae ASC NULLS LAST, mutation_order""",
    "mae pearson",
    "mutation_order",
)
def top_5(spark, sf):
    m = M.regression_metrics(V.predictions(spark, sf), ["mutation_order"])
    scored = M.score_only(m, F.col("mutation_order") == 3).select("mutation_order", "mae", "pearson")
    return scored.orderBy(F.asc_nulls_last("mae"), "mutation_order")


@query(
    "set_1",
    """SELECT 'returned' AS source_table, l_orderkey AS key, l_quantity AS predicted, NULL::DOUBLE AS sd FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'accepted', l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 'none', l_orderkey, l_extendedprice / 1000, l_tax FROM lineitem WHERE l_returnflag NOT IN ('R', 'A')""",
    "predicted sd",
)
def set_1(spark, sf):
    line = V.table(spark, sf, "lineitem")
    r = line.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("predicted")
    )
    a = line.where(F.col("l_returnflag") == "A").select(
        F.col("l_orderkey").alias("key"),
        F.col("l_quantity").alias("predicted"),
        F.col("l_discount").alias("sd"),
    )
    n = line.where(~F.col("l_returnflag").isin("R", "A")).select(
        F.col("l_orderkey").alias("key"),
        (F.col("l_extendedprice") / F.lit(1000)).alias("predicted"),
        F.col("l_tax").alias("sd"),
    )
    return S.stack_tables({"returned": r, "accepted": a, "none": n})


@query(
    "set_2",
    """WITH m AS (SELECT DISTINCT l_returnflag || l_linestatus AS s, l_partkey AS id FROM lineitem), z AS (SELECT s, count(*) AS n FROM m GROUP BY 1)
    SELECT a.s AS set_a, b.s AS set_b, any_value(za.n) AS size_a, any_value(zb.n) AS size_b, count(*) AS intersection,
    any_value(za.n + zb.n) - count(*) AS union_size, count(*) / (any_value(za.n + zb.n) - count(*))::DOUBLE AS jaccard
    FROM m a JOIN m b USING (id) JOIN z za ON za.s = a.s JOIN z zb ON zb.s = b.s GROUP BY 1, 2""",
    "jaccard",
)
def set_2(spark, sf):
    m = V.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("s"), F.col("l_partkey").alias("id")
    )
    return S.set_overlap(m, "s", "id")


@query(
    "set_3",
    """SELECT 'missing' AS kind, p_partkey FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49) UNION ALL
    SELECT 'unexpected', l_partkey FROM (SELECT l_partkey + 7 AS l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)""",
)
def set_3(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey")
    line = V.table(spark, sf, "lineitem")
    seen = line.where(F.col("l_quantity") > 49).select(F.col("l_partkey").alias("p_partkey"))
    moved = line.select((F.col("l_partkey") + 7).alias("p_partkey"))
    return S.stack_tables(
        {
            "missing": part.join(seen, "p_partkey", "left_anti").distinct(),
            "unexpected": moved.join(part, "p_partkey", "left_anti").distinct(),
        },
        "kind",
    )


@query(
    "rsh_1",
    """SELECT key, max(CASE WHEN model = 'A' THEN e END) AS "A", max(CASE WHEN model = 'N' THEN e END) AS "N",
    max(CASE WHEN model = 'R' THEN e END) AS "R" FROM (SELECT *, abs(observed - predicted) AS e FROM v_pred) GROUP BY 1""",
    "A N R",
)
def rsh_1(spark, sf):
    p = V.predictions(spark, sf).withColumn("e", M.abs_error())
    return S.widen(p, ["key"], "model", ["A", "N", "R"], "e")


@query(
    "rsh_2",
    """SELECT p_partkey, measure, value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part)
    ON p_size, p_retailprice INTO NAME measure VALUE value)""",
    "value",
)
def rsh_2(spark, sf):
    return S.lengthen(V.table(spark, sf, "part"), ["p_partkey"], ("p_size", "p_retail"))


@query(
    "rsh_3",
    """SELECT key, abs(observed - a) - abs(observed - n) AS gain_an, abs(observed - a) - least(abs(observed - a),
    abs(observed - n), abs(observed - r)) AS gain_best FROM v_paired""",
    "gain_an gain_best",
)
def rsh_3(spark, sf):
    e = {m: F.abs(F.col("observed") - F.col(m)) for m in "anr"}
    return V.paired(spark, sf).select(
        "key",
        (e["a"] - e["n"]).alias("gain_an"),
        (e["a"] - F.least(*e.values())).alias("gain_best"),
    )


@query(
    "rsh_4",
    f"""WITH m AS ({metrics_sql()}) SELECT 'metrics.' || model || '.' || stat AS name, num, NULL::VARCHAR AS txt FROM
    (UNPIVOT (SELECT model, n::DOUBLE AS n, mae, rmse, r2, pearson FROM m) ON n, mae, rmse, r2, pearson INTO NAME stat VALUE num)
    UNION ALL SELECT 'metrics.' || model || '.kind', NULL, lower(model) FROM m""",
    "num",
)
def rsh_4(spark, sf):
    m = M.regression_metrics(V.predictions(spark, sf), ["model"]).withColumn("kind", F.lower("model"))
    return M.long_values(m, ["model"], ["n", "mae", "rmse", "r2", "pearson", "kind"], "metrics")


@query(
    "fil_4",
    """SELECT p_type, p_partkey, p_retailprice, 0.8 * best AS floor FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_type) AS best FROM part)
    WHERE p_retailprice >= 0.8 * best""",
    "p_retailprice floor",
)
def fil_4(spark, sf):
    part = V.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    return S.at_least_fraction_of_best(part, ["p_type"], "p_retailprice", 0.8)


@query(
    "fil_6",
    """SELECT key, a, r FROM (SELECT key, max(CASE WHEN model = 'A' THEN predicted END) AS a, max(CASE WHEN model = 'R' THEN predicted END) AS r
    FROM v_pred GROUP BY 1) WHERE a IS NOT NULL AND r IS NOT NULL""",
    "a r",
)
def fil_6(spark, sf):
    wide = S.widen(V.predictions(spark, sf), ["key"], "model", ["A", "R"], "predicted")
    return wide.na.drop(subset=["A", "R"]).select("key", F.col("A").alias("a"), F.col("R").alias("r"))


@query(
    "fil_8",
    """SELECT model, count(*) AS n, FALSE AS missing FROM v_pred WHERE model IN ('A', 'R') OR starts_with(model, 'N') GROUP BY 1
    UNION ALL SELECT 'X', 0, TRUE""",
)
def fil_8(spark, sf):
    from platewright.operators.checks import required_values

    p = V.predictions(spark, sf)
    return required_values(p, "model", ["A", "R", "X"], optional_prefix="N")


@query(
    "fil_9",
    """SELECT 'all' AS scope, count(*) AS n, avg(abs(observed - predicted)) AS mae FROM v_pred UNION ALL
    SELECT 'without_parent', count(*), avg(abs(observed - predicted)) FROM v_pred WHERE mutation_order > 0""",
    "mae",
)
def fil_9(spark, sf):
    from platewright.operators.stats import with_scopes

    p = V.predictions(spark, sf)
    scoped = with_scopes(p, {"all": F.lit(True), "without_parent": F.col("mutation_order") > 0})
    return scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.avg(M.abs_error()).alias("mae")
    )
