"""Source and sink queries: each writes whole tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import variants as X
from platewright.operators import metrics as M
from platewright.operators.reshape import upsert
from platewright.operators.stability import scratch_path
from platewright.plans import views as V
from platewright.plans.registry import query
from platewright.plans.variant_queries import parsed
from platewright.sources import tables as S


@query(
    "src_1",
    "SELECT l_orderkey::VARCHAR AS variant_id, l_quantity AS activity, CASE WHEN l_linenumber <> 3 THEN l_discount END AS tm FROM lineitem",
    "activity tm",
)
def src_1(spark, sf):
    path = scratch_path(spark, "assay-csv")
    line = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("variant_id"),
        F.col("l_quantity").alias("activity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("tm"),
    )
    S.write_assay_csv(line, path)
    return S.read_assay_csv(spark, path, ["variant_id", "activity", "tm"], ["activity", "tm"])


@query(
    "src_2",
    """SELECT p_partkey, 'part.parquet' AS source_file, TRUE AS path_ends_with_file, 'run1' AS run, 'run1__' || p_partkey AS candidate_id FROM part""",
)
def src_2(spark, sf):
    t = S.read_with_provenance(spark, f"{sf}/part.parquet", "run1")
    return t.select(
        "p_partkey",
        "source_file",
        F.col("source_path").endswith("/part.parquet").alias("path_ends_with_file"),
        "run",
        F.concat_ws("__", "run", F.col("p_partkey").cast("string")).alias("candidate_id"),
    )


@query(
    "src_3",
    f"""SELECT p_partkey::VARCHAR AS id, upper(replace(p_name, ' ', '')) AS sequence,
    regexp_full_match(upper(replace(p_name, ' ', '')), '[{X.CANONICAL}]+') AS canonical FROM part""",
)
def src_3(spark, sf):
    """Records are written over two lines each to exercise the joining of lines."""
    path = scratch_path(spark, "fasta")
    seq = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    two_lines = F.concat(
        F.substring(seq, F.lit(1), F.lit(4)), F.lit("\n"), F.substring(seq, F.lit(5), F.length(seq))
    )
    S.write_fasta(V.table(spark, sf, "part").select("p_partkey", two_lines.alias("s")), "p_partkey", "s", path)
    return S.read_fasta(spark, path).select("id", "sequence", "canonical")


@query("src_4", "SELECT 'part' AS name, TRUE AS present, count(*) AS n FROM part UNION ALL SELECT 'no_such_table', FALSE, 0")
def src_4(spark, sf):
    out = None
    for name in ("part", "no_such_table"):
        df, present = S.read_optional(spark, f"{sf}/{name}.parquet", "p_partkey bigint")
        row = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("name"), F.lit(present).alias("present"), "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "src_5",
    """SELECT variant_id, len(toks) AS n, CASE WHEN len(toks) > 0 THEN poss[1] END::BIGINT AS first_pos,
    array_to_string(list_sort(list_distinct(toks)), ';') AS mutation_set FROM v_parsed""",
)
def src_5(spark, sf):
    path = scratch_path(spark, "prepared")
    prepared = parsed(spark, sf).withColumn("set", X.set_key("muts"))
    prepared.write.mode("overwrite").parquet(path)
    again = spark.read.parquet(path)
    flat = again.withColumn("n", F.size("muts")).withColumn("first_pos", F.get("muts", F.lit(0))["pos"])
    return S.flat_export(flat, ["muts", "set", "mutations"], {"set": "mutation_set"})


@query(
    "src_6",
    """SELECT vec_id, i - 1 AS dim, x[i] AS value FROM (SELECT *, unnest(range(1, 17)) AS i FROM v_comp WHERE component = 2)""",
    "value",
)
def src_6(spark, sf):
    path = scratch_path(spark, "features")
    store = V.components(V.assays(spark, sf), ("vec_id",)).withColumn(
        "component", F.col("component").cast("string")
    )
    store.write.mode("overwrite").partitionBy("component").parquet(path)
    keys = V.table(spark, sf, "embeddings").select("vec_id")
    hits = S.lookup_features(spark.read.schema("vec_id bigint, x array<double>, component string").parquet(path), keys, ["vec_id"], "2")
    return hits.select("vec_id", F.posexplode("x").alias("dim", "value"))


@query("src_7", "SELECT plate, count(*) AS n_wells, count(variant) AS n_assigned, sum(k)::BIGINT AS total_k FROM v_well GROUP BY 1")
def src_7(spark, sf):
    path = scratch_path(spark, "wells")
    V.wells(spark, sf).write.mode("overwrite").parquet(path)
    return (
        S.read_wells(spark, path)
        .groupBy("plate")
        .agg(
            F.count(F.lit(1)).alias("n_wells"),
            F.count("variant").alias("n_assigned"),
            F.sum("k").alias("total_k"),
        )
    )


@query(
    "snk_1",
    "SELECT 'predictions' AS name, count(*) AS n FROM v_pred UNION ALL SELECT 'paired', count(*) FROM v_paired UNION ALL SELECT 'variants', count(*) FROM v_var",
)
def snk_1(spark, sf):
    tables = {
        "predictions": V.predictions(spark, sf),
        "paired": V.paired(spark, sf),
        "variants": V.variants(spark, sf),
    }
    paths = S.write_tables(tables, scratch_path(spark, "results"))
    out = None
    for name, path in paths.items():
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "snk_2",
    """SELECT line, count(*) AS n FROM (SELECT '>' || variant_id AS line FROM v_parsed UNION ALL
    SELECT CASE WHEN len(toks) = 0 THEN 'WT' ELSE array_to_string(toks, '-') END FROM v_parsed) GROUP BY 1""",
)
def snk_2(spark, sf):
    path = scratch_path(spark, "fasta-out")
    name = F.when(F.size("muts") == 0, "WT").otherwise(F.array_join(X.mutation_names("muts"), "-"))
    S.write_fasta(parsed(spark, sf).withColumn("s", name), "variant_id", "s", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk_3",
    """SELECT p_partkey, p_size * 2 AS size, 'fresh' AS origin FROM part WHERE p_size > 25 UNION ALL
    SELECT p_partkey, p_size, NULL FROM part WHERE p_size <= 25""",
    "",
    "size",
)
def snk_3(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"))
    fresh = part.where(F.col("size") > 25).select(
        "p_partkey", (F.col("size") * 2).alias("size"), F.lit("fresh").alias("origin")
    )
    path = scratch_path(spark, "upserted")
    S.publish(part, path)
    S.publish(upsert(S.published(spark, path), fresh, ["p_partkey"]), path)
    return S.published(spark, path)


@query(
    "snk_4",
    """SELECT count(*) AS n, avg(abs(observed - predicted)) AS mae, NULL::DOUBLE AS ratio,
    '{"n":' || count(*) || ',"models":' || count(DISTINCT model) || '}' AS json FROM v_pred""",
    "mae ratio",
)
def snk_4(spark, sf):
    p = V.predictions(spark, sf)
    s = p.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("model").alias("models"),
        F.avg(M.abs_error()).alias("mae"),
        (F.max("sd") * F.lit(float("inf"))).alias("ratio"),
    )
    clean = S.one_row_summary(s, ["mae", "ratio"])
    return clean.select("n", "mae", "ratio", F.to_json(F.struct("n", "models")).alias("json"))


@query(
    "snk_5",
    "SELECT assay, component, count(*) AS n, sum(k) AS total, count(DISTINCT id_a) AS ids FROM v_kern GROUP BY 1, 2",
    "total",
    "component",
)
def snk_5(spark, sf):
    from platewright.plans.similarity_queries import kernels

    path = scratch_path(spark, "pairs")
    S.write_pairs(kernels(spark, sf), "assay", path, 8)
    return (
        spark.read.parquet(path)
        .groupBy("assay", "component")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("k").alias("total"),
            F.countDistinct("id_a").alias("ids"),
        )
    )
