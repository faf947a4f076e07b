"""Sources, sinks, checks and plate arithmetic on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from platewright.operators import assay as A
from platewright.operators import checks as C
from platewright.operators import features as P
from platewright.operators import folds, metrics as M, relate, reshape as S
from platewright.sources import tables as IO


def test_decimal_comma_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x;y\nv1;85,8;NaN\nv2;N/A;1,5\nv3;bad;2\n")
    got = IO.read_assay_csv(spark, str(tmp_path / "a.csv"), ["id", "x", "y"], ["x", "y"]).orderBy("id").collect()
    assert [(r["x"], r["y"]) for r in got] == [(85.8, None), (None, 1.5), (None, 2.0)]


def test_fasta_records(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 first one\nACDE\nfghi\n>s2\nACXB\n")
    got = {r["id"]: r for r in IO.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got["s1"]["sequence"] == "ACDEFGHI" and got["s1"]["canonical"] and not got["s2"]["canonical"]
    assert got["s1"]["description"] == "s1 first one"
    (tmp_path / "b.fasta").write_text(">v1 A>G note\nMKVAA\n>v2\r\nACDE\r\n")
    got = {r["id"]: r["sequence"] for r in IO.read_fasta(spark, str(tmp_path / "b.fasta")).collect()}
    assert got == {"v1": "MKVAA", "v2": "ACDE"}


def test_optional_source(spark, tmp_path):
    df, present = IO.read_optional(spark, str(tmp_path / "nothing"), "a int")
    assert not present and df.count() == 0 and df.columns == ["a"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1.0), (3, "d", 2.0)], "k int, v string, extra double")
    got = sorted((r["k"], r["v"], r["extra"]) for r in S.upsert(old, new, ["k"]).collect())
    assert [g[:2] for g in got] == [(1, "a"), (2, "c"), (3, "d")]


def test_incremental_scoring_computes_each_content_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "id int, text string").withColumn(
        "key", P.content_key(F.lit("m"), F.lit("r1"), F.col("text"))
    )
    path = str(tmp_path / "cache")
    spark.createDataFrame([], "key string, score double").write.parquet(path)
    seen = []

    def scorer(rows):
        seen.append(rows.count())
        return rows.withColumn("score", F.length("text").cast("double"))

    assert P.score_incrementally(df, "key", "text", path, scorer).count() == 3
    P.score_incrementally(df, "key", "text", path, scorer).count()
    assert seen == [2, 0]
    # Two overlapping runs left the same keys twice: results do not multiply.
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert P.score_incrementally(df, "key", "text", path, scorer).count() == 3
    seen.pop()
    other = df.withColumn("key", P.content_key(F.lit("m"), F.lit("r2"), F.col("text")))
    P.score_incrementally(other, "key", "text", path, scorer).count()
    assert seen == [2, 0, 2]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c d")], "k int, s string")
    assert {r["problem"] for r in C.key_violations(df, ["k"]).collect()} == {"duplicate", "null"}
    assert C.pattern_violations(df, "s", "[a-z]+").count() == 1
    assert [r[0] for r in C.missing_columns(df, ["k", "z"]).collect()] == ["z"]
    audit = C.numeric_parse_audit(spark.createDataFrame([("1,5",), ("x",), ("",), ("Infinity",)], "t string"), ["t"]).first()
    assert (audit["n_text"], audit["n_unparsed"], audit["n_infinite"]) == (3, 1, 1)
    with pytest.raises(C.CheckFailed):
        C.fail_fast(C.key_violations(df, ["k"]), "keys")


def test_drift_status(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 5.0), ("n", 1.0)], "name string, num double")
    b = spark.createDataFrame([("x", 1.0000001), ("y", 6.0), ("m", 1.0)], "name string, num double")
    got = {r["name"]: r["status"] for r in C.drift(a, b, 1e-6).collect()}
    assert got == {"x": "PASS", "y": "FAIL", "n": "new", "m": "missing"}


def test_model_coverage_and_one_to_one(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "model string, key int")
    got = {r["model"]: (r["n_missing"], r["complete"]) for r in C.model_coverage(p, "model", "key").collect()}
    assert got == {"a": (0, True), "b": (1, False)}
    left = spark.createDataFrame([(1,), (2,)], "key int")
    joined, ok = relate.one_to_one(left, p, ["key"])
    assert joined.withColumn("ok", ok).first()["ok"] is False


def test_plate_conversion(spark):
    rows = [("p", 1, True, 0.1, None, False), ("p", 2, True, 0.3, None, False), ("p", 3, False, 1.2, "V", False), ("p", 4, False, 1.2, "V", True), ("p", 5, False, 0.1, "V", False), ("p", 6, False, 0.9, None, False)]
    w = spark.createDataFrame(rows, "plate string, id int, is_blank boolean, raw_od double, variant string, doubled boolean")
    meta = A.plate_metadata(w, 0.5, 2.0, 4.0, 400.0)
    m = meta.first()
    assert m["blank_od"] == pytest.approx(0.2) and m["blank_sem"] == pytest.approx(0.1)
    assert m["lod"] == pytest.approx(3 * 0.1 / 0.5 / 2 / 4)
    wells = A.convert_wells(w, meta, 0.5, 2.0, 4.0, "doubled")
    act = A.variant_activity(wells).first()
    assert act["n"] == 2 and act["spec_act"] == pytest.approx((0.25 + 0.125) / 2) and act["loadings"] == "100, 200"
    bal = A.plate_balance(wells).first()
    assert (bal["n_wells"], bal["n_assigned"], bal["n_at_or_below_blank"], bal["n_used"]) == (4, 3, 1, 2)


def test_replicates_and_loo_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r for r in A.replicate_statistics(df, ["k"], "v").collect()}
    assert got["a"]["n"] == 2 and got["a"]["sem"] == pytest.approx(1.0) and got["b"]["sd"] is None
    loo = folds.leave_one_out_mean(df.na.drop(), ["k"], "v", "m").collect()
    assert sorted((r["k"], r["v"], r["m"]) for r in loo if r["m"]) == [("a", 1.0, 3.0), ("a", 3.0, 1.0)]


def test_sem_imputation_scope(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, None), (0, 0.0), (1, None), (1, 9.0)], "f int, s double")
    got = A.impute_training_sem(df, ["f"], "s", "u").collect()
    assert sorted((r["f"], r["u"]) for r in got) == [(0, 0.0), (0, 1.0), (0, 2.0), (0, 3.0), (1, 9.0), (1, 9.0)]


def test_robust_z_rules(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None])], "id int, x double")
    got = {r["id"]: r["z"] for r in M.robust_z(df, [], "x", "z").collect()}
    assert got[2] == 0.0 and got[4] == pytest.approx(0.6745 * 97) and got[5] == 0.0
    flat = spark.createDataFrame([(i, v) for i, v in enumerate([5.0] * 6 + [11.0])], "id int, x double")
    z = {r["id"]: r["z"] for r in M.robust_z(flat, [], "x", "z", False).collect()}
    sd = math.sqrt(sum((v - 41 / 7) ** 2 for v in [5.0] * 6 + [11.0]) / 7)
    assert z[6] == pytest.approx(-6 / sd) and z[0] == 0.0


def test_coverage_is_inclusive(spark):
    df = spark.createDataFrame([("m", 1.0, 0.0, 1.0), ("m", 3.0, 0.0, 1.0)], "model string, observed double, predicted double, sd double")
    got = M.coverage(df, ["model"], {"c": "sd"}, {"one": (0.5, 1.0)}).first()
    assert got["c"] == 0.5


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    IO.publish(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), root)
    for value in ("c", "d"):
        fresh = spark.createDataFrame([(2, value)], "k int, v string")
        IO.publish(S.upsert(IO.published(spark, root), fresh, ["k"]), root)
    (tmp_path / "t" / "v=000003").mkdir()
    assert sorted(map(tuple, IO.published(spark, root).collect())) == [(1, "a"), (2, "d")]
    IO.publish(IO.published(spark, root).where("k = 1"), root)
    assert IO.published(spark, root).count() == 1
