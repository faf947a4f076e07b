"""Mutation parsing and encoding on hand-made literals."""

import pytest
from pyspark.sql import functions as F

from platewright.functions import variants as X

PARENT = {99: "D", 134: "F", 304: "T", 330: "A"}


def one(spark, value, column):
    schema = "m string"
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,problem",
    [
        ("D99G;F134W", None),
        (" d99g / f134w ", None),
        ("", None),
        ("Wild Type", None),
        (None, None),
        ("D99", "malformed"),
        ("D99G-F134W", "malformed"),
        ("D99G;D99A", "duplicate_position"),
        ("D0G", "bad_position"),
        ("B12G", "noncanonical"),
        ("A99G", "wild_type_mismatch"),
        ("D99D", "no_op"),
        ("A12G", None),
    ],
)
def test_problems(spark, text, problem):
    assert one(spark, text, X.parse_problem("m", PARENT)) == problem


def test_reference_sequence_checks(spark):
    ref = F.lit("MKDF")
    assert one(spark, "K2A", X.parse_problem("m", PARENT, ref)) is None
    assert one(spark, "A2K", X.parse_problem("m", PARENT, ref)) == "wild_type_mismatch"
    assert one(spark, "K9A", X.parse_problem("m", PARENT, ref)) == "outside_reference"


def test_encodings(spark):
    m = X.parse_mutations("m")
    assert one(spark, "F134W;D99G", X.mutation_text(m)) == "D99G;F134W"
    assert one(spark, "F134W;D99G", X.signature(m)) == "99+134"
    assert one(spark, "wt", X.signature(m)) == "WT"
    assert one(spark, "F134W,D99G", X.set_key(m)) == ["D99G", "F134W"]
    assert one(spark, "F134W", X.pocket_of(m, PARENT)) == ["D", "W", "T", "A"]
    assert one(spark, "A2C;D4E", X.apply_mutations(F.lit("MAKD"), m)) == "MCKE"
    assert one(spark, "A2C;D4E;K3R", X.item_pairs(X.mutation_names(m))) == ["A2C__D4E", "A2C__K3R", "D4E__K3R"]
    assert one(spark, "D99G", X.only_positions(m, (99, 134))) is True
    assert one(spark, "D99G;K5R", X.only_positions(m, (99, 134))) is False


def test_pocket_round_trip(spark):
    pocket = F.array(*[F.lit(x) for x in "GFTV"])
    assert one(spark, "", X.mutation_text(X.differences(pocket, PARENT))) == "D99G;A330V"


def test_residue_status(spark):
    for seq, want in (("acd", "ok"), ("ac", "too_short"), ("acx", "noncanonical"), (None, "missing_value")):
        assert one(spark, seq, X.residue_at("m", 3)[1]) == want


def test_novelty(spark):
    pocket = F.array(F.lit("G"), F.lit("F"))
    seen = F.array(F.array(F.lit("A"), F.lit("G")), F.array(F.lit("W")))
    assert one(spark, "", X.novelty(pocket, seen)) == 1


def test_text_boolean_and_labels(spark):
    assert one(spark, " TRUE ", X.text_boolean("m")) is True
    assert one(spark, "no", X.text_boolean("m")) is False
    assert one(spark, "", X.well_label(F.lit(1), F.lit(3))) == "A03"
    assert one(spark, "", X.well_label(F.lit(17), F.lit(123))) == "Q123"
    assert one(spark, "", X.well_label(F.lit(27), F.lit(12))) == "AA12"
    assert one(spark, "", X.pad_left(F.lit(12345678), 7)) == "12345678"
