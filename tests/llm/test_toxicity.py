import random

import numpy as np
import pytest
from helpers import sentence
from pyspark.sql import functions as F

from platewright.llm import toxicity
from platewright.llm.toxicity import NAMES, Grammar

DOCS = "doc_id long, text string, score string, toxic string, held_out string"


def features(text, stems=None):
    return {n: round(float(np.expm1(v)), 6) for n, v in zip(NAMES, Grammar(stems or {}).features(text), strict=True) if v}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", {}),
        ("A calm text. Nothing here.", {}),
        ("What an IMBECILE.", {"insult": 1}),
        ("You are a vermin imbecile", {"at target": 1}),
        ("You imbecile! Also you bastard; vermin", {"at target": 2, "insult": 1}),
        ("This is not degenerate at all", {"negated": 1}),
        ("He is not what one would ever call an imbecile", {"at target": 1}),
        ("The report said imbecile twice", {"reported": 1}),
        ("I will kill you", {"threat": 1}),
        ("They kill time", {"violence": 1}),
        ("nonimbecile words and ximbecile", {}),
    ],
)
def test_clauses(text, want):
    assert features(text) == want


def test_learnt_stems_match_word_starts():
    assert features("Eine loweiig Sache", {"lowei": 1.0}) == {"insult": 1}
    assert features("Eine xloweiig Sache", {"lowei": 1.0}) == {}


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(1)
    for _ in range(200):
        word = [rng.choice("ivfynr.") for _ in range(12)]
        state, out = toxicity.START, []
        for x in word:
            state, y = toxicity.TABLE[state, x]
            out.append(y)
        steps = [
            toxicity._countdown("n", 3, {"i": "j", "v": "w"}),
            toxicity._countdown("r", 8, {"i": "q", "v": "w"}),
            toxicity._threats(),
            toxicity._targets(),
        ]
        for m in steps:
            s, done = m.start, []
            for x in word:
                s, y = m.step(s, x)
                done.append(y)
            word = done
        assert word == out


def _labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = sentence(rng, rng.randrange(20, 60)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorb", "you imbecile"]) + rng.choice(["", "", " "]) )
            words.append("zorb" + rng.choice(["el", "um", "ik"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(700, None), (701, ""), (None, "you vile zorbel imbecile"), (702, "fine words " * 50_000), (3, docs[3][1])]
    labels += [(None, 1), (5000, 1), (10, None), (15, 1), (15, 0)]
    return (
        spark.createDataFrame([(*d, "mine", "mine", "mine") for d in docs], DOCS),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_rows_and_edges(spark):
    docs, labels = _labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 605
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is None:
            assert r.predicted == 1 and not r.held_out
        elif r.doc_id >= 700:
            assert r.predicted == 0
        elif r.held_out:
            assert r.predicted == int(r.doc_id % 5 == 0)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = _labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect(), key=str) == sorted(toxicity.toxicity(docs, flipped).collect(), key=str)


def test_no_labels_and_no_rows(spark):
    docs, labels = _labelled(spark)
    plain = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert plain[700] == 0 and plain[701] == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_words_of_scripts_without_blanks_match_inside_a_clause():
    assert features("我觉得你是笨蛋。真的", {"笨蛋": 1.0}) == {"insult": 1}
    assert features("เขาเป็นคนโง่มาก", {"โง": 1.0}) == {"insult": 1}
    assert "笨蛋" in toxicity._document_stems("我觉得你是笨蛋") and "蛋" not in toxicity._document_stems("我觉得你是笨蛋")


def test_weak_stems_of_a_clause_add_up_and_negation_weakens():
    both = Grammar({"zor": 0.4, "bla": 0.4})
    of = lambda t: dict(zip(NAMES, np.expm1(both.features(t)).round(6).tolist(), strict=True))
    assert of("a zora blaf here")["insult"] == 0.8 and of("a zora here. Zoru there")["insult"] == 0.8
    assert both.measure("a zora here")[1]["zor"] > both.measure("it is not zora")[1]["zor"]
    assert both.measure("zora. calm. calm. calm")[1]["zor"] < both.measure("zora. calm")[1]["zor"]


def _plain(listed, rows, stems, values, n_stems, y):
    x = np.zeros((len(y), listed.shape[1] + n_stems))
    x[:, : listed.shape[1]] = listed
    np.add.at(x, (rows, stems + listed.shape[1]), values)
    return x


def _problem(seed=5, n=120, n_stems=30):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 4 == 0).astype(float)
    listed = rng.poisson(0.2, (n, len(NAMES))).astype(float)
    rows, stems = np.nonzero(rng.random((n, n_stems)) < 0.1 + 0.3 * y[:, None] * (np.arange(n_stems) < 8))
    return listed, rows, stems, rng.random(len(rows)) + 0.2, n_stems, y


def test_joint_weights_are_the_optimum():
    given = _problem()
    weights, strengths, bias = toxicity.fit_weights(*given, rounds=20_000)
    x, y = _plain(*given), given[-1]
    w = np.array(weights + strengths)
    prior = np.array([*toxicity.PRIOR.values(), *[0.0] * given[4]])
    share = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    slope = x.T @ (share * (p - y)) + w - prior
    # Weights above nothing have no slope, the others would only fall further.
    assert np.abs(slope[w > 1e-9]).max() < 1e-5 and slope[w <= 1e-9].min() > -1e-5
    assert abs((share * (p - y)).sum() + bias - toxicity.PRIOR_BIAS) < 1e-5


def test_calibration_stretches_and_keeps_the_order():
    given = _problem()
    plain, wide = toxicity.fit_weights(*given), toxicity.calibrated(*given)
    ratio = [a / b for a, b in zip(wide[0] + wide[1], plain[0] + plain[1], strict=True) if b > 1e-9]
    assert min(ratio) >= 1 and max(ratio) - min(ratio) < 1e-9
    none = (given[0][:0], given[1][:0], given[2][:0], given[3][:0], given[4], given[5][:0])
    assert toxicity.calibrated(*none)[2] == toxicity.PRIOR_BIAS


def test_stems_tried_against_plain_counts(spark):
    docs, labels = _labelled(spark)
    model = toxicity.learn(docs, labels)
    assert any(s.startswith("zorb"[: len(s)]) for s in model.stems)
    n, t, k, m = F.lit(9), F.lit(7), 40, 300
    one = spark.range(1).select(toxicity.log_odds(t, n, k, m).alias("z")).first().z
    a, b = 7.5, 2.5
    want = (np.log(a / (41 - a)) - np.log(b / (261 - b))) / np.sqrt(1 / a + 1 / b)
    assert np.isclose(one, want) and np.isclose(toxicity.log_odds_of(np.array([7]), np.array([9]), k, m)[0], want)
    rows = [("abc", 3, 4), ("abcd", 3, 4), ("abce", 1, 1), ("xyz", 2, 2)]
    assert toxicity.choose_stems(rows) == ["abcd", "abce", "xyz"]


@pytest.mark.parametrize(("table", "least", "most"), [("sf0.1", 0.9, 0.01), ("sf0.001", 0.0, 0.05)])
def test_held_out_recall(spark, table, least, most):
    read = lambda t: spark.read.parquet(f"/root/testdata/{table}/{t}.parquet")
    rows = toxicity.toxicity(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out")
    found = {r.toxic: r for r in rows.groupBy("toxic").agg(F.avg("predicted").alias("share"), F.avg("score").alias("score")).collect()}
    assert found[1].share >= least and found[0].share <= most and found[1].score > found[0].score
