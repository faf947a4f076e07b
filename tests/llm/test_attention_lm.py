import inspect
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import sentence

from platewright.llm import attention_lm as lm

DOCS = "doc_id long, text string, score string, held_out string"


def _layout(seed=1, vocabulary=60):
    rng = np.random.default_rng(seed)
    starts = np.arange(vocabulary) % 2 == 0
    unigram = rng.integers(0, 50, vocabulary).astype(float)
    ids = np.flatnonzero(unigram)
    place = lm.contexts(lm.by_count(unigram), starts)
    a, b, n = rng.choice(ids, 300), rng.choice(ids[ids % 2 == 1], 300), rng.integers(1, 5, 300)
    opening = np.where(starts, unigram, 0)
    return lm.Layout(vocabulary, starts, unigram, opening, (place[a], b, n), (a, place[b], n), 7), vocabulary


def test_next_id_probabilities_sum_to_one():
    layout, vocabulary = _layout()
    p = lm.initial(layout)
    for prefix in ([], [4], [4, 7, 9, 11]):
        # The same prefix and every possible next id; the text's end is the last alternative.
        texts = [np.array([*prefix, i]) for i in range(vocabulary)]
        whole = lm.log_probability(p, layout, texts)
        ends = []
        for t in texts:
            given = lm.log_probability(p, layout, [t])[0]
            ends.append(given)
        assert np.allclose(whole, ends, atol=1e-4)
        stop = math.exp(lm.log_probability(p, layout, [np.array(prefix, dtype=int)])[0])
        follow = sum(math.exp(_of_next(p, layout, prefix, i)) for i in range(vocabulary))
        lead = math.exp(sum(_of_next(p, layout, prefix[:k], prefix[k]) for k in range(len(prefix))))
        assert math.isclose(follow + stop / lead, 1.0, abs_tol=1e-4)


def _of_next(p, layout, prefix, i):
    """ln P(i | prefix), from the score of position len(prefix) alone."""
    given = np.array([layout.begin, *prefix])
    goal = np.array([*prefix, i])
    at, inside, scored = lm.windows(np.array([len(goal)]), lm.STRIDE)
    z = lm._attend(p, layout.row_of[given][at], lm._mask(p["near"]))[-1]
    before = layout.context_of[given]
    x = np.maximum(z[scored], 0) @ p["out"] + (layout.jump + p["bias"])[before[at[scored]]]
    x = x[-1].astype(float)
    x -= np.log(np.exp(x).sum())
    return x[layout.class_of[i]] + float(layout.within[before[-1], layout.column_of[i]])


@pytest.mark.parametrize("stride", [lm.STRIDE, lm.WINDOW])
def test_windows_score_each_position_once(stride):
    lengths = np.array([1, 31, 32, 33, 55, 56, 57, 500, 2])
    at, inside, scored = lm.windows(lengths, stride)
    assert sorted(at[scored].tolist()) == list(range(int(lengths.sum())))
    if stride == lm.STRIDE:
        later = scored & (at >= 0)
        rows = np.flatnonzero(~scored[:, 0] & scored[:, -1])
        assert all(np.flatnonzero(later[r])[0] >= lm.WINDOW - lm.STRIDE for r in rows)


def test_attention_is_causal():
    layout, vocabulary = _layout()
    p = lm.initial(layout)
    rng = np.random.default_rng(2)
    rows = layout.row_of[rng.integers(0, vocabulary, (1, lm.WINDOW))]
    z = lm._attend(p, rows, lm._mask(p["near"]))[-1].copy()
    rows[0, 9:] = rows[0, 0]
    other = lm._attend(p, rows, lm._mask(p["near"]))[-1]
    assert np.allclose(z[0, :9], other[0, :9], atol=1e-6) and not np.allclose(z[0, 9:], other[0, 9:])


def test_gradients():
    layout, vocabulary = _layout()
    p = {k: v.astype(np.float64) for k, v in lm.initial(layout).items()}
    rng = np.random.default_rng(3)
    ids = rng.integers(0, vocabulary, (3, lm.WINDOW))
    rows, target = layout.row_of[ids], layout.class_of[rng.integers(0, vocabulary, (3, lm.WINDOW))]
    counted = rng.random((3, lm.WINDOW)) < 0.7
    jump = layout.jump[layout.context_of[ids[counted]]].astype(float)
    g, _ = lm.train_step(p, rows, target, jump, counted)
    for name in p:
        flat, slope = p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:6]:
            kept, h = flat[i], 1e-5
            flat[i] = kept + h
            up = lm.train_step(p, rows, target, jump, counted)[1]
            flat[i] = kept - h
            down = lm.train_step(p, rows, target, jump, counted)[1]
            flat[i] = kept
            assert math.isclose((up - down) / (2 * h), slope[i], rel_tol=2e-2, abs_tol=1e-6), name


def _texts():
    rng = random.Random(4)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(150)]
    return texts + [None, "", "Alpha1 ALPHA1 é É", "x" * 5000 + " y", " \t\n", sentence(rng, 30_000)]


def test_base_score_and_edges(spark):
    texts = _texts()
    rows = [(i, t, "mine", "mine") for i, t in enumerate(texts)] + [(None, "alpha1", "a", "b"), (3, texts[3], "a", "b")]
    got = lm.score_texts(spark.createDataFrame(rows, DOCS), rounds=1).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            counts.update(words(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    part = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    for r in got:
        w = words(texts[r.doc_id] if r.doc_id is not None else "alpha1")
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(w) + 1, total)
        assert r.n_known == 1 + sum(counts[x] > 0 for x in w)
        assert math.isclose(r.base_score, part(ends) + sum(part(counts[x]) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    same = [r.score for r in got if r.doc_id == 3]
    assert math.isclose(*same, rel_tol=1e-6)
    assert lm.score_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    texts = _texts()[:60]
    table = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    near = lambda: {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score_texts(table, rounds=0).collect()}
    want = near()
    monkeypatch.setattr(lm, "COMMON_BITS", 6)
    assert near() == want


def test_training_beats_the_untrained_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    of = lambda rounds: sum(r.score for r in lm.score_texts(docs, rounds=rounds).collect() if r.held_out)
    assert of(3) > of(0)


def test_every_id_sees_enough_of_what_came_before():
    lengths = np.array([3, 40, 500])
    at, inside, scored = lm.windows(lengths, lm.STRIDE)
    first = np.concatenate([[0], np.cumsum(lengths)])
    for row, here in zip(at, scored, strict=True):
        start = first[np.searchsorted(first, row[0], side="right") - 1]
        for k in np.flatnonzero(here):
            assert k >= min(8, row[k] - start)
    assert inspect.signature(lm.score_texts).parameters["rounds"].default == 3


def test_weights_are_learnt_from_every_training_text(spark, monkeypatch):
    # 0.9 million training words, past what was once a limit of 400,000.
    texts = [(i, f"w{i} " + "alpha beta gamma delta " * 250, "", "") for i in range(1000)]
    given = []

    def train(texts, layout, *rest):
        given.extend(bytes(r.ids) for r in texts.collect())
        return lm.initial(layout)

    monkeypatch.setattr(lm, "train", train)
    lm.score_texts(spark.createDataFrame(texts, DOCS)).count()
    with open(lm.TOKENIZER, "rb") as f:
        encoding = lm._encoding(f.read(), lm.PATTERN)
    whole = [np.array(lm.subwords(encoding, t.encode().split()), dtype=np.uint16).tobytes() for i, t, *_ in texts if zlib.crc32(str(i).encode()) % 10]
    assert sorted(given) == sorted(whole)


def test_ids_of_single_words_are_those_of_the_text():
    """Words are split one by one and kept; the ids must be those of splitting the text at once."""
    with open(lm.TOKENIZER, "rb") as f:
        encoding = lm._encoding(f.read(), lm.PATTERN)
    for text in _texts() + ["it's a\u00a0b c\u00a0 d", "x--y \" 12ab\u3000z", "漢字 かな ไทย", "a\u2003\u2003b c"]:
        words = lm.blank_words((text or "").encode())
        if words and max(map(len, words)) <= lm.LONGEST_WORD:
            assert lm.subwords(encoding, words) == [i for w in words for i in lm.subwords(encoding, [w])]


def test_buffers_leave_no_trace_between_batches():
    layout, vocabulary = _layout()
    p = lm.initial(layout)
    step, rng = lm.Step(p, 6), np.random.default_rng(5)
    for n in (6, 2, 5, 1):
        ids = rng.integers(0, vocabulary, (n, lm.WINDOW))
        rows, cls = layout.row_of[ids], layout.class_of[ids]
        counted = rng.random((n, lm.WINDOW)) < 0.8
        before = layout.context_of[ids[counted]]
        g, loss = step.gradients(p, rows, cls[counted], layout.jump, before, counted)
        exact = {k: v.astype(np.float64) for k, v in p.items()}
        plain, want = lm.train_step(exact, rows, cls, layout.jump[before].astype(float), counted)
        assert math.isclose(loss, want, rel_tol=1e-4)
        for name in p:
            assert np.allclose(g[name], plain[name], atol=1e-5), name


@pytest.mark.skipif("PLATEWRIGHT_LM_QUALITY" not in os.environ, reason="names the table to measure on, such as check_s")
def test_held_out_score_at_the_registered_settings(spark):
    docs = spark.read.parquet(f"/root/testdata/{os.environ['PLATEWRIGHT_LM_QUALITY']}/documents.parquet")
    held = [r for r in lm.score_texts(docs).select("held_out", "n_tokens", "base_score", "score").collect() if r.held_out]
    words = sum(r.n_tokens for r in held)
    model, base = sum(r.score for r in held) / words, sum(r.base_score for r in held) / words
    print(f"held-out score per word: model {model:.4f}, unigram {base:.4f}, {words} words")
    assert model > base
