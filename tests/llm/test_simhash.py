import random

import pytest
import xxhash
from helpers import components, sentence
from pyspark.sql import functions as F

from platewright.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, component_id string"


def plain_fingerprint(text: str) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_leave_out_any_four_bits():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(5000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flips == 0 for m in masks)
    assert all(25 <= m.bit_count() <= 40 for m in masks)


def test_fingerprint_matches_plain_version():
    rng = random.Random(2)
    texts = ["", "One", "one two THREE", "a b c d", *[sentence(rng, n) for n in (4, 5, 50, 400)]]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_long_text_is_counted_whole(monkeypatch):
    raw = sentence(random.Random(3), 900).encode()
    want = simhash.fingerprint(raw)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.fingerprint(raw) == want


@pytest.mark.parametrize("block", [8192, 5])
def test_links_match_all_pairs(spark, block):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(30)} | set(centres)
    for c in centres:
        for _ in range(25):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.covering_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, block).collect()
    got = {frozenset((r.a, r.b)) for r in links}
    linked = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    assert components(signed, lambda a, b: frozenset((a, b)) in got) == components(signed, linked)


def _cases(spark):
    rng = random.Random(5)
    base = sentence(rng, 300)
    rows = [(1, base, "x"), (2, base + " more", "y"), (3, sentence(rng, 200), None), (3, sentence(rng, 200), "z")]
    rows += [(4, None, "a"), (5, "", "b"), (6, " \t ", "c"), (None, base, "d"), (7, base, "e"), (7, base, "e")]
    rows += [(None, sentence(rng, 90), "f"), (8, sentence(rng, 20_000), "g")]
    return spark.createDataFrame([(i, t, g, "mine", "mine") for i, t, g in rows], SCHEMA)


def test_nulls_repeats_and_clashing_columns(spark):
    found = simhash.near_duplicates(_cases(spark)).collect()
    assert len(found) == 12
    group = {(r.doc_id, r.component_id) for r in found}
    assert {(1, 1), (2, 1), (7, 1), (None, 1), (4, 4), (5, 4), (6, 4), (3, 3), (8, 8), (None, None)} == group
    assert sum(r.doc_id == 7 for r in found) == 2


def test_keep_one(spark):
    docs = _cases(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or -1, r.lang) for r in rows if r.doc_id != 3) == [(-1, "f"), (1, "x"), (4, "a"), (8, "g")]
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert all(r.fp == "mine" for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_query_on_all_documents(spark, sf):
    from platewright.llm.queries import QUERIES

    rows = QUERIES["op2_simhash"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()
    texts = {r.doc_id: r.text for r in docs}
    assert len(rows) == len(docs)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows[:25]:
        flat = " ".join((texts[r.doc_id] or "").split())
        assert prints[r.doc_id] == plain_fingerprint(flat)
    want = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r.doc_id: r.component_id for r in rows} == want
