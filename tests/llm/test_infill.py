import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewright.llm import infill


def draws(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing the string."""
    text = text or ""
    h1, h2, h3, h4 = draws(doc_id)
    n = len(text)
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rows_against_slicing(spark):
    rng = random.Random(4)
    letters = "ab <P>SM\n" + "äß€漢😀\u0301"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (9, "twice"), (9, "twice"), (10, "x<P>y"), (11, "<" * 50)]
    rows += [(12, "漢x" * 200_000), (13, "long " * 300_000), (15, "€")]
    docs = spark.createDataFrame([(*r, 5, "f", "o") for r in rows], "doc_id long, text string, n int, form string, output string")
    found = infill.move_middles(docs)
    found = found.withColumn("back", infill.restored_text(F.col("output"), F.col("form"))).collect()
    want = [(d, *brute(d, t), t or "") for d, t in rows]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.back).decode()) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infill.move_middles(docs.limit(0)).count() == 0


@given(st.text(alphabet="<PSM>a€😀", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
@settings(max_examples=400, deadline=None)
def test_round_trip(text, a, b, form):
    raw = text.encode()
    if infill.has_sentinel(raw):
        return
    assert infill.code_points(raw) == len(text)
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    cuts = infill.byte_offsets(raw, [a, b])
    assert cuts == [len(text[:a].encode()), len(text[:b].encode())]
    out = infill.moved(raw, *cuts, form)
    assert len(out) == len(raw) + 9 and infill.restored(out, form) == raw


def test_offsets_across_blocks(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 5)
    text = "a€漢b😀" * 40
    raw = text.encode()
    for a in range(0, len(text) + 1, 7):
        assert infill.byte_offsets(raw, [a, len(text)]) == [len(text[:a].encode()), len(raw)]
    assert infill.code_points(raw) == len(text)
