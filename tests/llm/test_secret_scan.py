import base64
import math
import random
import re
import string
import time

import numpy as np
import regex
from helpers import sentence
from pyspark.sql import functions as F

from platewright.llm import secret_scan

DOCS = "doc_id long, text string, base string, spans string"
N_KEYS = 50_000
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def _texts(rng):
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    blob = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    return [
        None,
        "",
        'x 😀 password = "hunter22" é token:abc secret=token: abcdefgh',
        "AKIA" + "A1" * 8 + " AKIASHORT AKIA" + "Z" * 30 + "😀" + key,
        "api_key='" + key + "' API-KEY: no; ApiKey=" + key[:5] + " Api_Key=" + key[:6],
        "deadbeef" * 3 + " " + "deadbeef" * 2 + " password: 1 password:123456",
        "K" * 50 + " ſecret=aaaaaaaaa passwd:" + "b" * 6 + "\n" + "secret = \n abcdefghi",
        (sentence(rng, 4000) + " ") * 5 + key + " " + sentence(rng, 4000),
        *[f"value {blob(48)} end" for _ in range(40)],
        *[" ".join("".join(rng.choice(["tion", "ing", "the", "an", "er"]) for _ in range(9)) for _ in range(20)) for _ in range(40)],
        "Donaudampfschifffahrtsgesellschaft internationalization_of_software_packages",
        "12345678901234567890 00000000000000000000000 abcabcabcabcabcabcabcabc",
    ]


def _scan(spark, texts):
    rows = [(i, t, "mine", "mine") for i, t in enumerate(texts)]
    rows += [(None, texts[3], "a", "b"), (3, texts[3], "a", "b")]
    return spark.createDataFrame(rows, DOCS)


def test_fixed_formats_match_plain_search(spark):
    texts = _texts(random.Random(1))
    got = secret_scan.find_secrets(_scan(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        assert [(s.start, s.kind, s.end) for s in r.base] == plain_base(t), t[:80]
        spans = [(s.start, s.kind, s.end) for s in r.spans]
        assert spans == sorted(spans) and set(plain_base(t)) <= set(spans)


def test_battery_finds_random_tokens_and_leaves_words(spark):
    texts = _texts(random.Random(2))
    got = {r.doc_id: r for r in secret_scan.find_secrets(_scan(spark, texts)).collect()}
    added = {i: [s for s in r.spans if s.kind == 3] for i, r in got.items() if i is not None}
    random_rows = range(8, 48)
    assert sum(bool(added[i]) for i in random_rows) >= 36
    for i in random_rows:
        for s in added[i]:
            assert texts[i][s.start : s.end] == texts[i].split()[1]
    assert not any(added[i] for i in range(48, len(texts)))


def test_redaction(spark):
    texts = _texts(random.Random(3))
    docs = _scan(spark, texts)
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r for r in clean.collect() if r.doc_id is not None}
    assert rows[0].text is None and rows[1].text == "" and rows[50].text == texts[50] and rows[50].base == "mine"
    assert rows[3].text == "[SECRET] AKIASHORT [SECRET]😀[SECRET]"
    assert "hunter22" not in rows[2].text and rows[2].text.startswith("x 😀 [SECRET]\" é token:abc")
    assert clean.count() == len(texts) + 2


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert secret_scan.find_secrets(none).count() == 0
    assert secret_scan.redact(none).count() == 0


def test_plan_is_native(spark):
    texts = spark.createDataFrame([(1, "a", "", "")], DOCS)
    plan = secret_scan.redact(texts)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_battery(token):
    """Encoding, length class, z bin and plausibility of one token, formula by formula."""
    enc = next(i for i, (p, _, _) in enumerate(secret_scan.ENCODINGS) if re.fullmatch(p, token))
    _, alphabet, rate = secret_scan.ENCODINGS[enc]
    n, k = len(token), len(alphabet)
    x = np.array([alphabet.index(c) + 1 for c in token], dtype=float)
    chi = sum(token.count(c) ** 2 for c in set(token)) * k / n - n
    part = 2 / (9 * (k - 1))
    uniform = ((chi / (k - 1)) ** (1 / 3) - (1 - part)) / math.sqrt(part)
    up = x > (k + 1) / 2
    both = 2 * up.sum() * (n - up.sum())
    spread = both * (both - n) / (n * n * (n - 1))
    runs = 1 + (up[1:] != up[:-1]).sum()
    alternating = (runs - both / n - 1) / math.sqrt(spread) if spread > 0 else 99.0
    d = x - x.mean()
    serial = ((d[1:] * d[:-1]).sum() / (d**2).sum() + 1 / n) * math.sqrt(n) if (d**2).sum() > 0 else 99.0
    excess = k * rate - 1
    z = (chi - (k - 1) - (n - 1) * excess) / math.sqrt(2 * (k - 1) + 4 * n * excess)
    bin_ = max(secret_scan.LOWEST_BIN, min(0, math.ceil(z * secret_scan.BINS_PER_UNIT)))
    fine = max(abs(uniform), abs(alternating), abs(serial)) <= secret_scan.TEST_BOUND
    return enc, int(math.log2(n)), bin_, fine


def test_battery_and_control_against_plain_formulas(spark):
    rng = random.Random(7)
    alphabets = ["0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", string.ascii_letters + string.digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "aab", "a"]
    tokens = ["".join(rng.choice(a) for _ in range(rng.randrange(16, 23 if "f" in a and len(a) == 16 else 60))) for a in alphabets for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i long, t string")
    one = F.array(F.struct(F.lit(0).alias("start"), F.char_length("t").alias("end"), F.col("t").alias("token")))
    tested = table.select("t", secret_scan.battery(one).alias("_tested"))
    got = {r.t: r["_tested"][0] for r in tested.collect()}
    want = {t: plain_battery(t) for t in tokens}
    assert {t: (g.enc, g["size"], g.bin, g.plausible) for t, g in got.items()} == want
    # Benjamini and Hochberg by hand on the same bins, every stratum by itself.
    strata = {}
    for t in tokens:
        strata.setdefault(want[t][:2], []).append(want[t][2])
    limits = {}
    for key, bins in strata.items():
        for b in sorted(set(bins)):
            chance = 0.5 * math.erfc(-(b / secret_scan.BINS_PER_UNIT) / math.sqrt(2)) * len(bins)
            if b < 0 and chance <= secret_scan.FALSE_SHARE * sum(x <= b for x in bins):
                limits[key] = b
    assert {(r.enc, r["size"]): r.bin for r in secret_scan.thresholds(tested).collect()} == limits and limits


def test_tokens_that_meet_a_span_are_left_out(spark):
    rng = random.Random(8)
    texts = [
        " ".join(rng.choice(["password=", "x", "", "api_key: "]) + "".join(rng.choice("abcDEF09+/") for _ in range(rng.randrange(1, 40))) for _ in range(60))
        for _ in range(30)
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    base = secret_scan.base_spans(F.col("t"))
    for r in table.select("t", secret_scan.candidates(F.col("t"), base).alias("c")).collect():
        spans = plain_base(r.t)
        tokens = [m.span() for m in regex.finditer(secret_scan.TOKEN, r.t)]
        want = [(a, b) for a, b in tokens if not any(s < b and a < e for s, _, e in spans)]
        assert [(c.start, c.end) for c in r.c] == want


def plain_redaction(t, spans):
    out, at = "", 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def test_replacement_across_chunks(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(secret_scan, "CHUNK", 7)
    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    rows = []
    for i in range(60):
        t = "".join(rng.choice("ab😀\né") for _ in range(rng.randrange(80)))
        spans = sorted((a, rng.randrange(3), min(len(t), a + rng.randrange(1, 20))) for a in (rng.randrange(max(1, len(t))) for _ in range(rng.randrange(1, 12))) if a < len(t))
        if spans:
            rows.append((i, t, spans))
    rows += [(100, "abc", [(0, 1, 3)]), (101, "abcdefg" * 2, [(0, 1, 7), (7, 0, 14)])]
    table = spark.createDataFrame(rows, f"i long, t string, s array<{secret_scan.SPAN}>")
    got = {r.i: r.x for r in table.select("i", secret_scan.replaced(F.col("t"), F.col("s"), "[SECRET]").alias("x")).collect()}
    assert got == {i: plain_redaction(t, s) for i, t, s in rows}


def test_many_keys_in_one_text_take_seconds(spark):
    rng = random.Random(10)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(N_KEYS)]
    text = " ".join(keys)
    docs = spark.createDataFrame([(1, text, "", ""), (2, "calm", "", "")], DOCS)
    begun = time.time()
    found = {r.doc_id: r.base for r in secret_scan.find_secrets(docs).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert len(found[1]) == N_KEYS and clean[1] == " ".join(["[SECRET]"] * N_KEYS) and clean[2] == "calm"
    assert time.time() - begun < 60
