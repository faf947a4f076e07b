import random

import pytest
from helpers import sentence

from platewright.llm import decontaminate
from platewright.llm.words import alnum_words

DOCS = "doc_id long, text string, items string, n_hit string"


def brute(text, items, width=13):
    words = alnum_words((text or "").encode())
    hit, held = set(), set()
    for item, t in items:
        w = alnum_words((t or "").encode())
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    held.add(str(item))
    return len(words), len(hit), sorted(held)


def _fixture(rng):
    items = [(i, sentence(rng, n)) for i, n in enumerate([40, 13, 14, 5, 1, 30])]
    items += [(6, None), (7, " .,! "), (1, "Extra passage of item one."), (8, items[0][1][:200])]
    docs = [sentence(rng, 60) for _ in range(6)]
    words = items[0][1].split()
    docs += [
        docs[0] + " " + " ".join(words[3:25]) + " " + docs[1],
        " ".join(words[3:15]),
        items[1][1].upper().replace(" ", ", "),
        items[3][1] + ".\n" + items[4][1],
        "x " * 400 + items[2][1],
        items[5][1] + " " + items[5][1],
        None,
        "",
        "extra  passage\tOF item-one",
        sentence(rng, 30_000) + " " + items[5][1] + " " + sentence(rng, 30_000),
    ]
    return docs, items


@pytest.mark.parametrize("block_bytes", [32 << 20, 100])
def test_matches_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (block_bytes,))
    docs, items = _fixture(random.Random(1))
    rows = [(i, t, "mine", "mine") for i, t in enumerate(docs)] + [(None, docs[6], "a", "b"), (8, docs[8], "a", "b")]
    table = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([*items, (None, docs[0])], "item_id long, text string")
    found = decontaminate.contamination(table, bench).collect()
    assert len(found) == len(rows)
    for r in found:
        text = docs[r.doc_id] if r.doc_id is not None else docs[6]
        n, hit, held = brute(text if len(text or "") < 10_000 else text[-9_000_000:], items) if r.doc_id != 15 else (None,) * 3
        if n is None:
            assert "5" in r["items"] and r.n_hit >= 30 and not r.contaminated and r.n_words == 60_030
            continue
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, held)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    bad = sum(r.contaminated for r in found)
    assert 0 < bad and kept.count() == len(rows) - bad
    cut = {r.doc_id: r.text for r in decontaminate.cut_passages(table, bench).collect()}
    assert cut[12] is None and cut[13] == "" and cut[1] == docs[1]
    assert brute(cut[6], items[:1])[1] == 0 and cut[6].startswith(docs[0]) and cut[6].endswith(docs[1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.contamination(docs, none).first()
    assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (3, 0, [], False)
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_query_matches_sql(spark, sf):
    from check_queries import compare, connect

    from platewright.llm.queries import ORACLES, QUERIES

    for name in ("op6_decontaminate", "op8_licenses", "op9_mixing", "op4_warc"):
        assert compare(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLES[name]).df()) == "", name
