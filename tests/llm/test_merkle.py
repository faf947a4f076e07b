import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from platewright.llm import merkle
from platewright.llm.words import crc_mod

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g long, i long, digest string, key string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(row):
    return [("-" if v is None else f"{len(str(v).encode())}:{v}") for v in row]


def climb(digests, k):
    """Levels of one tree, as worded: runs of k become their parents until one node is left."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + k]) for i in range(0, len(last), k)])
    return levels


def siblings(levels, i, k):
    out = []
    for level in levels[:-1]:
        first = i - i % k
        run = level[first : first + k]
        out.append((run[: i % k], run[i % k + 1 :]))
        i //= k
    return out


def brute(rows, k):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, one tree after the other."""
    trees = defaultdict(list)
    for r in rows:
        doc_id, source, lang, n_chars, text = r
        leaf = H(*written(r))
        off = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        claim = H(*written((doc_id, source, lang, n_chars + 1, text))) if off else leaf
        trees[lang].append((doc_id is not None, doc_id or 0, leaf, claim, doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:4])], k) for s in names}
    upper = climb([made[s][-1][0] for s in names], k)
    root, out = upper[-1][0], []
    for at, s in enumerate(names):
        for i, (_, _, leaf, claim, doc_id) in enumerate(sorted(trees[s], key=lambda x: x[:4])):
            path = siblings(made[s], i, k) + siblings(upper, at, k)
            folded = claim
            for left, right in path:
                folded = H(*left, folded, *right)
            proof = H(*[d for left, right in path for d in left + right])
            out.append((doc_id, leaf, made[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows():
    out = [(i, f"s{i % 3}", ("en", "de", "fr", None, "é", "")[min(5, i % 13)], i * 7, "wörd " * (i % 5)) for i in range(150)]
    out += [(200, "lone", "zz", 3, None), (None, None, "en", None, None), (None, None, "en", None, ""), (14, "s2", "en", None, "x")]
    return out + [out[5], out[5], out[6]]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_against_brute_force(spark, arity):
    given = rows()
    docs = spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in given], DOCS)
    tampered = F.when(crc_mod(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.verified(merkle.manifest(docs, claims={"n_chars": tampered}, arity=arity)).collect()
    want = brute(given, arity)
    assert sorted((tuple(r) for r in found), key=str) == want
    assert {w[-1] for w in want} == {True, False}


def test_order_of_rows_and_partitions_does_not_matter(spark):
    given = rows()
    make = lambda some, n: merkle.manifest(
        spark.createDataFrame([(*r, 1, 2, "", "") for r in some], DOCS).repartition(n)
    ).root
    assert make(given, 3) == make(given[::-1], 11)
    changed = [*given[:-1], (*given[-1][:4], "other text")]
    assert make(changed, 3) != make(given, 3)


def test_one_row_and_no_rows(spark):
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 2, "ab", 0, 0, "", "")], DOCS))
    r = merkle.verified(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H() and r.verified
    none = merkle.manifest(spark.createDataFrame([], DOCS))
    assert none.root is None and merkle.verified(none).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], DOCS), arity=1)
