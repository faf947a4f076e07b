"""Licence texts found by the digest of their canonical form."""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.license_texts import ISC, MIT, notices, whole_texts  # noqa: F401
from platewright.llm.store import saved
from platewright.operators.stability import broadcast_if_small

# Equivalent spellings (one word for one word), and what opens a copyright line.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "sublicences": "sublicenses", "organisation": "organization", "organisations": "organizations",
    "authorisation": "authorization", "authorised": "authorized", "favour": "favor", "whilst": "while",
    "judgement": "judgment", "acknowledgement": "acknowledgment", "recognised": "recognized", "https": "http",
    "licensor's": "licensors", "merchantibility": "merchantability",
}
# A copyright line may stand behind the marks of a comment.
COPYRIGHT = r"^[-*#/;%!<>|\x20\t]*(?:copyright|copyrights|©|\(c\))(?:\W.*)?$"
KNOWN = tuple(whole_texts() + notices())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def plain_lines(text: str) -> list[str]:
    """The lines of a text without case, punctuation and copyright lines; lines without words are left out."""
    out = []
    for line in text.translate(str.maketrans(UPPER, LOWER)).replace("'", "").split("\n"):
        line = line.strip()
        if re.match(COPYRIGHT, line):
            continue
        words = re.findall(r"[^\W_]+", line)
        if words:
            out.append(" ".join(words))
    return out


def digest(text: str) -> str:
    """sha256 of the canonical form, '' for a text without words. The same as the column expressions give."""
    words = " ".join(plain_lines(text)).split()
    return sha256(" ".join(SPELLINGS.get(w, w) for w in words).encode()).hexdigest() if words else ""


def known_licenses(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """``license, digest, n_words`` of licence texts."""
    rows = sorted({(name, digest(t), len(" ".join(plain_lines(t)).split())) for name, t in texts})
    return spark.createDataFrame(rows, "license string, digest string, n_words int")


def lines_column(text: Column) -> Column:
    """Lines as ``plain_lines`` makes them, JVM-side."""
    low = F.replace(F.translate(text, UPPER, LOWER), F.lit("'"), F.lit(""))
    lines = F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(x)), lambda x: ~x.rlike(COPYRIGHT))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, PUNCTUATION, " ")))
    return F.filter(bare, lambda x: x != "")


def digest_column(line: Column) -> Column:
    """Digest of a line or of joined lines after equivalent spellings."""
    pairs = [F.lit(x) for kv in sorted(SPELLINGS.items()) for x in kv]
    table = F.create_map(*pairs)
    words = F.transform(F.split(line, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.sha2(F.array_join(words, " ").cast("binary"), 256)


def find_licenses(
    docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, license, n_license_lines, licenses`` for every row.

    ``license`` names the licence whose canonical text the whole document is (the first by name, if several have
    the same digest), ``licenses`` all that some line of it is, and ``n_license_lines`` counts those lines. A
    digest is taken only of texts and lines with as many words as some known licence, as spellings stand word for
    word. ``known`` holds ``license, digest, n_words``; it is broadcast if measured small and joined by a shuffle
    otherwise, on digests that few rows reach.

    Null and empty texts have no licence; null ids and repeated rows keep a row each; an empty table gives no
    rows; further columns are ignored.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    table = saved(known.groupBy("digest", "n_words").agg(F.min("license").alias("license")), "licenses")
    # One number per length of a known text.
    sizes = [r["n_words"] for r in table.select("n_words").distinct().collect()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))
    lined = rows.select("doc_id", "rid", lines_column(F.coalesce("text", F.lit(""))).alias("lines"))
    counts = F.array(*[F.lit(n) for n in sizes]).cast("array<int>")
    size = lambda x: F.size(F.split(x, " "))
    fitting = F.filter("lines", lambda x: F.array_contains(counts, size(x)))
    whole = F.aggregate("lines", F.lit(0), lambda n, x: n + size(x))
    whole = F.when(F.array_contains(counts, whole), digest_column(F.array_join("lines", " ")))
    units = lined.select(
        "doc_id", "rid", F.transform(fitting, digest_column).alias("lines"), whole.alias("whole")
    )
    units = saved(units, "units")
    unit = F.explode(
        F.concat(
            F.transform("lines", lambda x: F.struct(x.alias("digest"), F.lit(False).alias("whole"))),
            F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("whole").alias("digest"), F.lit(True).alias("whole")))).otherwise(
                F.array().cast("array<struct<digest:string,whole:boolean>>")
            ),
        )
    )
    hits = units.select("rid", unit.alias("u")).select("rid", "u.digest", "u.whole")
    hits = hits.join(broadcast_if_small(table.select("digest", "license")), "digest")
    per_doc = hits.groupBy("rid").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.sum(F.when(~F.col("whole"), 1).otherwise(0)).alias("n_license_lines"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("licenses"),
    )
    out = units.select("doc_id", "rid").join(per_doc, "rid", "left")
    return out.select(
        "doc_id",
        "license",
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )
