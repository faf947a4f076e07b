"""Secret scans with DataFrame functions only: fixed formats, and a randomness battery for everything else.

A long token that is neither of the fixed formats is tested against what its alphabet allows. Under chance
every symbol is equally likely (chi-squared), highs and lows alternate (runs), and neighbours do not depend on
each other (serial correlation). The same chi-squared value is also held against written text, whose letters
coincide far more often; how far it falls below what text of that length gives is the evidence for a secret.
That evidence passes a false-discovery control within tokens of like encoding and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewright.functions.normal import upper_tail
from platewright.llm.store import saved

# The formats, as the contract words them, and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 6, 20

# A candidate is a whole run of symbols that encodings use, with nothing of a word next to it.
LEAST_TOKEN = 16
TOKEN = (
    rf"(?<![\p{{L}}\p{{N}}+/_=-])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}+(?![\p{{L}}\p{{N}}])={{0,2}}"
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed values, narrowest first: pattern, alphabet in order, and how often two symbols of structured or written strings
# in that alphabet are equal. 0.066 is the index of coincidence of English letters; the other rates are judgements: a
# little less where case or digits mix in, and about twice chance for numbers and hexadecimal with repeated digits.
ENCODINGS = (
    ("[0-9]+", DIGITS, 0.20),
    ("[0-9a-f]+", DIGITS + "abcdef", 0.125),
    ("[0-9A-F]+", DIGITS + "ABCDEF", 0.125),
    ("[a-z]+", LOWER, 0.066),
    ("[A-Z]+", UPPER, 0.066),
    ("[A-Z2-7]+", UPPER + "234567", 0.062),
    ("[a-z0-9]+", LOWER + DIGITS, 0.060),
    ("[A-Z0-9]+", UPPER + DIGITS, 0.060),
    ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS, 0.056),
    ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/", 0.055),
    ("[A-Za-z0-9_+/-]+", UPPER + LOWER + DIGITS + "-_+/", 0.055),
)
# Two-sided normal bound for each of three randomness tests at 1 % together.
TEST_BOUND = 2.94
BINS_PER_UNIT, LOWEST_BIN = 20, -600
FALSE_SHARE = 0.05

SPAN = "struct<start:int,kind:int,end:int>"
BLOCK = 256
CHUNK = 4096


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, join) -> Column:
    """The fold of every prefix of an integer array by an associative ``join``.

    Arrays grow only within blocks and over the list of blocks, so a long array is not copied once per entry.
    """

    def grown(part: Column, at: Column) -> Column:
        return F.aggregate(
            part, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: F.struct(
                join(acc["at"], v).alias("at"), F.array_append(acc["out"], join(acc["at"], v)).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return F.when(F.size(v) > 0, parts).otherwise(F.array().cast("array<array<int>>"))

    def folded(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, join))
        begins = F.slice(F.concat(F.array(zero), grown(totals, zero)), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, begins, grown))

    return let(let(values, cut), folded)


def _sum(a: Column, b: Column) -> Column:
    return (a + b).cast("int")


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pieces(text: Column, pattern: str, end: str) -> Column:
    """``array<struct<end, match>>`` of the matches of ``pattern``; ends are code points.

    Consecutive pieces of the text each end with a match; one pass, as \\G lets no search restart. ``end`` finds the match
    at the end of its piece.
    """
    found = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{pattern}"), F.lit(0))

    def described(found: Column) -> Column:
        ends = running(F.transform(found, F.char_length), F.lit(0), _sum)
        matched = F.transform(found, lambda p: F.regexp_extract(p, end, 0))
        return F.arrays_zip(ends.alias("end"), matched.alias("match"))

    return let(found, described)


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the matches that ``keep(match)`` accepts; offsets are code points."""
    number = KINDS.index(kind)
    found = F.filter(pieces(text, pattern, rf"(?s){pattern}\z"), lambda p: keep(p["match"]))
    return F.transform(
        found,
        lambda p: F.struct(
            (p["end"] - F.char_length(p["match"])).cast("int").alias("start"), F.lit(number).alias("kind"),
            p["end"].cast("int").alias("end"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed formats, sorted by start and kind."""
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN + r"\z", 1)) >= LEAST_VALUE
    access = lambda m: F.char_length(m) >= LEAST_ACCESS
    always = lambda m: F.lit(True)
    found = F.concat(
        _spans(text, ASSIGN, "assign", value),
        _spans(text, ACCESS, "access", access),
        _spans(text, HEX, "hex", always),
    )
    return F.array_sort(found)


def _by_encoding(encoding: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), encoding + 1)


def _encoding(token: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, (pattern, _, _) in enumerate(ENCODINGS):
        out = out.when(token.rlike(f"^{pattern}$"), F.lit(i))
    return out.otherwise(F.lit(len(ENCODINGS) - 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def battery(tokens: Column) -> Column:
    """``array<struct<start, end, token>>`` -> start, end, encoding, length class, z bin, plausible.

    ``plausible``: none of the three tests speaks against chance. The z bin places the chi-squared value among
    those of text of this length, in twentieths of a standard deviation below.
    """
    coded = F.transform(
        tokens,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"),
            _encoding(c["token"]).alias("enc"), F.char_length(c["token"]).cast("double").alias("n"),
        ),
    )
    alphabets, rates = [a for _, a, _ in ENCODINGS], [r for _, _, r in ENCODINGS]
    placed = F.transform(
        coded,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"), c["n"].alias("n"),
            _by_encoding(c["enc"], [float(len(a)) for a in alphabets]).alias("k"),
            _by_encoding(c["enc"], rates).alias("rate"),
            F.transform(
                F.array_distinct(F.split(c["token"], "")),
                lambda s: F.char_length(c["token"]) - F.char_length(F.replace(c["token"], s, F.lit(""))),
            ).alias("counts"),
            F.transform(
                F.split(c["token"], ""),
                lambda s: F.instr(_by_encoding(c["enc"], alphabets), s).cast("double"),
            ).alias("x"),
        ),
    )
    summed = F.transform(
        placed,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"),
            c["n"].alias("n"), c["k"].alias("k"), c["rate"].alias("rate"), c["x"].alias("x"),
            (_total(F.transform(c["counts"], lambda s: (s * s).cast("double"))) * c["k"] / c["n"] - c["n"]).alias("chi"),
            (_total(c["x"]) / c["n"]).alias("mean"),
            _total(F.transform(c["x"], lambda v: (v > (c["k"] + 1) / 2).cast("double"))).alias("high"),
        ),
    )
    pairs = F.transform(
        summed,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"), c["n"].alias("n"),
            c["k"].alias("k"), c["rate"].alias("rate"), c["chi"].alias("chi"),
            c["high"].alias("high"), (c["n"] - c["high"]).alias("low"),
            _total(F.transform(c["x"], lambda v: (v - c["mean"]) * (v - c["mean"]))).alias("spread"),
            _total(
                F.zip_with(
                    F.slice(c["x"], F.lit(2), F.size(c["x"]) - 1), F.slice(c["x"], F.lit(1), F.size(c["x"]) - 1),
                    lambda a, b: (a - c["mean"]) * (b - c["mean"]),
                )
            ).alias("lagged"),
            (1 + _total(
                F.zip_with(
                    F.slice(c["x"], F.lit(2), F.size(c["x"]) - 1), F.slice(c["x"], F.lit(1), F.size(c["x"]) - 1),
                    lambda a, b: ((a > (c["k"] + 1) / 2) != (b > (c["k"] + 1) / 2)).cast("double"),
                )
            )).alias("runs"),
        ),
    )

    def tests(c: Column) -> Column:
        df, n = c["k"] - 1, c["n"]
        # Wilson and Hilferty: the cube root of chi-squared over its mean is nearly normal.
        part = F.lit(2.0) / (F.lit(9.0) * df)
        uniform = (F.pow(c["chi"] / df, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)
        both = 2 * c["high"] * c["low"]
        spread = both * (both - n) / (n * n * (n - 1))
        alternating = F.when(spread > 0, (c["runs"] - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))
        serial = F.when(c["spread"] > 0, (c["lagged"] / c["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        excess = c["k"] * c["rate"] - 1
        written = (c["chi"] - df - (n - 1) * excess) / F.sqrt(2 * df + 4 * n * excess)
        bin_ = F.greatest(F.lit(LOWEST_BIN), F.least(F.lit(0), F.ceil(written * BINS_PER_UNIT).cast("int")))
        fine = (F.abs(uniform) <= TEST_BOUND) & (F.abs(alternating) <= TEST_BOUND) & (F.abs(serial) <= TEST_BOUND)
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"),
            F.floor(F.log2(n)).cast("int").alias("size"), bin_.alias("bin"), fine.alias("plausible"),
        )

    return F.transform(pairs, tests)


def candidates(text: Column, base: Column) -> Column:
    """Tokens that meet no base span, as ``array<struct<start, end, token>>``.

    Both lists are sorted once: a token meets a span that starts before it if the furthest end so far lies beyond
    its start, and one that starts inside it if the nearest start to come lies before its end.
    """
    tokens = F.transform(
        pieces(text, TOKEN, rf"(?s){TOKEN}\z"),
        lambda p: F.struct(
            (p["end"] - F.char_length(p["match"])).cast("int").alias("start"), F.lit(1).alias("kind"),
            p["end"].cast("int").alias("end"), F.rtrim(p["match"], F.lit("=")).alias("token"),
        ),
    )
    spans = F.transform(
        base,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(0).alias("kind"), s["end"].alias("end"), F.lit("").alias("token")
        ),
    )
    far = F.lit(2**31 - 1)

    def apart(both: Column) -> Column:
        reached = running(F.transform(both, lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(0)), F.lit(0), _most)
        starts = F.transform(F.reverse(both), lambda e: F.when(e["kind"] == 0, e["start"]).otherwise(far))
        coming = F.reverse(running(starts, far, _least))
        return F.arrays_zip(both.alias("e"), reached.alias("reached"), coming.alias("coming"))

    placed = let(F.array_sort(F.concat(spans, tokens)), apart)
    free = lambda p: (p["e"]["kind"] == 1) & (p["reached"] <= p["e"]["start"]) & (p["coming"] >= p["e"]["end"])
    return F.transform(
        F.filter(placed, free),
        lambda p: F.struct(
            p["e"]["start"].alias("start"), p["e"]["end"].alias("end"), p["e"]["token"].alias("token")
        ),
    )


def thresholds(tested: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """``enc, size, bin``: the largest z bin that the false-discovery control admits in each stratum.

    Benjamini and Hochberg on a fixed grid of z: of all candidates of like encoding and length (by powers of
    two), the expected number by chance up to a bin must stay under ``share`` of those found there. Counts per bin
    are pre-aggregated, so a stratum of any size is a histogram of at most 601 rows.
    """
    one = tested.select(F.explode("_tested").alias("c")).select("c.enc", "c.size", "c.bin")
    histogram = one.groupBy("enc", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    stratum = W.partitionBy("enc", "size")
    grown = histogram.withColumn("upto", F.sum("n").over(stratum.orderBy("bin"))).withColumn(
        "all", F.sum("n").over(stratum)
    )
    chance = upper_tail(F.col("bin") / F.lit(float(BINS_PER_UNIT))) * F.col("all")
    # The last bin holds everything that text explains.
    admitted = grown.where((F.col("bin") < 0) & (chance <= F.lit(share) * F.col("upto")))
    return admitted.groupBy("enc", "size").agg(F.max("bin").alias("bin"))


def _scanned(docs: DataFrame, text: Column) -> DataFrame:
    base = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_base", base_spans(F.col("_text")))
    return base.withColumn("_tested", battery(candidates(F.col("_text"), F.col("_base"))))


def _admitted(limits: list) -> Column:
    """Spans of tested candidates that pass; ``limits`` holds at most one row per encoding and power of two."""
    if not limits:
        return F.array().cast(f"array<{SPAN}>")
    table = F.create_map(*[F.lit(v) for r in limits for v in (r["enc"] * 64 + r["size"], r["bin"])])
    limit = lambda c: F.coalesce(F.try_element_at(table, c["enc"] * 64 + c["size"]), F.lit(LOWEST_BIN - 1))
    passed = F.filter("_tested", lambda c: c["plausible"] & (c["bin"] <= limit(c)))
    number = KINDS.index("random")
    return F.transform(
        passed, lambda c: F.struct(c["start"].alias("start"), F.lit(number).alias("kind"), c["end"].alias("end"))
    )


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, kind, end) in code points, ``kind`` an index into KINDS.

    ``base`` holds the fixed formats, ``spans`` these and the tokens that the battery adds, sorted by start and
    kind. Null text counts as empty and gives empty arrays; null ids and repeated rows keep a row each; an
    empty table gives no rows; further columns are ignored. Texts are read once; the narrow result of the scan
    is written before the corpus-wide control.
    """
    scanned = _scanned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), F.col("text"))
    scanned = saved(scanned.select("doc_id", F.col("_base").alias("base"), "_tested"), "secrets")
    limits = thresholds(scanned).collect()
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", _admitted(limits))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Code points [a, b) of the text whose chunks of CHUNK code points these are; reads only the chunks it touches."""
    i, j = F.floor(a / F.lit(CHUNK)).cast("int"), F.floor(b / F.lit(CHUNK)).cast("int")
    at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    head = F.substr(at(i), a - i * CHUNK + 1, F.lit(CHUNK))
    between = F.array_join(F.slice(chunks, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
    across = F.concat(head, between, F.substr(at(j), F.lit(1), b - j * CHUNK))
    return F.when(i == j, F.substr(at(i), a - i * CHUNK + 1, b - a)).otherwise(across)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` for every run of overlapping spans, which are sorted by start."""
    pieces_of = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), F.lit(0), _most)

    def joined(chunks: Column, reached: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reached, F.lit(1), F.greatest(F.lit(0), F.size(reached) - 1)))
        placed = F.arrays_zip(F.transform(spans, lambda s: s["start"]).alias("start"), before.alias("before"))
        fresh = F.filter(placed, lambda p: p["start"] >= p["before"])
        parts = F.transform(fresh, lambda p: F.concat(_cut(chunks, p["before"], p["start"]), F.lit(mark)))
        tail = _cut(chunks, F.element_at(reached, -1), F.char_length(text).cast("int"))
        return F.concat(F.array_join(parts, ""), tail)

    return let(pieces_of, lambda chunks: let(ends, lambda reached: joined(chunks, reached)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Every row, with each secret replaced by ``mark``; overlapping spans are replaced together.

    All columns come back as they were, null texts stay null. Texts are scanned once: rows and what was found in them
    are written, and the control is taken from there.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = _scanned(docs.select(F.struct(*names).alias("_row")), F.col("_row")[text])
    found = saved(found.select("_row", "_base", "_tested"), "secrets")
    limits = thresholds(found).collect()
    marked = found.withColumn("_all", F.array_sort(F.concat("_base", _admitted(limits))))
    whole = F.col("_row")[text]
    changed = F.when(F.size("_all") > 0, replaced(whole, F.col("_all"), mark)).otherwise(whole)
    return marked.withColumn("_changed", changed).select(
        *[F.col("_changed").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    )
