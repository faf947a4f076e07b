"""Variant descriptions as column expressions: parsing, validation, encoding.

A mutation is ``struct<pos int, wt string, mut string>`` so that arrays sort by position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewright.functions.common import col

# Canonical residue letters, wild-type spellings, the mutation token and separators.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
WILD_TYPE_WORDS = ("", "wt", "wildtype", "wild type", "nan")
TOKEN = "([A-Z])([0-9]+)([A-Z])"
SEPARATORS = r"[\s;,/_+]+"


def is_wild_type(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))), F.lit("")).isin(list(WILD_TYPE_WORDS))


def _clean(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def _mutation(pos: Column, wt: Column, mut: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), wt.alias("wt"), mut.alias("mut"))


def parse_mutations(c: str | Column) -> Column:
    """Text to an array of mutations in text order; wild type gives an empty array."""
    tokens = F.regexp_extract_all(_clean(c), F.lit(TOKEN), F.lit(0))
    parsed = F.transform(
        tokens,
        lambda t: _mutation(
            F.substring(t, F.lit(2), F.length(t) - 2).try_cast("int"),
            F.substring(t, F.lit(1), F.lit(1)),
            F.substring(t, F.length(t), F.lit(1)),
        ),
    )
    empty = F.array().cast("array<struct<pos:int,wt:string,mut:string>>")
    return F.when(is_wild_type(c), empty).otherwise(parsed)



def parse_problem(
    c: str | Column, parent: dict[int, str], reference: str | Column | None = None
) -> Column:
    """First problem of a description, or NULL: malformed, bad_position, duplicate_position,
    outside_reference, noncanonical, wild_type_mismatch, no_op."""
    muts = parse_mutations(c)
    rest = F.regexp_replace(F.regexp_replace(_clean(c), TOKEN, ""), SEPARATORS, "")
    positions = F.transform(muts, lambda m: m["pos"])
    letters = F.array(*[F.lit(x) for x in CANONICAL])
    foreign = F.exists(
        muts,
        lambda m: ~F.array_contains(letters, m["wt"]) | ~F.array_contains(letters, m["mut"]),
    )
    if reference is None:
        expected = F.create_map(*[F.lit(v) for kv in parent.items() for v in kv])
        wrong = F.exists(
            muts, lambda m: F.coalesce(F.element_at(expected, m["pos"]) != m["wt"], F.lit(False))
        )
        outside = F.lit(False)
    else:
        ref = col(reference)
        wrong = F.exists(muts, lambda m: F.substring(ref, m["pos"], F.lit(1)) != m["wt"])
        outside = F.exists(muts, lambda m: m["pos"] > F.length(ref))
    return F.when(
        ~is_wild_type(c),
        F.when((F.size(muts) == 0) | (rest != ""), "malformed")
        .when(F.exists(positions, lambda p: p.isNull() | (p < 1)), "bad_position")
        .when(F.size(F.array_distinct(positions)) < F.size(positions), "duplicate_position")
        .when(foreign, "noncanonical")
        .when(outside, "outside_reference")
        .when(wrong, "wild_type_mismatch")
        .when(F.exists(muts, lambda m: m["wt"] == m["mut"]), "no_op"),
    )


def mutation_names(muts: str | Column) -> Column:
    return F.transform(col(muts), lambda m: F.concat(m["wt"], m["pos"].cast("string"), m["mut"]))


def mutation_text(muts: str | Column) -> Column:
    """Sorted by position, ';'-joined."""
    return F.array_join(mutation_names(F.array_sort(col(muts))), ";")


def positions_of(muts: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(col(muts), lambda m: m["pos"])))


def signature(muts: str | Column) -> Column:
    p = positions_of(muts)
    joined = F.array_join(F.transform(p, lambda x: x.cast("string")), "+")
    return F.when(F.size(p) == 0, F.lit("WT")).otherwise(joined)


def set_key(muts: str | Column) -> Column:
    """Order-insensitive identity of a variant; arrays group and join where maps cannot."""
    return F.array_sort(F.array_distinct(mutation_names(muts)))


def only_positions(muts: str | Column, modelled: tuple[int, ...]) -> Column:
    allowed = F.array(*[F.lit(p) for p in modelled])
    return F.size(F.array_except(positions_of(muts), allowed)) == 0


def pocket_of(muts: str | Column, parent: dict[int, str]) -> Column:
    """Residue at each modelled position in fixed order, the parent's where unmutated."""

    def residue(pos: int, letter: str) -> Column:
        here = F.filter(col(muts), lambda m: m["pos"] == pos)
        return F.coalesce(F.get(F.transform(here, lambda m: m["mut"]), F.lit(0)), F.lit(letter))

    return F.array(*[residue(pos, letter) for pos, letter in parent.items()])


def apply_mutations(reference: str | Column, muts: str | Column) -> Column:
    """Point substitutions on a 1-based sequence."""
    return F.aggregate(
        col(muts),
        col(reference),
        lambda s, m: F.concat(
            F.substring(s, F.lit(1), m["pos"] - 1),
            m["mut"],
            F.substring(s, m["pos"] + 1, F.length(s)),
        ),
    )


def differences(pocket: str | Column, parent: dict[int, str]) -> Column:
    """Mutations that turn the parent pocket into this one."""
    wts = F.array(*[_mutation(F.lit(p), F.lit(w), F.lit("")) for p, w in parent.items()])
    paired = F.zip_with(wts, col(pocket), lambda w, x: _mutation(w["pos"], w["wt"], x))
    return F.filter(paired, lambda m: m["wt"] != m["mut"])


def residue_at(sequence: str | Column, position: int) -> tuple[Column, Column]:
    """(residue or NULL, status) at a 1-based position of a sequence column."""
    s = F.upper(F.trim(col(sequence)))
    r = F.substring(s, F.lit(position), F.lit(1))
    letters = F.array(*[F.lit(x) for x in CANONICAL])
    status = (
        F.when(col(sequence).isNull(), "missing_value")
        .when(F.length(s) < position, "too_short")
        .when(~F.array_contains(letters, r), "noncanonical")
        .otherwise("ok")
    )
    return F.when(status == "ok", r), status


def pocket_status(statuses: list[Column]) -> Column:
    """Any failed position makes the pocket incomplete."""
    ok = F.lit(True)
    for s in statuses:
        ok = ok & (s == "ok")
    return F.when(ok, "ok").otherwise("incomplete_pocket")


def flags(muts: str | Column, rules: dict[str, dict]) -> dict[str, Column]:
    """Named boolean flags from rules with ``positions`` and/or ``names`` that must all be present."""
    names, positions = mutation_names(muts), positions_of(muts)
    out = {}
    for flag, rule in rules.items():
        ok = F.lit(True)
        for p in rule.get("positions", ()):
            ok = ok & F.array_contains(positions, F.lit(p))
        for n in rule.get("names", ()):
            ok = ok & F.array_contains(names, F.lit(n))
        out[flag] = ok
    return out


def item_pairs(items: str | Column) -> Column:
    """All ``a__b`` pairs of a row's sorted distinct items (a row holds few items)."""
    s = F.array_sort(F.array_distinct(col(items)))
    return F.flatten(
        F.transform(
            s,
            lambda a: F.transform(
                F.filter(s, lambda b: b > a), lambda b: F.concat(a, F.lit("__"), b)
            ),
        )
    )


def one_hot(pocket: str | Column) -> Column:
    """Position x residue indicators as one array of doubles."""
    letters = F.array(*[F.lit(x) for x in CANONICAL])
    return F.flatten(
        F.transform(
            col(pocket),
            lambda r: F.transform(letters, lambda a: (a == r).cast("double")),
        )
    )


def normalise_key(c: str | Column, prefix_pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.upper(col(c)), prefix_pattern, ""))


def well_label(row: str | Column, column: str | Column) -> Column:
    """Plate coordinate: rows A-Z, then AA, AB, ... as on large plates; columns of at least two digits."""
    n = col(row).cast("int") - 1
    letter = lambda i: F.char(F.lit(65) + i)
    first = F.when(n >= 26, letter((n / 26).cast("int") - 1)).otherwise(F.lit(""))
    return F.concat(first, letter(n % 26), pad_left(col(column), 2))


def pad_left(number: Column, width: int) -> Column:
    """Zero-padded to ``width``; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def text_boolean(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))) == "true", F.lit(False))


def novelty(pocket: str | Column, observed: Column) -> Column:
    """Positions whose residue was never observed; ``observed`` is an array of residue arrays."""
    seen = F.zip_with(col(pocket), observed, lambda r, o: F.array_contains(o, r))
    return F.size(F.filter(seen, lambda x: ~F.coalesce(x, F.lit(False))))
