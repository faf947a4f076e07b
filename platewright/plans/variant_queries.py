"""Variant parsing and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import variants as X
from platewright.operators import encoding as E
from platewright.plans import views as V
from platewright.plans.registry import query

PARENT = dict(zip(V.POSITIONS, V.PARENT))
_PARENT_SQL = "MAP {" + ", ".join(f"{p}: '{w}'" for p, w in PARENT.items()) + "}"
_NAMES = "list_sort(list_distinct(toks))"
_POSS = "list_sort(list_distinct(poss))"


def parsed(spark, sf):
    v = V.variants(spark, sf)
    return v.withColumn("muts", X.parse_mutations("mutations"))


@query(
    "str_1",
    """SELECT variant_id, i AS place, poss[i + 1]::BIGINT AS pos, wts[i + 1] AS wt, muts[i + 1] AS mut
    FROM (SELECT *, unnest(range(len(toks))) AS i FROM v_parsed)""",
)
def str_1(spark, sf):
    return parsed(spark, sf).select("variant_id", F.posexplode("muts").alias("place", "m")).select(
        "variant_id", "place", "m.pos", "m.wt", "m.mut"
    )


@query(
    "str_2",
    f"""WITH e AS (SELECT variant_id, toks, poss, muts, wts, lower(trim(mutations)) IN ('', 'wt', 'wildtype', 'wild type', 'nan') AS is_wt,
    regexp_replace(regexp_replace(upper(trim(mutations)), '[A-Z][0-9]+[A-Z]', '', 'g'), '[\\s;,/_+]+', '', 'g') AS rest FROM v_parsed)
    SELECT variant_id, CASE WHEN is_wt THEN NULL WHEN len(toks) = 0 OR rest <> '' THEN 'malformed'
    WHEN len(list_filter(poss, lambda x: x < 1)) > 0 THEN 'bad_position'
    WHEN len(list_distinct(poss)) < len(poss) THEN 'duplicate_position'
    WHEN len(list_filter(list_concat(wts, muts), lambda x: instr('{X.CANONICAL}', x) = 0)) > 0 THEN 'noncanonical'
    WHEN len(list_filter(list_zip(poss, wts), lambda z: {_PARENT_SQL}[z[1]] <> z[2])) > 0 THEN 'wild_type_mismatch'
    WHEN len(list_filter(list_zip(wts, muts), lambda z: z[1] = z[2])) > 0 THEN 'no_op' END AS problem FROM e""",
)
def str_2(spark, sf):
    return V.variants(spark, sf).select(
        "variant_id", X.parse_problem("mutations", PARENT).alias("problem")
    )


@query(
    "str_3",
    """SELECT variant_id, coalesce(lower(trim(mutations)), '') IN ('', 'wt', 'wildtype', 'wild type', 'nan') AS wild_type FROM v_var""",
)
def str_3(spark, sf):
    return V.variants(spark, sf).select("variant_id", X.is_wild_type("mutations").alias("wild_type"))


_SEQ = "substr(p_name || p_type, p_size % 5 + 1)"


def sequences(spark, sf):
    """Text of varying length as a stand-in for chain sequences."""
    text = F.concat("p_name", "p_type")
    seq = F.substring(text, F.col("p_size") % 5 + 1, F.length(text))
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_partkey") % 31 != 0, seq).alias("seq")
    )


def _residue_sql(pos: int) -> str:
    s = "upper(trim(seq))"
    return f"""CASE WHEN seq IS NULL THEN 'missing_value' WHEN length({s}) < {pos} THEN 'too_short'
    WHEN instr('{X.CANONICAL}', substr({s}, {pos}, 1)) = 0 THEN 'noncanonical' ELSE 'ok' END"""


_SEQS = f"(SELECT p_partkey AS candidate_id, CASE WHEN p_partkey % 31 <> 0 THEN {_SEQ} END AS seq FROM part)"


@query(
    "str_4",
    f"""SELECT candidate_id, status, CASE WHEN status = 'ok' THEN substr(upper(trim(seq)), 12, 1) END AS residue
    FROM (SELECT *, {_residue_sql(12)} AS status FROM {_SEQS})""",
)
def str_4(spark, sf):
    residue, status = X.residue_at("seq", 12)
    return sequences(spark, sf).select("candidate_id", status.alias("status"), residue.alias("residue"))


@query(
    "str_5",
    f"""SELECT candidate_id, status, CASE WHEN status = 'ok' THEN substr(upper(trim(seq)), 2, 1) || substr(upper(trim(seq)), 4, 1)
    || substr(upper(trim(seq)), 8, 1) END AS pocket FROM (SELECT *, CASE WHEN {_residue_sql(2)} = 'ok' AND {_residue_sql(4)} = 'ok'
    AND {_residue_sql(8)} = 'ok' THEN 'ok' ELSE 'incomplete_pocket' END AS status FROM {_SEQS})""",
)
def str_5(spark, sf):
    parts = [X.residue_at("seq", p) for p in (2, 4, 8)]
    status = X.pocket_status([s for _, s in parts])
    return sequences(spark, sf).select(
        "candidate_id",
        status.alias("status"),
        F.when(status == "ok", F.concat(*[r for r, _ in parts])).alias("pocket"),
    )


_DIFF = "list_filter(list_zip([99, 134, 304, 330], ['D', 'F', 'T', 'A'], pocket), lambda z: z[2] <> z[3])"


@query(
    "str_6",
    f"""SELECT candidate_id, array_to_string([z[2] || z[1] || z[3] FOR z IN d], ';') AS mutations,
    array_to_string([z[1] FOR z IN d], '+') AS positions, len(d) AS n FROM (SELECT *, {_DIFF} AS d FROM v_cand)""",
)
def str_6(spark, sf):
    c = V.candidates(spark, sf).withColumn("d", X.differences("pocket", PARENT))
    return c.select(
        "candidate_id",
        X.mutation_text("d").alias("mutations"),
        F.array_join(F.transform("d", lambda m: m["pos"].cast("string")), "+").alias("positions"),
        F.size("d").alias("n"),
    )


@query(
    "str_7",
    """SELECT variant_id, coalesce((SELECT string_agg(t, ';' ORDER BY p, substr(t, 1, 1), substr(t, -1)) FROM (SELECT unnest(toks) AS t, unnest(poss) AS p)), '') AS text FROM v_parsed""",
)
def str_7(spark, sf):
    return parsed(spark, sf).select("variant_id", X.mutation_text("muts").alias("text"))


@query(
    "str_8",
    f"""SELECT variant_id, CASE WHEN len(poss) = 0 THEN 'WT' ELSE array_to_string({_POSS}, '+') END AS signature FROM v_parsed""",
)
def str_8(spark, sf):
    return parsed(spark, sf).select("variant_id", X.signature("muts").alias("signature"))


@query("str_9", "SELECT variant_id, len(toks) AS mutation_order FROM v_parsed")
def str_9(spark, sf):
    return parsed(spark, sf).select("variant_id", F.size("muts").alias("mutation_order"))


@query(
    "str_10",
    "SELECT variant_id, len(list_filter(poss, lambda x: x NOT IN (99, 134, 304, 330))) = 0 AS only_modelled FROM v_parsed",
)
def str_10(spark, sf):
    return parsed(spark, sf).select(
        "variant_id", X.only_positions("muts", V.POSITIONS).alias("only_modelled")
    )


@query("str_11", f"SELECT array_to_string({_NAMES}, ',') AS set_key, count(*) AS n FROM v_parsed GROUP BY 1")
def str_11(spark, sf):
    return (
        parsed(spark, sf)
        .groupBy(X.set_key("muts").alias("set_key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reference_sequence() -> str:
    """A 340-letter reference by rule, carrying the parent residues at the modelled positions."""
    letters = [V.ALPHABET[(i * 7) % 20] for i in range(340)]
    for p, w in PARENT.items():
        letters[p - 1] = w
    return "".join(letters)


@query(
    "str_12",
    f"""SELECT variant_id, len(toks) AS n, md5(CASE len(toks) WHEN 0 THEN ref WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) AS digest FROM (
    SELECT *, substr(s2, 1, poss[3] - 1) || muts[3] || substr(s2, poss[3] + 1) AS s3 FROM (
    SELECT *, substr(s1, 1, poss[2] - 1) || muts[2] || substr(s1, poss[2] + 1) AS s2 FROM (
    SELECT *, substr(ref, 1, poss[1] - 1) || muts[1] || substr(ref, poss[1] + 1) AS s1 FROM (
    SELECT *, '{reference_sequence()}' AS ref FROM v_parsed WHERE len(list_filter(poss, lambda x: x > 340 OR x < 1)) = 0))))""",
)
def str_12(spark, sf):
    ref = F.lit(reference_sequence())
    inside = F.forall("muts", lambda m: (m["pos"] >= 1) & (m["pos"] <= F.length(ref)))
    return (
        parsed(spark, sf)
        .where(inside)
        .select(
            "variant_id",
            F.size("muts").alias("n"),
            F.md5(X.apply_mutations(ref, "muts")).alias("digest"),
        )
    )


@query(
    "str_13",
    "SELECT p_partkey, trim(regexp_replace(upper(p_brand), '^BRAND[#_-]', '')) AS key FROM part",
)
def str_13(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", X.normalise_key("p_brand", "^BRAND[#_-]").alias("key")
    )


@query(
    "str_14",
    "SELECT well_id, chr(64 + well_row) || lpad(well_col::VARCHAR, greatest(2, length(well_col::VARCHAR))::INT, '0') AS well FROM v_well",
)
def str_14(spark, sf):
    return V.wells(spark, sf).select("well_id", X.well_label("well_row", "well_col").alias("well"))


@query(
    "str_15",
    """SELECT p_partkey, p_type || '__' || p_partkey AS composite, 'candidate_' || lpad(i, greatest(7, length(i))::INT, '0') AS fallback
    FROM (SELECT *, (row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR AS i FROM part)""",
)
def str_15(spark, sf):
    from platewright.operators.ranking import row_positions

    part = V.table(spark, sf, "part").select("p_partkey", "p_type")
    pos = row_positions(part, [], [("p_partkey", False)])
    return pos.select(
        "p_partkey",
        F.concat_ws("__", "p_type", F.col("p_partkey").cast("string")).alias("composite"),
        F.concat(F.lit("candidate_"), X.pad_left(F.col("pos") - 1, 7)).alias("fallback"),
    )


@query(
    "str_16",
    "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS label, count(*) AS n FROM lineitem GROUP BY 1",
)
def str_16(spark, sf):
    names = F.create_map(F.lit("A"), F.lit("accepted"), F.lit("R"), F.lit("returned"))
    label = F.coalesce(F.element_at(names, F.col("l_returnflag")), F.col("l_returnflag"))
    return V.table(spark, sf, "lineitem").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "str_17",
    """WITH o AS (SELECT i, list_distinct(list(pocket[i])) AS seen FROM v_cand, range(1, 5) AS r(i) WHERE m2 < 1000 AND m1 <= 12 GROUP BY i)
    SELECT candidate_id, sum((NOT list_contains(seen, pocket[i]))::INT)::BIGINT AS novelty FROM v_cand, o GROUP BY 1""",
)
def str_17(spark, sf):
    """Training rows are the low-metric candidates; everything is scored against their residues."""
    c = V.candidates(spark, sf)
    train = c.where((F.col("m2") < 1000) & (F.col("m1") <= 12))
    seen = E.observed_sets(train, "pocket", 4)
    table = seen.agg(F.array_sort(F.collect_list(F.struct("slot", "residues")))["residues"]).scalar()
    rows = c.select("candidate_id", "pocket", table.alias("seen"))
    return rows.select("candidate_id", X.novelty("pocket", F.col("seen")).alias("novelty"))


@query(
    "str_18",
    "SELECT p_partkey, lower(CASE WHEN p_size % 3 = 0 THEN 'True' WHEN p_size % 3 = 1 THEN 'no' ELSE 'TRUE ' END) LIKE 'true%' AS flag FROM part",
)
def str_18(spark, sf):
    s = F.col("p_size") % 3
    text = F.when(s == 0, "True").when(s == 1, "no").otherwise("TRUE ")
    return V.table(spark, sf, "part").select("p_partkey", X.text_boolean(text).alias("flag"))


_RULES = {
    "has_99": {"positions": (99,)},
    "has_d99g": {"names": ("D99G",)},
    "pair_99_134": {"positions": (99, 134)},
    "combined": {"positions": (99,), "names": ("F134W",)},
}


@query(
    "arr_2",
    """SELECT variant_id, list_contains(poss, 99) AS has_99, list_contains(toks, 'D99G') AS has_d99g,
    list_contains(poss, 99) AND list_contains(poss, 134) AS pair_99_134,
    list_contains(poss, 99) AND list_contains(toks, 'F134W') AS combined FROM v_parsed""",
)
def arr_2(spark, sf):
    return parsed(spark, sf).select(
        "variant_id", *[c.alias(n) for n, c in X.flags("muts", _RULES).items()]
    )


@query(
    "arr_3",
    """SELECT variant_id, list_contains(poss, 99)::BIGINT AS pos_99, list_contains(poss, 134)::BIGINT AS pos_134,
    list_contains(poss, 304)::BIGINT AS pos_304, list_contains(poss, 330)::BIGINT AS pos_330 FROM v_parsed""",
)
def arr_3(spark, sf):
    items = F.transform(X.positions_of("muts"), lambda p: F.concat(F.lit("pos_"), p.cast("string")))
    return E.indicator_columns(
        parsed(spark, sf), "variant_id", items, [f"pos_{p}" for p in V.POSITIONS]
    )


@query(
    "arr_4",
    """SELECT pair, count(*) AS n FROM (SELECT DISTINCT a.variant_id, a.t || '__' || b.t AS pair
    FROM (SELECT variant_id, unnest(toks) AS t FROM v_parsed) a JOIN (SELECT variant_id, unnest(toks) AS t FROM v_parsed) b
    ON a.variant_id = b.variant_id AND a.t < b.t) GROUP BY 1""",
)
def arr_4(spark, sf):
    pairs = parsed(spark, sf).select(F.explode(X.item_pairs(X.mutation_names("muts"))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query(
    "arr_5",
    f"""SELECT candidate_id, (SELECT string_agg(((pocket[(i // 20) + 1] = substr('{X.CANONICAL}', (i % 20 + 1)::INT, 1))::INT)::VARCHAR, '' ORDER BY i)
    FROM range(80) AS r(i)) AS bits FROM v_cand""",
)
def arr_5(spark, sf):
    bits = F.transform(X.one_hot("pocket"), lambda b: b.cast("int").cast("string"))
    return V.candidates(spark, sf).select("candidate_id", F.array_join(bits, "").alias("bits"))


@query(
    "arr_6",
    """SELECT candidate_id, i AS dim, CASE i % 3 WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS value
    FROM v_cand, range(12) AS r(i) JOIN v_lookup ON residue = pocket[(i // 3) + 1]""",
    "value",
)
def arr_6(spark, sf):
    vec = E.concatenated_descriptors(
        V.candidates(spark, sf), "candidate_id", "pocket", V.descriptor_lookup(spark, sf), ["d0", "d1", "d2"]
    )
    return vec.select("candidate_id", F.posexplode("vec").alias("dim", "value"))


@query(
    "agg_17",
    """SELECT poss AS pos, count(DISTINCT muts) AS n_distinct, count(*) AS n_rows, array_to_string(list_sort(list_distinct(list(muts))), ',') AS residues
    FROM (SELECT unnest(poss) AS poss, unnest(muts) AS muts FROM v_parsed) WHERE poss IN (99, 134, 304, 330) GROUP BY 1""",
    "",
    "pos",
)
def agg_17(spark, sf):
    m = parsed(spark, sf).select(F.explode("muts").alias("m")).select("m.pos", "m.mut")
    counts = (
        m.where(F.col("pos").isin(list(V.POSITIONS)))
        .groupBy("pos", "mut")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        F.array_sort(F.collect_set("mut")).alias("residues"),
    )


@query("agg_18", "SELECT len(toks) AS n_mutations, count(*) AS n FROM v_parsed GROUP BY 1")
def agg_18(spark, sf):
    return parsed(spark, sf).groupBy(F.size("muts").alias("n_mutations")).agg(F.count(F.lit(1)).alias("n"))


_OK = "len(toks) > 0 AND len(list_filter(poss, lambda x: x NOT IN (99, 134, 304, 330))) = 0"


@query(
    "fil_1",
    f"""SELECT variant_id, 'core' AS part FROM v_parsed WHERE {_OK} UNION ALL SELECT variant_id, 'excluded' FROM v_parsed WHERE NOT ({_OK})
    UNION ALL SELECT variant_id, 'all' FROM v_parsed""",
)
def fil_1(spark, sf):
    from platewright.operators.reshape import split_by, stack_tables

    v = parsed(spark, sf)
    core, excluded = split_by(v, (F.size("muts") > 0) & X.only_positions("muts", V.POSITIONS))
    tables = {"core": core, "excluded": excluded, "all": v}
    return stack_tables({k: d.select("variant_id") for k, d in tables.items()}, "part")


_CAND_KEY = f"array_to_string(list_sort([z[2] || z[1] || z[3] FOR z IN {_DIFF}]), ',')"


@query(
    "fil_2",
    f"""SELECT candidate_id FROM v_cand WHERE {_CAND_KEY} NOT IN (SELECT array_to_string({_NAMES}, ',') FROM v_parsed)""",
)
def fil_2(spark, sf):
    tested = parsed(spark, sf).select(X.set_key("muts").alias("k")).distinct()
    c = V.candidates(spark, sf).withColumn("k", X.set_key(X.differences("pocket", PARENT)))
    return c.join(tested, "k", "left_anti").select("candidate_id")


@query(
    "fil_3",
    f"""SELECT count(*) AS n_audit, count_if({_residue_sql(12)} = 'ok')::BIGINT AS n_ok FROM {_SEQS}""",
)
def fil_3(spark, sf):
    from platewright.operators.reshape import split_by

    audit = sequences(spark, sf).withColumn("status", X.residue_at("seq", 12)[1])
    ok, rejected = split_by(audit, F.col("status") == "ok")
    n_ok = ok.agg(F.count(F.lit(1)).alias("n")).scalar()
    return audit.agg(F.count(F.lit(1)).alias("n_audit")).withColumn("n_ok", n_ok)


@query(
    "joi_1",
    f"""SELECT candidate_id, {_CAND_KEY} IN (SELECT array_to_string({_NAMES}, ',') FROM v_parsed) AS already_tested FROM v_cand""",
)
def joi_1(spark, sf):
    tested = parsed(spark, sf).select(X.set_key("muts").alias("k")).distinct().withColumn("hit", F.lit(True))
    c = V.candidates(spark, sf).withColumn("k", X.set_key(X.differences("pocket", PARENT)))
    joined = c.join(tested, "k", "left")
    return joined.select("candidate_id", F.coalesce("hit", F.lit(False)).alias("already_tested"))


@query(
    "joi_3",
    """SELECT candidate_id, i - 1 AS slot, pocket[i] AS residue, d0, d1 FROM (SELECT *, unnest(range(1, 5)) AS i FROM v_cand)
    LEFT JOIN (SELECT * FROM v_lookup WHERE residue <> 'Y') ON residue = pocket[i]""",
    "d0 d1",
)
def joi_3(spark, sf):
    lookup = V.descriptor_lookup(spark, sf).where(F.col("residue") != "Y")
    return E.lookup_residues(V.candidates(spark, sf), "candidate_id", "pocket", lookup, ["d0", "d1"])


@query(
    "mod_2",
    f"""WITH u AS (SELECT variant_id, unnest({_POSS}) AS position FROM v_parsed), g AS (SELECT position, count(*) AS n_test FROM u GROUP BY 1)
    SELECT position, n_test, (SELECT count(*) FROM v_parsed) - n_test AS n_train, (SELECT count(*) FROM v_parsed) - n_test >= 5 AS usable FROM g""",
    "",
    "position",
)
def mod_2(spark, sf):
    from platewright.operators.folds import holdout_by_position

    v = parsed(spark, sf).withColumn("positions", X.positions_of("muts"))
    return holdout_by_position(v, "variant_id", "positions")
