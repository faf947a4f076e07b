"""Registered queries over the training-data tables; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm import (
    attention_lm, curves, decontaminate, infill, licenses, merkle, mixing, secret_scan, simhash, surrogates, toxicity,
    url_filter, warc,
)
from platewright.llm.words import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_curves")
def op1_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector, among all vectors."""
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the fixed formats and what the randomness battery adds."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(
        F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))
    ).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


SQL_OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM f
"""


@query("op4_warc", SQL_OP4)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.round_trip(table(spark, sf_dir, "pages"), columns=columns)


@query("op5_attention_lm")
def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the unigram base and the attention model."""
    return attention_lm.score_texts(table(spark, sf_dir, "documents"))


SQL_OP6 = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
docs AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS words
  FROM items, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS r(i)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS words
  FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)
  WHERE w[i:i + n - 1] IN (SELECT words FROM windows)),
hit_words AS (
  SELECT DISTINCT doc_id, p FROM places, unnest(range(i, i + n)) AS r(p)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
owners AS (SELECT DISTINCT p.doc_id, w.item FROM places AS p JOIN windows AS w ON p.words = w.words),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM owners GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
  coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.listed, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs AS d LEFT JOIN hits AS h USING (doc_id) LEFT JOIN named AS n USING (doc_id)
"""


@query("op6_decontaminate", SQL_OP6)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


# A demonstration key; a real run passes its own secret.
SECRET = b"surrogate demonstration key"


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by keyed surrogates."""
    found = surrogates.pseudonymise(table(spark, sf_dir, "documents"), SECRET)
    return found.select("doc_id", "n_entities", "text")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPELLED = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in sorted(licenses.SPELLINGS.items()))
_LICENSES = ", ".join(f"({_sql_text(name)}, '{licenses.digest(text)}')" for name, text in licenses.KNOWN)
SQL_OP8 = rf"""
WITH k AS (SELECT digest, min(license) AS license FROM (VALUES {_LICENSES}) AS t(license, digest) GROUP BY 1),
sp AS (SELECT map_from_entries(list((a, b))) AS m FROM (VALUES {_SPELLED}) AS t(a, b)),
l AS (
  SELECT doc_id, list_filter(list_transform(list_filter(list_transform(
    string_split(replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), chr(39), ''), chr(10)),
    lambda x: trim(x, ' ')), lambda x: NOT regexp_matches(x, '^[-*#/;%!<>|\x20\t]*(?:copyright|copyrights|©|\(c\))(?:[^A-Za-z0-9_].*)?$')),
    lambda x: trim(regexp_replace(x, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM documents),
d AS (
  SELECT doc_id, list_transform(lines, lambda x: sha256(array_to_string(list_transform(string_split(x, ' '),
      lambda w: coalesce(m[w], w)), ' '))) AS digests,
    sha256(array_to_string(list_transform(string_split(array_to_string(lines, ' '), ' '), lambda w: coalesce(m[w], w)), ' ')) AS whole
  FROM l, sp),
h AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM (SELECT doc_id, unnest(digests) AS digest FROM d) JOIN k USING (digest) GROUP BY 1)
SELECT d.doc_id, k.license, coalesce(h.n, 0)::BIGINT AS n_license_lines, coalesce(h.licenses, '') AS licenses
FROM d LEFT JOIN k ON d.whole = k.digest LEFT JOIN h ON h.doc_id = d.doc_id
"""


@query("op8_licenses", SQL_OP8)
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in all documents."""
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


SQL_OP9 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighed),
final AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE NOT cap <= level * w),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.cap <= l.level * l.w THEN l.cap ELSE f.level * l.w END AS target
  FROM levels AS l CROSS JOIN final AS f),
ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(concat_ws('|', '0', coalesce('s' || d.source, '-'))), 1, 13))::BIGINT::DOUBLE
      / 4503599627370496.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size,
      ('0x' || substr(md5(concat_ws('|', '0', d.doc_id::VARCHAR)), 1, 15))::BIGINT, d.doc_id) AS r
  FROM docs AS d JOIN targets AS t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(r * rate + u) - floor((r - 1) * rate + u)) * size)::BIGINT AS taken
FROM ranked
"""


@query("op9_mixing", SQL_OP9)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql_crc32(text: str) -> str:
    """crc32 of an ASCII string, from the list ``t`` of the 256 remainders."""
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: unicode(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295::BIGINT)"


def _sql_field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode({name}::VARCHAR)) || ':' || {name}::VARCHAR END"


_BIT = "list_reduce(list_prepend(x::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_LEAF = " || ".join(_sql_field(c) for c in merkle.COLUMNS)
_CLAIM = _LEAF.replace("n_chars", "said_chars")
SQL_OP11 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: {_BIT}) AS t),
said AS (
  SELECT *, CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS said_chars FROM documents, crc),
hashed AS (SELECT doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_CLAIM}) AS claim FROM said),
leaves AS (
  SELECT doc_id, leaf, claim, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
nodes AS (
  SELECT 0 AS level, g, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY level, g, i // 2, n),
subroots AS (SELECT g, level AS height, digest FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM upper WHERE n > 1 GROUP BY level, i // 2, n),
folded AS (
  SELECT g, i, 0 AS level, g AS own, i AS at, claim AS acc, '' AS proof, n AS wide FROM leaves
  UNION ALL
  SELECT f.g, f.i, f.level + 1, f.own, f.at // 2,
    sha256(CASE WHEN f.at % 2 = 0 THEN f.acc || coalesce(s.digest, '') ELSE s.digest || f.acc END),
    f.proof || coalesce(s.digest, ''), (f.wide + 1) // 2
  FROM folded AS f LEFT JOIN nodes AS s ON s.level = f.level AND s.g = f.g AND s.i = xor(f.at, 1)
  WHERE f.wide > 1),
below AS (SELECT g, i, acc, proof FROM folded WHERE wide = 1),
above AS (
  SELECT g, i, 0 AS level, g AS at, acc, proof, (SELECT count(*) FROM subroots) AS wide FROM below
  UNION ALL
  SELECT f.g, f.i, f.level + 1, f.at // 2,
    sha256(CASE WHEN f.at % 2 = 0 THEN f.acc || coalesce(s.digest, '') ELSE s.digest || f.acc END),
    f.proof || coalesce(s.digest, ''), (f.wide + 1) // 2
  FROM above AS f LEFT JOIN upper AS s ON s.level = f.level AND s.i = xor(f.at, 1)
  WHERE f.wide > 1),
done AS (SELECT g, i, acc, proof FROM above WHERE wide = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256,
  d.acc AS folded_root, d.acc = r.digest AS verified
FROM leaves AS l JOIN subroots AS s USING (g) JOIN done AS d ON d.g = l.g AND d.i = l.i
  JOIN (SELECT digest FROM upper WHERE n = 1) AS r ON true
"""


@query("op11_merkle", SQL_OP11)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; where 7 divides crc32 of the id, the holder claims one character more."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.verified(merkle.manifest(docs, claims={"n_chars": tampered}))
    return found.withColumnRenamed("key", "doc_id")


_RULES = ", ".join(f"({_sql_text(h)}, {_sql_text(p)}, {_sql_text(v)})" for h, p, v in url_filter.RULES)


def _sql_buckets(column: str, field: int) -> str:
    """Buckets of a field's n-grams, as the rolling hash gives them."""
    out = []
    for size in url_filter.SIZES:
        h = str(field)
        for k in range(size):
            h = f"(({h} * {url_filter.FACTOR} + {column}[i + {k}]) % {url_filter.PRIME})"
        out.append(f"list_transform(range(1, len({column}) - {size - 2}), lambda i: {h} % {url_filter.BUCKETS})")
    return "flatten([" + ", ".join(out) + "])"


def _sql_codes(column: str) -> str:
    marked = f"('^' || regexp_replace(translate({column}, '{licenses.UPPER}', '{licenses.LOWER}'), '[0-9]', '0', 'g') || '$')"
    return f"list_transform(range(1, length({marked}) + 1), lambda i: unicode(substr({marked}, i, 1))::BIGINT + 1)"


def _sql_op12() -> str:
    """The weights are those of the built-in table; training itself is tested by held-out folds."""
    model = url_filter.learn()
    weights = ", ".join(f"({i}, {w})" for i, w in enumerate(model.weights.tolist()) if w)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
weights(bucket, weight) AS (VALUES {weights}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT row_number() OVER () AS r, page_id, translate(raw, '{licenses.UPPER}', '{licenses.LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h),
f AS (
  SELECT r, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path, verdict <> 'block') AS k
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
c AS (SELECT r, {_sql_codes("host")} AS a, {_sql_codes("path")} AS b FROM p WHERE r NOT IN (SELECT r FROM f)),
b AS (SELECT r, unnest(list_distinct(list_concat({_sql_buckets("a", url_filter.HOST)}, {_sql_buckets("b", url_filter.PATH)}))) AS bucket FROM c),
z AS (
  SELECT r, {model.bias} + coalesce(sum(weight), 0)::DOUBLE / sqrt(greatest(1, count(*))) AS odds
  FROM b LEFT JOIN weights USING (bucket) GROUP BY r)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN odds > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON f.r = p.r AND f.k = 1 LEFT JOIN z ON z.r = p.r
"""


@query("op12_url_filter", _sql_op12())
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("log_odds")


SQL_OP13 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM d),
o AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""


@query("op13_infill", SQL_OP13)
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their middles moved, and moved back."""
    found = infill.move_middles(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
