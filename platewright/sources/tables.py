"""Readers and writers for assay, candidate, sequence, well and feature tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.functions.common import decimal_comma, finite
from platewright.functions.variants import CANONICAL

# Texts that stand for a missing value.
MISSING = ("NA", "N/A", "NaN", "nan", "null", "NULL", "None", "")
WELL_SCHEMA = (
    "well_id bigint, plate string, well_row int, well_col int, is_blank boolean, raw_od double, "
    "variant string, k int"
)


def read_assay_csv(
    spark: SparkSession, path: str, columns: list[str], numeric: list[str], missing: tuple[str, ...] = MISSING
) -> DataFrame:
    """';'-separated text with decimal commas; empty fields and the texts in ``missing`` are missing.

    Everything is read as text and cast explicitly: the CSV locale option does not apply to doubles.
    """
    schema = ", ".join(f"{c} string" for c in columns)
    raw = spark.read.csv(path, sep=";", header=True, schema=schema)
    given = lambda c: F.when(~F.trim(F.col(c)).isin(*missing), F.col(c))
    return raw.select(*[(decimal_comma(given(c)) if c in numeric else given(c)).alias(c) for c in columns])


def write_assay_csv(df: DataFrame, path: str) -> None:
    text = [
        F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*text).write.mode("overwrite").csv(path, sep=";", header=True, nullValue="NA")


def read_with_provenance(spark: SparkSession, path: str, run: str, fmt: str = "parquet") -> DataFrame:
    """A candidate table with the file each row came from and a run label."""
    return (
        spark.read.format(fmt)
        .load(path)
        .select(
            "*",
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("source_path"),
            F.lit(run).alias("run"),
        )
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, description, upper-cased sequence and a canonical-alphabet flag.

    A record starts at a ``>`` that opens a line; one inside a header or a sequence belongs to its line.
    """
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    records = records.where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    header = F.trim(F.element_at(lines, 1))
    body = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", ""))
    return records.select(
        F.regexp_extract(header, r"^(\S+)", 1).alias("id"),
        header.alias("description"),
        body.alias("sequence"),
        body.rlike(f"^[{CANONICAL}]+$").alias("canonical"),
    )


def write_fasta(df: DataFrame, key: str, sequence: str, path: str) -> None:
    record = F.concat_ws("\n", F.concat(F.lit(">"), F.col(key).cast("string")), F.col(sequence))
    df.select(record.alias("value")).write.mode("overwrite").text(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """The Parquet table, or an empty one of the given schema when the path is absent."""
    try:
        return spark.read.schema(schema).parquet(path), True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), False


def read_wells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WELL_SCHEMA).parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per named result table."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(paths[name])
    return paths


def write_pairs(pairs: DataFrame, group: str, path: str, buckets: int) -> None:
    """Pair table partitioned by a hash bucket of its group, so files do not grow with groups."""
    bucket = F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")
    out = pairs.withColumn("bucket", bucket)
    out.repartition("bucket", group).write.mode("overwrite").partitionBy("bucket").parquet(path)


def publish(df: DataFrame, root: str) -> None:
    """Write ``df`` as the next version of the table under ``root``; readers see it only when it is complete.

    The rows may come from the version that is current: nothing is overwritten.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/v={len(_versions(spark, root)):06d}")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The latest complete version."""
    return spark.read.parquet(_versions(spark, root)[-1])


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of complete versions (with the marker a finished write leaves), oldest first."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_SUCCESS")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().getParent().toString()) for s in fs.globStatus(pattern) or [])


def flat_export(df: DataFrame, nested: list[str], joined: dict[str, str]) -> DataFrame:
    """Drop nested columns, keeping some array columns as joined text."""
    out = df
    for c, name in joined.items():
        out = out.withColumn(name, F.array_join(F.col(c), ";"))
    return out.drop(*nested)


def lookup_features(store: DataFrame, keys: DataFrame, key: list[str], component: str) -> DataFrame:
    """Stored vectors of one component for the requested keys."""
    return keys.join(store.where(F.col("component") == component), key)


def one_row_summary(df: DataFrame, doubles: list[str]) -> DataFrame:
    """Non-finite numbers of a summary row become NULL."""
    return df.select(*[finite(c).alias(c) if c in doubles else F.col(c) for c in df.columns])
