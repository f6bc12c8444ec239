"""Readers and writers of the formats in use. All are lazy but the writers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = (
    "ku_id string, title string, knowledge_type string, stage string, severity string, role array<string>, problem_type array<string>, trade array<string>, material array<string>, scope string, description string, typical_scenario string, how_to_avoid string, trigger_keywords array<string>, related_ku_ids array<string>, "
    "evidence struct<source_type: string, source_ref: string, frequency: string, confidence: string>, causal_chain struct<root_cause: string, direct_cause: string, consequence: string>, standard_number string, standard_authority string, standard_requirement string, compliance_criteria string, verification_method string, "
    "metadata struct<created_at: string, updated_at: string, created_by: string, verified: boolean, verify_method: string, verified_by: string, version: string, source_file: string, quality_level: string, expires_at: string, last_reviewed_at: string, finalized_at: string>"
)


def read_json(spark: SparkSession, path: str, schema: str = UNIT) -> DataFrame:
    """Files that hold one array or one object each, with ``source_file`` and ``corrupt`` (the text of what can't be read)."""
    raw = spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return raw.withColumn("source_file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A comma-separated file with header, quoted fields (doubled quotes) and line ends inside them; a byte order mark and blank rows are dropped. All columns are strings, empty ones null."""
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=True).csv(path)
    return df.na.drop(how="all")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, length`` of a dictionary file: the first field of each line."""
    w = spark.read.text(path).select(F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("word"))
    return w.where("word <> ''").select("word", F.length("word").alias("length"))


def read_material(spark: SparkSession, path: str) -> DataFrame:
    """``stem, kind, pages``: files named ``contract_*`` or ``quote_*``; those that end in ``__p<n>`` are pages of one stem, in order. Contents aren't read."""
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("name"), "path")
    kind = F.regexp_extract("name", "^(contract|quote)_", 1)
    page = F.coalesce(F.nullif(F.regexp_extract("name", r"__p([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    each = f.select(F.regexp_replace("name", r"__p[0-9]+$", "").alias("stem"), kind.alias("kind"), page.alias("page"), "path").where("kind <> ''")
    return each.groupBy("stem", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "path"))), lambda x: x["path"]).alias("pages"))


def read_map(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``clause, page`` of a JSON object that holds a map under ``name``."""
    return spark.read.schema(f"`{name}` map<string, int>").option("multiLine", True).json(path).select(F.explode(name).alias("clause", "page"))


def read_small(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON table that is read anew by every query; an empty one where the file is missing."""
    fs, p = _fs(spark, path)
    return spark.read.schema(schema).option("multiLine", True).json(path) if fs.exists(p(path)) else spark.createDataFrame([], schema)


def write_version(df: DataFrame, folder: str) -> str:
    """Writes a new version beside the earlier ones and returns its path; nothing is overwritten, so what reads an earlier version may go on."""
    path = f"{folder}/v={int(time.time() * 1e6)}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_shards(df: DataFrame, folder: str, by: str, known: list[str] | None = None) -> None:
    """A folder for each value of ``by``; only folders of values in ``df`` are replaced. ``known``: values that are kept, all others dropped."""
    if known is not None:
        df = df.where(F.col(by).isin(known))
    df.repartition(F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def write_csv(df: DataFrame, folder: str, mark: bool = False) -> None:
    """Comma-separated files with header; arrays of strings are joined by commas. ``mark``: each file begins with a byte order mark."""
    name = lambda k, c: "\ufeff" + c if mark and k == 0 else c
    cols = [(F.array_join(c, ",") if t == "array<string>" else F.col(c)).alias(name(k, c)) for k, (c, t) in enumerate(df.dtypes)]
    df.select(*cols).write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=not mark).csv(folder)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_state(df: DataFrame, folder: str) -> None:
    """Replaces a small table as a whole: it is written beside the old one, which gives way only when the new one is complete."""
    spark = df.sparkSession
    fs, path = _fs(spark, folder)
    df.write.mode("overwrite").json(f"{folder}.new")
    fs.delete(path(f"{folder}.old"), True)
    if fs.exists(path(folder)):
        fs.rename(path(folder), path(f"{folder}.old"))
    fs.rename(path(f"{folder}.new"), path(folder))
    fs.delete(path(f"{folder}.old"), True)


def read_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table that ``write_state`` left; an empty one where there is none. One that can't be read is put aside as ``<folder>.bak`` and counts as empty."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception:
        fs.delete(path(f"{folder}.bak"), True)
        fs.rename(path(folder), path(f"{folder}.bak"))
        return spark.createDataFrame([], schema)
    return df


def append(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)
