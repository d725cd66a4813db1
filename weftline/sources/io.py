"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE_SCHEMA = """vfp_id string, affected_files map<string,string>,
    findings array<struct<id int, title string, description string, severity string,
    category map<string,array<string>>, location array<string>, files array<string>>>"""
ANNOTATION_SCHEMA = "filePath string, SWCs array<struct<category string, function string, lineNumber string>>"


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON bundles, one document a file, with a fixed schema (no inference pass) and the
    ``stem`` of the file's name.

    A file that is no JSON gives no row.
    """
    raw = spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", ""))


def findings_of(bundles: DataFrame) -> DataFrame:
    """One row a finding with its position; bundles without findings give none."""
    return bundles.select("vfp_id", F.posexplode("findings").alias("ord", "f")).select("vfp_id", "ord", "f.*")


def files_of(bundles: DataFrame) -> DataFrame:
    """The sources of each bundle: ``vfp_id, ord, file, text`` in their order in the file."""
    return bundles.select("vfp_id", F.posexplode(F.map_entries("affected_files")).alias("ord", "e")).select(
        "vfp_id", "ord", F.col("e.key").alias("file"), F.col("e.value").alias("text")
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """S3: annotation files, one row an annotation."""
    raw = spark.read.schema(ANNOTATION_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return raw.select("filePath", F.posexplode("SWCs").alias("ord", "s")).select("filePath", "ord", "s.*")


def read_sources(spark: SparkSession, path: str, glob: str = "*.sol", bundle: str | None = None) -> DataFrame:
    """Every source file below a folder: ``path, text``; unreadable files are skipped.

    With ``bundle`` all files belong to one constant bundle, as for a library.
    """
    df = (
        spark.read.option("ignoreCorruptFiles", True)
        .text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return df.withColumn("bundle", F.lit(bundle)) if bundle is not None else df


def read_items(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or lines of JSON; give a schema for large input."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def with_existing(df: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose file is listed, and the number of those that are not."""
    marked = df.join(listing.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.where("__there").drop("__there"), marked.agg(F.count_if(F.col("__there").isNull()).alias("missing"))


def write_items(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    """Overwrite a table as Parquet or JSON, in folders by the columns ``by``."""
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def render_report(title: str, tables: Mapping[str, DataFrame], most: int = 200) -> str:
    """A Markdown report of aggregates; at most ``most`` rows of each table, with a note on more."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
        out += ["", f"More than {most} rows."] if len(rows) > most else [""]
    return "\n".join(out)


def save_weights(spark: SparkSession, params: Mapping, path: str) -> None:
    """Named arrays and numbers of a model as a small table."""
    import numpy as np

    rows = [(k, list(np.shape(v)), [float(x) for x in np.ravel(v)]) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").json(path)


def load_weights(spark: SparkSession, path: str) -> dict:
    import numpy as np

    rows = spark.read.schema("name string, shape array<int>, data array<double>").json(path).collect()
    return {r["name"]: np.array(r["data"] or []).reshape(r["shape"] or ()) for r in rows}
