"""Delimited extracts in, tables and report files out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.deaths import match_deaths
from ..schemas import DEATH_KEYS, EXTRACTS

BAD_LINE = "bad_line"


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def _text_scan(spark: SparkSession, path: str, sep: str, keep_bad: bool = False, multi_line: bool = False) -> DataFrame:
    """All columns as text, in the order of the file's own header line."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    names = reader.csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in names]
    if keep_bad:
        fields.append(T.StructField(BAD_LINE, T.StringType()))
        # a parser that reads only some columns doesn't count a line's fields
        reader = reader.option("columnNameOfCorruptRecord", BAD_LINE).option("columnPruning", False)
    return reader.schema(T.StructType(fields)).option("mode", "PERMISSIVE").csv(path)


def read_extract(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = "\t", multi_line: bool = False
) -> DataFrame:
    """Read a delimited file, keep the schema's columns, lower-case the names.

    Columns are found by name, so the file may hold more of them in any order;
    only the kept ones are parsed.  A value that does not fit its type is NULL.
    Without a schema every column is kept as text.
    """
    df = lower_names(_text_scan(spark, path, sep, multi_line=multi_line))
    if schema is None:
        return df
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of a delimited file that hold what they should, and a quarantine of what does not.

    A line with another number of fields than the header is in the quarantine only.  A
    value that does not fit its type becomes NULL in its row and is listed as well.  The
    quarantine has (file, reason, column, value, line): ``fields`` with the whole line, or ``type``
    with the value.  ``multi_line`` lets quoted values hold line ends; such a file is read by one
    task, so keep files of that kind small.
    """
    raw = _text_scan(spark, path, sep, keep_bad=True, multi_line=multi_line).withColumn("_file", F.col("_metadata.file_path"))
    names = {c.lower(): c for c in raw.columns}
    kept = [(f, F.col(f"`{names[f.name]}`")) for f in schema.fields]
    # a reader needs a column of the file beside the broken line; this one is always there
    first = F.col(f"`{raw.columns[0]}`")
    whole = F.col(BAD_LINE).isNull() & (F.coalesce(F.length(first), F.lit(0)) >= 0)
    rows = raw.where(whole).select(*[c.try_cast(f.dataType).alias(f.name) for f, c in kept])
    text = F.lit(None).cast("string")
    misfits = F.array_compact(F.array(*[
        F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("column"), c.alias("value")))
        for f, c in kept if not isinstance(f.dataType, T.StringType)
    ])) if any(not isinstance(f.dataType, T.StringType) for f, _ in kept) else None
    rejects = raw.where(~whole).select(
        F.col("_file").alias("file"), F.lit("fields").alias("reason"), text.alias("column"), text.alias("value"),
        F.col(BAD_LINE).alias("line"),
    )
    if misfits is not None:
        rejects = rejects.unionByName(raw.where(whole).select("_file", F.inline(misfits)).select(
            F.col("_file").alias("file"), F.lit("type").alias("reason"), "column", "value", text.alias("line")
        ))
    return rows, rejects


def registry_rejects(spark: SparkSession, paths: dict[str, str], multi_line=()) -> DataFrame:
    """The quarantine of all extracts of the registry that have a schema, with the extract's name.

    ``multi_line`` names the extracts whose quoted values may hold line ends.
    """
    return stacked([
        read_checked(spark, paths[name], schema, "," if name == "patients" else "\t", name in multi_line)[1]
        .withColumn("extract", F.lit(name))
        for name, schema in EXTRACTS.items()
    ])


def rejected_lines(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines whose number of fields differs from the header's."""
    return lower_names(_text_scan(spark, path, sep, keep_bad=True)).where(F.col(BAD_LINE).isNotNull())


def read_by_prefix(
    spark: SparkSession, path: str, names, prefixes=(), sep: str = ","
) -> DataFrame:
    """All-text columns picked by name plus every column starting with a prefix."""
    df = lower_names(_text_scan(spark, path, sep))
    picked = [c for c in df.columns if c in names or any(c.startswith(p) for p in prefixes)]
    return df.select(*picked)


def read_registry(
    spark: SparkSession, paths: dict[str, str], rejects_path: str | None = None, multi_line=()
) -> dict[str, DataFrame]:
    """Load every base table from the extract files.

    ``paths`` names the file of each extract in ``schemas.EXTRACTS`` plus ``ndi``
    and ``ndi_cause``.  Patients are comma-separated, the others tab-separated.  With
    ``rejects_path`` malformed lines are left out of the tables, and the quarantine
    (``registry_rejects``) is written there as parquet.
    """
    def load(name, schema):
        sep = "," if name == "patients" else "\t"
        if rejects_path is None:
            return read_extract(spark, paths[name], schema, sep, name in multi_line)
        return read_checked(spark, paths[name], schema, sep, name in multi_line)[0]

    if rejects_path is not None:
        registry_rejects(spark, paths, multi_line).write.mode("errorifexists").parquet(rejects_path)
    tables = {name: load(name, schema) for name, schema in EXTRACTS.items() if name != "social_history"}
    tables["social_history"] = with_types(
        read_extract(spark, paths["social_history"]), EXTRACTS["social_history"]
    )
    tables["encounters"] = tables["encounters"].distinct()
    tables["patients"] = tables["patients"].join(tables.pop("last_encounters"), ["pat_id"], "left")
    manifest = read_by_prefix(spark, paths["ndi"], (*DEATH_KEYS, "ndi_status_code"))
    causes = read_by_prefix(
        spark, paths["ndi_cause"],
        (*DEATH_KEYS, "ndi_month_death", "ndi_day_death", "ndi_cause_underlying"),
        prefixes=("ndi_cause_record",),
    )
    tables["ndi_cause_of_death"] = match_deaths(manifest, causes, tables["patients"])
    return tables


def with_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the named columns; all others stay as they are."""
    return df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields})


def create_table(
    df: DataFrame, name: str, folder: str | None = None, cluster_by: str | None = None, buckets: int | None = None
) -> None:
    """Create a catalog table; an existing one is an error, never overwritten.

    With ``cluster_by`` and ``buckets`` rows are dealt by that column before they are written, a
    file per bucket, sorted: joins and groupings on it between tables of as many buckets
    need no exchange.
    """
    if cluster_by and buckets:
        df = df.repartition(buckets, cluster_by)
    writer = df.write.mode("errorifexists").format("parquet")
    if cluster_by and buckets:
        writer = writer.bucketBy(buckets, cluster_by).sortBy(cluster_by)
    if folder is not None:
        writer = writer.option("path", f"{folder}/{name}")
    writer.saveAsTable(name)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def write_report(df: DataFrame, path: str) -> None:
    """Write report rows as delimited text with a header line."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def stacked(frames) -> DataFrame:
    """Rows of all frames one below the other, matched by column name."""
    return reduce(DataFrame.unionByName, frames)
