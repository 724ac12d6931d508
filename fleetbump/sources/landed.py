"""Scans of landed tables: explicit schemas, one DataFrame each."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbump import schemas
from fleetbump.functions.patterns import decode_base64, strip
from fleetbump.operators.ranking import number_rows, range_chunks
from fleetbump.operators.rules import last_definitions, migrations_table


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that does not fit the schema fails the job that reads it."""
    lines = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # The reader refuses to give the corrupt column alone, so the message names the first field too.
    told = F.format_string("not a row of the landed table: %s (%s)", "_corrupt", F.col(lines.columns[0]).cast("string"))
    fits = F.when(F.col("_corrupt").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    return lines.filter(fits).drop("_corrupt")


def read_repository_keys(spark: SparkSession, path: str) -> DataFrame:
    """Requested repositories: one key per line, comments and blanks dropped, list order in ``ord``."""
    text = spark.read.text(path)
    # A text row has no position of its own: file, start of its split, and row id within the split keep the order.
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = text.select(strip(F.col("value")).alias("key"), order.alias("ord"))
    return lines.filter((F.length("key") > 0) & ~F.col("key").startswith("#"))


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.REPOS)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.TREE)


def read_branches(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.BRANCHES).select(
        "repo_id", "name", F.col("commit.committed_date").alias("committed_date"), "ord"
    )


def read_merge_requests(
    spark: SparkSession,
    path: str,
    state: str | None = None,
    source_branch: str | None = None,
    target_branch: str | None = None,
    fmt: str = "json",
) -> DataFrame:
    """Merge requests, narrowed by equality; stored as parquet the filters reach the scan."""
    table = spark.read.parquet(path) if fmt == "parquet" else _json(spark, path, schemas.MERGE_REQUESTS)
    for column, wanted in (("state", state), ("source_branch", source_branch), ("target_branch", target_branch)):
        if wanted is not None:
            table = table.filter(F.col(column) == wanted)
    return table


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.SEARCH_HITS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File contents landed as base64."""
    return _json(spark, path, schemas.LANDED_FILES).select(
        "repo_id", "ref", "path", decode_base64(F.col("content_base64")).alias("content")
    )


def read_working_tree(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Checked-out files under a folder; bytes are decoded as they are, so CRLF survives."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{extension}")
        .load(path)
    )
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def read_migrations(spark: SparkSession, path: str, last_only: bool = True) -> DataFrame:
    """Rule catalogue from JSON, or from YAML (parsed on the driver); a missing file is an empty one."""
    if path.endswith((".yml", ".yaml")):
        return migrations_table(spark, read_migration_list(path))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return migrations_table(spark, [])
    documents = spark.read.schema(schemas.CATALOGUE_FILE).option("multiLine", "true").json(path)
    # Files are numbered by name, in ranges of names, without their contents; a file is one document.
    names = documents.select(F.col("_metadata.file_path").alias("name")).distinct()
    numbered = number_rows(range_chunks(names, [], ["name"]), [], [F.col("name")], F.col("_range"), "file")
    numbered = numbered.select("name", (F.col("file") - 1).cast("long").alias("file"))
    placed = documents.select("migrations", F.col("_metadata.file_path").alias("name")).join(numbered, "name")
    entries = entries_of(placed.drop("name"))
    return last_definitions(entries) if last_only else entries


def entries_of(documents: DataFrame) -> DataFrame:
    """Entries of catalogue documents in order: by the document's number ``file``, if there is one, then by place."""
    if "file" not in documents.columns:
        return documents.select(F.posexplode("migrations").alias("ord", "m")).select("m.*", "ord")
    placed = documents.select("file", F.posexplode("migrations").alias("place", "m"))
    return placed.select("m.*", (F.shiftleft("file", 32) + F.col("place")).alias("ord"))


def read_migration_list(path: str, missing_ok: bool = True) -> list[dict]:
    """The rule file itself (small by nature), with the last definition of each id kept.

    It is read by the active session, so from any store Spark reads. A file that is not there is an empty list, or an
    error unless ``missing_ok``.
    """
    spark = SparkSession.active()
    try:
        files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").orderBy("file_path").collect()
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    load = json.loads
    if not path.endswith(".json"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML rule files needs PyYAML; JSON works without it") from e
        load = yaml.safe_load
    by_id: dict[str, dict] = {}
    for file in files:
        for entry in (load(file.value) or {}).get("migrations") or []:
            by_id[entry.get("id", "")] = entry
    return list(by_id.values())


class BadTrackingFile(ValueError):
    """A tracking document is missing or is not valid JSON."""


def read_tracking(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tracking documents: (one row per merge request, one metadata row per document)."""
    documents = (
        spark.read.schema(schemas.TRACKING)
        .option("multiLine", "true")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    # At most one row comes back: only whether a bad document exists matters here.
    if documents.select("_corrupt", "metadata.generated_at").filter(F.col("_corrupt").isNotNull()).take(1):
        raise BadTrackingFile(path)
    return tracking_rows_of(documents), documents.select("metadata.*")


def tracking_rows_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.posexplode("merge_requests").alias("ord", "mr")).select("mr.*", "ord")


def read_tracking_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tracking snapshot written as one JSON object per line (splittable, for large fleets)."""
    return _json(spark, path, schemas.TRACKED)


def parse_migration_results(raw: DataFrame) -> DataFrame:
    """Result lines (run_id, batch, output) as typed rows; text that is no JSON is a failed batch."""
    parsed = raw.withColumn(
        "r", F.from_json("output", schemas.MIGRATION_RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    success = ~broken & F.coalesce(F.col("r.success"), F.lit(False))
    none = F.array().cast("array<string>")

    def listed(name: str, keep: Column) -> Column:
        return F.when(keep, F.coalesce(F.col(f"r.{name}"), none)).otherwise(none)

    return parsed.select(
        "run_id",
        "batch",
        success.alias("success"),
        listed("modified_files", success).alias("modified_files"),
        listed("applied_rules", success).alias("applied_rules"),
        F.when(broken, F.array(F.lit("Failed to parse tool output")))
        .otherwise(listed("errors", ~success))
        .alias("errors"),
    )
