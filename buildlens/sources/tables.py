"""SQL tables over JDBC, and lake tables of the same shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buildlens import fixed_values as V
from buildlens.operators.metrics import build_times
from buildlens.schemas import PERFORMANCE_METRICS, TEST_RUNS

DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mariadb": "org.mariadb.jdbc.Driver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
}
SCHEMAS = {"test_runs": TEST_RUNS, "performance_metrics": PERFORMANCE_METRICS}


#: The first characters of a text, as each database says it.
HEAD = {"mysql": "LEFT({c}, {n})", "mariadb": "LEFT({c}, {n})", "clickhouse": "substringUTF8({c}, 1, {n})"}
NAMES_IN_PREDICATE = 500


def jdbc_options(dialect: str, host: str, port: int, database: str, table: str, user: str = "", password: str = "",
                 split: tuple[str, int | str, int | str, int] | None = None, text_cap: int = V.FAILURE_TEXT_CAP, with_id: bool | None = None) -> dict[str, str]:
    """Options of a JDBC scan; ``split`` = (column, lower, upper, partitions) reads in parallel.

    Failure texts are cut to ``text_cap`` characters by the database (0: whole), so that longer ones are not sent; filters and columns still
    reach it, around that query. ``with_id`` tells whether the table has an ``id``; the ClickHouse one has none unless told so.
    """
    scheme = "ch" if dialect == "clickhouse" else dialect
    with_id = dialect != "clickhouse" if with_id is None else with_id
    source = table
    if text_cap and table == "test_runs":
        capped = HEAD[dialect].format(c="failure_txt", n=text_cap)
        names = [f.name for f in TEST_RUNS if with_id or f.name != "id"]
        source = f"(SELECT {', '.join(f'{capped} AS failure_txt' if n == 'failure_txt' else n for n in names)} FROM {table}) capped"
    options = {
        "url": f"jdbc:{scheme}://{host}:{port}/{database}",
        "driver": DRIVERS[dialect],
        "dbtable": source,
        "fetchsize": "10000",
        "pushDownPredicate": "true",
        "preferTimestampNTZ": "true",
    }
    if user:
        options |= {"user": user, "password": password}
    if split:
        column, lower, upper, parts = split
        options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(parts)}
    return options


def recent_builds_options(options: dict[str, str], limit: int = V.PERF_HISTORY_LIMIT) -> dict[str, str]:
    """Options of a scan that lets the database find the builds recorded last: one row each comes over."""
    query = f"SELECT build, MAX(recorded_at) AS last_recorded FROM performance_metrics GROUP BY build ORDER BY last_recorded DESC, build DESC LIMIT {limit}"
    kept = {k: v for k, v in options.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return kept | {"dbtable": f"({query}) recent"}


def _text(value: str, dialect: str) -> str:
    """A text as a literal of the database."""
    if dialect in ("mysql", "mariadb", "clickhouse"):
        value = value.replace("\\", "\\\\")
    return "'" + value.replace("'", "''") + "'"


def name_predicates(names: Sequence[str], dialect: str, column: str = "name", most: int = NAMES_IN_PREDICATE) -> list[str]:
    """WHERE clauses of at most ``most`` names each, one partition of a scan each; together they ask for every name once."""
    known = sorted(set(names))
    parts = [known[i : i + most] for i in range(0, len(known), most)]
    return [f"{column} IN ({', '.join(_text(n, dialect) for n in part)})" for part in parts] or ["1 = 0"]


def read_named(spark: SparkSession, options: dict[str, str], table: str, names: Sequence[str], dialect: str) -> DataFrame:
    """Rows of a table with one of the names, asked for in chunks that are read side by side."""
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    found = spark.read.jdbc(options["url"], options["dbtable"], predicates=name_predicates(names, dialect), properties=properties)
    return conform(found, SCHEMAS[table])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema in its types; ones the table lacks are left out."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])


def read_table(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    """``test_runs`` or ``performance_metrics`` of either database; filters on it are pushed down."""
    return conform(spark.read.format("jdbc").options(**options).load(), SCHEMAS[table])


def read_lake(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The same table as Parquet, best partitioned by build.

    Rows written without an id get one from their file and place in it, so
    that exact copies stay distinct rows that can be spread over tasks.
    """
    schema = SCHEMAS[table]
    rows = spark.read.schema(schema).parquet(path)
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return conform(rows.withColumn("id", F.coalesce("id", place)), schema)


def write_lake(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Parquet by build, sorted so that names and models have narrow min/max ranges.

    Rows of a build are spread by their sort key range, so a build holding much of the table is written by many tasks.
    Measurements also leave a small table of every build's last time beside the lake, for ``read_build_times``.
    """
    key = ["build", "name", "ran_at"] if table == "test_runs" else ["build", "model", "metric_name", "recorded_at"]
    (
        df.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .write.mode(mode)
        .partitionBy("build")
        .parquet(path)
    )
    if table == "performance_metrics":
        build_times(df).write.mode(mode).parquet(_times_path(path))


def _times_path(path: str) -> str:
    return f"{path.rstrip('/')}.build-times"


def read_build_times(spark: SparkSession, path: str) -> DataFrame | None:
    """(build, last_recorded) rows that ``write_lake`` has kept, several for a build written several times; None for a lake that has none."""
    try:
        return spark.read.schema("build string, last_recorded timestamp_ntz").parquet(_times_path(path))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise
