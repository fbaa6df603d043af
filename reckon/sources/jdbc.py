"""External databases through JDBC: checked connections, and scans that Spark pushes down."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from reckon.plans import guard

MOST_PROFILES = 20


class ConnectionRefused(ValueError):
    """A connection that isn't allowed."""


@dataclass(frozen=True)
class Connection:
    """url may have {cluster} and {db}; user and password are never part of it nor shown."""

    url: str
    driver: str = ""
    user: str = field(default="", repr=False)
    password: str = field(default="", repr=False)
    clusters: tuple[tuple[str, str], ...] = ()  # label, name in the url; the first is the default
    timeout: int = 180
    allow_insecure: bool = False

    def __post_init__(self) -> None:
        if not self.url.startswith("jdbc:"):
            raise ConnectionRefused("a JDBC URL begins with jdbc:")
        if set(self.url) & set("\r\n\x00"):
            raise ConnectionRefused("the URL has a line break or NUL")
        if re.search(r"(?i)[?;&](user(name)?|password|passwd|pwd)\s*=", self.url) or re.search(r"://[^/@\s]+:[^/@\s]+@", self.url):
            raise ConnectionRefused("the URL has a user or a password; give them apart")
        plain = "http://" in self.url.lower() or re.search(r"(?i)(ssl|usessl|tls|encrypt)\s*=\s*(false|0|no)\b", self.url)
        if plain and not self.allow_insecure:
            raise ConnectionRefused("the connection isn't encrypted; allow_insecure must be set")
        if len(self.clusters) > MOST_PROFILES:
            raise ConnectionRefused(f"more than {MOST_PROFILES} clusters")
        object.__setattr__(self, "timeout", max(5, min(self.timeout, 3600)))

    def on(self, cluster: str = "", db: str = "") -> str:
        """The URL for a cluster (by label; the first if none is named) and a database."""
        names = dict(self.clusters)
        if cluster and cluster not in names:
            raise ConnectionRefused(f"no cluster {cluster}")
        name = names[cluster] if cluster else next(iter(names.values()), "")
        try:
            return self.url.format(cluster=name, db=db)
        except (KeyError, IndexError) as e:
            raise ConnectionRefused(f"the URL has an unknown part {e}") from None

    def without_secrets(self) -> "Connection":
        return replace(self, user="", password="")


def parse_profiles(text: str) -> tuple[tuple[str, str], ...]:
    """(label, name) of lines `label = name` or `label | name`; the first of a label counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(r"([^=|]+?)\s*[=|]\s*(.+)", line)
        if not m:
            raise ConnectionRefused(f"not `label = name`: {line}")
        out.setdefault(m.group(1).strip(), m.group(2).strip())
    return tuple(out.items())


def _reader(spark: SparkSession, connection: Connection, cluster: str, db: str) -> DataFrameReader:
    reader = spark.read.format("jdbc").option("url", connection.on(cluster, db)).option("user", connection.user).option("password", connection.password).option("queryTimeout", connection.timeout)
    return reader.option("driver", connection.driver) if connection.driver else reader


def table(spark: SparkSession, connection: Connection, name: str, cluster: str = "", db: str = "", predicates: list[str] | None = None) -> DataFrame:
    """The rows of a table; with predicates, a statement and a partition for each."""
    if predicates is None or not predicates:
        return _reader(spark, connection, cluster, db).option("dbtable", name).load()
    own = {k: v for k, v in (("user", connection.user), ("password", connection.password), ("driver", connection.driver), ("queryTimeout", str(connection.timeout))) if v}
    return spark.read.jdbc(connection.on(cluster, db), name, predicates=predicates, properties=own)


def quoted(spark: SparkSession, url: str, name: str) -> str:
    """A column's name as the database takes it, exactly."""
    return getattr(spark._jvm.org.apache.spark.sql.jdbc, "JdbcDialects").get(url).quoteIdentifier(name)


def query(spark: SparkSession, connection: Connection, sql: str, cluster: str = "", db: str = "", partition: dict | None = None) -> DataFrame:
    """The rows of a read-only query in the database. partition: Spark's partitionColumn, lowerBound,
    upperBound and numPartitions, to read it in parallel (then sql must be a table's name)."""
    reader = _reader(spark, connection, cluster, db)
    if partition:
        return reader.options(dbtable=sql, **{k: str(v) for k, v in partition.items()}).load()
    if guard.level(sql) == "blocked":
        raise guard.NotReadOnly(str(guard.findings(sql)))
    return reader.option("query", sql.strip().rstrip(";")).load()


def databases(spark: SparkSession, connection: Connection, cluster: str = "", system: tuple[str, ...] = ("information_schema", "mysql", "performance_schema", "sys", "_statistics_")) -> DataFrame:
    """name of each database but those of the system, by name."""
    named = query(spark, connection, "SELECT schema_name AS name FROM information_schema.schemata", cluster)
    return named.where(~F.lower("name").isin(*system)).orderBy("name")


def information(spark: SparkSession, connection: Connection, db: str, what: str = "tables", cluster: str = "") -> DataFrame:
    """Tables (name, rows, type) or columns (table, name, type, nullable, pos, is_key) of a database, from
    its information_schema."""
    quoted = "'" + db.replace("'", "''") + "'"
    if what == "tables":
        sql = f"SELECT table_name AS name, table_rows AS `rows`, table_type AS type FROM information_schema.tables WHERE table_schema = {quoted}"
    else:
        sql = f"SELECT table_name AS `table`, column_name AS name, column_type AS type, is_nullable = 'YES' AS nullable, ordinal_position AS pos, column_key = 'PRI' AS is_key FROM information_schema.columns WHERE table_schema = {quoted}"
    return query(spark, connection, sql, cluster, db)
