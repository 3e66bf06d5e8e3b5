"""What the catalogue's queries share: sources said once, in SQL that both engines read."""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

ROWS_PER_TASK = 20_000

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt to all cores if it has fewer partitions than there are cores.

    A small table in one file is one task otherwise. A large one has more
    partitions than cores and is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def names(sql: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(sql) if field})


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A source query over tables written as ``{table}``."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names(sql)})


def rows_spread(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The same, with every table dealt to all cores."""
    return spark.sql(sql, **{n: spread(table(spark, sf_dir, n)) for n in names(sql)})


def parts_of(rows_: int, cores: int) -> int:
    """Partitions for so many rows: one a core, and more when they would hold more than ``ROWS_PER_TASK``."""
    return max(cores, math.ceil(rows_ / ROWS_PER_TASK))


def rows_dealt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The same, with every table dealt by its number of rows, for narrow rows of which much is made.

    A file's partitions say little here: a few megabytes may be millions of rows, in one row group.
    """
    cores = spark.sparkContext.defaultParallelism
    tables = {n: table(spark, sf_dir, n) for n in names(sql)}
    return spark.sql(sql, **{n: t.repartition(parts_of(t.count(), cores)) for n, t in tables.items()})


def plain(sql: str) -> str:
    """The same source for the other engine."""
    return sql.format(**{n: n for n in names(sql)})


def query(oracle: str | None = None, **sources: str):
    """Register a function under its name, with its SQL; ``$name`` stands for a source in it."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLE_SQL[function.__name__] = string.Template(oracle).safe_substitute({k: f"({plain(v)})" for k, v in sources.items()})
        return function

    return add


#: Orders as vulnerability records.
CVES = """
SELECT concat('CVE-', CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS cve_id,
  o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 = 0 THEN 'REJECTED' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'Deferred' ELSE 'Analyzed' END AS vuln_status,
  o_orderdate AS last_modified,
  o_orderdate AS ingested_at,
  CAST(o_orderdate AS DATE) - CAST(o_orderkey % 40 AS INT) AS published_date,
  o_orderkey % 5 = 0 AS is_kev,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 21 AS INT) END AS kev_date_added,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Known' ELSE 'Unknown' END END AS kev_ransomware_use,
  o_orderkey % 4 = 0 AS has_exploit_ref,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST((o_orderkey * 37) % 101 AS DOUBLE) / 10 END AS cvss_score,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN (o_orderkey * 37) % 101 >= 90 THEN 'CRITICAL' WHEN (o_orderkey * 37) % 101 >= 70 THEN 'HIGH' WHEN (o_orderkey * 37) % 101 >= 40 THEN 'medium' ELSE 'LOW' END AS cvss_severity,
  CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS confidentiality_impact,
  CASE o_orderkey % 4 WHEN 0 THEN 'NETWORK' WHEN 1 THEN 'ADJACENT_NETWORK' WHEN 2 THEN 'LOCAL' END AS attack_vector,
  CAST((o_orderkey * 7) % 40 AS DOUBLE) / 10 AS exploitability_score,
  CAST((o_orderkey * 11) % 61 AS DOUBLE) / 10 AS impact_score
FROM {orders}
"""

#: Suppliers, parts, sizes and brands as a property graph.
EDGES = """
SELECT DISTINCT concat('x', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS edge_id, 'Actor' AS src_label, concat('A', CAST(l_suppkey AS STRING)) AS src_key, 'EXPLOITS' AS rel,
  'CVE' AS dst_label, concat('C', CAST(l_partkey AS STRING)) AS dst_key, concat('adv', CAST(l_orderkey AS STRING)) AS advisory_id FROM {lineitem} WHERE l_orderkey % 40 = 0
UNION ALL SELECT concat('w', CAST(p_partkey AS STRING)), 'CVE', concat('C', CAST(p_partkey AS STRING)), 'HAS_WEAKNESS', 'CWE', p_brand, 'none' FROM {part} WHERE p_partkey % 2 = 0
UNION ALL SELECT concat('r', CAST(p_partkey AS STRING)), 'CVE', concat('C', CAST(p_partkey AS STRING)), 'REFERENCES_TECHNIQUE', 'Technique', concat('T', CAST(1000 + p_size AS STRING)), 'none' FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT concat('u', CAST(s_suppkey AS STRING)), 'Actor', concat('A', CAST(s_suppkey AS STRING)), 'USES', 'Technique', concat('T', CAST(1001 + s_suppkey % 50 AS STRING)), 'none' FROM {supplier}
UNION ALL SELECT concat('c', CAST(p_partkey AS STRING)), 'CVE', concat('C', CAST(p_partkey AS STRING)), 'AFFECTS', 'CVE', concat('C', CAST(p_partkey + 1 AS STRING)), 'none' FROM {part} WHERE p_partkey % 5 = 0
"""

NODES = """
SELECT 'Actor' AS label, concat('A', CAST(s_suppkey AS STRING)) AS key, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE s_name END AS name, concat('G', CAST(s_suppkey AS STRING)) AS actor_id, CAST(NULL AS STRING) AS id, CAST(NULL AS STRING) AS external_id,
  CAST(NULL AS STRING) AS vuln_status, CAST(NULL AS DATE) AS published_date, FALSE AS is_kev FROM {supplier}
UNION ALL SELECT 'CVE', concat('C', CAST(p_partkey AS STRING)), p_name, NULL, concat('C', CAST(p_partkey AS STRING)), NULL, CASE WHEN p_partkey % 7 = 0 THEN 'Deferred' WHEN p_partkey % 8 = 0 THEN NULL ELSE 'Analyzed' END,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN DATE '2012-05-01' ELSE DATE '2020-05-01' END, p_partkey % 4 = 0 FROM {part}
UNION ALL SELECT DISTINCT 'CWE', p_brand, p_brand, NULL, p_brand, NULL, NULL, CAST(NULL AS DATE), FALSE FROM {part}
UNION ALL SELECT DISTINCT 'Technique', concat('T', CAST(1000 + p_size AS STRING)), NULL, NULL, concat('T', CAST(1000 + p_size AS STRING)), NULL, NULL, CAST(NULL AS DATE), FALSE FROM {part}
"""

#: Line items as triplets of an advisory (an order).
TRIPLETS = """
SELECT concat('adv', CAST(l_orderkey AS STRING)) AS advisory_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS ordinal,
  CASE WHEN l_suppkey % 17 = 0 THEN ' The Attacker ' WHEN l_suppkey % 23 = 0 THEN '' ELSE concat('Group ', CAST(l_suppkey % 40 AS STRING)) END AS subject,
  CASE l_linenumber % 5 WHEN 0 THEN 'uses' WHEN 1 THEN 'exploits' WHEN 2 THEN 'Uses' WHEN 3 THEN 'targets' ELSE 'mitigates' END AS relation,
  CASE WHEN l_partkey % 19 = 0 THEN 'malware' ELSE concat(CASE WHEN l_partkey % 2 = 0 THEN 'tool ' ELSE 'TOOL ' END, CAST(l_partkey % 60 AS STRING)) END AS object
FROM {lineitem} WHERE l_orderkey % 20 = 0
"""

#: Events as pipeline runs.
RUNS = """
SELECT concat('run', CAST(event_id AS STRING)) AS run_id, event_type AS source, CASE WHEN event_id % 6 = 0 THEN 'failed' ELSE 'success' END AS status, ts AS started_at,
  CASE WHEN event_id % 10 <> 0 THEN ts END AS completed_at, event_id, user_id, value FROM {events}
"""
