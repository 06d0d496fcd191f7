"""Fact relations over the provided tables.

Each relation is a source table, a list of expressions and an optional condition, in
the SQL that both Spark and other engines read, so that a query and its oracle see the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SEVERITY = "CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'R' THEN 'warning' ELSE 'info' END"
_EDGE_CONFIDENCE = "CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.9 WHEN '3-MEDIUM' THEN 0.8 WHEN '4-NOT SPECIFIED' THEN 0.75 ELSE 0.6 END"
_NAME = "CASE o_orderkey % 19 WHEN 0 THEN 'main' WHEN 1 THEN 'onClick' WHEN 2 THEN 'invokeAll' WHEN 3 THEN 'userRepository' WHEN 4 THEN 'mock_db' WHEN 5 THEN 'ngOnInit' WHEN 6 THEN 'apiList' WHEN 7 THEN 'List::next' WHEN 8 THEN 'cfg_unix' WHEN 9 THEN 'lazyPane' WHEN 10 THEN 'fn' WHEN 11 THEN 'write_hook' WHEN 12 THEN 'test_sum' ELSE 'compute_total' END"
_RESOLUTION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'same_file' WHEN '2-HIGH' THEN 'import' WHEN '3-MEDIUM' THEN 'export' WHEN '4-NOT SPECIFIED' THEN 'method' ELSE 'fuzzy' END"

RELATIONS: dict[str, tuple[str, list[str], str | None]] = {
    "detections": (
        "events",
        [
            "event_id AS id", "user_id AS file", "event_id % 200 AS line", "event_id % 80 AS column_num", "event_type AS pattern_id",
            "CASE event_type WHEN 'click' THEN 'api' WHEN 'error' THEN 'errors' WHEN 'purchase' THEN 'data_access' WHEN 'signup' THEN 'auth' ELSE 'components' END AS category",
            "least(value / 500.0D0, 1.0D0) AS confidence", "event_id % 5 AS detection_method", "ts AS created_at",
        ],
        None,
    ),
    "violations": (
        "lineitem",
        [
            "l_orderkey AS order_id", "l_linenumber AS seq", "l_partkey AS file", "l_orderkey % 500 AS line", "l_suppkey AS rule_id", "l_suppkey % 20 AS project",
            f"{_SEVERITY} AS severity", "l_linestatus = 'F' AS suppressed", "l_discount > 0.05D0 AS is_new", "l_shipdate AS created_at", "l_extendedprice AS cost",
        ],
        None,
    ),
    "call_edges": (
        "orders",
        [
            "o_orderkey AS caller", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey * 3 ELSE CAST(floor(o_orderkey / 3.0D0) AS BIGINT) END AS callee",
            f"{_EDGE_CONFIDENCE} AS confidence", f"{_RESOLUTION} AS resolution", "o_custkey % 400 AS line",
        ],
        None,
    ),
    "functions": (
        "orders",
        [
            "o_orderkey AS id", "o_custkey AS file", "o_orderstatus = 'F' AS is_exported", "o_orderpriority = '5-LOW' AS is_test", "o_orderpriority = '1-URGENT' AS is_entry",
            "CAST(floor(o_totalprice / 4000.0D0) AS BIGINT) AS lines", "o_custkey % 25 AS module", f"{_NAME} AS name", "CASE WHEN o_custkey % 9 = 0 THEN 'tests/unit.py' WHEN o_custkey % 31 = 0 THEN 'src/platform/io.py' ELSE 'src/app.py' END AS path",
        ],
        None,
    ),
    "memories": (
        "orders",
        [
            "o_orderkey AS memory_id", "o_orderpriority AS memory_type", "o_orderdate AS transaction_time", "o_orderdate AS valid_time",
            "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 720 + 1 AS INT) END AS valid_until",
            "least(o_totalprice / 500000.0D0, 1.0D0) AS confidence", "o_orderstatus = 'P' AS archived", "o_custkey AS entity", "o_orderkey % 40 AS access_count",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' ELSE 'low' END AS importance",
        ],
        None,
    ),
    "memory_events": (
        "events",
        [
            "event_id", "user_id AS memory_id", "ts AS recorded_at",
            "CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'confidence_changed' WHEN 'error' THEN 'contradicted' WHEN 'click' THEN 'accessed' ELSE 'modified' END AS event_type",
            "value AS delta", "event_type AS field",
        ],
        None,
    ),
    "feedback": (
        "events",
        [
            "event_id", "user_id % 20 AS detector", "ts AS created_at", "user_id AS author",
            "CASE event_type WHEN 'purchase' THEN 'fix' WHEN 'error' THEN 'dismiss' WHEN 'click' THEN 'suppress' WHEN 'signup' THEN 'escalate' ELSE 'dismiss' END AS action",
            "CASE event_type WHEN 'error' THEN 'false_positive' WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'wont_fix' WHEN 2 THEN 'duplicate' END END AS reason",
        ],
        None,
    ),
}


#: Tables of long texts: small ones may sit in one row group, which one task would read and work on alone.
TEXTS = ("documents",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table. Texts of few splits are dealt over the cores first; large inputs have splits enough and aren't shuffled."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() <= 2 * cores else df


def _dialect(expression: str, engine: str) -> str:
    if engine == "spark":
        expression = expression.replace("INTERVAL 1 DAY * CAST(o_orderkey % 720 + 1 AS INT)", "make_dt_interval(CAST(o_orderkey % 720 + 1 AS INT))")
        return expression.replace("D0", "D")
    return expression.replace(".0D0", ".0").replace("D0", "::DOUBLE")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``RELATIONS`` as a DataFrame."""
    source, columns, where = RELATIONS[name]
    df = table(spark, sf_dir, source)
    if where:
        df = df.where(where)
    return df.selectExpr(*(_dialect(c, "spark") for c in columns))


def relation_sql(name: str) -> str:
    """One of ``RELATIONS`` as a common table expression for the oracle."""
    source, columns, where = RELATIONS[name]
    return f"{name} AS (SELECT {', '.join(_dialect(c, 'sql') for c in columns)} FROM {source}{' WHERE ' + where if where else ''})"
