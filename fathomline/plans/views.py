"""Deterministic point, pose, navigation, frame and berth tables drawn from the star-schema tables.

Each view is one SQL text that Spark and an ANSI engine read alike, so that a query and its oracle
start from equal rows.  ``{micros:col}`` stands for microseconds since 1970 of a timestamp.

A keyframe has the lines of forty orders, a map five hundred keyframes, a unit (a vessel) the events of
ten users, a session some eighty parts, and berths of later parts lie farther out: the groups that windows and
folds go by keep their size as the tables grow, only their number grows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BODIES = {
    "pts": """
        SELECT CAST(floor(l_orderkey / 40e0) AS BIGINT) AS kf,
               CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 40e0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS idx,
               (l_partkey % 400) * 0.5e0 - 100e0 + l_quantity * 0.01e0 AS x, (l_orderkey % 300) * 0.5e0 - 75e0 AS y,
               l_discount * 50e0 - 1e0 AS z, CAST(floor(l_tax * 1000e0 + 0.5e0) AS INT) AS intensity
        FROM lineitem""",
    "kfs": """
        SELECT kf, CAST(floor(kf / 500e0) AS BIGINT) AS map, {micros:first_date} / 1e6 + kf * 1e-3 AS ts, (low % 500) * 0.2e0 - 50e0 AS tx, (high % 300) * 0.3e0 - 45e0 AS ty,
               (low % 7) * 0.1e0 AS tz, (kf * 7 % 360) * 1e0 AS yaw_deg
        FROM (SELECT CAST(floor(o_orderkey / 40e0) AS BIGINT) AS kf, min(o_orderdate) AS first_date, CAST(sum(o_custkey) AS BIGINT) AS low, CAST(sum(o_custkey * (o_orderkey % 7 + 1)) AS BIGINT) AS high FROM orders GROUP BY 1)""",
    "nav": """
        SELECT event_id AS id, {micros:ts} / 1e6 AS ts, 35.4e0 + value * 1e-5 AS lat, 119.5e0 + user_id * 1e-5 AS lon, value * 0.1e0 AS alt,
               (value * 7e0) % 360e0 AS yaw_deg, event_type <> 'error' AS valid, user_id % 3 AS generation, event_type AS sensor, CAST(floor(user_id / 10e0) AS BIGINT) AS unit, value
        FROM events""",
    "frames": """
        SELECT event_type AS sensor, {micros:ts} / 1e6 AS ts, event_id AS seq, user_id % 3 AS generation, user_id AS port, CAST(floor(user_id / 10e0) AS BIGINT) AS unit FROM events""",
    "berths": """
        SELECT p_partkey AS id, (p_partkey % 211) * 1.5e0 - 150e0 + floor(p_partkey / 7807e0) * 400e0 AS cx, (p_partkey % 37) * 8e0 - 148e0 AS cy, 7e0 + p_size % 6 AS w, 8e0 + p_size % 18 AS l,
               (p_partkey * 13 % 180) * 1e0 AS angle, CAST(1 + p_partkey % 2 AS INT) AS kind, CAST(p_partkey % 4 AS INT) AS opening_edge, p_retailprice AS ts, p_size AS hits, p_brand || '.' || CAST(CAST(floor(p_partkey / 2000e0) AS BIGINT) AS STRING) AS session
        FROM part""",
    "vec": """
        SELECT vec_id, CAST(embedding[{first}] AS DOUBLE) AS x, CAST(embedding[{first}+1] AS DOUBLE) AS y, CAST(embedding[{first}+2] AS DOUBLE) AS z, label FROM embeddings""",
}
NEEDS = {"pts": "lineitem", "kfs": "orders", "nav": "events", "frames": "events", "berths": "part", "vec": "embeddings"}


def _body(name: str, spark: bool) -> str:
    micros = r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))" if spark else r"epoch_us(\1)"
    return re.sub(r"\{micros:(\w+)\}", micros, BODIES[name]).replace("{first}", "0" if spark else "1")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in BODIES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = NEEDS[name]
    text = re.sub(rf"\bFROM {source}\b", "FROM {source}", _body(name, True))
    return spark.sql(text, source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_views(sql: str) -> str:
    """The oracle text with the views that it names in front."""
    used = [v for v in BODIES if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({_body(v, False)})" for v in used]
    sql = sql.strip()
    if not parts:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + sql[len("WITH RECURSIVE") :]
    if sql.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + sql[len("WITH") :]
    return "WITH " + ", ".join(parts) + " " + sql
