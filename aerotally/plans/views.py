"""Domain views over the given tables, one SQL text for Spark and for the DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerotally.plans.storage import materialise, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: ``EPOCH(x)`` stands for seconds as double, ``TEXT(x)`` for a cast to string.
VIEWS = {
    # one row per photo; flights of a few dozen shots
    "shots": """SELECT event_id AS shot, user_id AS flight, ts, EPOCH(ts) AS t, event_id AS seq, value AS x, CAST(event_id % 997 AS DOUBLE) AS y,
      CAST(1 AS DOUBLE) / (100 + event_id % 2000) AS exposure, CAST(-(event_id % 91) AS DOUBLE) AS pitch, CAST((event_id * 37) % 360 - 180 AS DOUBLE) AS yaw,
      1 + CAST(event_id % 7 AS DOUBLE) / 10 AS gsd, event_type AS program, CAST(30 + event_id % 60 AS DOUBLE) AS height, 5472 AS image_width, 3648 AS image_height,
      concat('E', TEXT(user_id % 3)) AS expedition, concat('I', TEXT(user_id % 7)) AS island, concat('D', TEXT(event_id % 4)) AS drone, concat('img', TEXT(event_id)) AS name
      FROM {events}""",
    # points on images: ground truth and predictions
    "marks": """SELECT l_suppkey AS image, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity) AS id,
      CAST((l_partkey * 7919) % 1000 AS DOUBLE) AS x, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) AS y,
      CASE WHEN l_linestatus = 'O' THEN 'gt' ELSE 'pred' END AS role, l_returnflag AS species, 1 - l_discount - CAST(l_orderkey % 10 AS DOUBLE) / 100 AS score
      FROM {lineitem}""",
    # labels with boxes in images of 4000 x 3000
    "annotations": """SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS label,
      o_orderpriority AS dataset, o_orderstatus AS status, l_returnflag AS class, CAST((l_partkey * 131) % 4000 AS DOUBLE) AS x1, CAST((l_suppkey * 977) % 3000 AS DOUBLE) AS y1,
      l_quantity AS w, CAST(5 + l_linenumber * 9 AS DOUBLE) AS h, 4000 AS image_width, 3000 AS image_height
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # marks of six users and a consensus on small images
    "user_marks": """SELECT l_partkey AS image, concat(l_returnflag, TEXT(l_linenumber % 2)) AS user_name FROM {lineitem}""",
    "counts": """SELECT i.image, u.user_name, coalesce(c.n, 0) AS n
      FROM (SELECT DISTINCT l_partkey AS image FROM {lineitem}) i CROSS JOIN (SELECT DISTINCT concat(l_returnflag, TEXT(l_linenumber % 2)) AS user_name FROM {lineitem}) u
      LEFT JOIN (SELECT l_partkey AS image, concat(l_returnflag, TEXT(l_linenumber % 2)) AS user_name, count(*) AS n FROM {lineitem} GROUP BY 1, 2) c
      ON i.image = c.image AND u.user_name = c.user_name""",
    "consensus": """SELECT l_partkey AS image, count(CASE WHEN l_linenumber <= 1 THEN 1 END) AS n FROM {lineitem} GROUP BY 1""",
    # crowd classifications: a user's marks on an image
    "crowd": """SELECT event_id AS id, event_id % 200 AS image, user_id, event_type AS phase, ts AS started_at, EPOCH(ts) AS t, CAST(json_get(props, '$.k') AS BIGINT) % 9 AS marks
      FROM {events}""",
    # documents with two labels
    "docs": """SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "boxes": """SELECT p_partkey AS id, p_partkey % 20 AS image, CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x1, CAST((p_partkey * 104729) % 800 AS DOUBLE) AS y1,
      CAST((p_partkey * 7919) % 1000 + p_size AS DOUBLE) AS x2, CAST((p_partkey * 104729) % 800 + p_size * 2 AS DOUBLE) AS y2, p_brand AS class, p_type AS kind FROM {part}""",
}

#: Tables that a view joins or numbers by a key, and that key.
DEALT = {"annotations": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "marks": {"lineitem": "l_suppkey"}}
#: Rows of the largest of them that a task sorts, whatever the number of shuffle partitions.
ROWS_PER_PART = 250_000


def _dialect(text: str, spark: bool) -> str:
    text = re.sub(r"EPOCH\((\w+)\)", r"(unix_micros(CAST(\1 AS TIMESTAMP)) / CAST(1000000 AS DOUBLE))" if spark else r"epoch(\1)", text)
    text = re.sub(r"TEXT\(([^()]+)\)", r"CAST(\1 AS STRING)" if spark else r"CAST(\1 AS VARCHAR)", text)
    return text.replace("json_get(", "get_json_object(" if spark else "json_extract_string(")


class Views:
    """Tables and views of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.written: dict[str, DataFrame] = {}
        self.parts: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.folder, name)
        if name not in VIEWS:
            raise AttributeError(name)
        text = _dialect(VIEWS[name], True)
        return self.spark.sql(text, **self._dealt(name, {t: table(self.spark, self.folder, t) for t in set(re.findall(r"\{(\w+)\}", text))}))

    def _dealt(self, name: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The view's tables, those that it joins or numbers dealt by its key."""
        keys = DEALT.get(name, {})
        return {t: self.dealt(df, name, keys[t]) if t in keys else df for t, df in tables.items()}

    def dealt(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Rows of a view dealt by a key into as many parts as the view's tables need, where that is more than a shuffle has."""
        if name not in self.parts:
            self.parts[name] = -(-max(table(self.spark, self.folder, t).count() for t in DEALT[name]) // ROWS_PER_PART)
        return df.repartition(self.parts[name], F.col(key)) if self.parts[name] > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    def once(self, name: str) -> DataFrame:
        """A view that is written at its first use in a query and read from there."""
        if name not in self.written:
            self.written[name] = materialise(getattr(self, name), f"view-{name}")
        return self.written[name]


def binding(query: Callable[[Views], DataFrame], sql: str | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str | None]:
    """A query over the views and its SQL twin, which gets the views it names as common table expressions."""
    return (lambda spark, folder: query(Views(spark, folder))), (with_views(sql) if sql else None)


def with_views(sql: str) -> str:
    used = [f"{name} AS ({_dialect(text, False)})" for name, text in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
    text = re.sub(r"\{(\w+)\}", r"\1", ", ".join(used))
    if not used:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {text}, {sql[15:]}"
    return f"WITH {text}{', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else ' ' + sql}"
