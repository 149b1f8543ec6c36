"""How queries are registered: a function over the tables, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        """A derived table of VIEWS."""
        return self.spark.sql(VIEWS[name], **{k: (self.view(k) if k in VIEWS else getattr(self, k)) for k in re.findall(r"\{(\w+)\}", VIEWS[name])})

    def _lines(self, rows: DataFrame) -> DataFrame:
        money = lambda c: F.col(c).cast("decimal(18,2)")
        return rows.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus",
            money("l_extendedprice").alias("ext"), F.to_date("l_shipdate").alias("day"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"),
        )

    @property
    def lines(self) -> DataFrame:
        """Invoice lines: lineitem with a day, a unit price cut to cents and money as exact decimals."""
        return self._lines(self.lineitem)

    def lines_between(self, first: str, last: str) -> DataFrame:
        """Invoice lines of the days from first to last. The bounds are on the stored column, so the scan sees them."""
        return self._lines(self.lineitem.where(between("l_shipdate", first, last)))


def between(c: str, first: str, last: str) -> F.Column:
    """A timestamp column within days, as a range that reaches the scan."""
    return F.expr(f"{c} >= TIMESTAMP_NTZ'{first}' AND {c} < TIMESTAMP_NTZ'{last}' + INTERVAL 1 DAY")


#: The same as SQL, for oracles.
LINES = (
    "lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus, "
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_shipdate AS DATE) AS day, floor(l_extendedprice / l_quantity * 100) / 100 AS price FROM lineitem)"
)

#: Tables of the domain that the driver's tables lack, derived from them in SQL that Spark and DuckDB read alike.
VIEWS = {
    # descriptions of goods and packs as vendors write them, with odd and missing ones
    "wording": """SELECT p_partkey AS id, p_name AS name, p_type AS category, p_size AS size,
        CASE p_partkey % 10 WHEN 0 THEN CAST(p_size AS STRING) || '/' || CAST(p_partkey % 13 + 1 AS STRING) || 'LB' WHEN 1 THEN CAST(p_size AS STRING) || ' ct'
          WHEN 2 THEN '6/#10CAN' WHEN 3 THEN CAST(p_partkey % 5 AS STRING) WHEN 4 THEN CAST(p_size AS STRING) || '/1.5 Gal' WHEN 5 THEN 'case of ' || CAST(p_size AS STRING)
          WHEN 6 THEN NULL WHEN 7 THEN CAST(p_size AS STRING) || 'doz' WHEN 8 THEN CAST(p_size AS STRING) || '/' || CAST(p_partkey % 17 AS STRING) ELSE CAST(p_size AS STRING) || 'EACH' END AS case_size,
        CASE p_partkey % 7 WHEN 0 THEN upper(p_name) || ', ' || CAST(p_size AS STRING) || ' LB' WHEN 1 THEN p_name || ' 36/' || CAST(p_size AS STRING) || '# avg'
          WHEN 2 THEN p_name || ', 1-1/9 BUSHEL' WHEN 3 THEN p_name || ' #' || CAST(p_partkey AS STRING) WHEN 4 THEN 'BUSHEL 1/' || CAST(p_size AS STRING) || ' ' || p_name
          WHEN 5 THEN p_name || ' 60 BU' ELSE p_name || ' ' || CAST(p_size AS STRING) || 'LBS' END AS description,
        CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) || '/4OZ' WHEN 1 THEN '' ELSE NULL END AS default_pack
        FROM {part}""",
    # what a recipe asks for, with quantities and units of every kind
    # the kitchen: orders as recipes and menus, lines as ingredients and invoice lines, days as a census
    "recipes": "SELECT o_orderkey AS recipe_id, 'dish ' || CAST(o_orderkey % 97 AS STRING) AS name, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0 ELSE 10 + o_orderkey % 30 END AS serves FROM {orders}",
    "ingredients": """SELECT l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(l_partkey AS BIGINT) * 100 + CAST(l_quantity AS BIGINT) AS ingredient_id, l_orderkey AS recipe_id, n.p_name AS name,
        CASE WHEN l_linenumber = 7 OR l_partkey % 19 = 0 THEN NULL ELSE l_partkey END AS product_id,
        CASE WHEN l_linenumber = 7 AND l_orderkey >= 10 THEN CAST(floor(l_orderkey / 10) AS BIGINT) ELSE NULL END AS sub_recipe_id,
        CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_quantity + 0.13 END AS quantity,
        CASE l_linenumber % 7 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' WHEN 2 THEN 'cup' WHEN 3 THEN 'each' WHEN 4 THEN 'tbsp' WHEN 5 THEN 'can' ELSE 'pinch' END AS unit,
        CASE WHEN l_tax > 0.06 THEN 80.0 ELSE NULL END AS yield_pct, CASE WHEN l_discount > 0.05 THEN l_partkey % 5 ELSE NULL END AS ref_id
        FROM {lineitem} JOIN {part} n ON n.p_partkey = l_partkey""",
    "refs": "SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN 90.0 ELSE NULL END AS ref_yield_pct, CASE WHEN p_partkey = 3 THEN 5.5 ELSE NULL END AS oz_per_cup, CASE WHEN p_partkey > 1 THEN 4.1 ELSE NULL END AS ap_weight_oz, CASE WHEN p_partkey = 4 THEN 'Head ' ELSE 'lb' END AS ap_unit FROM {part} WHERE p_partkey < 5",
    "products": "SELECT id AS product_id, name, default_pack AS default_case_size, category, size FROM {wording}",
    "bought": """SELECT l_partkey AS product_id, 'vendor ' || CAST(l_suppkey AS STRING) AS vendor, CAST(l_shipdate AS DATE) AS day, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq,
        floor(l_extendedprice / 10) / 100 + 0.00137 AS unit_price, CASE WHEN l_linenumber % 3 = 0 THEN case_size ELSE NULL END AS case_size, description AS raw_description,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_quantity + 0.29 ELSE NULL END AS per_pound, CASE WHEN l_linenumber = 2 THEN 8 ELSE NULL END AS count_low, CASE WHEN l_linenumber = 2 THEN 12 ELSE NULL END AS count_high,
        CASE WHEN l_tax > 0.07 THEN TRUE WHEN l_tax < 0.01 THEN NULL ELSE FALSE END AS flagged, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext FROM {lineitem} JOIN {wording} ON id = l_partkey""",
    "menus": "SELECT o_orderkey AS menu_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 3 WHEN 0 THEN 'lunch' WHEN 1 THEN 'dinner' ELSE 'breakfast' END AS slot, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS recipe_id FROM {orders}",
    "sides": "SELECT o_orderkey AS menu_id, o_orderkey + 1 AS recipe_id FROM {orders} WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey AS menu_id, o_orderkey AS recipe_id FROM {orders} WHERE o_orderkey % 8 = 1",
    "census": "SELECT CAST(o_orderdate AS DATE) AS day, 20 + CAST(min(o_custkey) % 30 AS INT) AS headcount FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY CAST(o_orderdate AS DATE)",
    # raw items of vendors, and descriptions that are mapped to names
    "raw_items": """SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'alpha' ELSE NULL END AS vendor, CASE WHEN p_partkey % 9 = 0 THEN 'C' || CAST(p_size AS STRING) ELSE NULL END AS code,
        CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'l', 'll') WHEN 2 THEN upper(p_name) || '/' || p_type WHEN 3 THEN 'fuel surcharge ' || CAST(p_size AS STRING) WHEN 4 THEN p_name || 's' WHEN 5 THEN '' ELSE 'xx ' || CAST(p_partkey AS STRING) END AS raw_description,
        CASE WHEN p_size % 3 = 0 THEN '** DAIRY **' ELSE NULL END AS section FROM {part}""",
    "mapped": """SELECT CASE p_partkey % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'beta' ELSE NULL END AS vendor, CASE WHEN p_partkey % 2 = 0 THEN 'C' || CAST(p_size AS STRING) ELSE NULL END AS code,
        CASE WHEN p_partkey % 5 = 0 THEN p_name || '/' || p_type ELSE upper(p_name) END AS description, p_name AS name FROM {part} WHERE p_size % 3 = 0 OR p_size % 7 = 0""",
    "freetext": "SELECT o_orderkey AS menu_id FROM {orders} WHERE o_orderkey % 10 = 0",
    "asked": """SELECT l_orderkey AS recipe_id, l_linenumber AS position, l_partkey AS product_id, l_quantity AS quantity, l_discount AS discount,
        CASE l_linenumber % 8 WHEN 0 THEN 'oz' WHEN 1 THEN 'Lbs.' WHEN 2 THEN 'cup' WHEN 3 THEN 'each' WHEN 4 THEN '' WHEN 5 THEN 'can' WHEN 6 THEN 'strips' ELSE 'pinch' END AS unit,
        CASE WHEN l_tax > 0.06 THEN 80.0 WHEN l_tax > 0.04 THEN 0.0 ELSE NULL END AS yield_pct, floor(l_extendedprice / 10) / 100 + 0.00137 AS case_price,
        CASE WHEN l_returnflag = 'R' THEN l_linenumber + 1.5 ELSE NULL END AS per_pound
        FROM {lineitem}""",
}


def views(*names: str) -> str:
    """The same as common table expressions, those they need first."""
    out: list[str] = []
    for name in names:
        for needed in re.findall(r"\{(\w+)\}", VIEWS[name]):
            if needed in VIEWS:
                out += [x for x in views(needed).split(",\n--\n") if x not in out]
        text = f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[name])})"
        if text not in out:
            out.append(text)
    return ",\n--\n".join(out)


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.replace("{LINES}", LINES)
        return f

    return register


def money(c) -> F.Column:
    """A sum of decimals as a double."""
    return F.sum(c).cast("double")
