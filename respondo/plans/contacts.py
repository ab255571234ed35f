"""The canonical ``contacts`` view: the star schema read as a flat table of
customer contacts, with the response-analytics roles as column names.

Join order is chosen for scale: the dimension chain (region -> nation ->
customer -> orders) is built first and the biggest table, ``lineitem``,
joins last, so it is shuffled exactly once (by order key). ``nation`` and
``region`` are broadcast behind a row-count check; the orders side is
broadcast only while the orders/customer files are proven small, else the
join is a shuffle join (AQE may still switch at run time, and splits a
skewed order key).

Only the joins that the requested columns need are built. Dropping an
unused inner join relies on the star schema's foreign keys (every line has
its order, every order its customer, ...), which the driver tables satisfy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.sources.tables import broadcast_by_size, load, sized_broadcast

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

# role -> (table the role needs, Spark SQL expression)
_ROLES: dict[str, tuple[str, str]] = {
    "y": ("lineitem", "CAST(l_returnflag = 'R' AS INT)"),
    "duration": ("lineitem", "l_extendedprice"),
    "campaign": ("lineitem", "l_quantity"),
    "previous": ("lineitem", "l_linenumber"),
    # + 0.0 folds the stored -0.0 into 0.0
    "discount": ("lineitem", "l_discount + CAST(0.0 AS DOUBLE)"),
    "tax": ("lineitem", "l_tax"),
    "contact": ("lineitem", "l_linestatus"),
    "month": ("lineitem", "month(l_shipdate)"),
    "day_of_week": ("lineitem", "dayofweek(l_shipdate)"),
    "pdays": ("orders", "datediff(to_date(l_shipdate), to_date(o_orderdate))"),
    "totalprice": ("orders", "o_totalprice"),
    "education": ("orders", "o_orderpriority"),
    "poutcome": ("orders", "o_orderstatus"),
    "job": ("customer", "c_mktsegment"),
    "acctbal": ("customer", "c_acctbal"),
    "nation": ("nation", "n_name"),
    "marital": ("region", "r_name"),
}

ROLES = list(_ROLES)
NUMERIC = ["duration", "campaign", "previous", "pdays", "discount", "tax",
           "totalprice", "acctbal", "month", "day_of_week"]
CATEGORICAL = ["job", "education", "contact", "poutcome", "marital", "nation"]

_DEPTH = {"lineitem": 0, "orders": 1, "customer": 2, "nation": 3, "region": 4}


def contacts(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
             key: bool = True) -> DataFrame:
    """Flat contact table with role columns (and the row key when ``key``)."""
    columns = list(columns or ROLES)
    unknown = [c for c in columns if c not in _ROLES]
    if unknown:
        raise ValueError(f"unknown contact columns: {unknown}")
    depth = max(_DEPTH[_ROLES[c][0]] for c in columns)

    line = load(spark, sf_dir, "lineitem")
    df = line
    if depth >= 1:
        dim = load(spark, sf_dir, "orders")
        if depth >= 2:
            cust = load(spark, sf_dir, "customer")
            if depth >= 3:
                nat = load(spark, sf_dir, "nation")
                if depth >= 4:
                    reg = load(spark, sf_dir, "region")
                    nat = nat.join(sized_broadcast(reg, 10_000),
                                   nat.n_regionkey == reg.r_regionkey)
                cust = cust.join(sized_broadcast(nat, 10_000),
                                 cust.c_nationkey == nat.n_nationkey)
            dim = dim.join(broadcast_by_size(cust, [load(spark, sf_dir, "customer")]),
                           dim.o_custkey == cust.c_custkey)
        # the dimension side has one row per order (foreign keys), so the
        # orders (+ customer) files bound its size; without that bound the
        # planner could pick the fact table as broadcast side
        bounds = [load(spark, sf_dir, "orders")] + (
            [load(spark, sf_dir, "customer")] if depth >= 2 else [])
        df = line.join(broadcast_by_size(dim, bounds), line.l_orderkey == dim.o_orderkey)

    out = ([F.col(k) for k in KEY] if key else []) + [
        F.expr(_ROLES[c][1]).alias(c) for c in columns if not (key and c in KEY)]
    return df.select(*out)


# The same view for the DuckDB oracle (full join; roles aliased alike).
CONTACTS_SQL = """contacts AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
    CAST(l.l_returnflag = 'R' AS INTEGER) AS y,
    l.l_extendedprice AS duration,
    l.l_quantity AS campaign,
    l.l_linenumber AS previous,
    l.l_discount + CAST(0.0 AS DOUBLE) AS discount,
    l.l_tax AS tax,
    l.l_linestatus AS contact,
    CAST(month(l.l_shipdate) AS INTEGER) AS month,
    CAST(dayofweek(l.l_shipdate) + 1 AS INTEGER) AS day_of_week,
    CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS pdays,
    o.o_totalprice AS totalprice,
    o.o_orderpriority AS education,
    o.o_orderstatus AS poutcome,
    c.c_mktsegment AS job,
    c.c_acctbal AS acctbal,
    n.n_name AS nation,
    r.r_name AS marital
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def with_contacts(sql: str, *ctes: str) -> str:
    """Prefix an oracle query with the contacts CTE (and any extra CTEs)."""
    return "WITH " + ",\n".join((CONTACTS_SQL,) + ctes) + "\n" + sql


# Category domains of the star schema's low-cardinality columns
# (only used to spell out one-hot columns in oracle SQL; the Spark side fits
# its vocabulary from the data).
DOMAINS = {
    "job": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "education": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "contact": ["F", "O"],
    "poutcome": ["F", "O", "P"],
    "marital": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}
