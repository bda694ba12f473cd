"""The library's canonical tables over the benchmark star schema, and the same
tables as SQL text for the oracle.

Only the dimension tables a query asks for are joined, so a query on two columns
scans two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderscope.operators import cleaning

# Stand-in parameters for the synthetic data (money is far smaller than in the
# real market, so the plausibility and tail limits are scaled down).
CAP = 104_000
RATIO = 5
FLOOR = 10_000
MEGA_QUANTILE = 0.75
TOP_ROTATION = 50
MIN_PROCESSES = 20
COMPETITIVE = ("1-URGENT", "2-HIGH", "3-MEDIUM")
CUT = "2000-01-01"
BASE_MONTH = "2001-06-01"
ANCHOR = "07$"
PEER = "[05]$"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_ORDER = {"published_at", "base_price", "method", "state", "buyer", "buyer_name", "buyer_department"}
_CUSTOMER = {"buyer", "buyer_name", "buyer_department"}
_SUPPLIER = {"supplier_name", "department"}
_PART = {"segment", "duration"}


def awards(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Award lines with the requested canonical columns."""
    want = set(cols)
    df, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    if want & _CUSTOMER:  # joined to the orders, of which there are fewer than lines
        buyers = table(spark, d, "customer").join(
            table(spark, d, "nation").select(
                F.col("n_nationkey").alias("bn_key"), F.col("n_name").alias("bn_name")
            ),
            F.col("c_nationkey") == F.col("bn_key"),
        )
        orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    if want & _ORDER:
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if want & _SUPPLIER:
        sup = table(spark, d, "supplier").join(
            table(spark, d, "nation").select(
                F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name")
            ),
            F.col("s_nationkey") == F.col("sn_key"),
        )
        df = df.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    if want & _PART:
        df = df.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    exprs = {
        "process_id": lambda: F.col("l_orderkey"),
        "line_no": lambda: F.col("l_linenumber"),
        "supplier_id": lambda: F.col("l_suppkey").cast("string"),
        "supplier_name": lambda: F.col("s_name"),
        "value": lambda: F.col("l_extendedprice").cast("decimal(18,2)"),
        "awarded": lambda: F.col("l_linestatus") == "F",
        "awarded_at": lambda: F.col("l_shipdate"),
        "published_at": lambda: F.col("o_orderdate"),
        "base_price": lambda: F.col("o_totalprice").cast("decimal(18,2)"),
        "method": lambda: F.col("o_orderpriority"),
        "state": lambda: F.col("o_orderstatus"),
        "buyer": lambda: F.concat(F.col("bn_name"), F.lit("/"), F.col("c_mktsegment")),
        "buyer_name": lambda: F.col("c_name"),
        "buyer_department": lambda: F.col("bn_name"),
        "department": lambda: F.col("sn_name"),
        "segment": lambda: F.col("p_type"),
        "duration": lambda: F.col("p_size"),
    }
    return df.select(*[exprs[c]().alias(c) for c in cols])


AWARDS_SQL = """
awards as (
  select l_orderkey as process_id, l_linenumber as line_no, cast(l_suppkey as varchar) as supplier_id,
         s_name as supplier_name, cast(l_extendedprice as decimal(18,2)) as value,
         l_linestatus = 'F' as awarded, l_shipdate as awarded_at, o_orderdate as published_at,
         cast(o_totalprice as decimal(18,2)) as base_price, o_orderpriority as method,
         o_orderstatus as state, bn.n_name || '/' || c_mktsegment as buyer, c_name as buyer_name,
         bn.n_name as buyer_department, sn.n_name as department, p_type as segment, p_size as duration
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation bn on c_nationkey = bn.n_nationkey join supplier on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey join part on l_partkey = p_partkey
)"""


def processes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per process with the requested columns (see ``line_to_process``)."""
    per_order = {"published_at", "base_price", "method", "state", "buyer", "department"}
    per_line = [c for c in cols if c not in per_order and c != "process_id"]
    needs = {"process_id"}
    if {"value", "awarded", "n_suppliers"} & set(per_line):
        needs.add("awarded")
    if "value" in per_line:
        needs.add("value")
    if "n_suppliers" in per_line:
        needs.add("supplier_id")
    needs |= {c for c in per_line if c in ("segment", "duration")}
    lines = awards(spark, d, *sorted(needs))
    rolled = cleaning.line_to_process(lines, [c for c in per_line])
    if not set(cols) & per_order:
        return rolled.select(*cols)
    o = table(spark, d, "orders")
    exprs = {
        "published_at": lambda: F.col("o_orderdate"),
        "base_price": lambda: F.col("o_totalprice").cast("decimal(18,2)"),
        "method": lambda: F.col("o_orderpriority"),
        "state": lambda: F.col("o_orderstatus"),
        "buyer": lambda: F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")),
        "department": lambda: F.col("n_name"),
    }
    if {"buyer", "department"} & set(cols):
        buyers = table(spark, d, "customer").join(
            table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        o = o.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("o_orderkey").alias("process_id"), *[exprs[c]().alias(c) for c in cols if c in per_order])
    return rolled.join(o, "process_id").select(*cols)


PROCESSES_SQL = """
processes as (
  select process_id, min(published_at) as published_at, max(base_price) as base_price, min(method) as method,
         min(state) as state, min(buyer) as buyer, min(buyer_department) as department, min(segment) as segment,
         max(duration) as duration, cast(coalesce(sum(value) filter (where awarded), 0) as decimal(28,2)) as value,
         bool_or(awarded) as awarded, count(distinct case when awarded then supplier_id end) as n_suppliers,
         count(*) as lots
  from awards group by process_id
)"""


def price_index(spark: SparkSession, d: str) -> DataFrame:
    """Monthly price index over the months of the data: 100 + 0.4 per month since 1995-01."""
    m = table(spark, d, "orders").select(F.trunc(F.col("o_orderdate"), "month").alias("month")).distinct()
    k = (F.year("month") - 1995) * 12 + F.month("month") - 1
    return m.select("month", (F.lit(100.0) + F.lit(0.4) * k).alias("index_value"))


PRICE_INDEX_SQL = """
price_index as (
  select distinct cast(date_trunc('month', o_orderdate) as date) as month,
         100.0::double + 0.4::double * ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) as index_value
  from orders
)"""

PROCESS_CAP = 10 * CAP  # a process sums several lines


def implausible_sql(cap: int = CAP) -> str:
    return f"(value > {cap} or (base_price > {FLOOR} and value > {RATIO} * base_price))"


def implausible(cap: float = CAP) -> Column:
    return cleaning.implausible(F.col("value"), F.col("base_price"), cap=cap, ratio=RATIO, floor=FLOOR)


def market(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Awarded, positive, plausible lines: the base of every market measure."""
    df = awards(spark, d, *dict.fromkeys([*cols, "awarded", "value", "base_price"]))
    return cleaning.awarded_lines(df).where(~implausible()).select(*cols)


MARKET_SQL = f"""
market as (
  select * from awards where awarded and value > 0 and not {implausible_sql()}
)"""

DEFLATED_SQL = f"""
deflated as (
  select p.*, cast(floor(cast(value as double) * factor * 100.0::double + 0.5::double) / 100.0::double as decimal(28,2)) as value_real,
         cast(floor(cast(base_price as double) * factor * 100.0::double + 0.5::double) / 100.0::double as decimal(28,2)) as base_price_real, factor
  from processes p left join (
    select month, (select index_value from price_index where month = date '{BASE_MONTH}') / index_value as factor
    from price_index) f on cast(date_trunc('month', published_at) as date) = f.month
)"""

# Implausible at process level: the aggregate value against the base price.
MEGA_SQL = f"""
flagged_processes as (select *, {implausible_sql(PROCESS_CAP)} as implausible from deflated),
mega as (
  select *, not implausible and awarded and n_suppliers = 1 and cast(value_real as double) > (
           select quantile_cont(cast(value_real as double), {MEGA_QUANTILE}) from flagged_processes
           where awarded and not implausible) as is_mega
  from flagged_processes
)"""

_VIEWS = {
    "awards": ("", AWARDS_SQL),
    "processes": ("awards", PROCESSES_SQL),
    "price_index": ("", PRICE_INDEX_SQL),
    "market": ("awards", MARKET_SQL),
    "deflated": ("processes price_index", DEFLATED_SQL),
    "mega": ("deflated", MEGA_SQL),
}


def add_view(name: str, needs: str, text: str) -> None:
    _VIEWS[name] = (needs, text)


def with_views(names: str, body: str) -> str:
    """SQL text of ``body`` preceded by the named views and what they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        needs, _ = _VIEWS[n]
        for m in needs.split():
            visit(m)
        if n not in done:
            done.append(n)

    for n in names.split():
        visit(n)
    ctes = ",".join(_VIEWS[n][1] for n in done)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    if body.startswith(","):
        return f"with {ctes}{body}"
    return f"with {ctes}\n{body}"
