"""Scans, derived datasets, seat maps and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.bindings import query
from tarmaq.bindings.views import (CABIN, FLIGHT, SEATLINE, bookings, cabins, events, flights, seat_lines)
from tarmaq.functions import scalars as S
from tarmaq.functions.predicates import in_tuples, owned_by
from tarmaq.operators import probes
from tarmaq.operators import relations as J
from tarmaq.plans import datasets as D
from tarmaq.plans import seating
from tarmaq.plans.quality import union_all
from tarmaq.session import measured, run_dir
from tarmaq.sources import catalog
from tarmaq.sources.scans import scan
from tarmaq.sources.sinks import append_new

# Column types of the driver tables, as declared in their files.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


@query("scan_project", "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def scan_project(spark, sf):
    return scan(spark, sf, "part", ["p_partkey", "p_name", "p_size"])


def _profile_sql() -> str:
    parts = []
    for table, columns in COLUMNS.items():
        for i, pair in enumerate(columns.split(", "), 1):
            name, kind = pair.split()
            value = f"{name} + 0::DOUBLE" if kind == "double" else name
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                         f"{i}::BIGINT AS ordinal, '{kind}' AS data_type, count(*) AS row_count, "
                         f"count(*) - count({name}) AS null_count, "
                         f"CAST(min({value}) AS VARCHAR) AS min_value, "
                         f"CAST(max({value}) AS VARCHAR) AS max_value FROM {table}")
    return "\nUNION ALL ".join(parts)


@query("column_profile", _profile_sql())
def column_profile(spark, sf):
    return union_all([catalog.profile(scan(spark, sf, t), t) for t in COLUMNS])


def _distinct_sql(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{pair.split()[0]}' AS column_name, count(*) AS row_count, "
        f"count(DISTINCT {pair.split()[0]}) AS distinct_count FROM {table}" for pair in COLUMNS[table].split(", "))


@query("column_profile_distinct", "\nUNION ALL ".join(_distinct_sql(t) for t in ("part", "orders")))
def column_profile_distinct(spark, sf):
    return union_all([catalog.profile(scan(spark, sf, t), t, "exact") for t in ("part", "orders")]).select(
        "table_name", "column_name", "row_count", "distinct_count")


@query("nullable_columns", """
WITH owner AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS guest,
         CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS member FROM orders)
SELECT 'orders' AS table_name, 'guest' AS column_name, 2::BIGINT AS ordinal, 'bigint' AS data_type,
       count(*) AS row_count, count(*) - count(guest) AS null_count FROM owner
UNION ALL SELECT 'orders', 'member', 3, 'bigint', count(*), count(*) - count(member) FROM owner""")
def nullable_columns(spark, sf):
    """The two owner columns are declared nullable, the key is not."""
    odd = F.col("o_orderkey") % 2 == 1
    owners = scan(spark, sf, "orders", ["o_orderkey", "o_custkey"]).select(
        F.coalesce("o_orderkey", F.lit(0)).alias("order_id"), F.when(odd, F.col("o_custkey")).alias("guest"),
        F.when(~odd, F.col("o_custkey")).alias("member"))
    return catalog.nullable_columns(owners, "orders")


def _merged_sql() -> str:
    def value(name, kind):
        return (f"epoch_us({name})" if kind.startswith("timestamp") else name) if kind != "string" else "NULL"

    return "\nUNION ALL ".join(
        f"SELECT 'orders' AS table_name, '{n}' AS column_name, count(*) AS row_count, count(*) - count({n}) AS null_count, "
        f"CAST(min({value(n, k)}) AS DOUBLE) AS min_number, CAST(max({value(n, k)}) AS DOUBLE) AS max_number, "
        f"{f'min({n})' if k == 'string' else 'NULL::VARCHAR'} AS min_text, "
        f"{f'max({n})' if k == 'string' else 'NULL::VARCHAR'} AS max_text FROM orders"
        for n, k in (pair.split() for pair in COLUMNS["orders"].split(", ")))


@query("column_profile_merged", _merged_sql())
def column_profile_merged(spark, sf):
    """Orders come in three parts (by status), are sketched one by one and merged; the exact columns."""
    orders = scan(spark, sf, "orders")
    parts = union_all([catalog.sketched(orders.filter(F.col("o_orderstatus") == s), "orders") for s in "FOP"])
    return catalog.estimated(catalog.merged_profiles(parts)).select(
        "table_name", "column_name", "row_count", "null_count", "min_number", "max_number", "min_text", "max_text")


@query("layout_map_json", f"""
WITH {CABIN}
SELECT plane_id, '{{' || string_agg('"' || class_type || '":{{"rows":' || rows_num || ',"cols":4}}',
                                    ',' ORDER BY class_type) || '}}' AS layout_json
FROM cabin GROUP BY plane_id""")
def layout_map_json(spark, sf):
    return catalog.layout_map(cabins(spark, sf))


@query("replace_children", """
WITH old AS (SELECT DISTINCT l_orderkey, l_suppkey AS child FROM lineitem),
fresh AS (SELECT DISTINCT l_orderkey, l_partkey AS child FROM lineitem WHERE l_returnflag = 'R')
SELECT * FROM old WHERE l_orderkey NOT IN (SELECT l_orderkey FROM fresh)
UNION ALL SELECT * FROM fresh""")
def replace_children(spark, sf):
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_suppkey", "l_partkey", "l_returnflag"])
    old = lines.select("l_orderkey", F.col("l_suppkey").alias("child")).distinct()
    fresh = (lines.filter(F.col("l_returnflag") == "R")
             .select("l_orderkey", F.col("l_partkey").alias("child")).distinct())
    return J.replace_children(old, fresh, "l_orderkey")


def _routed(spark, sf, *statuses):
    """Flights with an origin (customer's nation) and a destination (its region)."""
    nations = (scan(spark, sf, "nation")
               .join(scan(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
               .select(F.col("n_nationkey").alias("c_nationkey"),
                       F.col("n_name").alias("origin_airport"),
                       F.col("r_name").alias("destination_airport")))
    owners = (scan(spark, sf, "customer", ["c_custkey", "c_nationkey"])
              .join(nations, "c_nationkey").withColumnRenamed("c_custkey", "owner"))
    return (flights(spark, sf, *statuses).join(owners, "owner")
            .withColumnRenamed("minutes", "flight_duration"))


ROUTED = f"""{FLIGHT}, routed AS (
  SELECT f.*, n_name AS origin_airport, r_name AS destination_airport,
         takeoff_ts + to_minutes(minutes) AS landing_ts
  FROM flight f JOIN customer ON c_custkey = owner JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""


@query("trip_search", f"""
WITH {ROUTED}
SELECT r.flight_id, strftime(takeoff_ts, '%Y-%m-%d') AS takeoff_date, origin_airport,
       destination_airport, strftime(landing_ts, '%Y-%m-%d') AS landing_date,
       strftime(landing_ts, '%H:%M:%S') AS landing_time,
       CAST(min(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS from_price
FROM routed r LEFT JOIN lineitem ON l_orderkey = r.flight_id AND l_linestatus = 'O'
WHERE flight_status = 'Scheduled' AND origin_airport = 'NATION_3' GROUP BY ALL""")
def trip_search(spark, sf):
    found = D.flight_search(_routed(spark, sf, P.SCHEDULED), seat_lines(spark, sf), origin="NATION_3",
                            class_type="O", keys=("flight_id",))
    return found.select("flight_id", S.day_text("takeoff_ts").alias("takeoff_date"),
                        "origin_airport", "destination_airport", "landing_date", "landing_time",
                        "from_price")


LISTING_AS_OF = "2001-07-15 00:00:00"


@query("trip_listing", f"""
WITH {FLIGHT}
SELECT flight_id, strftime(takeoff_ts, '%Y-%m-%d') AS takeoff_date, flight_status,
       strftime(takeoff_ts + to_minutes(minutes), '%Y-%m-%d') AS landing_date,
       takeoff_ts >= TIMESTAMP '{LISTING_AS_OF}' + INTERVAL 72 HOUR AS can_cancel
FROM flight ORDER BY takeoff_ts DESC, flight_id ASC LIMIT {P.LISTING_ROWS}""")
def trip_listing(spark, sf):
    listed = D.flight_listing(
        flights(spark, sf).withColumn("flight_duration", F.col("minutes")), LISTING_AS_OF)
    return listed.select("flight_id", S.day_text("takeoff_ts").alias("takeoff_date"),
                         "flight_status", "landing_date", "can_cancel")


@query("landing_time", f"""
WITH {FLIGHT}
SELECT flight_id, minutes, strftime(takeoff_ts + to_minutes(minutes), '%Y-%m-%d') AS landing_date,
       strftime(takeoff_ts + to_minutes(minutes), '%H:%M:%S') AS landing_time FROM flight""")
def landing_time(spark, sf):
    return D.with_landing(flights(spark, sf), "minutes").select(
        "flight_id", "minutes", "landing_date", "landing_time")


@query("from_price", f"""
WITH {SEATLINE}
SELECT o_orderkey AS flight_id, CAST(min(price) AS DOUBLE) AS from_price
FROM orders LEFT JOIN seatline ON flight_id = o_orderkey AND class_type = 'O'
GROUP BY o_orderkey""")
def from_price(spark, sf):
    return D.from_price(flights(spark, sf).select("flight_id"), seat_lines(spark, sf), "O",
                        ("flight_id",))


@query("trip_cabin_offer", f"""
WITH {FLIGHT}, {SEATLINE}, cabin AS (
  SELECT priority AS plane_id, class_type, max(s_row) AS rows_num
  FROM seatline JOIN flight USING (flight_id) GROUP BY ALL),
price AS (SELECT flight_id, class_type, min(price) AS price FROM seatline GROUP BY ALL),
free AS (SELECT flight_id, class_type, count(*) AS available FROM seatline
         WHERE order_status = 'Cancelled by system' GROUP BY ALL)
SELECT f.flight_id, c.class_type, CAST(rows_num AS BIGINT) AS rows_num,
       CAST(price AS DOUBLE) AS price, coalesce(available, 0) AS available
FROM flight f JOIN cabin c ON c.plane_id = f.priority
LEFT JOIN price p ON p.flight_id = f.flight_id AND p.class_type = c.class_type
LEFT JOIN free e ON e.flight_id = f.flight_id AND e.class_type = c.class_type""")
def trip_cabin_offer(spark, sf):
    """Planes are order priorities; their cabins are what their lines show, measured first.

    One fold of the lines by flight and class then has the price and the free seats.
    """
    flown = flights(spark, sf).withColumnRenamed("priority", "plane_id")
    lines = seat_lines(spark, sf)
    layout = measured(lines.groupBy("flight_id", "class_type").agg(F.max("s_row").alias("rows_num"))
                      .join(flown.select("flight_id", "plane_id"), "flight_id")
                      .groupBy("plane_id", "class_type").agg(F.max("rows_num").alias("rows_num")), "layout")
    facts = lines.groupBy("flight_id", "class_type").agg(
        F.min("price").alias("price"), F.count_if(F.col("order_status") == P.BY_SYSTEM).alias("available"))
    return D.cabin_offer(flown, layout, facts, keys=("flight_id", "class_type")).select(
        "flight_id", "class_type", "rows_num", "price", "available")


@query("free_seats_by_class", f"""
WITH {SEATLINE}
SELECT flight_id, class_type, count(*) AS available FROM seatline
WHERE order_status = 'Cancelled by system' GROUP BY ALL""")
def free_seats_by_class(spark, sf):
    return D.free_seats(seat_lines(spark, sf, P.BY_SYSTEM), F.col("order_status") == P.BY_SYSTEM)


@query("seat_taken_map", f"""
WITH {SEATLINE}
SELECT flight_id, CAST(s_row AS BIGINT) AS s_row, min(class_type) AS class_type,
       bool_or(order_status = 'Active') AS is_taken
FROM seatline GROUP BY flight_id, s_row""")
def seat_taken_map(spark, sf):
    # F before O: the class is folded as a flag, as text would be sorted
    first = F.max(F.when(F.col("class_type") == "F", 1).otherwise(0)) == 1
    seats = seat_lines(spark, sf).groupBy("flight_id", "s_row").agg(
        F.when(first, "F").otherwise("O").alias("class_type"),
        F.max(F.when(F.col("order_status") == P.ACTIVE, F.col("flight_id"))).alias("order_id"))
    return D.seat_map(seats.withColumn("s_column", F.lit(1))).drop("s_column")


@query("order_total", f"""
WITH {SEATLINE}
SELECT o_orderkey AS order_id, CAST(coalesce(sum(price), 0) AS DOUBLE) AS total
FROM orders LEFT JOIN seatline ON flight_id = o_orderkey GROUP BY o_orderkey""")
def order_total(spark, sf):
    lines = seat_lines(spark, sf).withColumnRenamed("flight_id", "order_id")
    return D.order_totals(bookings(spark, sf).select("order_id"), lines)


@query("order_summary", f"""
WITH {ROUTED}, line AS (
  SELECT l_orderkey AS order_id, l_linenumber AS r, l_suppkey % 30 + 1 AS c,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
seat AS (
  SELECT order_id, string_agg(CASE WHEN c <= 26 THEN r || chr(CAST(64 + c AS INTEGER))
                                   ELSE r || '-' || c END, ', ' ORDER BY r, c) AS seats
  FROM (SELECT DISTINCT order_id, r, c FROM line) GROUP BY order_id),
total AS (SELECT order_id, sum(price) AS total FROM line GROUP BY order_id)
SELECT r.flight_id AS order_id, origin_airport, destination_airport,
       strftime(landing_ts, '%Y-%m-%d') AS landing_date,
       strftime(landing_ts, '%H:%M:%S') AS landing_time,
       coalesce(seats, '') AS seats, CAST(coalesce(total, 0) AS DOUBLE) AS total
FROM routed r LEFT JOIN seat s ON s.order_id = r.flight_id
LEFT JOIN total t ON t.order_id = r.flight_id""")
def order_summary(spark, sf):
    lines = seat_lines(spark, sf).select(
        F.col("flight_id").alias("order_id"), "s_row",
        (F.col("suppkey") % 30 + 1).alias("s_column"), "price")
    orders = bookings(spark, sf).select("order_id", F.col("order_id").alias("flight_id"))
    return D.order_summary(orders, _routed(spark, sf), lines).select(
        "order_id", "origin_airport", "destination_airport", "landing_date", "landing_time",
        "seats", "total")


HISTORY = 5


@query("purchase_history", f"""
WITH booking AS (
  SELECT o_orderkey AS order_id, o_custkey AS owner, o_orderdate AS date_of_purchase,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled by customer'
              WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Active' END AS order_status
  FROM orders WHERE o_orderstatus <> 'P'),
recent AS (
  SELECT *, row_number() OVER (PARTITION BY owner
                               ORDER BY date_of_purchase DESC, order_id) AS position
  FROM booking QUALIFY position <= {HISTORY})
SELECT owner, order_id, order_status, position,
       strftime(date_of_purchase, '%Y-%m-%d') AS purchased,
       count(l_orderkey) AS seats_count,
       CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total
FROM recent LEFT JOIN lineitem ON l_orderkey = order_id GROUP BY ALL""")
def purchase_history(spark, sf):
    lines = seat_lines(spark, sf).withColumnRenamed("flight_id", "order_id").drop("order_status")
    return D.purchase_history(bookings(spark, sf), lines, "owner", n=HISTORY).select(
        "owner", "order_id", "order_status", "position",
        S.day_text("date_of_purchase").alias("purchased"), "seats_count", "total")


OWNER = "Customer#000000007"


@query("owner_history", f"""
WITH booking AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 1 THEN c_name END AS guest,
         CASE WHEN o_orderkey % 2 = 0 THEN c_name END AS member, o_orderdate AS date_of_purchase,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled by customer'
              WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Active' END AS order_status
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P')
SELECT order_id, order_status, strftime(date_of_purchase, '%Y-%m-%d') AS purchased, count(l_orderkey) AS seats_count,
       CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total
FROM booking LEFT JOIN lineitem ON l_orderkey = order_id
WHERE guest = '{OWNER}' OR member = '{OWNER}' GROUP BY ALL""")
def owner_history(spark, sf):
    """The purchases of one owner: a guest of odd orders, a member of even ones."""
    odd = F.col("order_id") % 2 == 1
    names = scan(spark, sf, "customer", ["c_custkey", "c_name"]).toDF("owner", "name")
    orders = bookings(spark, sf).join(names, "owner").withColumns({
        "guest": F.when(odd, F.col("name")), "member": F.when(~odd, F.col("name"))})
    mine = orders.filter(owned_by("guest", "member", OWNER))
    lines = seat_lines(spark, sf).withColumnRenamed("flight_id", "order_id").drop("order_status")
    return D.purchase_history(mine, J.exists_in(lines, mine, ["order_id"]), "name").select(
        "order_id", "order_status", S.day_text("date_of_purchase").alias("purchased"), "seats_count", "total")


@query("append_new_rows", """
SELECT c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def append_new_rows(spark, sf):
    """Customers stand; suppliers are appended twice, and those with a new key are there once."""
    path = run_dir(spark, "appended")
    scan(spark, sf, "customer", ["c_custkey", "c_name"]).toDF("key", "name").write.parquet(path)
    fresh = scan(spark, sf, "supplier", ["s_suppkey", "s_name"]).toDF("key", "name")
    for _ in range(2):
        append_new(fresh, spark.read.schema(fresh.schema).parquet(path), path, ["key"])
    return spark.read.schema(fresh.schema).parquet(path)


@query("contact_list", """
SELECT c_custkey, c_name, coalesce((
  SELECT string_agg(p, ', ' ORDER BY p) FROM (
    SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey = c_custkey)), '') AS phones
FROM customer""")
def contact_list(spark, sf):
    phones = scan(spark, sf, "orders", ["o_custkey", "o_orderpriority"]).withColumnRenamed(
        "o_custkey", "c_custkey")
    return D.contact_list(scan(spark, sf, "customer", ["c_custkey", "c_name"]), phones,
                          "c_custkey", "o_orderpriority")


@query("order_owner_unify", """
SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS owner
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def order_owner_unify(spark, sf):
    pairs = (scan(spark, sf, "supplier", ["s_suppkey", "s_name"])
             .withColumnRenamed("s_suppkey", "key")
             .join(scan(spark, sf, "customer", ["c_custkey", "c_name"])
                   .withColumnRenamed("c_custkey", "key"), "key", "full"))
    return J.coalesce_owner(pairs, "s_name", "c_name").select("key", "owner")


@query("endpoint_union", """
SELECT n_name AS airport FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def endpoint_union(spark, sf):
    keys = J.distinct_union([(scan(spark, sf, "customer", ["c_nationkey"]), "c_nationkey"),
                             (scan(spark, sf, "supplier", ["s_nationkey"]), "s_nationkey")],
                            "n_nationkey")
    return (keys.join(scan(spark, sf, "nation", ["n_nationkey", "n_name"]), "n_nationkey")
            .select(F.col("n_name").alias("airport")))


def _owners_flown(spark, sf):
    return flights(spark, sf, P.COMPLETED).select(F.col("owner").alias("c_custkey"))


@query("exists_semi", """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def exists_semi(spark, sf):
    return J.exists_in(scan(spark, sf, "customer", ["c_custkey", "c_name"]),
                       _owners_flown(spark, sf), ["c_custkey"])


@query("anti_new_rows", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def anti_new_rows(spark, sf):
    return J.not_existing(scan(spark, sf, "customer", ["c_custkey", "c_name"]),
                          _owners_flown(spark, sf), ["c_custkey"])


DEAREST = 450_000


@query("selective_semi", f"""
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > {DEAREST})""")
def selective_semi(spark, sf):
    """The lines of the dearest orders: few, so most lines are dropped where they are read."""
    dear = scan(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).filter(F.col("o_totalprice") > DEAREST)
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    return probes.exists_selective(lines, dear.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("selective_anti", f"""
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > {DEAREST})""")
def selective_anti(spark, sf):
    """All other lines, most of which are not shuffled."""
    dear = scan(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).filter(F.col("o_totalprice") > DEAREST)
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    return probes.missing_selective(lines, dear.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("tuple_in_semi", """
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag
FROM lineitem WHERE (l_linenumber, l_returnflag) IN ((1, 'N'), (2, 'R'), (7, 'A'))""")
def tuple_in_semi(spark, sf):
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])
    return in_tuples(lines, ["l_linenumber", "l_returnflag"], [(1, "N"), (2, "R"), (7, "A")])


@query("scalar_subquery_filter", """
WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
SELECT o_orderkey, CAST(price AS DOUBLE) AS price FROM o
WHERE price * (SELECT count(*) FROM o) > (SELECT sum(price) FROM o)""")
def scalar_subquery_filter(spark, sf):
    """Orders dearer than the mean, compared without dividing."""
    priced = scan(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(
        "o_orderkey", S.money("o_totalprice").alias("price"))
    rows = priced.agg(F.count(F.lit(1)).cast("decimal(18,0)"))
    return J.above(priced, F.col("price") * rows.scalar(), priced.agg(F.sum("price")))


@query("cabin_start_row", f"""
WITH {CABIN}
SELECT plane_id, class_type, CAST(rows_num AS BIGINT) AS rows_num,
       CAST(1 + coalesce(sum(rows_num) OVER (PARTITION BY plane_id ORDER BY class_type
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row
FROM cabin""")
def cabin_start_row(spark, sf):
    return seating.start_rows(cabins(spark, sf), F.col("class_type")).select(
        "plane_id", "class_type", "rows_num", "start_row")


GRID = f"""{CABIN}, started AS (
  SELECT *, CAST(1 + coalesce(sum(rows_num) OVER (PARTITION BY plane_id ORDER BY class_type
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row
  FROM cabin),
grid AS (
  SELECT plane_id, class_type, start_row + r.n - 1 AS s_row, c.n AS s_column
  FROM started, LATERAL (SELECT unnest(range(1, rows_num + 1)) AS n) r,
       LATERAL (SELECT unnest(range(1, columns_num + 1)) AS n) c)"""


@query("seat_map_generate", f"""
WITH {GRID}
SELECT s_suppkey AS flight_id, s_row, s_column, plane_id, class_type
FROM supplier JOIN grid ON plane_id = 'Brand#' || (s_suppkey % 25 + 1)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey
                  AND l_linenumber = s_row AND l_partkey % 4 + 1 = s_column)""")
def seat_map_generate(spark, sf):
    """Every supplier flies one brand; seats its lines already mention exist."""
    fleet = scan(spark, sf, "supplier", ["s_suppkey"]).select(
        F.col("s_suppkey").alias("flight_id"),
        F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("plane_id"))
    present = scan(spark, sf, "lineitem", ["l_suppkey", "l_linenumber", "l_partkey"]).select(
        F.col("l_suppkey").alias("flight_id"), F.col("l_linenumber").alias("s_row"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("s_column"))
    return seating.seats_from_layout(fleet, cabins(spark, sf), present,
                                     F.col("class_type")).drop("order_id")


@query("number_series", """
SELECT unnest(range(1, (SELECT max(p_size) FROM part) + 1)) AS n""")
def number_series(spark, sf):
    return J.number_series(scan(spark, sf, "part", ["p_size"]).agg(F.max("p_size").alias("m")), "m")


@query("seat_labels", f"""
WITH {GRID}
SELECT plane_id, s_row, string_agg(s_row || chr(CAST(64 + s_column AS INTEGER)), ', '
                                   ORDER BY s_column) AS labels,
       string_agg(s_row || '-' || s_column, ' ' ORDER BY s_column) AS codes
FROM grid GROUP BY plane_id, s_row""")
def seat_labels(spark, sf):
    grid = seating.seat_grid(seating.start_rows(cabins(spark, sf), F.col("class_type")))
    coded = grid.withColumn("code", S.seat_code("s_row", "s_column"))
    back = coded.select("plane_id", "code", S.seat_row("code").alias("s_row"),
                        S.seat_column("code").alias("s_column"))
    return back.groupBy("plane_id", "s_row").agg(
        S.seat_list("s_row", "s_column").alias("labels"),
        F.array_join(F.sort_array(F.collect_set("code")), " ").alias("codes"))


@query("name_split", """
SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS first_name,
       array_to_string(string_split(p_name, ' ')[2:], ' ') AS last_name FROM part""")
def name_split(spark, sf):
    return scan(spark, sf, "part", ["p_partkey", "p_name"]).withColumns(
        {"first_name": S.first_name("p_name"), "last_name": S.last_name("p_name")})


@query("contact_normalise", """
SELECT c_custkey, lower(trim(c_name)) AS email, upper(trim(c_mktsegment)) AS code,
       replace(trim(' ' || substr(c_name, 10, 3) || '-' || substr(c_name, 13) || ' '), ' ', '')
         AS phone,
       regexp_full_match(substr(c_name, 10), '[0-9-]+') AS digits_are_phone,
       regexp_full_match(replace(trim(c_name), ' ', ''), '[0-9-]+') AS name_is_phone
FROM customer""")
def contact_normalise(spark, sf):
    digits = F.expr("substring(c_name, 10)")
    written = F.concat(F.lit(" "), F.substring("c_name", 10, 3), F.lit("-"),
                       F.expr("substring(c_name, 13)"), F.lit(" "))
    return scan(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"]).select(
        "c_custkey", S.clean_email("c_name").alias("email"),
        S.clean_code("c_mktsegment").alias("code"), S.clean_phone(written).alias("phone"),
        S.is_phone(digits).alias("digits_are_phone"), S.is_phone("c_name").alias("name_is_phone"))


@query("seat_rebuild", f"""
WITH {GRID}, flown AS (
  SELECT s_suppkey AS flight_id, 'Brand#' || (s_suppkey % 25 + 1) AS plane_id, s_acctbal > 0 AS again FROM supplier),
sound AS (SELECT * FROM flown WHERE again AND plane_id IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY'))
SELECT DISTINCT l_suppkey AS flight_id, CAST(l_linenumber AS BIGINT) AS s_row, l_partkey % 4 + 1 AS s_column
FROM lineitem WHERE l_suppkey NOT IN (SELECT flight_id FROM sound)
UNION ALL SELECT flight_id, s_row, s_column FROM sound JOIN grid USING (plane_id)""")
def seat_rebuild(spark, sf):
    """Suppliers in credit get new seats by the layout of their brand; the others keep those their lines mention."""
    fleet = scan(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).select(
        F.col("s_suppkey").alias("flight_id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("plane_id"),
        (F.col("s_acctbal") > 0).alias("again"))
    layout = cabins(spark, sf).withColumn("class_type", F.when(F.col("class_type") == "ECONOMY", "Economy")
                                          .otherwise(F.col("class_type")))
    seats = scan(spark, sf, "lineitem", ["l_suppkey", "l_linenumber", "l_partkey"]).select(
        F.col("l_suppkey").alias("flight_id"), F.col("l_linenumber").alias("s_row"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("s_column")).distinct()
    return seating.rebuild_seats(seats, fleet.filter("again"), layout, F.upper("class_type"))


RANKS = {"STANDARD": 1, "PROMO": 2, "LARGE": 3, "MEDIUM": 4, "SMALL": 5, "ECONOMY": 6}


@query("cabin_start_rank", f"""
WITH {CABIN}, ranked AS (
  SELECT *, CASE class_type {' '.join(f"WHEN '{c}' THEN {n}" for c, n in RANKS.items())} END AS place FROM cabin)
SELECT plane_id, class_type, CAST(rows_num AS BIGINT) AS rows_num,
       CAST(1 + coalesce(sum(rows_num) OVER (PARTITION BY plane_id ORDER BY place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row
FROM ranked""")
def cabin_start_rank(spark, sf):
    """Cabins in a declared order of classes, which is not that of their names."""
    return seating.start_rows(cabins(spark, sf), S.class_rank("class_type", RANKS)).select(
        "plane_id", "class_type", "rows_num", "start_row")


@query("takeoff_moment", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS takeoff FROM events""")
def takeoff_moment(spark, sf):
    """Date and time of day, kept apart as text, make one moment again."""
    apart = events(spark, sf).select("event_id", S.day_text("ts").alias("day"), S.clock_text("ts").alias("clock"))
    return apart.select("event_id", S.moment_text(S.takeoff("day", "clock")).alias("takeoff"))
