"""Scheduling checks and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.bindings import query
from tarmaq.bindings.views import (AS_OF, CABIN, FLIGHT, SPAN, cabins, flights, seat_lines, spans)
from tarmaq.functions.scalars import flag, plus_minutes
from tarmaq.operators import intervals as I
from tarmaq.plans import candidates
from tarmaq.plans import quality as Q
from tarmaq.plans import scheduling as C
from tarmaq.session import measured
from tarmaq.sources.scans import scan

SPAN_KEYS = (["user_id"], "start_ts", "end_ts", "event_id")


@query("conflict_overlap", f"""
WITH {SPAN}
SELECT a.event_id, a.user_id, count(b.event_id) AS clashes
FROM span a LEFT JOIN span b ON b.user_id = a.user_id AND b.event_id <> a.event_id
  AND b.start_ts < a.end_ts AND b.end_ts > a.start_ts
GROUP BY a.event_id, a.user_id""")
def conflict_overlap(spark, sf):
    return I.self_clash_counts(spans(spark, sf), *SPAN_KEYS)


@query("conflict_first", f"""
WITH {SPAN}
SELECT a.event_id, a.user_id,
       arg_min(b.event_id, (b.start_ts, b.end_ts, b.event_id)) AS first_clash
FROM span a LEFT JOIN span b ON b.user_id = a.user_id AND b.event_id <> a.event_id
  AND b.start_ts < a.end_ts AND b.end_ts > a.start_ts
GROUP BY a.event_id, a.user_id""")
def conflict_first(spark, sf):
    return I.first_clash(spans(spark, sf), *SPAN_KEYS).drop("start_ts", "end_ts")


@query("conflict_staff", f"""
WITH {SPAN}
SELECT a.event_id, a.user_id, count(b.event_id) AS clashes
FROM span a LEFT JOIN span b ON b.user_id = a.user_id AND b.event_type = 'view'
  AND b.start_ts < a.end_ts AND b.end_ts > a.start_ts
WHERE a.event_type = 'purchase' GROUP BY a.event_id, a.user_id""")
def conflict_staff(spark, sf):
    return I.clash_counts(spans(spark, sf, "purchase"), spans(spark, sf, "view"), *SPAN_KEYS)


@query("conflict_running_max", f"""
WITH {SPAN}
SELECT event_id, user_id, coalesce(max(end_ts) OVER (
         PARTITION BY user_id ORDER BY start_ts, end_ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start_ts, false) AS clashes
FROM span""")
def conflict_running_max(spark, sf):
    return I.clashes_with_earlier(spans(spark, sf).drop("event_type"), *SPAN_KEYS).select(
        "event_id", "user_id", "clashes")


@query("trip_class", f"""
WITH {FLIGHT}
SELECT CASE WHEN minutes >= 360 THEN 'long' ELSE 'short' END AS length,
       count(*) AS flights, count(*) FILTER (WHERE minutes > 360) AS long_in_reports
FROM flight GROUP BY 1""")
def trip_class(spark, sf):
    return C.flight_length(flights(spark, sf)).groupBy("length").agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum(flag(F.col("minutes") > P.REPORT_LONG_MINUTES)).alias("long_in_reports"))


def _timed(spark, sf):
    return C.open_flights(flights(spark, sf, *P.OPEN_FLIGHT)).select(
        "flight_id", "minutes", F.col("takeoff_ts").alias("start_ts"),
        plus_minutes("takeoff_ts", F.col("minutes")).alias("end_ts"))


def _eligible(member: str, pool: str, qualified: str) -> str:
    return f"""
WITH {FLIGHT}, link AS (
  SELECT DISTINCT l_orderkey AS flight_id, {member} FROM lineitem),
served AS (
  SELECT link.*, minutes, takeoff_ts AS s, takeoff_ts + to_minutes(minutes) AS e
  FROM link JOIN flight USING (flight_id) WHERE flight_status IN ('Scheduled', 'Full')),
pool AS ({pool}),
counted AS (
  SELECT a.flight_id, a.{member}, any_value(a.minutes) AS minutes, count(b.flight_id) AS clashes
  FROM served a LEFT JOIN served b ON b.{member} = a.{member} AND b.flight_id <> a.flight_id
    AND b.s < a.e AND b.e > a.s
  GROUP BY a.flight_id, a.{member})
SELECT flight_id, {member}, {qualified} IS NOT NULL AS known,
       coalesce(minutes < 360 OR {qualified}, false) AND {qualified} IS NOT NULL AS qualified, clashes,
       coalesce(minutes < 360 OR {qualified}, false) AND {qualified} IS NOT NULL AND clashes = 0 AS eligible
FROM counted LEFT JOIN pool USING ({member})"""


@query("eligible_crew", _eligible(
    "l_suppkey", "SELECT s_suppkey AS l_suppkey, s_acctbal > 0 AS trained FROM supplier",
    "trained"))
def eligible_crew(spark, sf):
    """Suppliers serve orders; a positive balance stands for long-flight training."""
    links = (scan(spark, sf, "lineitem", ["l_orderkey", "l_suppkey"])
             .withColumnRenamed("l_orderkey", "flight_id").distinct())
    crew = scan(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("trained"))
    return C.check_assignments(links, _timed(spark, sf), crew, ["l_suppkey"], "trained")


@query("eligible_planes", _eligible(
    "l_partkey", "SELECT p_partkey AS l_partkey, p_type = 'LARGE' AS is_large FROM part",
    "is_large"))
def eligible_planes(spark, sf):
    """Parts serve orders as planes; type LARGE stands for a large plane."""
    links = (scan(spark, sf, "lineitem", ["l_orderkey", "l_partkey"])
             .withColumnRenamed("l_orderkey", "flight_id").distinct())
    planes = scan(spark, sf, "part", ["p_partkey", "p_type"]).select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_type") == "LARGE").alias("large"))
    return C.check_assignments(links, _timed(spark, sf), planes, ["l_partkey"], "large")


@query("vehicle_first_clash", f"""
WITH {FLIGHT}, running AS (
  SELECT flight_id, flight_id % 300 AS plane_id, takeoff_ts AS s, takeoff_ts + to_minutes(minutes) AS e
  FROM flight WHERE flight_status IN ('Scheduled', 'Full'))
SELECT a.flight_id, a.plane_id, arg_min(b.flight_id, (b.s, b.e, b.flight_id)) AS first_clash
FROM running a LEFT JOIN running b ON b.plane_id = a.plane_id AND b.flight_id <> a.flight_id AND b.s < a.e AND b.e > a.s
GROUP BY a.flight_id, a.plane_id""")
def vehicle_first_clash(spark, sf):
    """Open flights of 300 planes."""
    timed = flights(spark, sf).select("flight_id", (F.col("flight_id") % 300).alias("plane_id"), "flight_status",
                                      F.col("takeoff_ts").alias("start_ts"),
                                      plus_minutes("takeoff_ts", F.col("minutes")).alias("end_ts"))
    return C.vehicle_clashes(timed).select("flight_id", "plane_id", "first_clash")


@query("crew_size_violations", f"""
WITH {FLIGHT}, head AS (
  SELECT l_orderkey AS flight_id, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber <= 2) AS pilot,
         count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber > 2) AS attendant
  FROM lineitem GROUP BY 1),
sized AS (
  SELECT flight_id, CASE WHEN minutes >= 360 THEN 'long' ELSE 'short' END AS length,
         coalesce(pilot, 0) AS pilot, coalesce(attendant, 0) AS attendant
  FROM flight LEFT JOIN head USING (flight_id)),
role AS (
  SELECT flight_id, length, 'pilot' AS role, pilot AS assigned,
         CASE length WHEN 'long' THEN 3 ELSE 2 END::BIGINT AS required FROM sized
  UNION ALL SELECT flight_id, length, 'attendant', attendant,
         CASE length WHEN 'long' THEN 6 ELSE 3 END::BIGINT FROM sized)
SELECT * FROM role WHERE assigned <> required""")
def crew_size_violations(spark, sf):
    """The first two lines of an order are its pilots, the others its attendants."""
    role = F.when(F.col("s_row") <= 2, "pilot").otherwise("attendant")
    links = seat_lines(spark, sf).select("flight_id", role.alias("role"), F.col("suppkey").alias("employee_id"))
    return C.crew_size_violations(flights(spark, sf), links)


NEW_FLIGHT = "1996-01-01 12:00:00"


@query("available_for", f"""
WITH {FLIGHT}, busy AS (
  SELECT DISTINCT l_suppkey FROM lineitem JOIN flight ON flight_id = l_orderkey
  WHERE flight_status IN ('Scheduled', 'Full') AND takeoff_ts < TIMESTAMP '{NEW_FLIGHT}' + to_minutes(400)
    AND takeoff_ts + to_minutes(minutes) > TIMESTAMP '{NEW_FLIGHT}')
SELECT s_suppkey AS l_suppkey FROM supplier
WHERE s_acctbal > 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM busy)""")
def available_for(spark, sf):
    """Suppliers that could serve a new flight of 400 minutes."""
    links = scan(spark, sf, "lineitem", ["l_orderkey", "l_suppkey"]).withColumnRenamed("l_orderkey", "flight_id")
    crew = scan(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("trained"))
    running = flights(spark, sf, *P.OPEN_FLIGHT).withColumns({
        "start_ts": F.col("takeoff_ts"), "end_ts": plus_minutes("takeoff_ts", F.col("minutes"))})
    return C.available_for(crew, links, running, "l_suppkey", "trained", NEW_FLIGHT, 400).select("l_suppkey")


@query("crew_candidates", f"""
WITH {FLIGHT}, member AS (
  SELECT 'crew' AS role, s_suppkey AS member, s_acctbal > 0 AS fit FROM supplier
  UNION ALL SELECT 'plane', p_partkey, p_type = 'LARGE' FROM part),
link AS (
  SELECT DISTINCT 'crew' AS role, l_suppkey AS member, l_orderkey AS flight_id FROM lineitem
  UNION ALL SELECT DISTINCT 'plane', l_partkey, l_orderkey FROM lineitem),
busy AS (
  SELECT role, member, takeoff_ts AS s, takeoff_ts + to_minutes(minutes) AS e
  FROM link JOIN flight USING (flight_id) WHERE flight_status = 'Scheduled'),
load AS (SELECT role, member, count(*) AS load FROM busy GROUP BY ALL),
pool AS (SELECT role, member, fit, coalesce(load, 0) AS load FROM member LEFT JOIN load USING (role, member)),
new AS (
  SELECT flight_id, takeoff_ts AS s, takeoff_ts + to_minutes(minutes) AS e, minutes >= 360 AS long, minutes
  FROM flight WHERE flight_status = 'Full'),
-- flights of one moment and length share their candidates
slot AS (SELECT s, e, any_value(long) AS long, count(*) AS flights FROM new GROUP BY s, e),
clash AS (
  SELECT DISTINCT slot.s, slot.e, busy.role, member FROM slot JOIN busy ON busy.s < slot.e AND busy.e > slot.s),
free AS (
  SELECT slot.s, slot.e, role, member, load, row_number() OVER (
           PARTITION BY slot.s, slot.e, role ORDER BY load, member) AS place,
         CASE WHEN role = 'plane' THEN 1 WHEN long THEN 3 ELSE 2 END AS seats
  FROM slot JOIN pool ON fit OR NOT long
  ANTI JOIN clash USING (s, e, role, member)
  QUALIFY place <= seats)
SELECT flight_id, role, place, member, load FROM new JOIN free USING (s, e)""")
def crew_candidates(spark, sf):
    """Full flights are new: their least-loaded free crews and planes among suppliers and parts."""
    timed = flights(spark, sf).select("flight_id", "flight_status", "minutes", F.col("takeoff_ts").alias("start_ts"),
                                      plus_minutes("takeoff_ts", F.col("minutes")).alias("end_ts"))
    running = timed.filter(F.col("flight_status") == P.SCHEDULED)
    # dealt out by flight once; copies go and times come where the lines are
    links = (scan(spark, sf, "lineitem", ["l_orderkey", "l_suppkey", "l_partkey"]).withColumnRenamed("l_orderkey", "flight_id")
             .join(running.select("flight_id"), "flight_id", "left_semi")
             .select("flight_id", F.inline(F.array(
                 F.struct(F.lit("crew").alias("role"), F.col("l_suppkey").alias("member")),
                 F.struct(F.lit("plane").alias("role"), F.col("l_partkey").alias("member"))))).distinct())
    busy = measured(links.join(running, "flight_id").select("role", "member", "start_ts", "end_ts"), "busy")
    pool = scan(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).select(
        F.lit("crew").alias("role"), F.col("s_suppkey").alias("member"), (F.col("s_acctbal") > 0).alias("fit")).unionByName(
        scan(spark, sf, "part", ["p_partkey", "p_type"]).select(
            F.lit("plane").alias("role"), F.col("p_partkey").alias("member"), (F.col("p_type") == "LARGE").alias("fit")))
    demand = candidates.crew_demand(timed.filter(F.col("flight_status") == P.FULL),
                                    {"long": {"crew": 3}, "short": {"crew": 2}})
    return candidates.shortlist(demand, candidates.loads(pool, busy), busy)


@query("schedule_violations", """
WITH new AS (
  SELECT o_orderkey AS flight_id, o_custkey AS route_id, o_orderkey % 250 AS plane_id,
         o_orderkey % 12 AS manager_id, o_orderstatus AS code
  FROM orders WHERE o_orderpriority = '1-URGENT'),
link AS (SELECT DISTINCT flight_id, l_suppkey, l_linenumber <= 2 AS pilot
         FROM new JOIN lineitem ON l_orderkey = flight_id)
SELECT flight_id, 'flight id is taken' AS rule, CAST(flight_id AS VARCHAR) AS subject
FROM new WHERE flight_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0)
UNION ALL SELECT flight_id, 'flight is not open', 'Completed' FROM new WHERE code = 'F'
UNION ALL SELECT flight_id, 'unknown route', CAST(route_id AS VARCHAR) FROM new
WHERE route_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT flight_id, 'unknown plane', CAST(plane_id AS VARCHAR) FROM new
WHERE plane_id NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT flight_id, 'unknown manager', CAST(manager_id AS VARCHAR) FROM new
WHERE manager_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT flight_id, CASE WHEN pilot THEN 'unknown pilot' ELSE 'unknown attendant' END,
       CAST(l_suppkey AS VARCHAR) FROM link
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def schedule_violations(spark, sf):
    """Urgent orders are proposals; customers, parts and suppliers are what they refer to."""
    urgent = flights(spark, sf).filter(F.col("priority") == "1-URGENT")
    new = urgent.select("flight_id", F.col("owner").alias("route_id"), (F.col("flight_id") % 250).alias("plane_id"),
                        (F.col("flight_id") % 12).alias("manager_id"), "flight_status")
    suppliers = scan(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).withColumnRenamed("s_suppkey", "employee_id")
    crew = (scan(spark, sf, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber"])
            .select(F.col("l_orderkey").alias("flight_id"), F.col("l_suppkey").alias("employee_id"),
                    (F.col("l_linenumber") <= 2).alias("pilot")).distinct()
            .join(new.select("flight_id"), "flight_id", "left_semi"))
    fit = suppliers.filter(F.col("s_acctbal") > 0)
    return C.reference_violations(
        new, new.filter(F.col("flight_id") % 7 == 0),
        scan(spark, sf, "customer", ["c_custkey", "c_acctbal"]).filter(F.col("c_acctbal") > 0)
        .withColumnRenamed("c_custkey", "route_id"),
        scan(spark, sf, "part", ["p_partkey"]).withColumnRenamed("p_partkey", "plane_id"), suppliers,
        {"pilot": fit, "attendant": fit},
        {"pilot": crew.filter("pilot").drop("pilot"), "attendant": crew.filter(~F.col("pilot")).drop("pilot")})


@query("missing_prices", f"""
WITH {CABIN}
SELECT plane_id, class_type FROM cabin
EXCEPT SELECT p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_quantity >= 50 AND l_discount >= 0.1""")
def missing_prices(spark, sf):
    """A cabin counts as priced when a line of 50 pieces or more got 10 % off."""
    priced = (scan(spark, sf, "lineitem", ["l_partkey", "l_quantity", "l_discount"])
              .filter((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1))
              .select("l_partkey").distinct()
              .join(scan(spark, sf, "part", ["p_partkey", "p_brand", "p_type"]),
                    F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("p_brand").alias("plane_id"), F.col("p_type").alias("class_type")))
    return C.missing_prices(cabins(spark, sf).select("plane_id", "class_type"), priced)


# --- data quality -----------------------------------------------------------

def _row(table: str, rule: str, sql: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, ({sql}) AS bad_rows"


def _rows(*rows: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(_row(*r) for r in rows)


def _bad(table: str, condition: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE NOT ({condition})"


@query("dq_unique", _rows(
    ("lineitem", "unique(l_orderkey,l_linenumber)",
     "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber "
     "HAVING count(*) > 1)"),
    ("orders", "unique(o_orderkey)",
     "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)")))
def dq_unique(spark, sf):
    return Q.union_all([
        Q.check_unique(scan(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]),
                       ["l_orderkey", "l_linenumber"], "lineitem"),
        Q.check_unique(scan(spark, sf, "orders", ["o_orderkey"]), ["o_orderkey"], "orders")])


@query("dq_foreign_key", _rows(
    ("lineitem", "fk(l_orderkey->orders)",
     "SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey"),
    ("orders", "fk(o_orderkey->lineitem)",
     "SELECT count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey"),
    ("lineitem", "fk(l_orderkey,l_linestatus->orders)",
     "SELECT count(*) FROM lineitem ANTI JOIN orders "
     "ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")))
def dq_foreign_key(spark, sf):
    # one fold of the fact feeds all three checks: its exchange is read twice
    lines = (scan(spark, sf, "lineitem", ["l_orderkey", "l_linestatus"])
             .groupBy("l_orderkey", "l_linestatus").agg(F.count(F.lit(1)).alias("rows")))
    orders = scan(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    return Q.union_all([
        Q.check_fk_both(lines, ["l_orderkey"], orders, ["o_orderkey"], "lineitem", "orders", "rows"),
        Q.check_fk(lines, ["l_orderkey", "l_linestatus"], orders, ["o_orderkey", "o_orderstatus"],
                   "lineitem", "orders", "rows")])


@query("dq_check", _rows(
    ("lineitem", "positive_quantity", _bad("lineitem", "l_quantity > 0")),
    ("lineitem", "shipped_since", _bad("lineitem", "l_shipdate >= TIMESTAMP '1995-06-01'")),
    ("orders", "total_above", _bad("orders", "o_totalprice > 5000"))))
def dq_check(spark, sf):
    since = F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00"))
    return Q.check_rules(
        scan(spark, sf, "lineitem", ["l_quantity", "l_shipdate"]),
        {"positive_quantity": F.col("l_quantity") > 0, "shipped_since": F.col("l_shipdate") >= since},
        "lineitem").unionByName(Q.check_rules(
            scan(spark, sf, "orders", ["o_totalprice"]),
            {"total_above": F.col("o_totalprice") > 5000}, "orders"))


@query("dq_domain", _rows(
    ("orders", "domain(o_orderpriority)",
     _bad("orders", "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")),
    ("orders", "length(o_orderpriority)", _bad("orders", "length(o_orderpriority) <= 8")),
    ("orders", "not_null(o_custkey)", _bad("orders", "o_custkey IS NOT NULL"))))
def dq_domain(spark, sf):
    values = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    return Q.check_rules(scan(spark, sf, "orders", ["o_orderpriority", "o_custkey"]),
                         Q.domain("o_orderpriority", values, 8) | Q.required("o_custkey"), "orders")


@query("dq_xor_owner", _rows(
    ("owners", "exactly_one(s_name,c_name)",
     "SELECT count(*) FROM supplier FULL JOIN customer ON s_suppkey = c_custkey "
     "WHERE (s_name IS NULL) = (c_name IS NULL)")))
def dq_xor_owner(spark, sf):
    owners = scan(spark, sf, "supplier", ["s_suppkey", "s_name"]).join(
        scan(spark, sf, "customer", ["c_custkey", "c_name"]),
        F.col("s_suppkey") == F.col("c_custkey"), "full")
    return Q.check_rules(owners, Q.exactly_one("s_name", "c_name"), "owners")


@query("dq_contact", _rows(
    ("customer", "phone(digits)",
     _bad("customer", "regexp_full_match(substr(c_name, 10), '[0-9-]+')")),
    ("customer", "phone(c_name)", _bad("customer", "regexp_full_match(c_name, '[0-9-]+')")),
    ("customer", "staff_id(digits)",
     _bad("customer", "regexp_full_match(substr(c_name, 10), '[0-9]{9}')")),
    ("customer", "staff_id(c_mktsegment)",
     _bad("customer", "regexp_full_match(c_mktsegment, '[0-9]{9}')")),
    ("customer", "required(c_mktsegment)", _bad("customer", "length(trim(c_mktsegment)) > 0")),
    ("customer", "positive(c_nationkey)", _bad("customer", "c_nationkey > 0")),
    ("orders", "day(o_day)", _bad("orders", f"o_orderdate <= TIMESTAMP '{AS_OF}'")),
    ("orders", "day(o_orderpriority)", "SELECT count(*) FROM orders")))
def dq_contact(spark, sf):
    people = scan(spark, sf, "customer", ["c_name", "c_mktsegment", "c_nationkey"]).withColumn(
        "digits", F.expr("substring(c_name, 10)"))
    orders = scan(spark, sf, "orders", ["o_orderdate", "o_orderpriority"]).withColumn(
        "o_day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return Q.check_rules(
        people, Q.contact_rules(AS_OF, phones=("digits", "c_name"),
                                staff_ids=("digits", "c_mktsegment"), needed=("c_mktsegment",),
                                positive=("c_nationkey",)), "customer").unionByName(
        Q.check_rules(orders, Q.contact_rules(AS_OF, days=("o_day", "o_orderpriority")), "orders"))


@query("dq_cross_table", _rows(
    ("customer+supplier", "disjoint(key)",
     "SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT "
     "SELECT s_suppkey FROM supplier)")))
def dq_cross_table(spark, sf):
    return Q.check_disjoint({
        "customer": scan(spark, sf, "customer", ["c_custkey"]).toDF("key"),
        "supplier": scan(spark, sf, "supplier", ["s_suppkey"]).toDF("key")}, "key")


@query("dq_layout", f"""
WITH {CABIN}, roomy AS (SELECT plane_id, class_type, rows_num FROM cabin)
SELECT 'cabin_class' AS table_name, 'rows_at_least_40' AS rule,
       (SELECT count(*) FROM roomy WHERE rows_num < 40) AS bad_rows
UNION ALL SELECT 'cabin_class', 'rows_positive', (SELECT count(*) FROM roomy WHERE rows_num <= 0)
UNION ALL SELECT 'cabin_class', 'columns_positive', 0
UNION ALL SELECT 'plane', 'large_needs_business', (
  SELECT count(*) FROM (SELECT DISTINCT plane_id FROM cabin) p
  WHERE plane_id NOT IN (SELECT plane_id FROM cabin
                         WHERE class_type = 'STANDARD' AND rows_num >= 50))""")
def dq_layout(spark, sf):
    """Every brand is a large plane; a STANDARD cabin of 50 rows or more is its Business."""
    layout = cabins(spark, sf)
    planes = layout.select("plane_id", F.lit("Large").alias("plane_size")).distinct()
    business = (F.col("class_type") == "STANDARD") & (F.col("rows_num") >= 50)
    named = layout.withColumn("class_type", F.when(business, "Business").otherwise("Economy"))
    return Q.check_rules(layout, {"rows_at_least_40": F.col("rows_num") >= 40},
                         "cabin_class").unionByName(Q.check_layout(planes, named))
