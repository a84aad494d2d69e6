"""Checks over a whole proposed schedule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.scalars import moment, plus_minutes
from tarmaq.operators.intervals import first_clash, self_clash_counts


def is_long(minutes: Column | str = "minutes", limit: int = P.LONG_FLIGHT_MINUTES) -> Column:
    return (F.col(minutes) if isinstance(minutes, str) else minutes) >= limit


def flight_length(flights: DataFrame, limit: int = P.LONG_FLIGHT_MINUTES) -> DataFrame:
    return flights.withColumn("length", F.when(is_long(limit=limit), "long").otherwise("short"))


def timed(flights: DataFrame, routes: DataFrame) -> DataFrame:
    """Flights with minutes, start_ts and end_ts (NULL where the route is unknown)."""
    return (flights.join(routes.select("route_id", F.col("flight_duration").alias("minutes")),
                         "route_id", "left")
            .withColumns({"start_ts": F.col("takeoff_ts"),
                          "end_ts": plus_minutes("takeoff_ts", F.col("minutes"))}))


def open_flights(flights: DataFrame) -> DataFrame:
    """Only scheduled and full flights occupy planes and crew."""
    return flights.filter(F.col("flight_status").isin(*P.OPEN_FLIGHT))


def check_assignments(links: DataFrame, flights: DataFrame, pool: DataFrame, member: list[str],
                      qualified: str) -> DataFrame:
    """Whether each linked crew member (or plane) may serve its flight.

    Long flights need a qualified member (trained crew, a large plane), and the
    member must not serve another open flight at the same time. A member that is
    not in the pool is not ``known`` and may not serve. ``flights``: flight_id,
    minutes, start_ts, end_ts, open flights only; links of other flights, and of
    flights without times, are not looked at. ``member`` are the columns that
    identify a member in ``links`` and ``pool``.
    """
    served = links.join(flights.filter(F.col("end_ts").isNotNull())
                        .select("flight_id", "minutes", "start_ts", "end_ts"), "flight_id")
    counted = self_clash_counts(served, member, "start_ts", "end_ts", "flight_id",
                                keep=("minutes",))
    known = pool.select(*member, F.col(qualified).alias("_qualified"), F.lit(True).alias("_known"))
    return (counted.join(known, member, "left")
            .withColumn("known", F.coalesce("_known", F.lit(False)))
            .withColumn("qualified", F.col("known") & (~is_long() | F.coalesce("_qualified", F.lit(False))))
            .withColumn("eligible", F.col("qualified") & (F.col("clashes") == 0))
            .select("flight_id", *member, "known", "qualified", "clashes", "eligible"))


def available_for(pool: DataFrame, links: DataFrame, flights: DataFrame, member: str,
                  qualified: str, start: str, minutes: int) -> DataFrame:
    """The members that could serve one new flight: qualified and not busy then."""
    begins = moment(start)
    busy = (open_flights(flights)
            .filter((F.col("start_ts") < plus_minutes(begins, minutes))
                    & (F.col("end_ts") > begins))
            .select("flight_id").join(links, "flight_id").select(member).distinct())
    fit = pool.filter(F.col(qualified)) if minutes >= P.LONG_FLIGHT_MINUTES else pool
    return fit.join(busy, member, "left_anti")


def vehicle_clashes(flights: DataFrame, vehicle: str = "plane_id") -> DataFrame:
    """First clashing open flight of the same plane, for every open flight."""
    return first_clash(open_flights(flights), [vehicle], "start_ts", "end_ts", "flight_id")


def crew_size_violations(flights: DataFrame, links: DataFrame,
                         rules: dict[str, dict[str, int]] = P.CREW_RULES) -> DataFrame:
    """Flights whose head count per role differs from the rule (none counts as 0).

    ``flights``: flight_id, minutes ; ``links``: flight_id, role, employee_id.
    """
    heads = (links.groupBy("flight_id")
             .agg(*[F.count_distinct(F.when(F.col("role") == role, F.col("employee_id")))
                    .alias(role) for role in rules["long"]]))
    sized = flight_length(flights.select("flight_id", "minutes")).join(heads, "flight_id", "left")
    rows = F.array(*[
        F.struct(F.lit(role).alias("role"),
                 F.coalesce(F.col(role), F.lit(0)).alias("assigned"),
                 F.when(F.col("length") == "long", rules["long"][role])
                 .otherwise(rules["short"][role]).cast("bigint").alias("required"))
        for role in rules["long"]])
    return (sized.select("flight_id", "length", F.inline(rows))
            .filter(F.col("assigned") != F.col("required")))


def missing_prices(cabins: DataFrame, prices: DataFrame,
                   keys: tuple[str, ...] = ("plane_id", "class_type")) -> DataFrame:
    """Cabins that are to be sold but have no price."""
    return cabins.join(prices.select(*keys).distinct(), list(keys), "left_anti")


def planes_without_economy(planes: DataFrame, cabins: DataFrame) -> DataFrame:
    economy = cabins.filter(F.col("class_type") == "Economy").select("plane_id").distinct()
    return planes.join(economy, "plane_id", "left_anti")


def schedule_violations(flights: DataFrame, planes: DataFrame, cabins: DataFrame,
                        prices: DataFrame, pilots: DataFrame, attendants: DataFrame,
                        pilot_links: DataFrame, attendant_links: DataFrame) -> DataFrame:
    """Every broken scheduling rule of the open flights: (flight_id, rule, subject).

    ``flights`` are timed flights (see ``timed``).
    """
    running = open_flights(flights)

    def members(df, role, ident, *columns):
        return df.select(F.lit(role).alias("role"), F.col(ident).alias("member"), *columns)

    # Planes and crews are checked in one sweep, keyed by role and member.
    trained = F.col("long_flight_training").alias("fit")
    pool = (members(planes, "plane", "plane_id", (F.col("plane_size") == "Large").alias("fit"))
            .unionByName(members(pilots, "pilot", "employee_id", trained))
            .unionByName(members(attendants, "attendant", "employee_id", trained)))
    crew = (members(pilot_links, "pilot", "employee_id", "flight_id")
            .unionByName(members(attendant_links, "attendant", "employee_id", "flight_id")))
    links = crew.unionByName(members(running, "plane", "plane_id", "flight_id"))
    checked = check_assignments(links, running, pool, ["role", "member"], "fit")
    broken = F.array(
        F.when(F.col("known") & ~F.col("qualified"), F.concat("role", F.lit(" not fit for a long flight"))),
        F.when(F.col("clashes") > 0, F.concat("role", F.lit(" has an overlapping flight"))))
    assigned = (checked.select("flight_id", F.explode(F.array_compact(broken)).alias("rule"),
                               F.col("member").alias("subject")))

    heads = crew_size_violations(running, crew.withColumnRenamed("member", "employee_id"))
    sold = running.select("flight_id", "plane_id").join(cabins, "plane_id")
    unpriced = missing_prices(sold, prices, ("flight_id", "plane_id", "class_type"))
    bare = running.join(planes_without_economy(planes, cabins).select("plane_id"), "plane_id",
                        "left_semi")

    def rule(df, name, subject):
        return df.select("flight_id", F.lit(name).alias("rule"), F.col(subject).alias("subject"))

    return (assigned.unionByName(rule(heads, "crew size", "role"))
            .unionByName(rule(unpriced, "cabin without a price", "class_type"))
            .unionByName(rule(bare, "plane without Economy", "plane_id")))


def reference_violations(new: DataFrame, existing: DataFrame, routes: DataFrame, planes: DataFrame,
                         managers: DataFrame, pools: dict[str, DataFrame],
                         links: dict[str, DataFrame]) -> DataFrame:
    """What proposed flights refer to and is not there: (flight_id, rule, subject).

    A flight_id that is taken, or proposed twice; a status that is not open; an
    unknown route, plane, manager or (per role of ``pools`` and ``links``) crew
    member. A NULL reference is unknown.
    """
    def rule(df, name, subject):
        return df.select("flight_id", F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject"))

    def unknown(df, known, column, name):
        return rule(df.join(known.select(column).distinct(), column, "left_anti"), name, column)

    twice = new.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    closed = new.filter(~F.coalesce(F.col("flight_status").isin(*P.OPEN_FLIGHT), F.lit(False)))
    found = [rule(new.join(existing.select("flight_id").distinct(), "flight_id", "left_semi"),
                  "flight id is taken", "flight_id"),
             rule(twice, "flight id is proposed twice", "flight_id"),
             rule(closed, "flight is not open", "flight_status"),
             unknown(new, routes, "route_id", "unknown route"),
             unknown(new, planes, "plane_id", "unknown plane"),
             unknown(new, managers.select(F.col("employee_id").alias("manager_id")), "manager_id",
                     "unknown manager")]
    found += [unknown(links[role], pool, "employee_id", f"unknown {role}") for role, pool in pools.items()]
    return reduce(DataFrame.unionByName, found)
