"""Whole flows put together from the operators.

Each takes the sixteen tables (a dict of DataFrames) and an ``as_of`` and stays
one lazy plan per result, except where a checkpoint is needed (seat claims work
in rounds; the violations of a schedule are used three times).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.scalars import clean_email, moment, percent, plus_minutes
from tarmaq.operators.relations import exists_in, not_existing, replace_children, upsert
from tarmaq.plans import claims, datasets, reports, scheduling, seating, transitions
from tarmaq.session import cut_lineage

Tables = dict[str, DataFrame]


def dashboard(t: Tables, as_of: str) -> Tables:
    """All management reports after the status refresh, each in display order."""
    flights = transitions.refresh_status(t["flight"], as_of)
    tally = reports.seat_tally(t["seat"], t["orders"])
    occupancy = tally.select("flight_id", percent(F.col("kept"), F.col("seats"), 12)
                             .alias("occupancy_pct"))
    staff = t["pilot"].select("employee_id").unionByName(t["attendant"].select("employee_id"))
    links = t["pilot_flight"].unionByName(t["attendant_flight"])
    lines = reports.priced_lines(t["seat"], t["orders"], flights, t["plane"], t["pricing"])
    return {
        "kpi_counts": reports.kpi_counts(
            {"planes": t["plane"], "routes": t["route"], "flights": flights}),
        "average_occupancy": reports.average_occupancy(flights, tally),
        "revenue_by_class": reports.revenue_by_class(lines).orderBy(
            "plane_size", "plane_manufacturer", "class_type"),
        "staff_hours": reports.staff_hours(
            staff, links, reports.completed_minutes(flights, t["route"])).orderBy(
            F.desc("total_hours"), "employee_id"),
        "cancel_rate_by_month": reports.cancel_rate_by_month(t["orders"]).orderBy("purchase_month"),
        "fleet_monthly": reports.fleet_monthly(flights, t["route"], occupancy, as_of).orderBy(
            "plane_id", "month"),
        "completed_by_month": reports.completed_by_month(flights).orderBy("month"),
        "top_routes": reports.top_routes(reports.completed_per_route(flights, t["route"])),
        "flights_by_hour": reports.flights_by_hour(flights, as_of).orderBy("takeoff_hour"),
    }


def refresh(t: Tables, as_of: str) -> Tables:
    """The time-driven changes: holds lapse, flights complete or fill, orders complete."""
    orders, seats = transitions.expire_holds(t["orders"], t["seat"], as_of)
    flown = transitions.refresh_status(t["flight"], as_of)
    flights = transitions.derive_full(flown, reports.seat_tally(seats, orders))
    return {"flight": flights, "seat": seats,
            "orders": transitions.derive_order_completed(orders, flights)}


def book(t: Tables, requests: DataFrame, payments: DataFrame, as_of: str,
         guests: DataFrame | None = None) -> Tables:
    """Requests become pending orders, paid ones active; the rest is void.

    ``requests``: order_id, flight_id, guest_email, reg_customer_email, s_row,
    s_column, requested_ts, a row per seat (class_type too, if it is to be
    checked). ``payments``: order_id, paid_at. Payments of standing orders come
    first, then what is still pending and older than the limit lapses; a seat is
    free from the moment its hold lapsed. Requests whose order_id is taken are
    returned as they came (rejected_requests). ``guests`` (order_id,
    customer_email, customer_first_name, customer_last_name, customer_phone, a
    row per phone) are saved for the orders that were paid in this run.
    """
    paid, unused = transitions.confirm_payment(t["orders"], payments, P.HOLD_MINUTES)
    standing = cut_lineage(paid)
    lapsed = standing.filter(transitions.is_expired(as_of)).select(
        "order_id", plus_minutes("date_of_purchase", P.HOLD_MINUTES).alias("_until"))
    orders, seats = transitions.expire_holds(standing, t["seat"], as_of)
    freed = (t["seat"].filter(F.col("order_id").isNotNull()).join(lapsed, "order_id")
             .select(*claims.SEAT, F.col("_until").alias("free_from")))
    fresh = not_existing(requests, t["orders"], ["order_id"])
    decided = claims.claim_all_or_nothing(fresh, seats.join(freed, claims.SEAT, "left"))
    asked = fresh.groupBy("order_id", "flight_id").agg(
        F.any_value("guest_email").alias("guest_email"),
        F.any_value("reg_customer_email").alias("reg_customer_email"),
        F.min("requested_ts").alias("date_of_purchase"))
    placed = (asked.join(decided.select("order_id", "accepted"), "order_id")
              .withColumn("order_status", F.when(F.col("accepted"), P.PENDING)
                          .otherwise(P.BY_SYSTEM)).select(*orders.columns))
    new, rejected = transitions.confirm_payment(placed, unused, P.HOLD_MINUTES)
    booked = orders.unionByName(new)
    after = {"orders": booked, "seat": claims.apply_claims(seats, fresh, decided),
             "rejected_payments": rejected,
             "rejected_requests": exists_in(requests, t["orders"], ["order_id"])}
    if guests is not None:
        was = t["orders"].filter(F.col("order_status") == P.ACTIVE)
        now = not_existing(booked.filter(F.col("order_status") == P.ACTIVE), was, ["order_id"])
        after |= save_guests(t["guest"], t["guest_phone"], exists_in(guests, now, ["order_id"]))
    return after


def summaries(t: Tables) -> DataFrame:
    """Order summaries (route, landing, seats, total) of all orders."""
    routed = t["flight"].join(t["route"], "route_id").drop("flight_status")
    return datasets.order_summary(t["orders"], routed,
                                  datasets.order_lines(t["seat"], t["pricing"]))


def save_guests(guests: DataFrame, phones: DataFrame, updates: DataFrame) -> Tables:
    """Guests are inserted or their names overwritten; their phones are replaced.

    ``updates``: customer_email, names and customer_phone, a row per phone.
    """
    numbers = updates.filter(F.col("customer_phone").isNotNull()).select(*phones.columns).distinct()
    return {"guest": upsert(guests, updates.select(*guests.columns).distinct(), ["customer_email"]),
            "guest_phone": replace_children(phones, numbers, "customer_email")}


def schedule(t: Tables, proposals: Tables) -> Tables:
    """Check proposed flights against the schedule; accept those without a violation.

    ``proposals`` holds flight, pricing, pilot_flight and attendant_flight rows.
    All violations of all proposals come back at once. Of the standing schedule
    only what the proposals' planes and crews serve is looked at.
    """
    new, ids = proposals["flight"], proposals["flight"].select("flight_id").distinct()
    standing = not_existing(t["flight"], ids, ["flight_id"])
    links = {name: not_existing(exists_in(t[name], proposals[name], ["employee_id"]), ids, ["flight_id"])
             for name in ("pilot_flight", "attendant_flight")}
    involved = (exists_in(standing, new, ["plane_id"]).select("flight_id")
                .unionByName(links["pilot_flight"].select("flight_id"))
                .unionByName(links["attendant_flight"].select("flight_id")))
    flights = exists_in(standing, involved, ["flight_id"]).unionByName(new)
    crews = {name: links[name].unionByName(proposals[name]) for name in links}
    found = scheduling.schedule_violations(
        scheduling.timed(flights, t["route"]), t["plane"], t["cabin_class"],
        exists_in(t["pricing"], involved, ["flight_id"]).unionByName(proposals["pricing"]),
        t["pilot"], t["attendant"], crews["pilot_flight"], crews["attendant_flight"])
    missing = scheduling.reference_violations(
        new, t["flight"], t["route"], t["plane"], t["manager"],
        {"pilot": t["pilot"], "attendant": t["attendant"]},
        {"pilot": proposals["pilot_flight"], "attendant": proposals["attendant_flight"]})
    # Written once: the accepted flights and their seats depend on it as well.
    violations = cut_lineage(found.join(ids, "flight_id", "left_semi").unionByName(missing).distinct())
    accepted = not_existing(new, violations, ["flight_id"])
    return {"violations": violations, "flight": accepted,
            "seat": seating.seats_from_layout(accepted, t["cabin_class"], t["seat"])}


def cancel_orders(t: Tables, requests: DataFrame, as_of: str) -> Tables:
    """Customers cancel their orders (order_id, email): decisions and new tables.

    A request counts when the e-mail is the order's owner, whatever its case;
    an order that is not there, or another's, is not_found. Only the seats of
    the requested orders are priced.
    """
    flights = transitions.refresh_status(t["flight"], as_of)
    asked = requests.select("order_id", clean_email("email").alias("_email")).distinct()
    owner = clean_email(F.coalesce("guest_email", "reg_customer_email"))
    mine = t["orders"].join(asked, "order_id").filter(owner == F.col("_email"))
    timed = mine.join(flights.select("flight_id", "takeoff_ts"), "flight_id")
    lines = datasets.order_lines(exists_in(t["seat"], asked, ["order_id"]), t["pricing"])
    decided = transitions.cancel_decisions(datasets.order_totals(timed, lines), as_of).select(
        "order_id", "decision", "total", "fee", "refund")
    orders, seats = transitions.apply_customer_cancel(t["orders"], t["seat"], decided)
    nothing = [F.lit(0).cast(decided.schema[c].dataType).alias(c) for c in ("total", "fee", "refund")]
    lost = not_existing(requests.select("order_id").distinct(), decided, ["order_id"]).select(
        "order_id", F.lit("not_found").alias("decision"), *nothing)
    return {"decisions": decided.unionByName(lost), "orders": orders, "seat": seats}


def cancel_requests(t: Tables, requests: DataFrame, as_of: str) -> Tables:
    """Flight cancellations asked for by managers: decisions, refunds, new tables.

    Only the seats and orders of the cancelled flights are priced.
    """
    flights = transitions.refresh_status(t["flight"], as_of)
    decided = transitions.flight_cancel_decisions(requests, flights, as_of)
    gone = transitions.cancelled_flights(decided)
    touched = exists_in(t["orders"], gone, ["flight_id"])
    totals = datasets.order_totals(touched.select("order_id"), datasets.order_lines(
        exists_in(t["seat"], gone, ["flight_id"]), t["pricing"]))
    new_flights, orders, seats = transitions.cancel_flights(gone, flights, t["orders"], t["seat"])
    return {"decisions": decided, "flight": new_flights, "orders": orders, "seat": seats,
            "refunds": transitions.flight_cancel_refunds(gone, touched, totals)}


def sale_fact(t: Tables, as_of: str) -> DataFrame:
    """Sale lines to keep before seats are released, stamped with the time."""
    return reports.order_line_fact(t["seat"], t["pricing"]).withColumn("as_of", moment(as_of))
