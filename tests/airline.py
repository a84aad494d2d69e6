"""Airline fixture tables.

Fixed values: planes, routes, flights and prices are inputs of the golden
results. Orders, seats and crews follow from the booking rules below. People
are neutral placeholders.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from tarmaq.plans.seating import seats_from_layout
from tarmaq.schemas import schema_of

AS_OF = "2026-02-01 00:00:00"

# plane size maker bought ; cabins as class rows x columns
PLANES = """
P0001 Large Boeing   2018-05-01 Business 8x4 Economy 6x6
P0002 Large Airbus   2019-09-12 Business 5x4 Economy 7x6
P0003 Small Dassault 2021-03-25 Economy 10x4
P0004 Large Dassault 2017-11-03 Business 8x4 Economy 6x6
P0005 Small Airbus   2025-06-18 Economy 9x4
P0006 Large Airbus   2020-01-20 Business 4x5 Economy 8x6
"""

# route origin destination minutes
ROUTES = """
101 TLV ATH 120
102 TLV FCO 180
103 TLV DXB 190
104 ATH FCO 105
105 FCO CDG 110
106 CDG BER 105
107 BER FCO 120
108 BER JFK 510
109 JFK DXB 840
110 DXB SYD 1200
111 SYD AKL 190
112 AKL DXB 1020
113 DXB CDG 420
114 FCO TLV 180
"""

# flight route plane manager takeoff status | economy price, business price |
# orders, first row, seats per order (0: the whole row), order status, rows void
FLIGHTS = """
F1001 102 P0003 M1 2025-08-05T07:30 Completed | 450      |  5 1 3 Completed 4
F1002 105 P0003 M1 2025-08-06T12:00 Completed | 520      |  5 1 3 Completed 4
F1003 106 P0003 M1 2025-09-11T09:00 Full      | 480      | 10 1 4 Completed
F1004 107 P0003 M1 2025-09-15T10:20 Completed | 500      |  5 1 3 Completed 4
F1005 101 P0005 M2 2026-02-01T06:50 Scheduled | 400      |  4 1 4 Active 3
F1006 104 P0005 M2 2026-02-03T10:00 Scheduled | 420      |  4 1 4 Active
F1007 104 P0005 M2 2026-02-22T09:30 Scheduled | 430      |  4 1 4 Active
F1008 105 P0005 M2 2026-02-25T08:40 Scheduled | 510      |  4 1 4 Completed 3
F1009 106 P0002 M3 2025-11-03T09:10 Completed | 480 1200 |  8 5 3 Completed
F1010 108 P0002 M3 2025-11-04T11:45 Completed | 950 2200 |  8 1 3 Completed 6 8
F1011 109 P0002 M3 2025-11-07T14:00 Full      | 1100 2600 | 12 1 0 Completed
F1012 113 P0002 M3 2025-11-10T09:00 Completed | 600 1400 |  8 1 3 Completed 6
F1013 106 P0002 M3 2025-11-12T07:10 Completed | 500 1250 |  8 1 3 Completed
F1014 108 P0002 M3 2025-11-14T15:20 Cancelled | 980 2300 |  5 1 3 System
F1015 102 P0004 M2 2025-10-02T07:20 Completed | 460 1150 |  8 1 4 Completed 5 7
F1016 105 P0004 M2 2025-10-06T11:45 Completed | 520 1350 |  8 1 4 Completed
F1017 106 P0004 M3 2025-10-19T09:00 Full      | 500 1250 | 14 1 0 Completed
F1018 108 P0004 M3 2025-10-21T12:30 Completed | 990 2400 |  7 1 4 Completed
F1019 106 P0001 M1 2026-03-08T09:10 Scheduled | 520 1300 |  7 1 4 Active 5
F1020 108 P0001 M1 2026-03-09T13:00 Scheduled | 980 2300 |  7 1 4 Active
F1021 109 P0001 M1 2026-03-12T15:20 Cancelled | 1050 2500 |  5 1 3 System
F1022 109 P0001 M1 2026-03-15T08:50 Full      | 1100 2700 | 14 1 0 Completed
F1023 103 P0006 M3 2026-01-10T07:00 Completed | 600 1500 |  4 1 3 Completed
F1024 110 P0006 M3 2026-01-12T22:30 Completed | 1200 2900 |  4 1 3 Completed 3
F1025 111 P0006 M3 2026-01-14T09:00 Full      | 700 1800 | 14 1 0 Completed
F1026 112 P0006 M3 2026-01-17T11:40 Completed | 1000 2400 |  7 1 3 Completed
F1027 110 P0006 M3 2026-01-21T22:30 Completed | 1250 3000 |  7 1 3 Completed
F1028 114 P0003 M1 2025-09-20T08:30 Completed | 520      |  4 1 3 Completed
F1029 109 P0004 M2 2025-10-23T07:50 Completed | 1150 2700 |  4 1 3 Completed
F1030 113 P0004 M2 2025-10-25T16:45 Completed |          |  4 1 3 Completed 4
F1031 111 P0006 M3 2026-02-05T18:55 Scheduled | 700 1750 |  4 1 3 Active
F1032 112 P0006 M3 2026-02-07T09:00 Scheduled | 1250 3000 |  4 1 3 Active
F1033 113 P0004 M2 2026-02-25T16:45 Scheduled | 1000 2450 |  4 1 3 Active
"""

# Purchases per month and final status.
PURCHASES = {
    "Completed": {"2025-03": 2, "2025-04": 1, "2025-05": 2, "2025-06": 10, "2025-07": 76,
                  "2025-08": 40, "2025-09": 30},
    "Active": {"2025-04": 2, "2025-06": 9, "2025-07": 9, "2025-08": 4, "2025-10": 12},
    "Cancelled by customer": {"2025-04": 1, "2025-05": 1, "2025-06": 3, "2025-07": 6,
                              "2025-08": 1, "2025-10": 1},
    "Cancelled by system": {"2025-07": 5, "2025-08": 5},
}

# Crews: planes -> (pilots, attendants, trained); the idle ones serve nothing.
CREWS = {"small": (2, 3, False), "large": (3, 6, True), "far": (3, 6, True)}
IDLE = (2, 5)


def lines(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def _flights():
    for line in FLIGHTS.strip().splitlines():
        head, price, booked = (part.split() for part in line.split("|"))
        yield head, [Decimal(p) for p in price], booked


def _crew_of(head: list[str]) -> str:
    if head[2] in ("P0003", "P0005"):
        return "small"
    return "far" if head[2] in ("P0001", "P0006") or head[0] == "F1033" else "large"


def _crew(role: str) -> dict[str, list[str]]:
    place = {"pilot": 0, "attendant": 1}[role]
    letter = role[0].upper()
    members = {name: [f"{letter}{name}{i}" for i in range(rule[place])]
               for name, rule in CREWS.items()}
    members["idle"] = [f"{letter}idle{i}" for i in range(IDLE[place])]
    return members


def _staff(ident: str) -> tuple:
    return (ident, "First", "Last", "000-000001", "City", "Street", 1, date(2020, 1, 1))


def raw() -> dict[str, list[tuple]]:
    data: dict[str, list[tuple]] = {name: [] for name in (
        "plane", "cabin_class", "route", "flight", "pricing", "orders", "pilot", "attendant",
        "pilot_flight", "attendant_flight", "manager", "guest", "guest_phone",
        "registered_customer", "registered_customer_phone")}
    cabins = {}
    for plane, size, maker, bought, *layout in lines(PLANES):
        data["plane"].append((plane, size, maker, date.fromisoformat(bought)))
        for name, shape in zip(layout[::2], layout[1::2]):
            rows, columns = map(int, shape.split("x"))
            cabins.setdefault(plane, {})[name] = (rows, columns)
            data["cabin_class"].append((plane, name, columns, rows))
    for ident, origin, destination, minutes in lines(ROUTES):
        data["route"].append((int(ident), origin, destination, int(minutes)))
    for i in range(20):
        data["guest"].append((f"g{i:03d}@example.org", "Guest", str(i)))
        data["guest_phone"].append((f"g{i:03d}@example.org", f"00000{i:04d}"))
        data["registered_customer"].append((f"m{i:03d}@example.org", "Member", str(i), f"X{i:05d}",
                                            date(1990, 1, 1), date(2025, 1, 1)))
        data["registered_customer_phone"].append((f"m{i:03d}@example.org", f"11111{i:04d}"))
    data["manager"] = [_staff(m) for m in ("M1", "M2", "M3")]
    for role in ("pilot", "attendant"):
        for name, members in _crew(role).items():
            for i, ident in enumerate(members):
                trained = CREWS[name][2] if name in CREWS else (role == "pilot" and i == 0)
                data[role].append((*_staff(ident), trained))

    held = []  # (flight, row, column, order)
    months = {s: [m for m, n in spread.items() for _ in range(n)]
              for s, spread in PURCHASES.items()}
    names = {"System": "Cancelled by system"}
    number = 0
    for head, price, (count, first, width, status, *void) in _flights():
        flight, route, plane, manager, takeoff, state = head
        data["flight"].append((flight, int(route), plane, manager,
                               datetime.fromisoformat(takeoff), state))
        for name, amount in zip(("Economy", "Business"), price):
            data["pricing"].append((flight, plane, name, amount))
        crew = _crew_of(head)
        for role in ("pilot", "attendant"):
            data[f"{role}_flight"] += [(flight, member) for member in _crew(role)[crew]]
        for row in range(int(first), int(first) + int(count)):
            number += 1
            order = f"O{number:04d}"
            final = "Cancelled by customer" if str(row) in void else names.get(status, status)
            bought = datetime.fromisoformat(months[final].pop(0) + "-01") + timedelta(hours=number)
            owner = (f"g{number % 20:03d}@example.org", None) if number % 2 else (
                None, f"m{number % 20:03d}@example.org")
            data["orders"].append((order, flight, *owner, bought, final))
            if final in ("Completed", "Active"):
                business = cabins[plane].get("Business", (0, 0))
                whole = business[1] if row <= business[0] else cabins[plane]["Economy"][1]
                held += [(flight, row, c, order) for c in range(1, (int(width) or whole) + 1)]
    data["_held"] = held
    return data


def tables(spark) -> dict:
    data = raw()
    held = spark.createDataFrame(data.pop("_held"),
                                 "flight_id string, s_row int, s_column int, held string")
    frames = {name: spark.createDataFrame(rows, schema_of(name)).cache()
              for name, rows in data.items()}
    seats = seats_from_layout(frames["flight"], frames["cabin_class"])
    linked = (seats.drop("order_id").join(held, ["flight_id", "s_row", "s_column"], "left")
              .withColumnRenamed("held", "order_id"))
    frames["seat"] = linked.select(*schema_of("seat").names).cache()
    return frames
