"""Declared schemas of the sixteen tables, with keys, references and domains.

Date and time of departure are one ``takeoff_ts``; passwords are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from tarmaq import params as P

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "money": T.DecimalType(10, 2),
}


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        """``name type`` pairs; a trailing ``?`` marks a nullable column."""
        fields = []
        for pair in self.columns.split(","):
            name, kind = pair.split()
            fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
        return T.StructType(fields)


_PERSON = "customer_email string, customer_first_name string, customer_last_name string"
_STAFF = (
    "employee_id string, first_name string, last_name string, phone string, city string, "
    "street string, street_num int, employment_date date"
)
_CREW = Table(f"{_STAFF}, long_flight_training boolean", ("employee_id",),
              max_length={"employee_id": 9})

TABLES: dict[str, Table] = {
    "plane": Table(
        "plane_id string, plane_size string, plane_manufacturer string, purchase_date date",
        ("plane_id",),
        domains={"plane_size": P.PLANE_SIZES, "plane_manufacturer": P.MANUFACTURERS},
        max_length={"plane_id": 5},
    ),
    "route": Table(
        "route_id int, origin_airport string, destination_airport string, flight_duration int",
        ("route_id",),
        max_length={"origin_airport": 100, "destination_airport": 100},
    ),
    "guest": Table(_PERSON, ("customer_email",), max_length={"customer_email": 100}),
    "guest_phone": Table(
        "customer_email string, customer_phone string",
        ("customer_email", "customer_phone"),
        references=((("customer_email",), "guest", ("customer_email",)),),
    ),
    "registered_customer": Table(
        f"{_PERSON}, passport_id string, birth_date date, sign_up_date date",
        ("customer_email",),
        unique=(("passport_id",),),
        max_length={"customer_email": 100},
    ),
    "registered_customer_phone": Table(
        "customer_email string, customer_phone string",
        ("customer_email", "customer_phone"),
        references=((("customer_email",), "registered_customer", ("customer_email",)),),
    ),
    "manager": Table(_STAFF, ("employee_id",), max_length={"employee_id": 9}),
    "pilot": _CREW,
    "attendant": _CREW,
    "flight": Table(
        "flight_id string, route_id int, plane_id string, manager_id string, "
        "takeoff_ts datetime, flight_status string",
        ("flight_id",),
        references=(
            (("route_id",), "route", ("route_id",)),
            (("plane_id",), "plane", ("plane_id",)),
            (("manager_id",), "manager", ("employee_id",)),
        ),
        domains={"flight_status": P.FLIGHT_STATUSES},
        max_length={"flight_id": 5},
    ),
    "orders": Table(
        "order_id string, flight_id string, guest_email string?, reg_customer_email string?, "
        "date_of_purchase datetime, order_status string",
        ("order_id",),
        references=(
            (("flight_id",), "flight", ("flight_id",)),
            (("guest_email",), "guest", ("customer_email",)),
            (("reg_customer_email",), "registered_customer", ("customer_email",)),
        ),
        domains={"order_status": P.ORDER_STATUSES},
        max_length={"order_id": 5},
    ),
    "cabin_class": Table(
        "plane_id string, class_type string, columns_num int, rows_num int",
        ("plane_id", "class_type"),
        references=((("plane_id",), "plane", ("plane_id",)),),
        domains={"class_type": tuple(P.CLASS_RANK)},
    ),
    "seat": Table(
        "flight_id string, s_row int, s_column int, plane_id string, class_type string, "
        "order_id string?",
        ("flight_id", "s_row", "s_column"),
        references=(
            (("flight_id",), "flight", ("flight_id",)),
            (("plane_id", "class_type"), "cabin_class", ("plane_id", "class_type")),
            (("order_id",), "orders", ("order_id",)),
        ),
        domains={"class_type": tuple(P.CLASS_RANK)},
    ),
    "pricing": Table(
        "flight_id string, plane_id string, class_type string, price money",
        ("flight_id", "plane_id", "class_type"),
        references=(
            (("flight_id",), "flight", ("flight_id",)),
            (("plane_id", "class_type"), "cabin_class", ("plane_id", "class_type")),
        ),
        domains={"class_type": tuple(P.CLASS_RANK)},
    ),
    "pilot_flight": Table(
        "flight_id string, employee_id string",
        ("flight_id", "employee_id"),
        references=(
            (("flight_id",), "flight", ("flight_id",)),
            (("employee_id",), "pilot", ("employee_id",)),
        ),
    ),
    "attendant_flight": Table(
        "flight_id string, employee_id string",
        ("flight_id", "employee_id"),
        references=(
            (("flight_id",), "flight", ("flight_id",)),
            (("employee_id",), "attendant", ("employee_id",)),
        ),
    ),
}


def schema_of(table: str) -> T.StructType:
    return TABLES[table].schema
