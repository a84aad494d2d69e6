"""Data-quality rules over whole tables.

Every check yields (table_name, rule, bad_rows). Rules of one table share a
single pass and a single aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.functions.scalars import (day_in_range, is_phone, is_positive_int, is_staff_id,
                                      moment, parse_day)
from tarmaq.schemas import TABLES, Table

def _result(df: DataFrame, table: str, rule: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     F.col("bad_rows").cast("bigint").alias("bad_rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_unique(df: DataFrame, key: list[str], table: str) -> DataFrame:
    counted = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("bad_rows"))
    return _result(counted, table, f"unique({','.join(key)})")


def orphans(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str]) -> DataFrame:
    """Child rows whose (fully set) reference has no parent."""
    referenced = parent.select(*[F.col(p).alias(f) for f, p in zip(fk, pk)]).distinct()
    set_refs = child.filter(_set(fk))
    return set_refs.join(referenced, fk, "left_anti")


def _set(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def check_fk(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str], table: str,
             parent_name: str, weight: str | None = None) -> DataFrame:
    """Counts orphans by reference value, so a hot value is one row per map task.

    ``weight`` is the column of a folded child that says how many rows a row
    stands for. NULL references are passed over in the sum and not by a filter:
    that would sink below the fold and keep several checks from reading one.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    referenced = (parent.select(*[F.col(p).alias(f) for f, p in zip(fk, pk)]).distinct()
                  .withColumn("_there", F.lit(True)))
    orphan = _set(fk) & F.col("_there").isNull()
    counted = (child.groupBy(*fk).agg(rows.alias("_n")).join(referenced, fk, "left")
               .agg(F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).alias("bad_rows")))
    return _result(counted, table, f"fk({','.join(fk)}->{parent_name})")


def check_fk_both(one: DataFrame, key: list[str], other: DataFrame, other_key: list[str], table: str,
                  other_name: str, weight: str | None = None) -> DataFrame:
    """Rows of either table whose key the other one has not: two checks, one join.

    Both sides are folded to their keys first; ``weight`` as in ``check_fk``, for ``one``.
    """
    first = one.groupBy(*key).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_one"))
    second = (other.groupBy(*[F.col(o).alias(k) for k, o in zip(key, other_key)])
              .agg(F.count(F.lit(1)).alias("_other")))
    lost = [F.coalesce(F.sum(F.when(_set(key) & F.col(b).isNull(), F.col(a))), F.lit(0)).alias(a)
            for a, b in (("_one", "_other"), ("_other", "_one"))]
    names = ((table, f"fk({','.join(key)}->{other_name})", "_one"),
             (other_name, f"fk({','.join(other_key)}->{table})", "_other"))
    rows = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(rule).alias("rule"),
                              F.col(c).cast("bigint").alias("bad_rows")) for t, rule, c in names])
    return first.join(second, key, "full").agg(*lost).select(F.inline(rows))


def check_rules(df: DataFrame, rules: dict[str, Column], table: str) -> DataFrame:
    """Rows that break each rule. As with a CHECK, NULL does not break it."""
    counts = df.agg(*[F.count_if(~rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"),
                              F.col(f"r{i}").alias("bad_rows"))
                     for i, name in enumerate(rules)])
    return counts.select(F.inline(rows))


def required(column: str) -> dict[str, Column]:
    return {f"not_null({column})": F.col(column).isNotNull()}


def domain(column: str, values, max_length: int | None = None) -> dict[str, Column]:
    rules = {f"domain({column})": F.col(column).isin(*values)} if values else {}
    if max_length is not None:
        rules[f"length({column})"] = F.length(column) <= max_length
    return rules


def exactly_one(first: str, second: str) -> dict[str, Column]:
    return {f"exactly_one({first},{second})":
            F.col(first).isNull() != F.col(second).isNull()}


def contact_rules(as_of: str, phones: tuple[str, ...] = (), days: tuple[str, ...] = (),
                  staff_ids: tuple[str, ...] = (), needed: tuple[str, ...] = (),
                  positive: tuple[str, ...] = ()) -> dict[str, Column]:
    """Form rules as column rules; text days are parsed, bad ones fail."""
    rules = {f"phone({c})": is_phone(c) for c in phones}
    rules |= {f"day({c})": day_in_range(parse_day(c), moment(as_of)) for c in days}
    rules |= {f"staff_id({c})": is_staff_id(c) for c in staff_ids}
    rules |= {f"required({c})": F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0
              for c in needed}
    rules |= {f"positive({c})": is_positive_int(F.col(c).cast("string")) for c in positive}
    return rules


def shared_keys(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that occur in more than one of the tables."""
    parts = [df.select(F.col(key), F.lit(i).alias("_source"))
             for i, df in enumerate(frames.values())]
    return (union_all(parts).groupBy(key)
            .agg((F.min("_source") != F.max("_source")).alias("_shared"))
            .filter("_shared").select(key))


def check_disjoint(frames: dict[str, DataFrame], key: str) -> DataFrame:
    counted = shared_keys(frames, key).agg(F.count(F.lit(1)).alias("bad_rows"))
    return _result(counted, "+".join(frames), f"disjoint({key})")


def layout_rules() -> dict[str, Column]:
    return {"rows_positive": F.col("rows_num") > 0, "columns_positive": F.col("columns_num") > 0}


def large_without_business(planes: DataFrame, cabins: DataFrame) -> DataFrame:
    business = cabins.filter(F.col("class_type") == "Business").select("plane_id").distinct()
    return (planes.filter(F.col("plane_size") == "Large")
            .join(business, "plane_id", "left_anti"))


def check_layout(planes: DataFrame, cabins: DataFrame) -> DataFrame:
    counted = large_without_business(planes, cabins).agg(F.count(F.lit(1)).alias("bad_rows"))
    return check_rules(cabins, layout_rules(), "cabin_class").unionByName(
        _result(counted, "plane", "large_needs_business"))


def _declared_checks(name: str) -> dict[str, Column]:
    if name == "route":
        return {"positive_duration": F.col("flight_duration") > 0,
                "endpoints_differ": F.col("origin_airport") != F.col("destination_airport")}
    if name == "pricing":
        return {"positive_price": F.col("price") > 0}
    if name == "cabin_class":
        return layout_rules()
    if name == "orders":
        return exactly_one("guest_email", "reg_customer_email")
    return {}


def column_rules(name: str, table: Table) -> dict[str, Column]:
    rules: dict[str, Column] = {}
    for field in table.schema:
        if not field.nullable:
            rules |= required(field.name)
        rules |= domain(field.name, table.domains.get(field.name),
                        table.max_length.get(field.name))
    return rules | _declared_checks(name)


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """All declared rules of the given tables: keys, references, columns, staff ids."""
    found = []
    for name, df in tables.items():
        table = TABLES[name]
        found.append(check_rules(df, column_rules(name, table), name))
        for key in (table.key, *table.unique):
            found.append(check_unique(df, list(key), name))
        for fk, parent, pk in table.references:
            if parent in tables:
                found.append(check_fk(df, list(fk), tables[parent], list(pk), name, parent))
    staff = {n: tables[n] for n in ("manager", "pilot", "attendant") if n in tables}
    if len(staff) > 1:
        found.append(check_disjoint(staff, "employee_id"))
    owners = {n: tables[n] for n in ("guest", "registered_customer") if n in tables}
    if len(owners) > 1:
        found.append(check_disjoint(owners, "customer_email"))
    if "plane" in tables and "cabin_class" in tables:
        found.append(check_layout(tables["plane"], tables["cabin_class"])
                     .filter(F.col("rule") == "large_needs_business"))
    return union_all(found)
