"""Column catalog and nested layout export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declared_columns(df: DataFrame, table: str, nullable_only: bool = False) -> DataFrame:
    """Table, column, position, type and nullability from the schema."""
    rows = [(table, f.name, i, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema, 1) if f.nullable or not nullable_only]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, data_type string, "
              "is_nullable boolean")


NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def profile(df: DataFrame, table: str, distinct: str | None = None) -> DataFrame:
    """Observed profile, one row per column; every column is read once.

    ``distinct``: None, "approx" (a sketch, still one pass) or "exact" (a
    shuffle of the distinct values of every column). Texts are folded apart from
    the other columns, whose minima need no sort.
    """
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}

    def plain(c):  # one zero: which of -0.0 and 0.0 is the minimum is left open
        return F.col(c) + F.lit(0.0) if c in floating else F.col(c)

    measures = {"row_count": lambda c: F.count(F.lit(1)),
                "null_count": lambda c: F.count(F.lit(1)) - F.count(c),
                "min_value": lambda c: F.min(plain(c)),
                "max_value": lambda c: F.max(plain(c))}
    if distinct:
        count = F.approx_count_distinct if distinct == "approx" else F.count_distinct
        measures["distinct_count"] = lambda c: count(c)
    fields = list(enumerate(df.schema))
    texts = [(i, f) for i, f in fields if f.dataType.typeName() == "string"]
    parts = []
    for some in (texts, [x for x in fields if x not in texts]):
        if some:
            totals = df.agg(*[measure(f.name).alias(f"{name}_{i}")
                              for i, f in some for name, measure in measures.items()])
            rows = F.array(*[
                F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
                         F.lit(i + 1).alias("ordinal"), F.lit(f.dataType.simpleString()).alias("data_type"),
                         *[F.col(f"{name}_{i}").cast("string" if name.endswith("_value") else "bigint").alias(name)
                           for name in measures])
                for i, f in some])
            parts.append(totals.select(F.inline(rows)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def nullable_columns(df: DataFrame, table: str) -> DataFrame:
    """The columns that are declared nullable, with what they hold: ordinal, data_type, null_count, row_count."""
    declared = declared_columns(df, table, nullable_only=True).select("column_name")
    return (profile(df, table).join(declared, "column_name", "left_semi")
            .select("table_name", "column_name", "ordinal", "data_type", "row_count", "null_count"))


# --- profiles that are merged instead of counted again -----------------------

#: Size of the sketches: about 0.8 % error of a distinct count, 0.7 % of a rank.
HLL_BITS, KLL_K = 14, 400


def sketched(df: DataFrame, table: str) -> DataFrame:
    """A profile that can be merged: a row per column, from one pass.

    Counts, the smallest and largest number and text, a sketch of the distinct
    values and, for numbers, one of their order. Moments count as microseconds.
    """
    def number(f):
        kind = f.dataType.typeName()
        if kind in NUMBERS:
            return F.col(f.name).cast("double")
        if kind == "timestamp_ntz":
            return F.unix_micros(F.col(f.name).cast("timestamp")).cast("double")
        return F.unix_micros(F.col(f.name).cast("timestamp")).cast("double") if kind in ("timestamp", "date") else None

    nothing = F.lit(None)
    folds, rows = [], []
    for i, f in enumerate(df.schema):
        value, text = number(f), F.col(f.name).cast("string")
        is_text = f.dataType.typeName() == "string"
        measures = {
            "row_count": F.count(F.lit(1)), "null_count": F.count(F.lit(1)) - F.count(f.name),
            "min_number": F.min(value) if value is not None else nothing.cast("double"),
            "max_number": F.max(value) if value is not None else nothing.cast("double"),
            "min_text": F.min(text) if is_text else nothing.cast("string"),
            "max_text": F.max(text) if is_text else nothing.cast("string"),
            "distinct_sketch": F.hll_sketch_agg(text, F.lit(HLL_BITS)),
            "order_sketch": F.kll_sketch_agg_double(value, F.lit(KLL_K)) if value is not None else nothing.cast("binary")}
        folds += [c.alias(f"{name}_{i}") for name, c in measures.items()]
        rows.append(F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
                             *[F.col(f"{name}_{i}").alias(name) for name in measures]))
    return df.agg(*folds).select(F.inline(F.array(*rows)))


def merged_profiles(parts: DataFrame) -> DataFrame:
    """One row per column from the sketched profiles of several parts of a table."""
    return parts.groupBy("table_name", "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number"),
        F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("order_sketch").alias("order_sketch"))


def estimated(profiles: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts and bounds, the number of distinct values and the quantiles (NULL for texts)."""
    quantiles = [F.when(F.kll_sketch_get_n_double("order_sketch") > 0,  # a merged sketch may be of nothing
                        F.kll_sketch_get_quantile_double("order_sketch", F.lit(share)))
                 .alias(f"q{round(100 * share)}") for share in shares]
    return profiles.select("table_name", "column_name", "row_count", "null_count", "min_number", "max_number",
                           "min_text", "max_text", F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
                           *quantiles)


def layout_map(cabins: DataFrame) -> DataFrame:
    """Per plane: class -> {rows, cols} as JSON, classes in order.

    A (plane, class) pair is one cabin, so a plane's map stays small.
    """
    entry = F.struct(F.col("class_type"),
                     F.struct(F.col("rows_num").alias("rows"), F.col("columns_num").alias("cols")))
    entries = F.sort_array(F.collect_set(entry))
    return cabins.groupBy("plane_id").agg(
        F.to_json(F.map_from_entries(entries)).alias("layout_json"))
