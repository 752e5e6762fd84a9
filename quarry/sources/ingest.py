"""Typed CSV ingest.

The scan reads every field as text with a corrupt-record column (PERMISSIVE),
keeps rows that parsed or are merely short (the reference keeps short rows
and skips over-long ones), then converts each column with ``try_*`` casts so a
bad cell becomes NULL instead of failing the job (ANSI mode is on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import qcol

CORRUPT = "_corrupt_record"
_PLACE = ["_file", "_start", "_line"]


def read_csv_typed(spark: SparkSession, path: str, types: dict[str, str],
                   timestamps: list[str] = (), booleans: list[str] = (),
                   row_cap: int | None = None, header: bool = True, places: bool = False) -> DataFrame:
    """``types`` maps column → Spark SQL type for numeric/text
    columns, in file order (together with the timestamp and boolean ones). ``row_cap`` keeps any so many rows;
    the first ones in file order are kept by :func:`read_csv_ordered`. ``places`` adds where a row was read
    (``_file``, ``_start`` of its split, ``_line``, rising within the split)."""
    cols = list(types)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols] +
                          [T.StructField(CORRUPT, T.StringType())])
    # Column pruning changes which rows count as malformed; this read parses all columns.
    raw = (spark.read.option("header", header).option("columnPruning", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))
    # A short row is filled with NULL; a row with a field too many is skipped.
    wide = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(cols) + 1)])
    extra = F.from_csv(F.col(CORRUPT), wide.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"})[f"f{len(cols)}"]
    ok = F.col(CORRUPT).isNull() | (qcol(cols[-1]).isNull() & extra.isNull())
    out = [F.col(c) for c in _PLACE] if places else []
    if places:
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                         F.monotonically_increasing_id().alias("_line"))
    for c in cols:
        if c in timestamps:
            out.append(F.try_to_timestamp(qcol(c)).alias(c))
        elif c in booleans:
            out.append(F.expr(f"try_cast(`{c}` AS BOOLEAN)").alias(c))
        elif types[c] == "string":
            out.append(qcol(c))
        else:
            v = F.expr(f"try_cast(`{c}` AS {types[c]})")
            if types[c] in ("double", "float"):
                v = F.nullif(v, F.lit(float("nan")).cast(types[c]))    # NaN is missing
            out.append(v.alias(c))
    df = raw.where(ok).select(*out)
    return df.limit(row_cap) if row_cap else df            # S3


def read_csv_ordered(spark: SparkSession, path: str, types: dict[str, str], timestamps: list[str] = (), booleans: list[str] = (),
                     first: int | None = None, header: bool = True) -> DataFrame:
    """Typed rows of many files with ``_order``, which rises in file order (files by name, then lines), and
    with ``first``, only the first so many good rows in that order.

    Rows are parsed once into a table that knows each row's split. Splits (a row per 128 MB of input) are cumulated
    to offsets, so rows get their place by a join with their split's, not by a window over all rows; only the
    one split that holds the last wanted row is ranked. ``_order`` counts good rows with gaps between splits of 0 or more."""
    from quarry.functions.stats import ranged, running_totals
    from quarry.sources.sinks import materialize

    rows = materialize(read_csv_typed(spark, path, types, timestamps, booleans, header=header, places=True), "csv-rows")
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_low"), F.max("_line").alias("_high"))
    splits = splits.withColumn("_span", F.col("_high") - F.col("_low") + 1).withColumn("_at", F.struct("_file", "_start"))
    placed = running_totals(ranged(splits, [], "_at"), [], "_at", ["_n", "_span"], F.col("_range"))
    placed = materialize(placed.select("_file", "_start", "_low", "_n", (F.col("cum__span") - F.col("_span")).alias("_offset"),
                                       (F.col("cum__n") - F.col("_n")).alias("_before")), "csv-splits")
    out = rows.join(placed, ["_file", "_start"]).withColumn("_order", F.col("_offset") + F.col("_line") - F.col("_low"))
    if first is not None:
        cut = placed.where((F.col("_before") < first) & (F.col("_before") + F.col("_n") > first)).first()
        last = None
        if cut is not None:  # the last wanted row is the k-th line of this split
            held = rows.where((F.col("_file") == cut["_file"]) & (F.col("_start") == cut["_start"]))
            last = held.orderBy("_line").limit(first - cut["_before"]).agg(F.max("_line")).first()[0] - cut["_low"] + cut["_offset"]
        out = out.where(F.col("_before") < first)
        out = out.where(F.col("_order") <= last) if last is not None else out
    return out.select("_order", *[qcol(c) for c in types])


def write_csv(df: DataFrame, path: str) -> str:
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"       # keep microseconds (the default writes ms)
    df.write.mode("overwrite").option("header", True).option("timestampFormat", fmt) \
        .option("timestampNTZFormat", fmt).csv(path)
    return path


_INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2 ** 31, 2 ** 31 - 1)]
_FLOAT_MAX = 3.4028234663852886e38


def narrowed_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Smallest integer type that holds min..max, float for doubles in
    float range: (column, narrowed_type), one aggregation."""
    from quarry.functions.stats import to_long
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    fields = [f for f in df.schema.fields if (columns is None or f.name in columns)
              and isinstance(f.dataType, ints + (T.FloatType, T.DoubleType))]
    kinds = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(
        "int" if isinstance(f.dataType, ints) else "float"))])
    long = to_long(df, [f.name for f in fields])
    mm = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    is_int = F.element_at(kinds, F.col("column")) == "int"
    choose = None
    for name, lo, hi in _INT_RANGES:
        cond = is_int & (F.col("lo") >= lo) & (F.col("hi") <= hi)
        choose = F.when(cond, name) if choose is None else choose.when(cond, name)
    choose = choose.when(is_int, "bigint").when(
        (F.col("lo") >= -_FLOAT_MAX) & (F.col("hi") <= _FLOAT_MAX), "float").otherwise("double")
    return mm.select("column", choose.alias("narrowed_type"))


def narrow(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Apply a narrowing plan (column → type) as casts."""
    return df.select(*[qcol(c).cast(plan[c]).alias(c) if c in plan else qcol(c) for c in df.columns])
