"""Readers: tables, CSV, matrices, payloads and messages into long panels (series_id, ts, y)."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidepanel.functions import parse
from tidepanel.operators.blocks import number_rows
from tidepanel.operators.clean import add_steps, normalize_ids

# Column names that mark a role, in order of preference (fixed values).
TIMESTAMP_NAMES = (
    "timestamp", "timestamps", "ds", "time", "date", "datetime", "date_time", "observation_date", "utc_timestamp", "year", "fecha",
)
SERIES_NAMES = ("id", "series", "series_id", "unique_id", "entity", "country")
TARGET_NAMES = (
    "target", "value", "y", "ot", "demand", "users", "number of flights", "total electricity", "gdp", "close", "actual",
    "pm2.5", "pm25", "pm10", "no2", "so2", "co",
)
TARGET_SUFFIXES = ("_load_actual_entsoe_transparency",)
FREQ_NAMES = ("freq", "frequency")
SERIES_HINTS = (
    "series_id", "unique_id", "item_id", "entity_id", "store_id", "sku", "symbol", "ticker", "station", "sensor", "node", "store", "entity", "id",
)
INDICATOR_IDS = ("Country Name", "Country Code", "Indicator Name", "Indicator Code")
DELIMITERS = (",", ";", "\t", "|")
SNIFF_BYTES = 65_536


class RoleError(ValueError):
    """No usable column for a role."""


# ---- CSV -------------------------------------------------------------------------------------


def sniff(lines: Sequence[str]) -> tuple[str, list[str], int]:
    """(delimiter, header fields, records before the header) from the first lines of a file; blank lines are no records.

    The delimiter with most fields in a record wins, comma on ties. The most frequent number of fields (of two or more, the
    larger one on ties) is that of the data, counted over the second half of a sample of 20 records or more, and the header is
    the first record with that many.
    """
    text = [x.lstrip("\ufeff") for x in lines if x.strip()]
    if not text:
        return ",", [], 0

    def records(sep: str) -> list[list[str]]:
        whole = list(csv.reader([x + "\n" for x in text], delimiter=sep))
        # a stray quote swallows the rest of the sample: then lines are taken one by one
        return whole if 2 * len(whole) >= len(text) else [next(csv.reader([x], delimiter=sep)) for x in text]

    parsed = {sep: records(sep) for sep in DELIMITERS}
    best = max(DELIMITERS, key=lambda sep: (max(len(r) for r in parsed[sep]), sep == ","))
    rows = parsed[best]
    widths = [len(r) for r in rows]
    counted = widths[len(widths) // 2 :] if len(widths) >= 20 else widths
    wide = [w for w in counted if w > 1] or [w for w in widths if w > 1] or [1]
    usual = max(set(wide), key=lambda w: (wide.count(w), w))
    at = widths.index(usual)
    return best, [c.strip().lstrip("\ufeff") for c in rows[at]], at


def sniff_files(spark: SparkSession, path: str) -> list[tuple[str, str, list[str], int]]:
    """(file, delimiter, header fields, records before the header) of every file, from its first SNIFF_BYTES.

    Heads are read and sniffed inside the tasks; the driver gets one row per file.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")

    def heads(batches):
        import pandas as pd

        file, head, size, done = None, [], 0, []

        def close():
            if file is not None:
                done.append((file, *sniff(head)))

        for pdf in batches:
            for name, value in zip(pdf["file"], pdf["value"]):
                if name != file:
                    close()
                    file, head, size = name, [], 0
                if size < SNIFF_BYTES:
                    head.append(value)
                    size += len(value.encode()) + 1
        close()
        yield pd.DataFrame(done, columns=["file", "sep", "header", "skip"])

    found = lines.mapInPandas(heads, "file string, sep string, header array<string>, skip int").orderBy("file").collect()
    return [(r["file"], r["sep"], list(r["header"]), r["skip"]) for r in found]


def _column_names(header: Sequence[str]) -> list[str]:
    """Blank cells become unnamed_<i>, repeated names get a number."""
    names: list[str] = []
    for i, h in enumerate(header):
        name = h or f"unnamed_{i}"
        seen = sum(1 for n in names if n.lower() == name.lower() or re.fullmatch(re.escape(name.lower()) + r"_\d+", n.lower()))
        names.append(f"{name}_{seen + 1}" if name.lower() in [n.lower() for n in names] else name)
    return names


def _csv_groups(spark: SparkSession, path: str, multiline: bool = True, extra: Sequence[str] = ()) -> list[tuple[list[str], DataFrame]]:
    """(column names, rows with `_file` and `_record`) for the files of each header and layout."""
    groups: dict[tuple, list[str]] = {}
    for file, sep, header, skip in sniff_files(spark, path):
        if len(header) == 1 and any(d in header[0] for d in DELIMITERS):
            raise RoleError(f"{file} does not look like delimited text")
        if header:
            groups.setdefault((sep, tuple(_column_names(header)), skip), []).append(file)
    out = []
    for (sep, names, skip), files in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, *extra)])
        reader = spark.read.schema(schema).options(sep=sep, quote='"', escape='"', multiLine=str(multiline or skip > 0), mode="PERMISSIVE")
        if extra:
            reader = reader.option("columnNameOfCorruptRecord", extra[0])
        rows = reader.option("header", str(skip == 0)).csv(files)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_record"))
        if skip:
            # such files are read whole, so the records of one have consecutive numbers
            first = rows.groupBy("_file").agg(F.min("_record").alias("_first"))
            rows = rows.join(first, "_file").where(F.col("_record") - F.col("_first") > skip).drop("_first")
        out.append((list(names), rows))
    return out


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV with sniffed delimiter, skipped preamble, trimmed header and byte-order mark removed.

    All columns are text. Every file is read by its own header and the columns are united by name; blank header cells are named
    `unnamed_<i>`. Quoted fields may hold delimiters, doubled quotes and, with `multiline`, line breaks (a file is then read
    by one task). Rows with too few fields keep NULLs; the fields beyond the header of others are listed by `csv_rejects`.
    """
    parts = [rows.select(*[F.col(f"`{n}`") for n in names]) for names, rows in _csv_groups(spark, path, multiline)]
    if not parts:
        raise RoleError(f"{path} has no header")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def csv_rejects(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(file, record): rows that hold more fields than the header of their file."""
    out = spark.createDataFrame([], "file string, record string")
    for names, rows in _csv_groups(spark, path, multiline, ("_rejected",)):
        long = rows.where(F.col("_rejected").isNotNull() & F.col(f"`{names[-1]}`").isNotNull())
        out = out.unionByName(long.select(F.col("_file").alias("file"), F.col("_rejected").alias("record")))
    return out


def promote_unnamed_time(df: DataFrame) -> DataFrame:
    """A nameless first column becomes `timestamp` where at least 80 % of it parses (one aggregate)."""
    first = df.columns[0]
    if first.strip() and not first.lower().startswith("unnamed"):
        return df
    share = df.agg(F.avg(parse.timestamp(F.col(f"`{first}`").cast("string")).isNotNull().cast("double")).alias("s")).first()["s"]
    return df.withColumnRenamed(first, "timestamp") if share is not None and share >= 0.8 else df


def unpivot_indicators(df: DataFrame) -> DataFrame:
    """Indicator matrix (four id columns, one column per year) to (timestamp, series, target).

    The series is the country code, or the name where the code is blank; series without any number go.
    """
    years = [c for c in df.columns if re.fullmatch(r"\d{4}", c)]
    if not all(c in df.columns for c in INDICATOR_IDS) or len(years) < 3:
        return df
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in (*INDICATOR_IDS, *years)])
    code, name = F.trim("Country Code"), F.trim("Country Name")
    wide = text.withColumn("series", F.when(code != "", code).otherwise(name))
    any_value = F.greatest(*[parse.number(F.col(f"`{y}`")).isNotNull().cast("int") for y in years])
    with_any = wide.groupBy("series").agg(F.max(any_value).alias("_any")).where("_any = 1").select("series")
    long = wide.unpivot(["series"], years, "year", "raw")
    return long.join(with_any, "series", "left_semi").select(
        F.concat("year", F.lit("-01-01")).alias("timestamp"), "series", parse.number(F.col("raw")).alias("target")
    )


# ---- column roles ----------------------------------------------------------------------------


def _plain(name: str) -> str:
    return name.strip().lstrip("\ufeff").casefold()


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First exact match in order of preference, then first case-insensitive one."""
    exact = next((n for n in names if n in columns), None)
    if exact:
        return exact
    folded = {}
    for c in columns:
        folded.setdefault(_plain(c), c)
    return next((folded[_plain(n)] for n in names if _plain(n) in folded), None)


def resolve_roles(df: DataFrame, ts: str | None = None, series: str | None = None, target: str | None = None, freq: str | None = None) -> dict[str, str | None]:
    """Columns for ts, series, target and freq from the schema alone."""
    cols = df.columns
    ts, series, freq = ts or find_column(cols, TIMESTAMP_NAMES), series or find_column(cols, SERIES_NAMES), freq or find_column(cols, FREQ_NAMES)
    if target is None:
        target = find_column(cols, TARGET_NAMES) or next((c for c in cols if _plain(c).endswith(TARGET_SUFFIXES)), None)
    if target is None:
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (ts, series, freq)]
        if len(numeric) != 1:
            raise RoleError("no target column" if not numeric else f"several numeric columns: {numeric}")
        target = numeric[0]
    if ts is None:
        raise RoleError("no timestamp column")
    return {"ts": ts, "series": series, "target": target, "freq": freq}


def to_panel(df: DataFrame, **roles) -> DataFrame:
    """(series_id, ts, y[, freq]) by resolved roles; a missing id column makes one series."""
    r = resolve_roles(df, **roles)
    c = lambda k: F.col(f"`{r[k]}`")
    kind = df.schema[r["ts"]].dataType
    ts = parse.timestamp(c("ts")) if isinstance(kind, T.StringType) else c("ts").cast("timestamp")
    y = c("target").try_cast("double") if isinstance(df.schema[r["target"]].dataType, T.StringType) else c("target").cast("double")
    sid = c("series").cast("string") if r["series"] else F.lit(None).cast("string")
    out = df.select(sid.alias("series_id"), ts.alias("ts"), y.alias("y"), *([c("freq").alias("freq")] if r["freq"] else []))
    return normalize_ids(out)


def wide_to_panel(df: DataFrame, ts: str) -> DataFrame:
    """Every numeric column of a wide table becomes a series."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != ts]
    if not cols:
        raise RoleError("no numeric column")
    base = df.select(F.col(ts).alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return base.unpivot(["ts"], cols, "series_id", "y").select("series_id", "ts", "y")


# ---- payloads, matrices, directories ---------------------------------------------------------

PAYLOAD = "id string, freq string, timestamps array<string>, target array<double>"


def payloads_to_panel(df: DataFrame, column: str = "payload", ordinal: str = "ordinal") -> DataFrame:
    """JSON objects {id, timestamps, target} to rows; missing timestamps count 0, 1, 2, ...

    A missing id becomes series_<ordinal>.
    """
    p = F.from_json(column, PAYLOAD)
    rows = df.select(F.coalesce(p["id"], F.concat(F.lit("series_"), F.col(ordinal).cast("string"))).alias("series_id"), p["timestamps"].alias("t"), F.posexplode(p["target"]).alias("pos", "y"))
    return rows.select("series_id", F.coalesce(F.get("t", F.col("pos")), F.col("pos").cast("string")).alias("timestamp"), F.col("pos").cast("long").alias("pos"), "y")


def matrix_to_panel(df: DataFrame, id_column: str) -> DataFrame:
    """One row per series with ragged value columns to (series_id, pos, n, y); NULLs close up.

    A series has at most as many rows as the table has columns.
    """
    cols = [c for c in df.columns if c != id_column]
    values = F.array(*[F.col(f"`{c}`").try_cast("double") for c in cols])
    cells = df.select(F.col(id_column).cast("string").alias("series_id"), F.posexplode(values).alias("c", "y"))
    return number_rows(cells.where(F.col("y").isNotNull()), ("c",), bucket_seconds=None).select("series_id", "pos", "n", "y")


def train_test_panel(train: DataFrame, test: DataFrame, id_column: str, horizon: int, context: int, start: str = "2000-01-01") -> tuple[DataFrame, DataFrame]:
    """Matrix pair to (history, actuals): ids in both, the last `context` training values, the first
    `horizon` test values, synthetic daily timestamps. Series that are too short stay out."""
    a, b = matrix_to_panel(train, id_column).where("n >= 2"), matrix_to_panel(test, id_column).where(F.col("n") >= horizon)
    drop = F.greatest(F.col("n") - context, F.lit(0))
    a = a.where(F.col("pos") >= drop).select("series_id", (F.col("pos") - drop).alias("pos"), (F.col("n") - drop).alias("n"), "y")
    a = a.join(b.select("series_id").distinct(), "series_id", "left_semi")
    b = b.where(F.col("pos") < horizon).join(a.select("series_id").distinct(), "series_id", "left_semi")
    day = F.date_add(F.lit(start).cast("date"), F.col("pos").cast("int")).cast("timestamp")
    return a.withColumn("ts", day), b.select("series_id", (F.col("pos") + 1).cast("int").alias("step"), F.col("y").alias("a"))


def read_csv_directory(spark: SparkSession, path: str, keep: int | None = None, id_from: str = "file") -> DataFrame:
    """One series per CSV file (or folder): id from its name, time and value columns chosen by name in each file.

    `keep` retains the last rows of every series.
    """
    parts = []
    for names, raw in _csv_groups(spark, path):
        ts = next((c for c in names if c.strip().lower() in ("datetime", "timestamp", "date", "time")), names[0])
        value = next((c for c in names if c != ts), None)
        if value is None:
            continue
        where = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1) if id_from == "folder" else F.regexp_replace(F.regexp_extract("_file", r"([^/]+)$", 1), r"\.[^.]*$", "")
        where = F.url_decode(F.replace(F.regexp_replace(where, "^[^=]*=", ""), F.lit("+"), F.lit("%2B")))
        parts.append(raw.select(F.lower(where).alias("series_id"), parse.timestamp(F.col(f"`{ts}`")).alias("ts"), parse.number(F.col(f"`{value}`")).alias("y")))
    if not parts:
        raise RoleError(f"{path} has no file with a time and a value column")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = number_rows(rows.where("ts is not null and y is not null"))
    return rows if keep is None else rows.where(F.col("pos") >= F.col("n") - keep)


def explode_targets(df: DataFrame, freq: str) -> DataFrame:
    """Array-valued targets: element i gets ts + i steps; invalid elements drop out first."""
    ok = F.filter("target", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = df.select("series_id", "ts", F.posexplode(ok).alias("i", "y"))
    return rows.select("series_id", add_steps(F.col("ts"), F.col("i"), freq).alias("ts"), "y")


def series_column_ranking(df: DataFrame, required_rows: int, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, values, max_rows) of candidate id columns, best first: hinted names, more than one value,
    a largest group of at least `required_rows`."""
    def hinted(c: str) -> bool:
        n = re.sub(r"[- ]", "_", c.strip().lower())
        return any(h in n for h in SERIES_HINTS)

    cols = [c for c in df.columns if c not in exclude and hinted(c)]
    if not cols:
        raise RoleError("no candidate id column")
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    groups = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    per = groups.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.max("c").alias("max_rows"))
    return per.where((F.col("values") > 1) & (F.col("max_rows") >= required_rows)).orderBy(F.col("max_rows").desc(), "values", "column")


# Name hints that break ties between equally parseable columns, in order of preference (fixed values).
TIME_HINTS = ("timestamp", "datetime", "date_time", "dateutc", "date", "time", "dt", "period", "start", "ds", "tstmp")
VALUE_HINTS = ("target", "value", "actual", "actuals", "y", "close", "price", "demand", "sales", "sale_amount", "label")


def _priority(column: str, hints: Sequence[str]) -> int:
    n = column.strip().lower().replace(" ", "_")
    if n in hints:
        return hints.index(n)
    return next((len(hints) + i for i, h in enumerate(hints) if h in n), 10_000)


def infer_roles(df: DataFrame) -> DataFrame:
    """(column, time_ratio, number_ratio, role): parse shares of every column in one pass; the best time
    column and the best other number column get their roles."""
    cols = list(df.columns)
    text = [F.col(f"`{c}`").cast("string") for c in cols]
    one = df.agg(
        *[F.avg(parse.timestamp(t).isNotNull().cast("double")).alias(f"t{i}") for i, t in enumerate(text)],
        *[F.avg(parse.number(t).isNotNull().cast("double")).alias(f"n{i}") for i, t in enumerate(text)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"t{i}").alias("time_ratio"), F.col(f"n{i}").alias("number_ratio"), F.lit(_priority(c, TIME_HINTS)).alias("tp"), F.lit(_priority(c, VALUE_HINTS)).alias("np"))
            for i, c in enumerate(cols)
        ]
    )
    best_time = F.array_min(F.transform(entries, lambda e: F.named_struct(F.lit("a"), -e.time_ratio, F.lit("b"), e.tp, F.lit("c"), e.column)))["c"]
    out = one.select(entries.alias("e"), best_time.alias("bt"))
    rest = F.filter("e", lambda e: e.column != F.col("bt"))
    best_value = F.array_min(F.transform(rest, lambda e: F.named_struct(F.lit("a"), -e.number_ratio, F.lit("b"), e.np, F.lit("c"), e.column)))["c"]
    out = out.select(F.explode("e").alias("x"), "bt", best_value.alias("bv"))
    role = F.when(F.col("x.column") == F.col("bt"), "timestamp").when(F.col("x.column") == F.col("bv"), "target").otherwise("")
    return out.select("x.column", "x.time_ratio", "x.number_ratio", role.alias("role"))


def assess_schema(df: DataFrame, ts: str, target: str, order: Sequence[str], min_time: float = 0.95, min_number: float = 0.95, min_rows: int = 32) -> DataFrame:
    """(time_ratio, number_ratio, longest_run, problem) of a column pair in row order."""
    t, v = parse.timestamp(F.col(ts).cast("string")).isNotNull(), parse.number(F.col(target).cast("string")).isNotNull()
    from tidepanel.operators.clean import missing_runs

    flat = df.select(F.lit("all").alias("series_id"), *order, t.alias("_t"), v.alias("_v"))
    rows = number_rows(flat, tuple(order))
    # A run of valid rows is a gap in the sense of `missing_runs` once validity is inverted.
    run = missing_runs(rows.withColumn("y", F.when(~(F.col("_t") & F.col("_v")), F.lit(1.0))))
    share = rows.groupBy("series_id").agg(F.avg(F.col("_t").cast("double")).alias("time_ratio"), F.avg(F.col("_v").cast("double")).alias("number_ratio"))
    out = share.join(run, "series_id").withColumnRenamed("max_gap", "longest_run")
    problem = (
        F.when(F.col("time_ratio") < min_time, F.format_string(f"timestamp_ratio=%.3f < {min_time:.3f}", "time_ratio"))
        .when(F.col("number_ratio") < min_number, F.format_string(f"target_ratio=%.3f < {min_number:.3f}", "number_ratio"))
        .when(F.col("longest_run") < min_rows, F.format_string(f"contiguous_valid_rows=%d < {min_rows}", F.col("longest_run")))
    )
    return out.select("time_ratio", "number_ratio", "longest_run", problem.alias("problem"))


# ---- stores and messages ---------------------------------------------------------------------

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _identifier(name: str, dotted: bool = False) -> str:
    parts = name.split(".") if dotted else [name]
    if len(parts) > 2 or not all(_IDENT.fullmatch(p) for p in parts):
        raise ValueError(f"invalid identifier {name!r}")
    return name


def read_jdbc(spark: SparkSession, url: str, table: str, id_column: str = "series_id", ts_column: str = "timestamp", value_column: str = "value",
              partition_column: str | None = None, bounds: tuple[str, str] | None = None, partitions: int = 32, **options) -> DataFrame:
    """Database table as a panel; filters and limits put on the result are pushed to the database.

    With `partition_column` and `bounds` the read is split into parallel range queries.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", _identifier(table, dotted=True)).options(**options)
    if partition_column:
        lo, hi = bounds
        reader = reader.option("partitionColumn", _identifier(partition_column)).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", partitions)
    return select_series(reader.load(), id_column, ts_column, value_column)


def select_series(df: DataFrame, id_column: str, ts_column: str, value_column: str, series_id=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Project to (series_id, ts, y) with optional id and time-range predicates; `limit` takes the first rows
    in (id, time) order."""
    out = df
    if series_id is not None:
        out = out.where(F.col(_identifier(id_column)) == series_id)
    if start is not None:
        out = out.where(F.col(_identifier(ts_column)) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(_identifier(ts_column)) <= F.lit(end).cast("timestamp"))
    out = out.select(F.col(_identifier(id_column)).alias("series_id"), F.col(_identifier(ts_column)).alias("ts"), F.col(_identifier(value_column)).alias("y"))
    return out if limit is None else out.orderBy("series_id", "ts").limit(limit)


def list_series(df: DataFrame) -> DataFrame:
    """Distinct ids in order."""
    return df.select("series_id").distinct().orderBy("series_id")


def chunks(panel: DataFrame, rows: int = 1000) -> DataFrame:
    """Array form: (series_id, chunk, ts, y) with at most `rows` points per chunk, in order."""
    part = F.floor(F.col("pos") / rows)
    packed = panel.groupBy("series_id", part.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "ts", "y"))).alias("a"))
    return packed.select("series_id", "chunk", F.transform("a", lambda e: e.ts).alias("ts"), F.transform("a", lambda e: e.y).alias("y"))


def read_objects(spark: SparkSession, path: str, fmt: str = "parquet", id_column: str = "series_id", ts_column: str = "timestamp", value_column: str = "value") -> DataFrame:
    """All CSV or parquet objects below a prefix (s3a://, hdfs://, ...) as (series_id, ts, y); a missing id is `default`."""
    df = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.parquet(path)
    sid = F.coalesce(F.col(id_column).cast("string"), F.lit("default")) if id_column in df.columns else F.lit("default")
    ts = F.col(ts_column)
    ts = parse.timestamp(ts) if df.schema[ts_column].dataType.typeName() == "string" else ts.cast("timestamp")
    value = F.col(value_column).try_cast("double") if df.schema[value_column].dataType.typeName() == "string" else F.col(value_column).cast("double")
    return df.select(sid.alias("series_id"), ts.alias("ts"), value.alias("y"))


def parse_messages(df: DataFrame, column: str = "value", id_key: str = "series_id", ts_key: str = "timestamp", value_key: str = "value") -> DataFrame:
    """JSON messages to (series_id, ts, y): objects only, default id `default`, non-numeric values skipped.

    Works on batch and streaming frames alike.
    """
    fields = T.StructType([T.StructField(k, T.StringType()) for k in (id_key, ts_key, value_key)])
    text = F.col(column).cast("string")
    m = df.where(F.ltrim(text).startswith("{")).withColumn("_m", F.from_json(text, fields))
    y = F.coalesce(F.col(f"_m.{value_key}"), F.lit("0")).try_cast("double")
    out = m.select(*[c for c in df.columns if c != column], F.coalesce(f"_m.{id_key}", F.lit("default")).alias("series_id"), parse.timestamp(F.col(f"_m.{ts_key}")).alias("ts"), y.alias("y"))
    return out.where(F.col("y").isNotNull())


def append_actuals(history: DataFrame, actuals: DataFrame, freq: str) -> DataFrame:
    """History and held-out actuals as one panel; actual step k lies k steps after the last timestamp."""
    ends = history.groupBy("series_id").agg(F.max("ts").alias("_t"), F.max("n").alias("_n"))
    tail = actuals.join(ends, "series_id").select("series_id", add_steps(F.col("_t"), F.col("step"), freq).alias("ts"), F.col("a").alias("y"), (F.col("_n") + F.col("step") - 1).cast("long").alias("pos"))
    return history.select("series_id", "ts", "y", "pos").unionByName(tail)


def sample_series(panel: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """`count` series drawn by a seeded hash of their id: the same draw under any partitioning."""
    ids = panel.select("series_id").distinct()
    drawn = ids.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "series_id")), "series_id").limit(count)
    return panel.join(drawn, "series_id", "left_semi")
