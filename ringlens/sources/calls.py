"""Call-log sources.

* ``load_raw``          - the raw calls CSV (four null tokens, renamed columns,
                          ``call_completed``), with a row key ``call_id``.
* ``calls_from_events`` - a call log derived from the ``events`` table; the
                          test tables hold no call log, so every query in the
                          registry runs over this view.
* ``read_table``        - parquet table of the test data folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens.constants import COLUMN_RENAME, NULL_TOKENS
from ringlens.sources.csv_records import read_csv

REQUIRED_HEADERS = list(COLUMN_RENAME)
# parameter: rows of a table that one task takes at most
ROWS_PER_TASK = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in as many partitions as its rows ask for.

    A compact file holds many rows in few splits, and the work of a row (transcript, JSON) does not
    depend on the bytes it takes there: so the tasks grow in number with the rows, not in length.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    rows = df.count()  # from the files' footers
    return spread(df, max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK)))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer splits than the cluster's parallelism.

    A small input (one Parquet row group, one multi-line CSV file) would
    otherwise run every row-level stage in a single task. Inputs with at least
    ``min_partitions`` splits are left as they are (no extra shuffle).
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def validate_columns(columns: list[str], required=REQUIRED_HEADERS) -> None:
    """Abort with the list of required columns that are missing."""
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"missing columns in calls input: {missing}")


def null_tokens(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Every string cell equal to one of ``tokens`` becomes null.

    The CSV reader's ``nullValue`` takes a single token, hence this step.
    """
    toks = list(tokens)
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(toks), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`")).alias(c)
        if isinstance(t, T.StringType) else F.col(f"`{c}`")
        for c, t in ((f.name, f.dataType) for f in df.schema.fields)
    ])


def type_raw(df: DataFrame) -> DataFrame:
    """Typed raw columns; bad values become null (non-strict casts)."""
    return df.withColumns({
        # numeric text keeps its integer reading ("007" -> "7"), other text stays
        "campaign_id": F.coalesce(F.expr("try_cast(campaign_id AS BIGINT)").cast("string"), F.col("campaign_id")),
        "target_id": F.expr("try_cast(target_id AS BIGINT)"),
        "connected": F.expr("try_cast(connected AS BOOLEAN)"),
    })


def add_call_completed(df: DataFrame) -> DataFrame:
    return df.withColumn("call_completed", F.col("call_url").isNotNull())


def content_key(df: DataFrame, name: str = "call_id") -> DataFrame:
    """A row key made of the row's content: 128 hash bits of all columns and an occurrence number.

    The key depends on no file order, split or position, so tables loaded separately share it.
    Equal rows are numbered 0, 1, ... - which of them gets which number makes no difference, as they
    are equal. They are numbered per input partition and shifted by the counts of the
    partitions before it, so a row repeated very often never meets itself in one task.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumns({"_h1": F.xxhash64(F.lit(1), *cols), "_h2": F.xxhash64(F.lit(2), *cols),
                           "_at": F.monotonically_increasing_id()}).withColumn("_part", F.shiftright("_at", 33))
    key = ["_h1", "_h2", "_part"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_h1", "_h2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*key).orderBy("_at")) - 1
    out = rows.withColumn("_own", own).join(shift, key)
    text = F.format_string("%016x%016x-%d", F.col("_h1"), F.col("_h2"), F.col("_own") + F.col("_shift"))
    return out.select(*cols, text.alias(name))


def typed_calls(raw: DataFrame) -> DataFrame:
    """S1-S4 on a table of text columns with the raw headers: null tokens, renames, casts, ``call_completed``."""
    validate_columns(raw.columns)
    return add_call_completed(type_raw(null_tokens(raw).withColumnsRenamed(COLUMN_RENAME)))


def load_raw(spark: SparkSession, path: str, with_row_key: bool = True, multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    """Read the raw calls CSV.

    All columns are read as strings with an explicit schema taken from the
    header (no inference pass over the data), then null tokens, renames and
    typed columns are applied. ``call_id`` is a key of the row's content
    (``content_key``). Fields may hold line breaks: files split all the same
    (``csv_records``). ``multi_line=False`` saves that scan for inputs whose
    fields hold none. ``whole_files`` reads each file in one task, for files with
    quotes inside unquoted fields.
    """
    def reader():
        return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')

    header = reader().csv(path).columns
    validate_columns(header)
    if multi_line and not whole_files:
        raw = read_csv(spark, path, header)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = reader().schema(schema).option("mode", "PERMISSIVE").csv(path)
    df = typed_calls(raw)
    return spread(content_key(df) if with_row_key else df)


def normalize_raw(df: DataFrame) -> DataFrame:
    """Accept raw or already renamed input and fill in whatever derived columns are missing.

    Adds, only when absent: ``call_completed``, ``duration_sec`` (from
    ``duration_ms``), ``hour`` (from ``executed_at``), ``campaign_type`` (from
    ``name``) and ``sentiment_own`` (from the transcript). Present columns are
    kept as they are, so a cleaned table and a raw one can be audited together.
    """
    from ringlens.functions.categorical import campaign_type
    from ringlens.operators.clean import local_timestamp
    from ringlens.operators.sentiment import analyze_sentiment

    present = set(df.columns)
    if present & set(COLUMN_RENAME) and not present & set(COLUMN_RENAME.values()):
        df = df.withColumnsRenamed(COLUMN_RENAME)
    add = {}
    if "call_completed" not in df.columns:
        add["call_completed"] = F.col("call_url").isNotNull()
    if "duration_sec" not in df.columns and "duration_ms" in df.columns:
        add["duration_sec"] = F.expr("try_cast(duration_ms AS DOUBLE)") / F.lit(1000.0)
    if "hour" not in df.columns and "executed_at" in df.columns:
        add["hour"] = F.hour(local_timestamp(df, "executed_at"))
    if "campaign_type" not in df.columns and "name" in df.columns:
        add["campaign_type"] = campaign_type("name")
    if add:
        df = df.withColumns(add)
    if "sentiment_own" not in df.columns:
        if "transcript_text" in df.columns:
            df = analyze_sentiment(df)
        elif "transcript" in df.columns:
            lines = F.from_json(F.col("transcript"), T.ArrayType(T.StringType()))
            df = analyze_sentiment(df.withColumn("_tt", F.array_join(lines, "\n")), text_col="_tt").drop("_tt")
    return df


# ---------------------------------------------------------------------------
# call log derived from the events table
# ---------------------------------------------------------------------------

# fixed values: the call-log view over ``events`` (campaign names, transcripts
# and JSON bodies by residue class) used by every registered query.
_NAMES = [
    "Early Churn Julio", "Posibles churn", "Upsell TV digital", "Sales Q1",
    "Cliente 2do pago", "Aviso corte", " Servicio al Cliente ", "Promo RELÁMPAGO",
    "prueba", "Varios",
]
_TRANSCRIPTS = [
    '["Agent: Hola, le llamo por su servicio","User: No me interesa"]',
    '["Agent: Hola, le llamo por su servicio","User: Sí, me interesa","Agent: Hola, le llamo por su servicio!"]',
    '["Agent: ¿Desea recargar hoy?","User: Muchas gracias, todo bien"]',
    '["User: pésimo servicio, quiero cancelar","Agent: Entiendo"]',
    '["Agent: ¿Sigue ahí?"]',
    "[]",
    '["User: ok","Agent: Gracias"]',
    '["Agent: Buenas tardes","User: la casa es azul","user: excelente"]',
]
_PCA_BODIES = [
    '{"sentimiento":"negativo","razon_churn":" No supo recargar ","posible_recuperacion":"No"}',
    '{"sentimiento":"neutral","razon_churn":"otro","posible_recuperacion":""}',
    '{"sentimiento":"positivo","razon_churn":"","posible_recuperacion":"Sí"}',
    '{"sentimiento":"","razon_churn":"Mudanza"}',
]
_REASONS = {
    "purchase": " User_Hangup",
    "click": "agent_hangup",
    "signup": "inactivity",
    "view": "voicemail_reached",
}


def _pick(index: F.Column, values: list[str]) -> F.Column:
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def calls_from_events(events: DataFrame) -> DataFrame:
    """Call log (raw schema + ``call_id`` + ``call_completed``) derived row by row from ``events``.

    A pure projection: it keeps the partitioning of the scan and adds no
    shuffle; only the five event columns it needs are read.
    """
    e = events
    not_error = F.col("event_type") != "error"
    reason = None
    for k, v in _REASONS.items():
        cond = F.col("event_type") == k
        reason = F.when(cond, F.lit(v)) if reason is None else reason.when(cond, F.lit(v))
    return e.select(
        F.col("event_id").alias("call_id"),
        (F.col("user_id") % 37).cast("string").alias("campaign_id"),
        _pick(F.col("event_id") % 10, _NAMES).alias("name"),
        F.col("user_id").alias("target_id"),
        F.when(not_error, F.concat(F.lit("call://"), F.col("event_id").cast("string"))).alias("call_url"),
        F.col("event_type").isin("purchase", "click", "signup").alias("connected"),
        reason.alias("disconnected_reason"),
        F.when(not_error, F.col("value") * 1000).alias("duration_ms"),
        F.when(not_error, _pick((F.col("event_id") + F.col("user_id")) % 8, _TRANSCRIPTS)).alias("transcript"),
        F.when(F.col("event_type") == "purchase", _pick(F.col("event_id") % 4, _PCA_BODIES)).alias("post_call_analysis"),
        F.col("ts").alias("executed_at"),
        F.coalesce(not_error, F.lit(False)).alias("call_completed"),
    )


def load_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw call log over the test tables (``call_completed`` derived in the same projection)."""
    return calls_from_events(read_table(spark, sf_dir, "events"))


def raw_text_from_events(events: DataFrame) -> DataFrame:
    """The call log as a raw text export: raw headers, every column text, and cells that do not parse.

    ``events`` row by row (a projection). ``event_id`` is kept as an extra column. By
    ``event_id % 11``: 0 a bad duration, 1 a bad time, 2 a bad connected flag, 3 a bad target id,
    4 a target id with leading zeros; missing cells hold one of the null tokens, by ``event_id % 4``.
    """
    calls = calls_from_events(events).withColumn("executed_at", F.date_format("executed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")) \
        .withColumn("duration_ms", F.floor("duration_ms").cast("long"))
    which = F.col("call_id") % 11
    spoiled = {
        "duration_ms": F.when(which == 0, "n.d."),
        "executed_at": F.when(which == 1, "31/12/2024 25:00"),
        "connected": F.when(which == 2, "maybe"),
        "target_id": F.when(which == 3, F.concat(F.lit("x"), F.col("target_id").cast("string")))
                      .when(which == 4, F.concat(F.lit("00"), F.col("target_id").cast("string"))),
    }
    token = F.element_at(F.array(*[F.lit(t) for t in NULL_TOKENS]), (F.col("call_id") % len(NULL_TOKENS) + 1).cast("int"))
    return calls.select(F.col("call_id").alias("event_id"), *[
        F.coalesce(spoiled.get(new, F.lit(None)), F.col(new).cast("string"), token).alias(raw)
        for raw, new in COLUMN_RENAME.items()])
