"""Pipeline stages over the test tables, shared by the registered queries.

``calls -> prepared -> scored -> flagged`` are lazy plans. The reports do
not re-run the text processing (JSON parsing, transcript scoring, agent-line
tests) for every report: the scored and flagged call table, without the raw
transcript and JSON text, is written once as Parquet into the shared
checkpoint folder (``spark.checkpoint.dir``) under a key made of the input
files' fingerprint and a hash of the rules (S10), and every report scans that
narrow table. This is the stage hand-over of the original pipeline (clean
table, sentiment and agent checkpoints) as one columnar table; it also cuts
the lineage, so a lost executor recomputes from the table, not from the raw
text. The scalar limits (p99, IQR fence) are computed once from it.
The table is scoped to the application unless ``ringlens.stages.reuse=true``
lets later sessions with the same input and rules read it.
"""

from __future__ import annotations

import inspect
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlens import constants
from ringlens.functions import categorical, text
from ringlens.operators import clean as clean_rules
from ringlens.operators import failures as failure_rules
from ringlens.operators import sentiment as sentiment_rules
from ringlens.sources import calls as call_rules
from ringlens.operators.clean import Fence, clean_limits, filter_outliers, flag_duration_outliers, prepare_calls
from ringlens.operators.failures import detect_failures
from ringlens.operators.sentiment import analyze_sentiment
from ringlens.session import ensure_checkpoint_dir
from ringlens.sources.calls import load_calls
from ringlens.sources.sinks import reuse_or_build, stage_key

# wide text columns that no report needs after scoring; not part of the stage table
RAW_TEXT = ["transcript", "post_call_analysis", "transcript_text"]
# modules whose code decides what the stage table holds
_RULES = (call_rules, text, categorical, clean_rules, sentiment_rules, failure_rules)

_MEMO: dict = {}
# stages nest (table -> flagged -> scored -> prepared), hence a re-entrant lock; it also keeps
# two threads of one session from writing the same stage table at once
_LOCK = threading.RLock()


def _memo(spark: SparkSession, sf_dir: str, name: str, build):
    """One result per session, input files, rules and name: a changed input or rule is built anew."""
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    key = (id(spark), spark.sparkContext.applicationId, stage_key(src, _fingerprint(spark, src), _rules()), name)
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = build()
        return _MEMO[key]


def _rules() -> list:
    """The fixed values as they are now and the code of the rules."""
    return [{k: repr(v) for k, v in vars(constants).items() if k.isupper()}, *map(inspect.getsource, _RULES)]


def clear() -> None:
    with _LOCK:
        _MEMO.clear()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "calls", lambda: load_calls(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "prepared", lambda: prepare_calls(calls(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str, keep_score: bool = False) -> DataFrame:
    return _memo(spark, sf_dir, f"scored{int(keep_score)}",
                 lambda: analyze_sentiment(prepared(spark, sf_dir), keep_score=keep_score))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "flagged", lambda: detect_failures(scored(spark, sf_dir)))


def _fingerprint(spark: SparkSession, path: str) -> list:
    """(name, size, modification time) of every file under ``path`` - changes when the input changes."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        st = it.next()
        out.append((st.getPath().getName(), st.getLen(), st.getModificationTime()))
    return sorted(out)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow scored + flagged call table, written once per input and read back (see module doc)."""
    def build():
        src = f"{sf_dir.rstrip('/')}/events.parquet"
        scope = [] if spark.conf.get("ringlens.stages.reuse", "false") == "true" else [spark.sparkContext.applicationId]
        key = stage_key(_rules(), src, _fingerprint(spark, src), *scope)
        base = ensure_checkpoint_dir(spark).rstrip("/") + "/ringlens-stages"
        narrow = lambda: flagged(spark, sf_dir).drop(*RAW_TEXT)
        return reuse_or_build(spark, base, key, narrow, expected_cols=["sentiment_own", "fail_agent_hangup"])
    return _memo(spark, sf_dir, "table", build)


def limits(spark: SparkSession, sf_dir: str) -> tuple[float | None, Fence]:
    """(p99 of duration_ms, IQR fence) of the call table, computed once (two passes)."""
    return _memo(spark, sf_dir, "limits", lambda: clean_limits(table(spark, sf_dir)))


def with_outliers(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_duration_outliers(df, p99=limits(spark, sf_dir)[0])


def clean(spark: SparkSession, sf_dir: str, with_failures: bool = False) -> DataFrame:
    """Clean table (p99 flag over all rows, F1-F3) with own sentiment and failure flags."""
    def build():
        df = with_outliers(table(spark, sf_dir), spark, sf_dir)
        return filter_outliers(df, limits(spark, sf_dir)[1])
    return _memo(spark, sf_dir, "clean", build)


def r9(c) -> F.Column:
    """Round a floating statistic to 9 decimals (engine-independent last bits)."""
    return F.round(c if not isinstance(c, str) else F.col(c), 9)
