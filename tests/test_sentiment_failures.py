
from ringlens.operators.clean import prepare_calls
from ringlens.operators.failures import detect_failures
from ringlens.operators.sentiment import analyze_sentiment

CASES = [
    ("No me interesa", -1.0, "negativo"),
    ("Si me interesa", 3.0, "positivo"),
    ("Sí, me interesa", 1.0, "positivo"),
    ("quiero cancelar", -2.0, "negativo"),
    ("ok", 0.0, "neutral"),
    ("no funciona", 1.0, "positivo"),
    ("sin señal", 0.0, "neutral"),
]


def _score(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, transcript_text string")
    return [(r["sentiment_score"], r["sentiment_own"]) for r in
            analyze_sentiment(df, keep_score=True).orderBy("id").collect()]


def test_lexicon_cases(spark):
    got = _score(spark, [f"User: {t}" for t, _, _ in CASES])
    assert got == [(s, lab) for _, s, lab in CASES]


def test_word_lists_are_hashed_once_for_the_plan(spark):
    df = spark.createDataFrame([(1, "User: gracias gracias, mal ok")], "id int, transcript_text string")
    out = analyze_sentiment(df, keep_score=True)
    assert out.first()["sentiment_score"] == 1.0  # gracias (once) + ok - mal
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert " INSET " in plan and "array_intersect" not in plan


def test_null_transcript_neutral_or_null(spark):
    df = spark.createDataFrame([(1, None)], "id int, transcript_text string")
    assert analyze_sentiment(df).first()["sentiment_own"] == "neutral"
    assert analyze_sentiment(df, strict_nulls=True).first()["sentiment_own"] is None


def test_metamorphic_agent_lines_case_accents(spark):
    base = ["User: Muchas gracias, todo bien", "User: pésimo servicio, quiero cancelar", "User: No me interesa"]
    with_agent = [t + "\nAgent: excelente perfecto genial" for t in base]
    upper = ["User: " + t[6:].upper() for t in base]
    folded = ["User: Muchas gracias, todo bien", "User: pesimo servicio, quiero cancelar", "User: No me interesa"]
    ref = _score(spark, base)
    assert _score(spark, with_agent) == ref
    assert _score(spark, upper) == ref
    assert _score(spark, folded) == ref


def _flags(spark, calls_df, rows):
    df = detect_failures(analyze_sentiment(prepare_calls(calls_df(rows))))
    return {r["call_id"]: r for r in df.collect()}


def test_failure_flags(spark, calls_df):
    rep = '["Agent: Hola, le llamo por su servicio","User: hola","Agent: Hola, le llamo por su servicio!"]'
    short = '["Agent: Buenas tardes","Agent: Buenas tardes"]'
    neg = '["User: pésimo servicio, quiero cancelar"]'
    pca_otro = '{"razon_churn":"otro","sentimiento":"negativo"}'
    rows = [
        (1, "1", "x", 1, "u1", True, "agent_hangup", "1000", rep, None, "2024-01-01 10:00:00"),
        (2, "1", "x", 1, "u2", True, "agent_hangup", "1000", short, None, "2024-01-01 10:00:00"),
        (3, "1", "x", 1, "u3", True, "user_hangup", None, neg, pca_otro, "2024-01-01 10:00:00"),
        (4, "1", "x", 1, "u4", False, "user_hangup", None, neg, pca_otro, "2024-01-01 10:00:00"),
        (5, "1", "x", 1, "u5", True, "inactivity", "5000", None, None, "2024-01-01 10:00:00"),
    ]
    f = _flags(spark, calls_df, rows)
    assert f[1]["fail_repetitive"] and f[1]["fail_agent_hangup"]
    assert not f[2]["fail_repetitive"]
    assert f[3]["fail_objection"] and f[3]["fail_misunderstanding"]
    assert not any(f[4][c] for c in ["fail_repetitive", "fail_objection", "fail_misunderstanding", "fail_agent_hangup"])
    assert f[5]["fail_inactivity"] and not f[5]["fail_repetitive"]
