from pyspark.sql import functions as F

from ringlens.functions.categorical import campaign_type, churn_reason, has_reason, sentiment_ordinal
from ringlens.functions.text import fold_accents, normalize_category, normalize_text, speaker_lines, user_text


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_normalize_text_keeps_inner_spaces(spark):
    assert one(spark, normalize_text, "¿Sí, señal_1?") == "si  senal_1"


def test_normalize_text_unicode_word_chars(spark):
    # ñ folds to n; other letters stay word characters (no split)
    assert one(spark, normalize_text, "Cañón ÇA!") == "canon ça"


def test_fold_accents_only_listed(spark):
    assert one(spark, fold_accents, "ÁéÍóÚüÑ àç") == "AeIoUuN àç"


def test_speaker_lines(spark):
    text = "Agent: Hola\n User: si \nuser: no\nUser:x"
    assert one(spark, lambda c: speaker_lines(c, "User"), text) == ["si", "x"]
    assert one(spark, lambda c: speaker_lines(c, "User"), None) == []


def test_user_text_join(spark):
    assert one(spark, lambda c: user_text(c, " | "), "User: a\nAgent: b\nUser: c") == "a | c"


def test_normalize_category(spark):
    assert one(spark, normalize_category, "  Mala Atención ") == "mala_atencion"
    for v in ["", None, "   "]:
        assert one(spark, normalize_category, v) is None


def test_churn_alias(spark):
    assert one(spark, churn_reason, "No supo recargar") == "no_sabe_recargar"
    assert one(spark, churn_reason, "no recarga") == "no_sabe_recargar"
    assert one(spark, churn_reason, "Mudanza") == "mudanza"


def test_campaign_type(spark):
    cases = {"Early Churn upsell": "churn_prevention", "Promo RELÁMPAGO": "promo", "Relampago": "promo",
             "Varios": "otro", "Cliente 2do pago": "cobranza", " Servicio al Cliente ": "servicio_cliente",
             "prueba": "prueba", None: "otro"}
    for name, expected in cases.items():
        assert one(spark, campaign_type, name) == expected, name
    assert one(spark, lambda c: campaign_type(c, strict_nulls=True), None) is None


def test_ordinals(spark):
    assert one(spark, sentiment_ordinal, None) == 1.0
    assert one(spark, sentiment_ordinal, "raro") == 1.0
    assert one(spark, sentiment_ordinal, "positivo") == 2.0
    for v, e in [(None, 0.0), ("n/a", 0.0), ("otro", 0.0), ("mudanza", 1.0)]:
        assert one(spark, has_reason, v) == e
