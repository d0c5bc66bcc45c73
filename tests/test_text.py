"""Text functions: the reference's unit cases plus derived cases (FIXTURES.md §1, §3)."""

from pyspark.sql import functions as F

from revtriage.functions import text as T
from revtriage.sources.files import read_uploaded_file, resolve_column


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_model_clean_case_punctuation_spacing(spark):
    assert one(spark, T.model_clean("x"), "  Payment FAILED!!!  ") == "payment failed"


def test_model_clean_keeps_numbers(spark):
    assert one(spark, T.model_clean("x"), "OTP 1234 not received") == "otp 1234 not received"


def test_two_cleaners_differ_on_apostrophe(spark):
    assert one(spark, T.model_clean("x"), "I can't pay") == "i cant pay"
    assert one(spark, T.rule_clean("x"), "I can't pay") == "i can t pay"


def test_rule_clean_null_reads_nan(spark):
    assert one(spark, T.rule_clean("x"), None) == "nan"


def test_unicode_trim(spark):
    assert one(spark, T.unicode_trim("x"), "　\t x y \x1c\n") == "x y"


def test_trim_set_is_python_s():
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(T.WHITESPACE) and len(T.WHITESPACE) == len(set(T.WHITESPACE))


def test_cleaners_pass_over_the_text_once_per_step(spark):
    rows = ["A--b\t\u00e9\u2003c 9!?", " 'x' \x0b\x1c y\u00a0", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    assert [r[0] for r in df.select(T.model_clean("x")).collect()] == ["ab c 9", "x y", "", None]
    assert [r[0] for r in df.select(T.rule_clean("x")).collect()] == ["a b c 9", "x y", "", "nan"]
    assert df.select(T.model_clean("x").alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert "regexp" not in df.select(T.unicode_trim("x").alias("c"))._jdf.queryExecution().optimizedPlan().toString()


def test_cut_counts_code_points(spark):
    assert one(spark, T.cut("x", 3), "héllo") == "hél"


def test_label_normalisation(spark):
    df = spark.createDataFrame([(" OTP Issue ",), ("billing",), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(T.normalize_label("x")).collect()]
    assert got == ["account_access_issue", None, None, None]


def test_display_name(spark):
    assert one(spark, T.display_name("x"), "payment_failure") == "Payment Failure"
    assert one(spark, T.display_name("x"), "some_label") == "Some Label"


def test_app_id_from_store_url(spark):
    url = "https://play.google.com/store/apps/details?id=my.com.tngdigital.ewallet"
    assert one(spark, T.app_id_from_reference("x"), url) == "my.com.tngdigital.ewallet"


def test_app_id_validity(spark):
    rows = ["a.b.c", "", "noDot", "a b.c", "https://play.google.com/store/apps/details?hl=en"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    out = df.select(T.app_id_is_valid(T.app_id_from_reference("x")).alias("ok")).collect()
    assert [r.ok for r in out] == [True, False, False, False, False]


def test_row_caption(spark):
    text = "line one\n" + "word " * 30
    cap = spark.createDataFrame([(3, "Payment Failure", text)], "n int, l string, t string").select(
        T.row_caption("n", "l", "t").alias("c")
    ).first()["c"]
    assert cap.startswith("Row 3 | Payment Failure | line one word")
    assert cap.endswith("...") and "\n" not in cap


def test_percent(spark):
    assert one(spark, T.percent("x"), 0.1234, "x double") == "12.34%"
    assert one(spark, T.percent("x"), None, "x double") == ""


def test_uploaded_csv_uses_supported_text_column(spark, tmp_path):
    p = tmp_path / "upload.csv"
    p.write_bytes(b"review\nPayment failed!\nOTP not received\n")
    df = read_uploaded_file(spark, str(p))
    assert [r.clean_text for r in df.collect()] == ["payment failed", "otp not received"]


def test_resolve_column_candidate_order():
    assert resolve_column([" Review ", "BODY"], ["text", "content", "review", "comment", "feedback", "body"], "text") == " Review "
