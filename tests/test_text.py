import pytest
from pyspark.sql import functions as F

from kinlink.functions import text


def one(spark, build, value):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Müller & Söhne, Pvt.", "muller and sohne private"), ("12 Rue St.-Denis", "12 rue street denis"), (None, ""), ("", ""), ("ﬁne № 5 ½", "fine no 5 12"),
        ("दिल्ली", "द ल ल"), ("Straße", "strae"), ("A\tB\nC", "a b c"), ("co_op 50B", "co_op 50b"),
    ],
)
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize, given) == wanted


@pytest.mark.parametrize("given, wanted", [("acme private limited", "acme"), ("the company", "the company"), ("", "")])
def test_core_name(spark, given, wanted):
    assert one(spark, text.core_name, given) == wanted


@pytest.mark.parametrize("given, wanted", [("lakshmi", "lxm"), ("laxmi", "lxm"), ("r0yce", "rc"), ("royce", "rc"), ("0135", "0135"), ("a", "a")])
def test_phonetic(spark, given, wanted):
    assert one(spark, text.phonetic, given) == wanted


@pytest.mark.parametrize("given, wanted", [("09", "9"), ("50b", "50b"), ("000", "0")])
def test_number(spark, given, wanted):
    assert one(spark, text.number, given) == wanted


def test_digit_runs_are_not_number_tokens(spark):
    assert one(spark, text.digit_runs, "50b 050 x7y7") == ["50", "7"]
    assert one(spark, lambda c: text.number_tokens(text.words(c)), "50b 050 x7y7") == ["50b", "50", "x7y7"]


def test_country(spark):
    assert one(spark, text.country, " India\t") == "india"
    assert one(spark, text.country, None) == ""
