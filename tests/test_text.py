"""Array literals, pairs, blanks, digests: hand cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallymap.functions import text
from tallymap.schema import TEXT_ATTRIBUTES


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "literal, items",
    [
        ("{}", []),
        ("{ARTHIES}", ["ARTHIES"]),
        ("{NULL,NULL,NULL,NULL}", [None] * 4),
        ('{"FOS SUR MER","FOS SUR MER"}', ["FOS SUR MER"] * 2),
        ('{A,"b, c",NULL}', ["A", "b, c", None]),
        ('{"NULL","say \\"x\\"","back\\\\slash"}', ["NULL", 'say "x"', "back\\slash"]),
        ("{" + ",".join(["GASSIN"] * 13) + "}", ["GASSIN"] * 13),
        ("ONAGRE", ["ONAGRE"]),
        (None, None),
    ],
)
def test_parse_array(spark, literal, items):
    assert one(spark, text.parse_array(F.lit(literal).cast("string"))) == items


def test_literal_and_back(spark):
    items = ["a", 'q"q', "b,c", None, "back\\slash", "NULL"]
    array = F.array(*(F.lit(i).cast("string") for i in items))
    assert one(spark, text.parse_array(text.array_literal(array))) == items


@pytest.mark.parametrize(
    "value, literal",
    [("a+b", '{"a","b"}'), ("a", '{"a"}'), ("", "{NULL}"), ("0", "{NULL}"), (None, "{NULL}")],
)
def test_plus_to_literal(spark, value, literal):
    assert one(spark, text.plus_to_literal(F.lit(value).cast("string"))) == literal


@pytest.mark.parametrize(
    "si, num, out",
    [
        ("{ONAGRE,ONAGRE}", "{1,1}", ("{ONAGRE}", "{1}")),
        ("{S3IC,ONAGRE,S3IC}", "{1,2,1}", ("{S3IC,ONAGRE}", "{1,2}")),
        ("{S3IC,S3IC}", "{1,2}", ("{S3IC,S3IC}", "{1,2}")),
        (None, None, ("{}", "{}")),
        (None, "{7,8}", ("{}", "{7}")),
        ("{A,B}", "{1}", ("{A,B}", "{1,}")),
        ("{A}", "{1,2}", ("{A}", "{1}")),
        ("ONAGRE", "x1", ("ONAGRE", "x1")),
    ],
)
def test_unique_pairs(spark, si, num, out):
    got = one(spark, text.unique_pairs(F.lit(si).cast("string"), F.lit(num).cast("string")))
    assert tuple(got) == out


def digest(spark, **values):
    row = {c: F.lit(values.get(c)).cast("string") for c in TEXT_ATTRIBUTES}
    return one(spark, text.fingerprint(row))


def test_fingerprint_text(spark):
    got = digest(spark, projet="p", communes='{"A B",C}', duree="0")
    assert got == hashlib.md5("p///{A B,C}///////0///".encode()).hexdigest()


def test_fingerprint_depends_on_item_order(spark):
    a = digest(spark, si_metier="{S3IC,ONAGRE}", numero_dossier="{0068.06388,2015-12-28x-01276}")
    b = digest(spark, si_metier='{"ONAGRE","S3IC"}', numero_dossier='{"0068.06388","2015-12-28x-01276"}')
    c = digest(spark, si_metier='{"S3IC","ONAGRE"}', numero_dossier='{"0068.06388","2015-12-28x-01276"}')
    assert a != b and a == c


def test_fingerprint_keeps_no_boundaries(spark):
    assert digest(spark, projet="a/", categorie="b") == digest(spark, projet="a", categorie="/b")


@pytest.mark.parametrize("amount, label", [(2.5, "3 Mois(s)"), (2.4, "2 Mois(s)"), (None, text.UNKNOWN_DURATION)])
def test_duration_rounds_halves_up(spark, amount, label):
    assert one(spark, text.duration_label(F.lit(amount).cast("double"), F.lit("Mois"))) == label


def test_duration_without_unit(spark):
    assert one(spark, text.duration_label(F.lit(2.0), F.lit(None).cast("string"))) == text.UNKNOWN_DURATION


@pytest.mark.parametrize("value, out", [("", None), ("0", None), ("00", "00"), ("a", "a"), (None, None)])
def test_blank_to_null(spark, value, out):
    assert one(spark, text.blank_to_null(F.lit(value).cast("string"))) == out
