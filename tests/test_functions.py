import pytest
from pyspark.sql import functions as F

from nestlake.functions import identifiers as ids
from nestlake.functions import units as u
from nestlake.functions.fingerprint import popcount_bounds, words_of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1.25 h", (1.25, "hour", None)), ("10 ± 2 mL", None), ("10±2 mL", (10.0, "milliliter", 2.0)), ("−5 °C", (-5.0, "celsius", None)), ("1e-3 mol", (0.001, "mole", None)),
        ("3g.", (3.0, "gram", None)), ("1 mL/min", (1.0, "milliliter_per_minute", None)), ("5 cm^-1", (5.0, "wavenumber", None)),
    ],
)
def test_parse(text, want):
    if want is None:
        with pytest.raises(ValueError):
            u.Units().parse(text)
        return
    q = u.Units().parse(text)
    assert (q.value, q.unit, q.precision) == want


def test_parse_refusals_and_ranges():
    units = u.Units()
    q = units.parse("1-2 h", allow_range=True)
    assert (q.value, q.precision) == (1.5, 0.5)
    for bad in ("1-2 h", "-3 g", "5", "abc", "1 m", "1 parsec"):
        with pytest.raises((ValueError, KeyError)):
            units.parse(bad)
    assert u.Units(u.CONCENTRATIONS, forbidden={}).parse("2 mM").unit == "millimolar"


def test_every_unit_converts_to_every_other_of_its_dimension_and_back():
    units = u.Units()
    for d, a, _, _ in u.UNITS:
        for e, b, _, _ in u.UNITS:
            q = u.Quantity(d, 7.0, a, 0.5)
            if d != e:
                with pytest.raises(ValueError):
                    units.convert(q, b)
                continue
            back = units.convert(units.convert(q, b), a)
            assert back.value == pytest.approx(7.0) and back.unit == a
    assert units.convert(u.Quantity("temperature", 212.0, "fahrenheit", 9.0), "kelvin") == u.Quantity("temperature", pytest.approx(373.15), "kelvin", pytest.approx(5.0))
    assert units.convert(u.Quantity("wavelength", 5.0, "nanometer", 5.0), "wavenumber").precision is None


def test_unit_columns_agree_with_scalars(spark):
    units = u.Units()
    rows = [(d, a, 3.5, 0.25) for d, a, _, _ in u.UNITS] + [("mass", None, 1.0, None), ("wavelength", "wavenumber", 0.0, 0.1)]
    df = spark.createDataFrame(rows, "d string, unit string, v double, p double")
    for dimension, target in u.CANONICAL.items():
        got = df.filter(F.col("d") == dimension).select("unit", "v", "p", u.canonical_value(F.col("v"), F.col("unit"), dimension).alias("x"), u.canonical_precision(F.col("v"), F.col("p"), F.col("unit"), dimension).alias("y")).collect()
        for r in got:
            if r.unit is None or r.v == 0:
                assert r.x is None
                continue
            want = units.convert(u.Quantity(dimension, r.v, r.unit, r.p), target)
            assert r.x == pytest.approx(want.value) and r.y == pytest.approx(want.precision)


def scalar(text, allow):
    try:
        q = u.Units().parse(text, allow)
    except u.Refused:
        return None
    return q.value, q.precision, q.unit, q.dimension


def test_parsed_and_formatted_columns(spark):
    df = spark.createDataFrame([("1.25 h",), ("10±2 mL",), ("-4 g",), ("-4 K",), ("nothing",), (None,), ("1 mL/min",)], "t string")
    got = [None if r[0] is None else (r[0]["value"], r[0]["precision"], r[0]["unit"]) for r in df.select(u.parsed(F.col("t"))).collect()]
    assert got == [(1.25, None, "hour"), (10.0, 2.0, "milliliter"), None, (-4.0, None, "kelvin"), None, None, (1.0, None, "milliliter_per_minute")]
    texts = ["1-2 h", "3e-2 g", "7 ± 1 g", "5 cm^-1.", "2 m", "−5 degrees_C", "1.5±0.5  mm Hg", "2-", "4 parsec", "-3 - 4 K", "6±6 g."]
    for allow in (False, True):
        got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(u.parsed(F.col("t"), allow_range=allow)).collect()]
        assert got == [scalar(t, allow) for t in texts] and sum(x is not None for x in got) == 5 + allow
    df = spark.createDataFrame([(5.0, 0.1, "mL"), (2.5, None, "g"), (None, None, "g")], "v double, p double, x string")
    assert [r[0] for r in df.select(u.formatted(F.col("v"), F.col("p"), F.col("x"))).collect()] == ["5 (± 0.1) mL", "2.5 g", None]
    moles = spark.createDataFrame([(0.01, 0.5), (2.0, 1.0)], "v double, c double").select(u.solute_moles(F.col("v"), F.col("c")).alias("m")).collect()
    assert [(round(r.m.value, 6), r.m.unit) for r in moles] == [(5.0, "millimole"), (2.0, "mole")]


def test_identifiers(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(ids.is_orcid, "0000-0002-1825-0097") and not one(ids.is_orcid, "0000-0002-1825-0098") and not one(ids.is_orcid, "x") and one(ids.is_orcid, None) is None
    assert one(ids.is_orcid, "0000-0002-1694-233X")
    assert one(ids.doi, "https://doi.org/10.1000/abc.def.") == "10.1000/abc.def" and one(ids.doi, "none") is None
    assert one(ids.is_url, "HTTPS://a.b/c") and not one(ids.is_url, "ftp://a") and one(ids.has_atom_mapping, "[CH3:1]O") and not one(ids.has_atom_mapping, "CO")
    assert one(lambda c: ids.split_extension(c)["extension"], "CC |$R1$|") == "|$R1$|" and one(lambda c: ids.split_extension(c)["core"], "CC |$R1$|") == "CC"
    assert str(one(ids.timestamp, "03/04/2020, 10:11:12")) == "2020-03-04 10:11:12" and one(ids.timestamp, "soon") is None


def test_fingerprint_helpers():
    assert words_of([0, 63, 64], 128) == [-(2**63) + 1, 1]
    low, high = popcount_bounds(0.55, 100)
    assert low <= 55 and high >= 181
