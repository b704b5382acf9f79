import pytest

from nestlake.functions.resolve import chained, parse_input, resolve_names
from nestlake.operators import relational


def test_inputs_in_words():
    one = parse_input("10 g of sodium chloride")
    assert (one.amount.unit, one.solute, one.solvent) == ("gram", "sodium chloride", None)
    two = parse_input("5 mL of 0.5 M sodium hydroxide in water")
    assert (two.amount.value, two.concentration.unit, two.concentration.value, two.solute, two.solvent) == (5.0, "molar", 0.5, "sodium hydroxide", "water")
    for bad in ("salt", "5 mL of 0.5 M salt", "5 g of 0.5 M salt in water", "5 mL of salt in water", "5 parsec of salt"):
        with pytest.raises((ValueError, KeyError)):
            parse_input(bad)


def test_resolvers(spark):
    r = chained({"a": "1"}.__getitem__, {"b": "2"}.__getitem__)
    assert (r("a"), r("b")) == ("1", "2")
    with pytest.raises(KeyError):
        r("c")
    got = resolve_names(spark.createDataFrame([(" Water ",), ("tar",), (None,)], "n string"), "n", spark.createDataFrame([("water", "O"), ("WATER", "O")], "name string, smiles string"))
    assert {(x.n, x.smiles) for x in got.collect()} == {(" Water ", "O"), ("tar", None), (None, None)}


def test_delete_takes_what_lies_below(spark):
    df = spark.createDataFrame([("a", [([(1,)],), ([(2,), (3,)],)]), ("b", [([(4,)],)])], "id string, xs array<struct<ys:array<struct<v:int>>>>")
    left = relational.deleted(relational.decomposed(df, "id"), df.filter("id = 'a'"), "id")
    assert {n: t.count() for n, t in left.items()} == {"record": 1, "record.xs": 1, "record.xs.ys": 1}
    assert relational.recomposed(left, df.schema).collect() == df.filter("id = 'b'").collect()
