"""Each family of record rules on rows made to break one rule at a time."""

import pytest

from nestlake.operators import record_rules as families
from nestlake.operators.rules import violations

AMOUNT = "amount struct<mass:struct<value:double>,moles:struct<value:double>,volume:struct<value:double>,unmeasured:struct<type:string>,volume_includes_solutes:boolean>"
GRAMS = (((1.0,), None, None, None, None),)


def amount(mass=None, moles=None, volume=None, unmeasured=None, solutes=None):
    return tuple(None if x is None else (x,) for x in (mass, moles, volume, unmeasured)) + (solutes,)


CASES = {
    "inputs": (
        f"texture struct<type:string>, components array<struct<texture:struct<type:string>,{AMOUNT.replace(' struct', ':struct', 1)}>>",
        [
            ((("SOLID",), [(("LIQUID",), amount(1.0))]), {"texture_fits_components"}),
            ((("GAS",), [(("LIQUID",), amount(unmeasured="SATURATED"))]), {"saturated_in_something"}),
            ((None, []), {"input_has_components"}), ((None, None), {"input_has_components"}),
            ((("SOLID",), [(("LIQUID",), amount(1.0)), (("CUSTOM",), amount(unmeasured="SATURATED"))]), set()),
        ],
    ),
    "amounts": (AMOUNT, [((amount(1.0, solutes=True),), {"solutes_in_volumes_only"}), ((amount(volume=1.0, solutes=False),), set()), ((amount(moles=-1.0),), {"amount_moles_non_negative"}), ((amount(),), set()), ((None,), set())]),
    "crude_components": (
        f"reaction_id string, has_derived_amount boolean, {AMOUNT}",
        [(("r", True, amount()), set()), (("", False, amount(1.0)), {"crude_has_source"}), (("r", True, amount(1.0)), {"crude_amount_once"}), (("r", None, amount()), {"crude_amount_once"}), (("r", None, amount(moles=1.0)), {"crude_amount_kind"})],
    ),
    "identifiers": (
        "type string, value string, details string",
        [
            (("SMILES", "CC", None), set()), (("SMILES", "CC |x|", None), {"smiles_extension"}), (("CAS_NUMBER", "64-17-5", None), set()), (("CAS_NUMBER", "64-175", None), {"cas_number_form"}),
            (("INCHI_KEY", "x", None), {"inchi_key_form"}), (("PUBCHEM_CID", "12a", None), {"pubchem_cid_form"}), (("NAME", " a", None), {"identifier_outer_space"}), (("NAME", None, None), {"identifier_value"}),
            (("UNSPECIFIED", "a", None), {"type_specified"}), (("CUSTOM", "a", ""), {"type_details"}), ((None, "a", None), {"type_specified"}),
        ],
    ),
    "compounds": ("identifiers array<struct<type:string,value:string>>", [((None,), {"compound_identified", "compound_not_by_name_only"}), (([("NAME", "a")],), {"compound_not_by_name_only"}), (([("NAME", "a"), ("SMILES", "C")],), set()), (([(None, "C")],), set())]),
    "preparations": ("type string, details string, reaction_id string", [(("SYNTHESIZED", None, "r"), set()), (("DRIED", None, "r"), {"reaction_id_only_for_synthesized"}), (("DRIED", None, ""), set())]),
    "conditions": ("conditions_are_dynamic boolean, details string, ph double", [((True, "", 7.0), {"dynamic_needs_details"}), ((None, "d", None), {"details_are_dynamic"}), ((True, "d", 14.5), {"ph_range"}), ((None, None, None), set())]),
    "products": ("reaction_role string, is_desired_product boolean", [(("SIDE_PRODUCT", True), {"side_product_not_desired"}), (("SIDE_PRODUCT", None), set()), ((None, True), set())]),
    "mass_spectra": (
        "type string, details string, tic_minimum_mz double, tic_maximum_mz double, eic_masses array<double>",
        [(("TIC", None, 5.0, 2.0, None), {"tic_range"}), (("TIC_POSITIVE", None, None, -1.0, [1.0]), {"tic_maximum_mz_non_negative", "eic_masses_not_for_tic"}), (("EIC", None, None, None, []), {"eic_needs_eic_masses"}), (("EIC", None, None, None, [1.0, -1.0]), {"eic_masses_non_negative"})],
    ),
    "outcomes": (
        "products array<struct<is_desired_product:boolean,measurements:array<struct<analysis_key:string>>>>, analyses map<string,struct<type:string>>, conversion struct<value:double>",
        [
            (([(True, [("a",)]), (None, None)], {"a": ("X",)}, None), set()), (([(True, None), (True, None)], None, None), {"one_desired_product"}),
            (([(None, [("b",), ("",), (None,)])], {"a": ("X",)}, None), {"analysis_exists"}), (([(None, [("b",)])], None, None), {"analysis_exists"}), ((None, None, None), {"outcome_says_something"}), ((None, None, (1.0,)), set()),
        ],
    ),
    "illumination": ("type string, details string, peak_wavelength struct<value:double>", [(("LED", None, (-1.0,)), {"peak_wavelength.value_non_negative"}), (("LED", None, None), set())]),
    "rpm": ("rpm double", [((-1.0,), {"rpm_non_negative"}), ((None,), set())]),
}


@pytest.mark.parametrize("family", CASES)
@pytest.mark.parametrize("level", [None, "held"])
def test_family(spark, family, level):
    schema, rows = CASES[family]
    df = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(rows)], f"id long, {schema}")
    if level:
        df = df.selectExpr("id", f"array(struct({', '.join(df.columns[1:])})) AS held")
    rules = getattr(families, family)(level)
    assert families.applicable(df.schema, rules) == rules
    got = {i: set() for i in range(len(rows))}
    for r in violations(df, "id", rules).collect():
        got[r.id].add(r.rule)
        assert r.trace == ("held[0]" if level else "")
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_rules_without_their_fields_are_left_out(spark):
    df = spark.createDataFrame([(1, "WAIT")], "id long, type string")
    assert families.applicable(df.schema, families.workups("absent")) == [] and [r.name for r in families.applicable(df.schema, families.workups(None))] == ["type_specified"]
