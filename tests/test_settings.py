"""Configuration files."""

import pytest

from quillon.config import DEFAULT
from quillon.sources import settings

TEXT = """
#numbers
max_base: 12   # bases up to here
custom_digits : "01#23"
variable_atoms:
  - left_operand: "a"
  - right_operand: "b"
signs: ["+", "-", "=="]
condition_numeric_range:
  max_value: 50
  min_value: -3
condition_probabilities:
  1: 0.5
  2: 0.5
expr_variables:
  - a
  - b
expr_type_weights:
  binary: 1
  unary_prefix: 0
expr_atom_type_weights:
  variable: 0.8
  number: 0.2
random_base:
  flag: true
  base: 10
longer_result_compute:
  flag: false
"""


def test_a_file_is_read(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(TEXT)
    found = settings.parse(TEXT)
    assert found["custom_digits"] == "01#23" and found["variable_atoms"] == [{"left_operand": "a"}, {"right_operand": "b"}] and found["signs"] == ["+", "-", "=="] and found["expr_variables"] == ["a", "b"]
    s = settings.read(spark, f"file://{tmp_path}/s.yaml")
    assert s.max_base == 12 and s.condition_range == (-3, 50) and s.condition_weights == (0.5, 0.5) and s.base is None and s.longer_result_base is None and s.variable_share == 0.8
    assert s.node_weights == {"binary": 1.0, "prefix": 0.0, "postfix": 0.1, "atom": 0.0} and s.value_range == DEFAULT.value_range


def test_empty_and_broken_files():
    assert settings.settings_of(settings.parse("")) == DEFAULT and settings.parse("# nothing\n\n") == {}
    for text in ("a: 1\n    b: 2", "a: 1\nno key", 'a: "open', "- x\na: 1"):
        with pytest.raises(settings.SettingsError):
            settings.parse(text)
    with pytest.raises(settings.SettingsError):
        settings.settings_of({"condition_probabilities": {1: 2.0}})


def test_settings_drive_the_generators(spark):
    from pyspark.sql import functions as F

    from quillon.operators import generation

    one = settings.settings_of({"max_if_branches": 4, "condition_probabilities": {1: 1.0}, "condition_numeric_range": {"min_value": 5, "max_value": 5}})
    rows = generation.definitions(spark.range(200).select(F.col("id").alias("key"), F.lit("⊛").alias("symbol")), one).where("definition_type = 'branch_definition'").collect()
    assert {r["definition"].count(";") for r in rows} == {1, 2, 3, 4} and all(" 5 ;" in r["definition"] and " and " not in r["definition"] for r in rows)
