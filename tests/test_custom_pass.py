"""A custom pass reads its replies once, however often its items are used."""

from marginalia.catalog import QUERIES


def test_replies_are_parsed_once(spark, sf):
    made = QUERIES["custom_pass"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in made and "jsontostructs" not in made.lower()
