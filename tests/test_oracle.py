"""Every registered query next to its oracle SQL."""

import pytest

import __spark_entry__ as spark_entry
import check

NAMES = sorted(spark_entry.queries())


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return check.oracle_connection(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, sf_dir, name):
    verdict, rows = check.compare(spark, oracle, name, sf_dir)
    # text operators that SQL cannot express are tested by brute force in tests/llm
    assert verdict == "ok" or (verdict == "rows" and name.startswith(("op", "pipeline")))
    if name != "w8_beacon_jitter":
        assert rows > 0


def test_entry_is_the_flagship(spark, sf_dir):
    df = spark_entry.entry(spark)
    assert df.columns[:2] == ["window_start", "window_end"] and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(NAMES)
