import pytest

from fathomline.llm.queries import training

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(training.queries))
def test_runs_on_the_smallest_tables(spark, name):
    df = training.queries[name](spark, SMALL)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
