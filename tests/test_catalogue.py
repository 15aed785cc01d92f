"""The registered queries: twins exist, and a sample of them agrees with SQL on the smallest tables.

``python check.py`` compares every query.
"""

import os

import pytest

import __spark_entry__ as contract
import check

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "conformal_headline",
    "average_precision_row_order",
    "calibration_split",
    "leak_pairs",
    "paired_bootstrap",
    "best_match_top_up",
    "stream_alarms",
    "logistic_probe",
]


def test_every_query_has_a_twin():
    assert not set(contract.catalogue.QUERIES) - set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = check.connect(SF_DIR)
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    assert check.compare(got, con.execute(contract.oracle_sql()[name]).df()) is None


def test_compare_sees_a_changed_value():
    import pandas as pd

    a = pd.DataFrame({"x": [1, 2], "y": ["a", None]})
    assert check.compare(a, a.iloc[::-1]) is None
    assert check.compare(a, a.assign(x=[1, 3])) is not None
    assert check.compare(a, a.rename(columns={"x": "z"})) is not None
