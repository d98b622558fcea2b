import os

import pytest

from checks.verify import compare, connect
from pixledger.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_oracle(spark, name):
    count, same, why = compare(spark, SMALL, QUERIES[name], ORACLES[name], connect(SMALL))
    assert same and count > 0, why


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
