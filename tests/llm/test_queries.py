"""Registration, and the operators SQL can express against their oracles."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle_check import check, duck
from tallyhouse.llm.oracles import ORACLES


def test_one_query_per_operator_and_the_pipeline():
    names = set(queries())
    for n in range(1, 14):
        assert len([q for q in names if re.match(rf"op{n}_", q)]) == 1
    assert "pipeline" in names and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_the_oracle(spark, folder, name):
    good, message = check(spark, duck(folder), folder, name, queries()[name], ORACLES[name])
    assert good, message
