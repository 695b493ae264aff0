"""Registered queries of the subpackage against their SQL, over all columns."""

import pytest

import __spark_entry__
from seriesloom.llm import queries
from tests.test_entry import con, test_query_equals_sql  # noqa: F401
from tests.test_entry import registry as series_registry

NAMES = ("op2_warc_boundary_chain", "op6_schema_fingerprint_chat", "op8_spaced_seed_decontamination", "op9_block_at_a_time_top_k", "op10_capped_water_filling", "op11_seed_and_extend_repeats", "op12_sparse_index_fim", "op13_range_maximum_search")
equals_sql = test_query_equals_sql
del test_query_equals_sql


def test_every_oracle_is_sql():
    assert {n: type(q) for n, q in __spark_entry__.oracle_sql().items() if not isinstance(q, str)} == {}
    assert set(NAMES) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_llm_query_equals_sql(spark, sf, con, name, monkeypatch):  # noqa: F811
    monkeypatch.setitem(series_registry.QUERIES, name, __spark_entry__.queries()[name])
    monkeypatch.setitem(series_registry.ORACLES, name, __spark_entry__.oracle_sql()[name])
    equals_sql(spark, sf, con, name)
