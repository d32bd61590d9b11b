"""Ranks over ranges with nulls in groups and values, ties and empty tables, against SQL."""

import pytest

from loomwork import relational


ORDERS = "o_orderkey long, o_orderpriority string, o_totalprice double"


def test_price_quartiles(held):
    rows = [(i, None if i % 3 == 0 else f"p{i % 2}", None if i % 4 == 1 else float(i % 5)) for i in range(23)]
    assert len(held("price_quartiles", orders=(ORDERS, rows))) == 23
    assert held("price_quartiles", orders=(ORDERS, [])) == []


def test_value_spread(held):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], None if i % 4 == 1 else float(i % 5)) for i in range(31)] + [(100, "null only", None)]
    assert len(held("value_spread", events=("event_id long, event_type string, value double", rows))) == 4


def test_richer_customers(held):
    customers = [(i, None if i % 7 == 0 else i % 2, None if i % 5 == 0 else float(i % 4)) for i in range(40)]
    suppliers = [(1, 0, 2.0), (2, 0, 2.0), (3, None, 0.0), (4, 1, None), (5, 9, 1.0), (6, 1, -1.0)]
    kinds = "c_custkey long, c_nationkey int, c_acctbal double", "s_suppkey long, s_nationkey int, s_acctbal double"
    assert len(held("richer_customers", customer=(kinds[0], customers), supplier=(kinds[1], suppliers))) == 6
    assert len(held("richer_customers", customer=(kinds[0], []), supplier=(kinds[1], suppliers))) == 6


def test_a_name_is_given_once():
    with pytest.raises(ValueError, match="two queries"):
        relational.query("select 1")(relational.QUERIES["buyers"])
