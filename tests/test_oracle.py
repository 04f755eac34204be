"""Every registered query against its SQL, over whole tables."""

import builtins
import importlib
import sys

import pytest
from compare import assert_same, connect, spark_rows

import __spark_entry__ as contract
from ticklens.registered.oracle import all_oracles
from ticklens.registered.queries import all_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_of_the_library_has_sql():
    assert all_oracles().keys() == all_queries().keys()
    assert all_oracles().items() <= contract.oracle_sql().items()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", all_oracles())
def test_query_matches_sql(spark, duck, name):
    rows = assert_same(all_queries()[name](spark, SF_DIR), duck, all_oracles()[name])
    assert rows > 0


@pytest.mark.parametrize(
    "one,other",
    [
        ("frame_ticks_edges_open", "frame_ticks_edges_half_open"),
        ("reaction_edges_open", "reaction_edges_half_open"),
    ],
)
def test_bounds_make_a_difference(spark, one, other):
    """The quotes of these queries lie on the bounds, so confusing the two would show."""
    rows = [spark_rows(all_queries()[name](spark, SF_DIR)) for name in (one, other)]
    assert rows[0] != rows[1]


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns[:7] == [
        *("key0", "previous", "forecast", "actual", "curr_pair", "day", "time"),
    ]
    assert result.count() > 0


def test_optional_part_does_not_take_the_library_along(monkeypatch):
    """Whatever the optional part cannot import, the other queries stay."""
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.split(".")[0] == "corpus_pipeline":
            raise ImportError("a package it needs is missing", name="some_package")
        return real(name, *args, **kwargs)

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(builtins, "__import__", refuse)
    with pytest.warns(UserWarning, match="some_package|a package it needs"):
        importlib.reload(contract)
    assert contract.queries().keys() == all_queries().keys()
    assert contract.oracle_sql() == all_oracles()
    monkeypatch.undo()
    importlib.reload(contract)
