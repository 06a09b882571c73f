"""Every registered query of the library, against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from stemma import catalog

SLOW = {"passages_by_reference", "reference_resolve"}


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLE if n not in SLOW))
def test_matches_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE[name])


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES and catalog.FLAGSHIP in catalog.ORACLE
