"""Every registered query against its independent SQL on the supplied tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from swathline.plans import load_all
from swathline.plans.registry import ENTRIES

SF_DIR = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, name):
    status, message = compare(spark, ENTRIES[name], SF_DIR, con)
    assert status in ("ok", "rows"), f"{name}: {status} {message}"
    if status == "rows":
        assert not message.startswith("0 rows"), name
