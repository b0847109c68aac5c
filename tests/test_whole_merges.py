"""The merges over the whole albums meet known and unknown keys."""

from pathlib import Path

import pytest

from tesserae import queries as Q

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["upsert_discovered", "set_pending", "replace_albums"])
def test_whole(spark, name):
    got = Q.queries()[name](spark, str(DATA))
    known = {r[0] for r in spark.read.parquet(f"{DATA}/albums.parquet").select("bunkr_id").collect()}
    keys = {r[0] for r in got.select("bunkr_id").collect()}
    assert known < keys and all(k.startswith("new") for k in keys - known)
