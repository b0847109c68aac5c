"""The queries of copies run the ledger over batches that share classes."""

from pathlib import Path

import pytest

from tesserae.llm import copies
from tesserae.llm import queries as Q

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
KEY = ["bucket", "source_table", "coarse", "fine"]


@pytest.fixture
def joined(monkeypatch):
    """The (ledger, batch) pairs that a query joins."""
    pairs, update = [], copies.update
    monkeypatch.setattr(copies, "update", lambda ledger, batch: pairs.append((ledger, batch)) or update(ledger, batch))
    return pairs


def meeting(pairs):
    return sum(old.join(batch, KEY, "left_semi").count() for old, batch in pairs if old is not None)


def whole(spark):
    return copies.classes(copies.aggregate(Q._keyed(spark, str(DATA))))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_found(spark, joined):
    got = Q.p5_found(spark, str(DATA))
    assert meeting(joined) > 0
    keyed = Q._keyed(spark, str(DATA))
    assert rows(got) == rows(copies.members(keyed, whole(spark).filter("copies > 1")))


def test_records(spark, joined):
    got = Q.p5_records(spark, str(DATA))
    assert meeting(joined) > 0
    assert rows(got) == rows(copies.records(whole(spark)))
