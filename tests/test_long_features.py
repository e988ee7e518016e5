"""Features of more values than one task should order take the route over slices in the split queries too."""

import duckdb
import pytest

from foreloom.operators import splits
from test_oracles import TABLES, compare


@pytest.mark.parametrize("name", ["split_batched", "top_split"])
def test_split_queries_cut_long_features_into_slices(spark, folder, short_groups, monkeypatch, name):
    sliced = []
    plain = splits.running_sums
    monkeypatch.setattr(splits, "running_sums", lambda *a, **k: sliced.append(1) or plain(*a, **k))
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    compare(spark, duck, folder, name)
    assert sliced
