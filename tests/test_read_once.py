"""The input of a search is read once, later steps read what was written of it."""

import pytest

from foreloom.suite import Tables, lifecycle


class Stop(Exception):
    pass


def test_daily_batches_add_the_events_up_once(spark, folder, monkeypatch):
    seen = []

    def create_forecast(self, kind, table, df, *names):
        seen.extend(df.inputFiles())
        raise Stop

    monkeypatch.setattr(lifecycle.Registry, "create_forecast", create_forecast)
    with pytest.raises(Stop):
        lifecycle._daily_batches(Tables(spark, folder), "geometric")
    assert seen and not [f for f in seen if "events.parquet" in f]
