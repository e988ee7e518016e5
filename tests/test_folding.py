"""Folds over arrays: the states are those made row by row, in bounded portions; the stream's files are spread."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from foreloom.operators import css, folding
from foreloom.suite import Tables, lifecycle

STATE = pa.struct([
    ("t", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("y_lags", pa.list_(pa.float64())), ("e_lags", pa.list_(pa.float64())),
    ("css", pa.float64()), ("d", pa.int32()), ("n_diff", pa.int32()), ("diff_buf", pa.list_(pa.float64())),
])
MODEL = pa.struct([
    ("id", pa.int64()), ("phi", pa.list_(pa.float64())), ("theta", pa.list_(pa.float64())), ("c", pa.float64()), ("d", pa.int32()), ("state", STATE),
])


def plainly(vals, m):
    row = SimpleNamespace(first=0, halo=[], vals=vals)
    item = (row, m, *css._levels_of(m, row))
    _, e, _ = css._evaluate([item], len(m["phi"]), len(m["theta"]))
    return dict(zip(css.STATE_NAMES, css._state_after(item, e[0], True)))


def folded(series, models):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(series))), pa.array(series, pa.list_(pa.float64())), pa.array(models, pa.list_(MODEL))], names=["k", "vals", "models"]
    )
    # what Spark hands over may be a part of a longer batch
    out = [b.to_pylist() for b in folding.fold_rows(batch.slice(1), ["k"], ["id"])]
    return out, {(r["k"], r["id"]): r["state"] for b in out for r in b}


@pytest.mark.parametrize("portion", [1, 400, 500_000])
def test_states_are_those_made_row_by_row(monkeypatch, portion):
    monkeypatch.setattr(folding, "PORTION_VALUES", portion)
    rng = np.random.default_rng(7)
    orders = [(p, q, d) for p in range(4) for q in range(3) for d in range(3)]
    lengths = [1, 1, 2, 3, 4, 5, 9, 30, 256, 257, 300]
    first = [rng.normal(50, 20, n).tolist() for n in lengths]
    first[6][3] = 1e200  # a loss that is no number
    second = [rng.normal(50, 20, n).tolist() for n in reversed(lengths)]
    models = [
        [dict(id=i, phi=rng.uniform(-1, 1, p).tolist(), theta=rng.uniform(-1, 1, q).tolist(), c=float(rng.normal()), d=d, state=None) for i, (p, q, d) in enumerate(orders)]
        for _ in lengths
    ]
    models[4] = models[4][:1]
    for series in (first, second):
        parts, got = folded(series, models)
        assert len(got) == sum(map(len, models[1:]))
        assert {1: len(parts) == 10, 400: 1 < len(parts) < 10, 500_000: len(parts) == 1}[portion]
        for k in range(1, len(lengths)):
            for m in models[k]:
                want = plainly(series[k], m)
                have = got[k, m["id"]]
                for name, value in want.items():
                    assert have[name] == pytest.approx(value, rel=1e-9, abs=1e-9), (k, m["id"], name)
        # some go on from their state, others start again
        for k in range(1, len(lengths)):
            for m in models[k]:
                m["state"] = got[k, m["id"]] if m["id"] % 5 else None


class Stop(Exception):
    pass


def test_parts_of_the_stream_are_spread_over_files(spark, folder, monkeypatch):
    seen = []

    def on_insert(session, path, *_, files_per_batch=1, **__):
        seen.extend([path, files_per_batch])
        raise Stop

    monkeypatch.setattr(lifecycle.I, "on_insert", on_insert)
    t = Tables(spark, folder)
    spark.conf.set("spark.foreloom.groupRows", str(-(-t.events.count() // 3)))
    try:
        with pytest.raises(Stop):
            lifecycle._streamed(t, "fixed", "spread")
    finally:
        spark.conf.unset("spark.foreloom.groupRows")
    path, files = seen
    rows = spark.read.parquet(path)
    assert files == 3 and 3 < len(rows.inputFiles()) <= 9
    # the order of files is that of the rows of every series
    rows.selectExpr("series_id", "ts", "_metadata.file_path AS file").createOrReplaceTempView("spread_rows")
    per_file = spark.sql("SELECT series_id, file, min(ts) AS low, max(ts) AS high FROM spread_rows GROUP BY 1, 2")
    meet = per_file.alias("a").join(per_file.alias("b"), "series_id").where("a.file <> b.file AND a.low <= b.high AND b.low <= a.high")
    assert meet.count() == 0
