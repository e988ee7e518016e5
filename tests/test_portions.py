"""Folds work on a bounded number of rows at a time, whatever a batch holds."""

import pandas as pd

from foreloom.operators import css


def test_a_batch_is_worked_on_in_portions():
    size = css.PORTION_ROWS
    batches = [pd.DataFrame({"k": range(3 * size + 5)}), pd.DataFrame({"k": range(2)})]
    parts = list(css.portions(iter(batches)))
    assert max(len(p) for p in parts) <= size
    assert [k for p in parts for k in p["k"]] == [*range(3 * size + 5), 0, 1]
