"""Global positions and carry-forward: distributed == single-partition."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators.carry import carry_forward
from tidewatch.operators.positions import with_global_position


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_are_a_permutation_in_order(spark, parts):
    rows = [(int(k), int(i)) for i, k in enumerate(np.random.default_rng(1).integers(0, 5, 500))]
    df = spark.createDataFrame(rows, "k long, i long")
    out = with_global_position(df, ["k", "i"], num_partitions=parts).toPandas().sort_values("_gpos")
    assert list(out["_gpos"]) == list(range(500))
    assert list(zip(out.k, out.i)) == sorted(rows)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_carry_forward_matches_pandas(spark, parts):
    rng = np.random.default_rng(parts)
    vals = [None if rng.random() < 0.6 else float(i) for i in range(300)]
    vals[0] = None
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, z double")
    got = carry_forward(df, ["i"], ["z"], num_partitions=parts).toPandas().sort_values("i")["z"].tolist()
    want = pd.Series(vals, dtype="float64").ffill().tolist()
    assert [None if pd.isna(a) else a for a in got] == [None if pd.isna(b) else b for b in want]
