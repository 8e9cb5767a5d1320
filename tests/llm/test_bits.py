import numpy as np
import pytest

from labelwright.llm.bits import bit_filter, opened, repeated_filter


@pytest.mark.parametrize("bits", [1 << 18, 1 << 20, 1 << 24])
def test_filters_never_miss_a_number(spark, bits):
    rnd = np.random.default_rng(3)
    numbers = rnd.integers(-2**63, 2**63 - 1, 6_000)
    once, twice = numbers[:3_000], numbers[3_000:]
    rows = [int(x) for x in np.concatenate((once, twice, twice, twice[:100]))]
    df = spark.createDataFrame([(x,) for x in rows], "h long").repartition(7)
    every = opened(bit_filter(df, bits), bits)
    assert every(np.array(rows)).all()
    found = opened(repeated_filter(df, lambda batch: [batch.column(0).to_numpy().view(np.uint64)], bits), bits, twofold=True)
    assert found(twice).all()
    share = found(once).mean()
    assert share <= (2 * 3_000 / bits) ** 2 + 0.02


def test_filters_of_nothing(spark):
    none = spark.createDataFrame([], "h long")
    ask = np.arange(50)
    assert not opened(bit_filter(none, 1 << 18), 1 << 18)(ask).any()
    empty = repeated_filter(none, lambda batch: [batch.column(0).to_numpy().view(np.uint64)], 1 << 18)
    assert not opened(empty, 1 << 18, twofold=True)(ask).any()
