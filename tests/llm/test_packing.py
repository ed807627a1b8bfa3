import numpy as np
import pytest

from quillon.llm.packing import combinations, pack

WORDS = [1] * 3000 + [2] * 500 + [7] * 100 + [9, 64, 65, 100] * 3 + [0]


def test_short_texts_fill_sequences(spark):
    """One word takes one place: no more sequences than total words / capacity."""
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate(WORDS)] + [(-1, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).toPandas()
    held = got[got["length"] > 0]
    assert held.groupby("doc_id")["length"].sum().to_dict() == {i: n for i, n in enumerate(WORDS) if n}
    assert set(got[got["length"] == 0]["doc_id"]) == {-1, len(WORDS) - 1}
    assert got[got["length"] == 0]["sequence"].isna().all()
    for _, own in held.groupby("sequence"):
        own = own.sort_values("position")
        ends = (own["position"] + own["length"]).to_numpy()
        assert ends[-1] <= 64 and (ends[:-1] <= own["position"].to_numpy()[1:]).all()
    assert held["sequence"].nunique() == -(-sum(WORDS) // 64)


def test_short_texts_at_the_capacity_in_use(spark):
    rows = spark.range(4096 * 3).selectExpr("id AS doc_id", "'w' AS text")
    assert pack(rows).select("sequence").distinct().count() == 6


@pytest.mark.parametrize("seed", range(4))
def test_combinations_hold_exactly_the_counts(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.integers(5, 60))
    counts = rng.integers(0, 50, room) * (rng.random(room) < 0.5)
    found, bound = combinations(counts, room)
    got = np.zeros(room, dtype=np.int64)
    for held, n in found:
        assert sum(held) + len(held) <= room
        np.add.at(got, list(held), n)
    assert (got == counts).all()
    assert sum(n for _, n in found) >= bound - 1e-6
