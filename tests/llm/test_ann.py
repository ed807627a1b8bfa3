import numpy as np

from quillon.llm.ann import _add_back, build, search


def _unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_the_nearest_of_many_back_links_is_kept():
    """A hub that 40 new nodes link to, the nearest of them last."""
    angles = np.concatenate([[0.0], np.linspace(1.5, 0.1, 40)])
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    room = 4
    table = np.full((41, room), -1, dtype=np.int64)
    new = np.arange(1, 41)
    table[new, 0] = 0
    _add_back(vectors, table, new, room)
    assert 40 in table[0]


def _recall(vectors, k=10):
    """Share of the true k nearest found, by similarity: among equal ones any will do."""
    graph = build(np.arange(len(vectors)), vectors)
    asked = np.random.default_rng(3).choice(len(vectors), 400, replace=False)
    got = total = 0
    for a in range(0, len(asked), 200):
        own = asked[a : a + 200]
        found, near = search(graph, vectors[own], k + 1)
        truth = vectors[own] @ vectors.T
        truth[np.arange(len(own)), own] = -np.inf
        bar = np.sort(truth, axis=1)[:, -k]
        ok = (found != own[:, None]) & (near >= bar[:, None] - 1e-6)
        got += np.minimum(ok.sum(axis=1), k).sum()
        total += k * len(own)
    return got / total


def test_recall_in_a_shard_with_many_copies():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(200, 32))
    spread = centres[rng.integers(0, 200, 12_000)] + 0.4 * rng.normal(size=(12_000, 32))
    copies = np.repeat(spread[:20], 300, axis=0)
    vectors = _unit(np.concatenate([spread, copies]))
    vectors = vectors[rng.permutation(len(vectors))]
    assert _recall(vectors) >= 0.9
