"""A block of a mixed bucket gives fewer links than it has components, and the same components as all pairs."""

import numpy as np
import pyarrow as pa

from siltstone.llm import near_dedup as M


def test_blocks_give_few_links():
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(3):  # three groups: similar within, unlike between
        base = draw.integers(0, 1 << 63, 100).astype(np.uint64)
        for _ in range(80):
            own = base.copy()
            own[draw.integers(0, 100, 6)] = draw.integers(0, 1 << 63, 6).astype(np.uint64)
            sets.append(np.unique(own))
    nodes = np.arange(len(sets))
    similar = lambda i, j: M.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80)

    def components(pairs):
        label = nodes.copy()
        for a, b in pairs:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        return label.tolist()

    pairs = [(i, j) for i in nodes for j in nodes[:i] if similar(i, j)]
    assert len(pairs) > 4000
    key, zero = pa.array([7] * len(nodes)), pa.array([0] * len(nodes))
    prints = pa.array([(s >> np.uint64(40)).astype("<u2").tobytes() for s in sets])
    full = pa.array([s.astype("<u8").tobytes() for s in sets])
    side = lambda end, **more: pa.table({f"{k}{end}": v for k, v in ({"key": key, "l": zero, "r": zero, "node": pa.array(nodes), "part": pa.array(nodes)} | more).items()})
    first = {"n": pa.array([len(s) for s in sets]), "small": prints, "bands": pa.array([None] * len(nodes), pa.list_(pa.int64()))}
    flags = M._block(80)(side("", **first), side("_", **first)).to_pylist()
    assert len(flags) == 1 and flags[0]["key"] == 7 and {x for p in pairs for x in p} <= set(flags[0]["nodes"])
    links = [tuple(r.values()) for r in M._joined(80)(side("", full=full), side("_", full=full)).to_pylist()]
    assert len(links) < len(nodes) and all(similar(*x) for x in links)
    assert components(links) == components(pairs)
