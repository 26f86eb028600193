"""The learners and the ring against plain Python that shares no code with them."""

import math
from bisect import bisect_left
from collections import defaultdict
from zlib import crc32

import numpy as np
from emberline.llm import packing, quality, sharding, toxicity


def plain_ftrl(rows, labels):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.RATE + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for row, y in zip(rows, labels):
            w = {i: weight(i) for i in [*row, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.RATE * wi
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_by_plain_python():
    rng = np.random.default_rng(5)
    rows = [sorted({*rng.integers(0, 60, 8).tolist(), *([3] if i % 3 == 0 else [])}) for i in range(300)]
    labels = [float(i % 3 == 0) for i in range(300)]
    at, w, bias = toxicity.fit([np.array(r) for r in rows], np.array(labels), least=1)
    want = plain_ftrl(rows, labels)
    got = dict(zip(at.tolist(), w))
    assert set(got) == {i for i, x in want.items() if x and i != "bias"}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got) and abs(bias - want["bias"]) < 1e-9


def plain_cumulative_link(rows, grades, top):
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    w, n = defaultdict(float), defaultdict(lambda: 1e-3)
    theta = []
    for k in range(top):
        share = min(0.98, max(0.02, sum(g <= k for g in grades) / len(grades)))
        theta.append(max([math.log(share / (1 - share)) + 1e-3 * k, *theta]))
    tn = [1.0] * top
    for _ in range(quality.EPOCHS):
        for row, y in zip(rows, grades):
            s = sum(w[i] * x for i, x in row.items())
            a = sigmoid(theta[y] - s) if y < top else 1.0
            b = sigmoid(theta[y - 1] - s) if y > 0 else 0.0
            for i, x in row.items():
                g = (1 - a - b) * x + quality.RIDGE * w[i]
                n[i] += g * g
                w[i] -= quality.RATE * g / math.sqrt(n[i])
            for k, slope in ((y, -a * (1 - a)), (y - 1, b * (1 - b))):
                if 0 <= k < top:
                    t = slope / max(a - b, 1e-6)
                    tn[k] += t * t
                    theta[k] -= quality.RATE * t / math.sqrt(tn[k])
            for k in range(1, top):
                theta[k] = max(theta[k], theta[k - 1])
    return w, theta


def test_cumulative_link_by_plain_python():
    rng = np.random.default_rng(6)
    grades = [i % 3 for i in range(240)]
    rows = [{int(i): 0.3 for i in rng.integers(0, 40, 5)} | {100 + y: 0.5} for y in grades]
    w, theta = quality.fit([(np.array([*r]), np.array([*r.values()])) for r in rows], np.array(grades), 2, least=1)
    want, limits = plain_cumulative_link(rows, grades, 2)
    assert np.allclose(theta, limits) and all(abs(w[i] - x) < 1e-9 for i, x in want.items())
    assert w[102] > w[101] > w[100]


def test_shapes_are_of_whole_tokens():
    assert quality.shape("a" * 500 + "1!B") == "a0!A"
    assert quality.features("x" * 300 + " y")[0].tolist() != quality.features("x" * 300 + "1 y")[0].tolist()
    assert "x" * 300 not in quality.TOKENS


def walked(counts, shards, vnodes, slack):
    """Every row walks by itself: in each round a row tries the point it stands at, and goes on if that shard is full."""
    points = sharding.ring(shards, vnodes)
    total = sum(counts.values())
    room = [math.ceil((1 + slack) * total / shards)] * shards if slack else [total // shards + (s < total % shards) for s in range(shards)]
    rows = [[cell, rank, bisect_left([p for p, _ in points], cell) % len(points)] for cell in sorted(counts) for rank in range(counts[cell])]
    at = {}
    while rows:
        full = []
        for cell, rank, k in rows:
            shard = points[k][1]
            if room[shard]:
                room[shard] -= 1
                at[cell, rank] = shard
            else:
                full.append([cell, rank, (k + 1) % len(points)])
        rows = full
    return at


def test_ring_by_single_steps():
    rng = np.random.default_rng(7)
    for shards, vnodes, slack in ((3, 4, 0.0), (5, 8, 0.0), (7, 16, 0.25)):
        counts = {int(c): int(k) for c, k in zip(rng.integers(0, sharding.CELLS, 80), rng.integers(1, 12, 80))} | {77: 300}
        got = {(cell, r): shard for cell, lo, hi, shard, _ in sharding.plan(counts, shards, vnodes, slack) for r in range(lo, hi)}
        assert got == walked(counts, shards, vnodes, slack)


def test_number_of_patterns_is_bounded():
    for n in (10_000, 1_000_000):
        found = packing.patterns({3000: n, 1000: n // 2, 500: n // 2})
        assert len(found) < 20
        held = defaultdict(int)
        for times, members in found:
            for length, k in members:
                held[length] += times * k
        assert held == {3000: n, 1000: n // 2, 500: n // 2}


def test_long_chunks_are_not_remembered():
    chunks = packing.Chunks(packing.public_tokenizers.path("word_bpe_49k.json"))
    ids = chunks.of(["漢字" * 200 + " short", "漢字" * 200])
    assert len(ids[1]) > 8 and all(len(c) <= 64 for c in chunks.chunks) and "short" in chunks.chunks
    assert crc32(chunks.of(["漢字" * 200])[0]) == crc32(ids[1])
