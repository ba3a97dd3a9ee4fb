"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from veridoc.llm import vectors as V


def plain(rows, threshold=0.98):
    """Links and components from all pairs."""
    unit = []
    for key, v, label in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, dtype=float)
        if x is None or label is None or key is None or not len(x) or not np.isfinite(x).all() or not x.any():
            unit.append(None)
        else:
            x = x / np.abs(x).max()
            unit.append(x / math.sqrt(x @ x))
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(str((rows[i][0], links[i], least.get(find(i)))) for i in range(n))


def sample(seed, dim=24):
    rng, rows = np.random.default_rng(seed), []
    for label in (0, 1, 2):
        for _ in range(30):
            rows.append((len(rows), rng.standard_normal(dim).tolist(), label))
    hub = rng.standard_normal(dim)
    for scale in rng.uniform(0.01, 0.12, 150):
        rows.append((len(rows), (hub * rng.uniform(.1, 9) + rng.standard_normal(dim) * scale).tolist(), 1))
    rows += [(1000 + i, hub.tolist(), 1) for i in range(7)] + [(5, hub.tolist(), 2), (5, hub.tolist(), 2)]
    inf, nan = float("inf"), float("nan")
    bad = [None, [0.0] * dim, [nan] * dim, [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0], [-2.0], [3.0], [1e300, 1e300], [1e-300, 1e-300]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(bad)] + [(3000, hub.tolist(), None), (None, hub.tolist(), 1), (3001, hub.tolist(), 7)]
    return rows


@pytest.mark.parametrize("bucket_rows,tile_rows", [(1024, 1024), (40, 16)])
def test_links_are_those_of_brute_force(spark, bucket_rows, tile_rows):
    rows = sample(7)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    got = V.near_vectors(docs, bucket_rows=bucket_rows, tile_rows=tile_rows).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == plain(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert V.near_vectors(docs.limit(0)).count() == 0


def test_estimates_are_unbiased_and_within_bounds():
    rng, dim = np.random.default_rng(1), 64
    x = rng.standard_normal(dim)
    y = x + rng.standard_normal(dim) * 0.7
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    true, off = x @ y, []
    for _ in range(3000):
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        rx, ry = q @ x, q @ y
        f = np.abs(ry).sum() / math.sqrt(dim)
        off.append((np.sign(ry) @ rx) / math.sqrt(dim) / f - true)
        assert abs(off[-1]) <= math.sqrt(1 - true ** 2) * math.sqrt(1 - f * f) / f + 1e-9
    assert abs(np.mean(off)) < 4 * np.std(off) / math.sqrt(len(off))


def test_tables_make_misses_rare():
    for n in (10, 5000, 10 ** 6, 10 ** 9):
        bits, tables = V.bucket_tables(n)
        meet = (1 - math.acos(.98) / math.pi) ** bits
        assert (1 - meet) ** tables <= V.MISS and n / 2 ** bits <= V.BUCKET_ROWS
