import random
import time

from corpusforge.operators.merge import merge_groups


def by_trying(sizes, apart, limit):
    clusters = {g: ({g}, n) for g, n in sizes.items()}
    clash = lambda x, y: any((p, q) in apart or (q, p) in apart for p in clusters[x][0] for q in clusters[y][0])
    while len(clusters) > limit:
        order = sorted(clusters, key=lambda c: (clusters[c][1], c))
        pair = next(((x, y) for i, x in enumerate(order) for y in order[i + 1 :] if not clash(x, y)), None)
        if pair is None:
            break
        (gx, nx), (gy, ny) = (clusters.pop(p) for p in pair)
        clusters[" + ".join(sorted(set(pair)))] = (gx | gy, nx + ny)
    return {c: sorted(g) for c, (g, _) in clusters.items()}


def test_same_as_trying_all_pairs():
    rng = random.Random(6)
    for case in range(300):
        names = [f"g{i}" for i in range(rng.randint(0, 9))]
        sizes = {g: rng.randint(1, 5) for g in names}
        apart = {(a, b) for a in names for b in names if a <= b and rng.random() < (0.1, 0.5, 0.9)[case % 3]} | {("zz", "g0")}
        limit = rng.randint(1, 3)
        assert merge_groups(sizes, apart, limit)[0] == by_trying(sizes, apart, limit), (sizes, apart)


def test_many_groups():
    rng = random.Random(9)
    sizes = {f"g{i:05d}": rng.randint(1, 1000) for i in range(20_000)}
    apart = {tuple(sorted((f"g{rng.randrange(20_000):05d}", f"g{rng.randrange(20_000):05d}"))) for _ in range(30_000)} | {("g00000", f"g{i:05d}") for i in range(1, 20_000)}
    start = time.time()
    clusters, stuck = merge_groups(sizes, apart, 3)
    assert time.time() - start < 30 and stuck[:1] == ["g00000"] and sorted(g for gs in clusters.values() for g in gs) == sorted(sizes)
    where = {g: c for c, gs in clusters.items() for g in gs}
    assert all(where[a] != where[b] for a, b in apart if a != b)
