"""Embedding near-duplicates by iterative quantisation.

A rotation is learned that makes the signs of rotated vectors good balanced binary codes; several rotations give codes as long
as wanted. Codes are cut into substrings, each the key of one Hamming table. A vector is stored under its key and under the
keys that differ in one of its least certain bits, so that two vectors meet up to a Hamming distance of two. Vectors that meet
are compared by 96 bits of code, as no more than ids and codes are moved (more bits where the sample shows that so few would
leave too many false candidates); what stays close makes candidate clusters. Where a cluster is dense, so that a quarter of its
pairs or more are candidates, its original vectors are compared every one with every other; of all other clusters, such as
those that chains of candidates make of vectors about a mean, the candidate pairs alone are. Both are compared in double
precision, so no link is below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_task, mix, partitions, release, saved, small, spread, table
from corpusforge.llm.components import components

#: Bits that those who meet are compared by, the fewest that the sample allows.
FILTERS = [96, 160, 256, 512]


def entry_type(bits: int) -> np.dtype:
    """What is stored for each key: 24 bytes with the fewest bits."""
    return np.dtype([("cell", "<u4"), ("node", "<i8"), ("code", "<u4", (bits // 32,))])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def learn_rotation(x: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: alternate between the codes of rotated data and the rotation nearest to those codes."""
    rotation = start
    for _ in range(rounds):
        codes = np.where(x @ rotation > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(x.T @ codes)
        rotation = u @ v
    return rotation


@dataclass
class Tables:
    """Rotations (side by side) about a mean. Table t has the bits from t * bits on, the filter the first `filter` ones; those
    within `distance` of them stay candidates."""

    mean: np.ndarray
    rotation: np.ndarray
    bits: int
    n_tables: int
    probes: int
    filter: int = FILTERS[0]
    distance: int = FILTERS[-1]
    met: float = 0.0  # others that a row meets, each as often as it does, as far as the sample tells

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation

    def keys(self, y: np.ndarray, t: int) -> np.ndarray:
        """The key of each row of y (as projected) in table t, then the keys with one of its least certain bits flipped."""
        mine = y[:, t * self.bits : (t + 1) * self.bits]
        key = (mine > 0) @ (1 << np.arange(self.bits, dtype=np.int64))
        if not self.probes:
            return key[:, None]
        weak = np.argpartition(np.abs(mine), self.probes - 1, axis=1)[:, : self.probes] if self.probes < self.bits else np.tile(np.arange(self.bits), (len(y), 1))
        return np.column_stack([key, key[:, None] ^ (np.int64(1) << weak)])

    def codes(self, y: np.ndarray) -> np.ndarray:
        return np.packbits(y[:, : self.filter] > 0, axis=1, bitorder="little").view("<u4")

    def entries(self, x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of unit vectors and a hash of each one's cell."""
        y = self.project(x)
        codes = self.codes(y)
        keys = [mix(self.keys(y, t).astype(np.uint64) + (np.uint64(t + 1) << np.uint64(40)) + (np.uint64(x.shape[1]) << np.uint64(48))) for t in range(self.n_tables)]
        cell = np.concatenate([k.ravel() for k in keys])
        row = np.concatenate([np.repeat(np.arange(len(x)), k.shape[1]) for k in keys])
        out = np.empty(len(cell), entry_type(self.filter))
        out["cell"], out["node"], out["code"] = cell & np.uint64(0xFFFFFFFF), nodes[row], codes[row]
        return out, cell >> np.uint64(32)


def fit_tables(sample: np.ndarray, n_rows: int, threshold: float, recall: float = 0.95, probes: int = 3, seed: int = 9, most: int = 40) -> Tables:
    """Tables from a bounded sample of unit vectors. Keys grow with the logarithm of the rows, so that cells stay small.

    Tables are added until, of pairs at the threshold made from vectors of the sample, `recall` meet, and nearly as many in
    each quarter by distance from the mean (a dense group lies near it). Centring balances the codes, but takes more tables where
    vectors lie about a mean, and isn't tried beyond `most`; uncentred, only the angle counts. What costs less is taken: a row's
    entries, of which one is as dear as ten comparisons of codes, and the rows that it meets.
    """
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))]
    bits = int(np.clip(math.ceil(math.log2(max(2, n_rows))) - 3, min(4, dims), min(40, dims)))
    x = sample[:2000]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
    y = threshold * x + math.sqrt(1 - threshold**2) * noise

    some = sample[:4000]

    def cells(tables: Tables) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each table: rows of the sample by cell, and where each cell begins and how many it has."""
        projected = tables.project(some)
        for t in range(tables.n_tables):
            keys = tables.keys(projected, t)
            order = np.argsort(keys.ravel(), kind="stable")
            flat = keys.ravel()[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            yield order // keys.shape[1], first, np.diff(np.append(first, len(flat)))

    def cost(tables: Tables) -> float:
        return tables.met + 10 * tables.n_tables * (tables.probes + 1)

    def filtered(tables: Tables, learned: np.ndarray, axes: np.ndarray) -> Tables:
        """With the fewest bits that leave a vector less than 0.2 false candidates, as far as the sample tells."""
        met_a, met_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, first, size in cells(tables):
            for i, j in _pairs_in_runs(first, size):
                false = np.einsum("ij,ij->i", some[row[i]], some[row[j]]) < threshold
                met_a.append(row[i[false]])
                met_b.append(row[j[false]])
        a, b = np.concatenate(met_a), np.concatenate(met_b)
        for tables.filter in FILTERS:
            while tables.rotation.shape[1] < tables.filter:  # the filter wants more bits than the tables
                tables.rotation = np.hstack([tables.rotation, learn_rotation(learned, axes @ np.linalg.qr(rng.standard_normal((dims, dims)))[0])])
            cx, cy, codes = (tables.codes(tables.project(v)) for v in (x, y, some))
            tables.distance = int(np.quantile(apart(cx, cy), 0.99)) + 1
            close = apart(codes[a], codes[b]) <= tables.distance
            if 2 * len(np.unique(a[close] * len(some) + b[close])) / len(some) * n_rows / len(some) < 0.2:
                break
        return tables

    def fitted(mean: np.ndarray, bound: int) -> tuple[Tables, np.ndarray, np.ndarray] | None:
        centred = sample - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        group = np.argsort(np.argsort(((x - mean) ** 2).sum(1))) * 4 // max(1, len(x))
        met = np.zeros(len(x), bool)
        learned = centred[:8000]  # a sample has no order
        rotations, n_tables = [], 0
        while n_tables < bound:
            start = axes @ np.linalg.qr(rng.standard_normal((dims, dims)))[0]
            rotations.append(learn_rotation(learned, start))
            tables = Tables(mean, np.hstack(rotations), bits, len(rotations) * dims // bits, min(probes, bits))
            px, py = tables.project(x), tables.project(y)
            for t in range(n_tables, tables.n_tables):
                kx, ky = tables.keys(px, t), tables.keys(py, t)
                met |= (kx[:, :, None] == ky[:, None, :]).any((1, 2))
                if met.mean() >= recall and all(met[group == g].mean() >= recall - 0.04 for g in np.unique(group)):
                    tables.n_tables = t + 1
                    met_pairs = sum(float((size * (size - 1.0)).sum()) for _, _, size in cells(tables))
                    tables.met = met_pairs / len(some) * n_rows / len(some)
                    return tables, learned, axes
            n_tables = tables.n_tables
        return None

    centred = fitted(sample.mean(0), most)
    # uncentred tables whose entries alone cost more needn't be looked at
    plain = fitted(np.zeros(dims), 4096 if centred is None else min(4096, int(cost(centred[0]) // (10 * (centred[0].probes + 1)))))
    return filtered(*min((f for f in (centred, plain) if f), key=lambda f: cost(f[0])))


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    lengths = np.asarray(column.value_lengths())
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), int(lengths[0]) if len(lengths) else 0)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, initial=0)[:, None]  # so that no square overflows or vanishes
        return x / np.linalg.norm(x, axis=1)[:, None]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over links between places a and b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _pairs_in_runs(first: np.ndarray, size: np.ndarray, budget: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in runs (first, size), some runs at a time; a run of more than the budget's root is cut by rows."""
    pairs = np.cumsum(size * (size - 1) // 2)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + budget, side="right")))
        rows = spread(size[lo:hi], first[lo:hi])
        left = np.repeat(first[lo:hi] + size[lo:hi], size[lo:hi]) - rows - 1  # places after each one in its run
        ends = np.cumsum(left)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + budget, side="right")))
            yield np.repeat(rows[at:to], left[at:to]), spread(left[at:to], rows[at:to] + 1)
            at = to
        lo = hi


def candidate_links(entries: DataFrame, tables: dict[int, Tables], crowded: int = 4096, most: int = 3_000_000) -> DataFrame:
    """Links a, b between nodes that meet in a cell and whose codes are within the distance that their length's tables allow, from rows
    (sub, dims, content), sorted by (sub, dims) in each partition, so many that they connect what all such pairs do; `pairs` add
    up to the number of those. A cell of more than `crowded` entries is joined whole and not held (once there are `most` in a
    sub), and counts as one whose entries are all close, so nothing is lost. No entries: no links."""

    limits = {d: (t.filter, t.distance) for d, t in tables.items()}

    def links(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(pairs, pa.int64())], ["a", "b", "pairs"])

    def near(some: np.ndarray, dims: int) -> pa.RecordBatch:
        a, b, n = ([np.zeros(0, np.int64)] for _ in range(3))
        some, close_ones = _close(some, limits[dims][1])
        for i, j in close_ones:
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = used[least_labels(len(used), place[: len(i)], place[len(i) :])]
            a.append(some["node"][used])
            b.append(some["node"][root])
            n.append(np.bincount(place[len(i) :], minlength=len(used)))  # the later one of a pair is never a root
        return links(np.concatenate(a), np.concatenate(b), np.concatenate(n))

    def thinned(held: list[np.ndarray], heads: dict[int, int], out: list[pa.RecordBatch]) -> np.ndarray:
        """What is left to compare once crowded cells are stars about their first node, and are from now on."""
        some = np.concatenate(held)
        cells, first, n = np.unique(some["cell"], return_index=True, return_counts=True)
        for c, k in zip(cells[n > crowded].tolist(), first[n > crowded].tolist()):
            heads.setdefault(c, int(some["node"][k]))
        if not heads:
            return some
        names, nodes = np.array(sorted(heads), np.uint32), np.array([heads[c] for c in sorted(heads)], np.int64)
        at = np.minimum(np.searchsorted(names, some["cell"]), len(names) - 1)
        mine = names[at] == some["cell"]
        out.append(links(some["node"][mine], nodes[at[mine]], np.full(int(mine.sum()), crowded // 2)))
        return some[~mine]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, bound, heads = None, [], 0, most, {}
        out: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if held and len(rest := thinned(held, heads, out)):
                out.append(near(rest, key[1]))
            yield from out
            out.clear()

        for batch in batches:
            for sub, dims, content in zip(batch.column("sub").to_pylist(), batch.column("dims").to_pylist(), batch.column("content")):
                if (sub, dims) != key:
                    yield from close()
                    key, held, size, bound, heads = (sub, dims), [], 0, most, {}
                held.append(np.frombuffer(content.as_py(), entry_type(limits[dims][0])))
                size += len(held[-1])
                if size > bound:
                    held = [thinned(held, heads, out)]
                    size = len(held[0])
                    bound = max(most, 2 * size)
                    yield from out
                    out.clear()
        yield from close()

    found = entries.mapInArrow(arrow_task(join), "a bigint, b bigint, pairs bigint")
    return found.filter("a != b")


def _close(some: np.ndarray, distance: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Entries in the order of their cells, and the places i < j of those of one cell whose codes are within the distance."""
    some = some[np.argsort(some["cell"], kind="stable")]
    first = np.flatnonzero(np.append(True, some["cell"][1:] != some["cell"][:-1]))
    size = np.diff(np.append(first, len(some)))
    wide = size > 1

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _pairs_in_runs(first[wide], size[wide]):
            close = apart(some["code"][i], some["code"][j]) <= distance
            if close.any():
                yield i[close], j[close]

    return some, pairs()


def candidate_pairs(entries: DataFrame, tables: dict[int, Tables]) -> DataFrame:
    """Every pair a < b of nodes that meet in a cell with codes within the distance, once, from rows (sub, dims, content), sorted by
    (sub, dims) in each partition. A sub's entries are held together, its pairs given as they are found. No entries: no rows."""
    limits = {d: (t.filter, t.distance) for d, t in tables.items()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def given() -> Iterator[pa.RecordBatch]:
            some, close_ones = _close(np.concatenate(held), limits[key[1]][1]) if held else (None, [])
            for i, j in close_ones:
                x, y = some["node"][i], some["node"][j]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            for sub, dims, content in zip(batch.column("sub").to_pylist(), batch.column("dims").to_pylist(), batch.column("content")):
                if (sub, dims) != key:
                    yield from given()
                    key, held = (sub, dims), []
                held.append(np.frombuffer(content.as_py(), entry_type(limits[dims][0])))
        yield from given()

    return entries.mapInArrow(arrow_task(meet), "a bigint, b bigint").filter("a != b").distinct()


def exact_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """node, links and root, as of exact_links, for pairs (a, b) of classes (node, copies, v) of one length; each vector is sent to
    its pairs, and nothing else is compared."""
    side = lambda n: classes.select(F.col("node").alias(n), F.col("copies").alias(f"copies_{n}"), F.col("v").alias(f"v_{n}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("v_a").value_lengths())
            for n in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == n))
                linked = rows.filter(pa.array(np.einsum("ij,ij->i", _vectors(rows.column("v_a")), _vectors(rows.column("v_b"))) >= threshold))
                a, b, copies_a, copies_b = (linked.column(c) for c in ("a", "b", "copies_a", "copies_b"))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([copies_b, copies_a]), pa.concat_arrays([b, a])], ["node", "links", "root"])

    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.mapInArrow(arrow_task(compare), "node bigint, links bigint, root bigint")


def exact_links(tiles: DataFrame, threshold: float) -> DataFrame:
    """node, links (copies of linked classes) and root (a linked node that stands for all it reaches in the tile) from rows
    (cluster, tile, mine, half, node, copies, v), sorted by (cluster, tile, mine) in each partition. Of a tile of two blocks
    only pairs across are compared, of one half only nothing."""

    def several(rows: pa.Table) -> pa.RecordBatch:
        cluster, tile, mine, half, node, copies = (rows.column(c).to_numpy() for c in ("cluster", "tile", "mine", "half", "node", "copies"))
        x = _vectors(rows.column("v").combine_chunks())
        first = np.flatnonzero(np.append(True, (cluster[1:] != cluster[:-1]) | (tile[1:] != tile[:-1])))
        size = np.diff(np.append(first, len(node)))
        total, a, b = np.zeros(len(node), np.int64), [], []

        def count(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(total, i, copies[j])
            np.add.at(total, j, copies[i])
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            if len(used):
                a.append(used)
                b.append(used[least_labels(len(used), place[: len(i)], place[len(i) :])])

        few = (size > 1) & (size <= 64) & ~half[first]
        for i, j in _pairs_in_runs(first[few], size[few], max(1, 4_000_000 // max(1, x.shape[1]))):
            close = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            count(i[close], j[close])
        for lo, n in zip(first[(size > 1) & ~few].tolist(), size[(size > 1) & ~few].tolist()):
            hi, cut = lo + n, lo + int(np.searchsorted(mine[lo : lo + n], mine[lo + n - 1]))
            if half[lo] and cut == lo:
                continue
            end = cut if half[lo] else hi
            step = max(1, 2_000_000 // n)
            for at in range(lo, end, step):
                to = min(end, at + step)
                start = cut if half[lo] else at
                i, j = np.nonzero(x[at:to] @ x[start:hi].T >= threshold)
                i, j = i + at, j + start
                count(i[i < j], j[i < j])
        place = np.concatenate(a) if a else np.zeros(0, np.int64)
        root = np.concatenate(b) if b else place
        # a node's links are given once, with its first root
        once = np.zeros(len(place), np.int64)
        known, at = np.unique(place, return_index=True)
        once[at] = total[known]
        return pa.RecordBatch.from_arrays([pa.array(node[place]), pa.array(once), pa.array(node[root])], ["node", "links", "root"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if not len(rows):
                continue
            last = [rows.column(c)[len(rows) - 1].as_py() for c in ("cluster", "tile")]
            same = np.all([rows.column(c).to_numpy() == v for c, v in zip(("cluster", "tile"), last)], axis=0)
            cut = len(rows) - int(same.sum())
            carry = rows.slice(cut)
            if cut:
                yield from by_length(rows.slice(0, cut))
        if carry is not None and len(carry):
            yield from by_length(carry)

    def by_length(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([np.asarray(c.value_lengths()) for c in rows.column("v").chunks])
        for n in np.unique(lengths).tolist():  # a cluster's vectors are of one length
            yield several(rows.filter(pa.array(lengths == n)))

    return tiles.mapInArrow(arrow_task(join), "node bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, max_fit_rows: int = 20_000, few: int = 64, block_bytes: int = 8 << 20, crowded: int = 4096, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding); other columns aren't read.

    Null, empty and zero vectors, those that hold a null or a non-finite component, and rows without a vec_id link with nothing.
    Vectors of different lengths aren't compared. Rows with equal vectors are one class and linked with each other. n_links
    counts rows; rows of one vec_id are rows of their own and share a component. An empty table gives an empty result.

    A length that up to `few` classes have is compared whole. For each other one tables are fitted on at most about
    max_fit_rows rows and hold all rows. A dense cluster of vectors of more than block_bytes is cut into blocks, and all pairs
    of blocks are compared, each in a task of its own; of a cluster that isn't dense the candidate pairs are. report, if given,
    gets how many pairs of vectors are compared either way, and the tables of each length.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    nan = F.lit(float("nan")).cast(vectors.schema["embedding"].dataType.elementType)
    # array_contains is null where there is a null and no NaN
    finite = F.coalesce(~F.array_contains(e, nan) & (F.array_max(e) < float("inf")) & (F.array_min(e) > -float("inf")) & ((F.array_max(e) != 0) | (F.array_min(e) != 0)) & F.col("vec_id").isNotNull(), F.lit(False))
    hashes = [F.when(finite, F.xxhash64(F.lit(k), e, F.size(e))).alias(f"h{k}") for k in (1, 2)]
    rows = saved(vectors.select("vec_id", *hashes), "rows")
    classes = vectors.select("vec_id", "embedding", *hashes).filter("h1 is not null").groupBy("h1", "h2")
    classes = classes.agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("v"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "id", "copies", F.size("v").alias("dims"), "v"), "classes")
    release(spark)
    lengths = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    tables = {}
    for dims, n in sorted(lengths.items()):
        if n > few:
            pick = F.pmod(F.xxhash64("node", F.lit(8)), F.lit(1 << 24)) < int(min(1.0, max_fit_rows / n) * (1 << 24))
            x = _vectors(classes.filter((F.col("dims") == dims) & pick).orderBy("id", "h1").select("v").toArrow().column("v").combine_chunks())
            tables[dims] = fit_tables(x, n, threshold)
    whole = [d for d, n in lengths.items() if n <= few]
    shared = spark.sparkContext.broadcast(tables)
    n_entries = sum(lengths[d] * t.n_tables * (t.probes + 1) for d, t in tables.items())
    n_subs = max(1, n_entries // 250_000)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for dims, parts in held.items():
                some, sub = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(sub, kind="stable")
                some, sub = some[order], sub[order]
                first = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
                contents = [some[i:j].tobytes() for i, j in zip(first.tolist(), np.append(first[1:], len(sub)).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(sub[first], pa.int64()), pa.array([dims] * len(first), pa.int32()), pa.array(contents, pa.binary())], ["sub", "dims", "content"])
            held.clear()

        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == dims))
                for lo in range(0, len(mine), 4096):
                    part = mine.slice(lo, 4096)
                    some, cell = shared.value[dims].entries(_vectors(part.column("v")), part.column("node").to_numpy())
                    held.setdefault(dims, []).append((some, (cell % np.uint64(n_subs)).astype(np.int64)))
                    size += len(some)
                    if size > 1_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    def dealt(rows: DataFrame) -> DataFrame:
        indexed = rows.filter(F.col("dims").isin(list(tables))).select("node", "dims", "v").mapInArrow(arrow_task(stored), "sub bigint, dims int, content binary")
        return indexed.repartition(partitions(spark), "sub", "dims").sortWithinPartitions("sub", "dims")

    candidates = saved(candidate_links(dealt(classes), tables, crowded), "candidates")
    release(spark)
    grown = saved(components(candidates), "clusters").select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    n_clustered = grown.count()
    # a cluster is dense if a quarter of its pairs are candidates, each counted as often as it meets
    close = candidates.groupBy(F.col("a").alias("node")).agg(F.sum("pairs").alias("pairs"))
    density = grown.join(close, "node", "left").groupBy("cluster").agg(F.count("*").alias("members"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    density = saved(density.withColumn("dense", 8 * F.col("pairs") >= F.col("members") * (F.col("members") - 1)), "density")
    sparse = density.filter("not dense").select("cluster")
    n_sparse = sparse.count()
    clusters = grown if not n_sparse else saved(grown.join(small(sparse, 8 * n_sparse), "cluster", "left_anti").select("node", "cluster"), "dense")
    # a length that few classes have is one cluster, numbered below the nodes
    small_lengths = classes.filter(F.col("dims").isin(whole)).withColumn("cluster", -F.col("dims").cast("bigint"))
    columns = ["cluster", "node", "copies", "dims", "v"]
    members = classes.join(small(clusters, 16 * n_clustered, 16 << 20), "node").select(*columns).unionByName(small_lengths.select(*columns))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    sizes = sizes.unionByName(small_lengths.groupBy("cluster").agg(F.count("*").alias("members")))
    large = saved(sizes.filter(F.col("members") > 256), "large")
    block = F.greatest(F.lit(256), F.floor(F.lit(block_bytes) / (8 * F.col("dims"))))
    tiled = members.join(small(large, 16 * large.count()), "cluster", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int"))
    tiled = tiled.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tiled = tiled.select("cluster", F.explode(F.expr("transform(sequence(0, blocks - 1), j -> cast(least(mine, j) as bigint) * blocks + greatest(mine, j))")).alias("tile"), "mine", "blocks", "node", "copies", "v")
    tiled = tiled.withColumn("half", F.col("tile") % (F.col("blocks") + 1) != 0)  # tiles on the diagonal are whole
    tiled = tiled.repartition(partitions(spark), "cluster", "tile").sortWithinPartitions("cluster", "tile", "mine", "node")
    linked = exact_links(tiled.select("cluster", "tile", "mine", "half", "node", "copies", "v"), threshold)
    if n_sparse:
        chained = saved(classes.join(grown.join(small(sparse, 8 * n_sparse), "cluster", "left_semi").select("node"), "node", "left_semi").select("node", "copies", "dims", "v"), "chained")
        pairs = saved(candidate_pairs(dealt(chained), tables), "pairs")
        linked = linked.unionByName(exact_pairs(pairs, chained, threshold))
    links = saved(linked, "links")
    if report is not None:
        in_dense = density.filter("dense").agg(F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()[0]
        report |= {"dense": int(in_dense or 0), "sparse": pairs.count() if n_sparse else 0, "tables": tables}
    release(spark)
    # classes that share a vec_id share a component, whatever their vectors
    named = rows.filter("h1 is not null").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    several = saved(named.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("vec_id", "a"), "several")
    same = named.join(small(several, 16 * several.count()), "vec_id").select("a", F.col("node").alias("b"))
    grouped = saved(components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(same)), "grouped")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "h1", "h2", "id", "copies").join(counts, "node", "left").join(grouped.select(F.col("id").alias("node"), "component"), "node", "left")
    joined = saved(joined.withColumn("component", F.coalesce("component", "node")), "joined")
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    found = joined.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("class_links"), "component_id")
    out = rows.join(found, ["h1", "h2"], "left").select("vec_id", F.coalesce("class_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; vectors that can't be compared, and empty tables, as near_duplicates has them."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
