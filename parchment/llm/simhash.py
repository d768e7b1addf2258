"""SimHash near-duplicate groups by the generalised pigeonhole.

1. A document's fingerprint: majority bits over the XXH64 of its word shingles.
2. Bits that agree with each other are grouped into partitions.  If partition i
   is searched with threshold t_i (-1: not at all) and the t_i add up to
   radius - partitions + 1, every pair within the radius agrees to within t_i
   in some partition i.
3. Each fingerprint gets its own thresholds, by dynamic programming over the
   number of candidates that each partition would give it: the exact number of
   fingerprints with its value for t = 0, an estimate from the bit frequencies
   for more, so frequent values are searched by other partitions.
4. Probes meet the indexed values in one shuffle.  A frequent value is cut into
   blocks of bounded size, probes go to each block, and a block passes on the
   edges of a spanning forest only, never all of its pairs.

``first_of_groups`` asks for a similarity of shingle sets instead of a distance: several independent fingerprints
are searched as above, each fingerprint's nearest smaller ones are candidates, and shingle sets decide.  Sets of different
components that share one of their first shingles, in an order that puts frequent ones last, are candidates too, so no pair is missed.

Null text counts as empty.  Documents without words have fingerprint zero and
link like any others.  Rows with a null id get fingerprint and a null
component unless their group holds an id.  Repeated rows are repeated in the
result.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import row_key, small_batches, stored, texts
from parchment.llm.graph import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Of groups by similarity: words of a shingle, least Jaccard similarity, independent fingerprints, the radius they are searched
#: with, and differing bits of a candidate (pairs of similarity 0.8 differ in 10 of 64 on average, with a deviation of 3).
SET_WORDS, SIMILARITY = 5, 0.8
SKETCHES, SET_RADIUS, NEAREST = 6, 2, 15
#: Of the order of shingles: one set of so many is counted, and those that so many of them have, at most so many, go last.
SAMPLED, OFTEN, FREQUENT = 16, 8, 200_000
PARITIES = ("p0", "p1", "p2", "p3")
#: Fingerprints of one block of a frequent value.
BLOCK = 4096
#: Pairs that are compared at once within a task.
PAIRS = 1 << 20


def _shingle_hashes(body: bytes, n: int) -> list[int]:
    """XXH64 of the word n-grams; fewer words: of the whole sequence; none: nothing."""
    words = body.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes; runs of size 0 give 0."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    starts = np.cumsum(sizes) - sizes
    # eight one-byte counters lie in each 64-bit lane, so a block holds 255 rows at most
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    counts = np.add.reduceat(np.add.reduceat(bits, at, axis=0).view(np.uint8).astype(np.int32), first, axis=0)
    ones = np.ascontiguousarray(2 * counts > sizes[:, None])
    out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, sizes, fps, held = batch.column(0), [], [], [], 0
            for body in batch.column(1):
                h = _shingle_hashes(body.as_py(), shingle_words)
                hashes.append(np.array(h, np.uint64))
                sizes.append(len(h))
                held += len(h)
                if held > 500_000:
                    fps.append(majority_bits(np.concatenate(hashes), np.array(sizes)))
                    hashes, sizes, held = [], [], 0
            if sizes:
                fps.append(majority_bits(np.concatenate(hashes), np.array(sizes)))
            found = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(nodes: DataFrame, sketches: int = 1) -> list[tuple[int, np.ndarray]]:
    """nodes(sketch, fp) -> of each sketch the number of fingerprints and the 64 x 64 table of how often two bits are both set,
    over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((sketches, 64, 64)), np.zeros(sketches)
        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            fps = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
            for k in range(sketches):
                own = bits[of == k]
                both[k] += own.T @ own
                n[k] += len(own)
        cells = np.concatenate([n[:, None], both.reshape(sketches, -1)], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    found = nodes.select("sketch", "fp").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    cells = np.zeros(sketches * 4097)
    for r in found.collect():  # 4097 sums a sketch
        cells[r["cell"]] = r["v"]
    return [(int(c[0]), c[1:].reshape(64, 64)) for c in cells.reshape(sketches, 4097)]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` partitions of about equal width, each grown from a seed by the
    bits that correlate most with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, out))) // (parts - k)
        own = [max(free, key=lambda b: (tie[b, sorted(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < width:
            best = max(free, key=lambda b: (tie[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def within(fps: np.ndarray, bits: list[int], p: np.ndarray, most: int) -> np.ndarray:
    """Share of fingerprints expected within 0..most differing bits of each one's partition."""
    at = np.zeros((len(fps), most + 1))
    at[:, 0] = 1
    for b in bits:
        one = ((fps >> np.uint64(b)) & np.uint64(1)).astype(bool)
        miss = np.where(one, 1 - p[b], p[b])[:, None]
        moved = np.zeros_like(at)
        moved[:, 1:] = at[:, :-1] * miss
        at = at * (1 - miss) + moved
    return np.cumsum(at, axis=1)


def _probe_count(width: int, t: int) -> int:
    from math import comb

    return sum(comb(width, d) for d in range(t + 1))


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds of least cost.  costs[q, i, t + 1]: of query q in partition i at threshold t
    (t = -1 .. radius); the thresholds of a query add up to ``total``."""
    n, parts, levels = costs.shape
    low, size = -parts, total + parts + 1
    best = np.full((n, size), np.inf)
    best[:, 0] = 0
    shift = 0
    picks = []
    for i in range(parts):  # after i partitions, best[:, s] is for a sum of s - i
        nxt, pick = np.full((n, size), np.inf), np.zeros((n, size), np.int8)
        for lv in range(levels):
            cand = np.full((n, size), np.inf)
            cand[:, lv:] = best[:, : size - lv] + costs[:, i, lv, None]
            better = cand < nxt
            nxt[better] = cand[better]
            pick[better] = lv
        best = nxt
        picks.append(pick)
    assert low + size - 1 == total and shift == 0
    s, out = np.full(n, size - 1), np.zeros((n, parts), np.int8)
    for i in reversed(range(parts)):
        lv = picks[i][np.arange(n), s]
        out[:, i] = lv - 1
        s = s - lv
    return out


def choose_parts(n: int, both: np.ndarray, radius: int) -> list[list[int]]:
    """The number of partitions whose expected probes and candidates cost least."""
    p = np.diag(both) / max(n, 1)
    same = p * p + (1 - p) * (1 - p)
    best, found = None, None
    for parts in range(2, radius + 2):
        groups = group_bits(n, both, parts)
        costs = np.zeros((1, parts, radius + 2))
        for i, bits in enumerate(groups):
            at = np.zeros(radius + 1)
            at[0] = 1
            for b in bits:
                at = at * same[b] + np.concatenate([[0], at[:-1]]) * (1 - same[b])
            for t in range(radius + 1):
                costs[0, i, t + 1] = n * at[: t + 1].sum() + 8 * _probe_count(len(bits), t)
        t = allocate(costs, radius - parts + 1)[0]
        cost = sum(costs[0, i, t[i] + 1] for i in range(parts)) + 8 * parts
        if best is None or cost < best:
            best, found = cost, groups
    return found


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> one edge per node to the least node of its component, fewer than nodes."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root) and np.array_equal(root[a], root[b]):
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def nearest_smaller(q: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints -> for each of q that of d which differs in the fewest bits, at most ``most``, of the smaller ones."""
    far = np.bitwise_count(q ^ d)
    at = np.flatnonzero((far <= most) & (d < q))
    at = at[np.lexsort((d[at], far[at], q[at]))]
    at = at[np.append(True, q[at][1:] != q[at][:-1])] if len(at) else at
    return q[at].view(np.int64), d[at].view(np.int64)


def _meet(radius: int, nearest: int | None = None):
    """Rows sorted by (part, key, block, role): role 0 indexed, 1 probe -> spanning edges, or each probe's nearest
    smaller fingerprint."""

    def edges_of(data, probes) -> pa.RecordBatch | None:
        # data, probes: (group number, fp), sorted by group
        lo = np.searchsorted(data[0], probes[0], "left")
        n = np.searchsorted(data[0], probes[0], "right") - lo
        us, vs, start = [], [], 0
        ends = np.cumsum(n)
        while start < len(n):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            k = n[start:stop]
            q = np.repeat(probes[1][start:stop], k)
            d = data[1][np.repeat(lo[start:stop], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            start = stop
            if nearest is not None:
                a, b = nearest_smaller(q, d, nearest)
                us.append(a)
                vs.append(b)
                continue
            near = (np.bitwise_count(q ^ d) <= radius) & (q != d)
            if near.any():
                a, b = spanning(q[near].view(np.int64), d[near].view(np.int64))
                us.append(a)
                vs.append(b)
        if not us:
            return None
        a, b = np.concatenate(us), np.concatenate(vs)
        if nearest is None:
            a, b = spanning(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group's indexed rows: (key columns, fps)
        for batch in batches:
            part, key, block, role, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            fp = np.ascontiguousarray(fp).view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            group = np.cumsum(new)
            is_data = role == 0
            dg, df = group[is_data], fp[is_data]
            if held is not None and held[0] == (part[0], key[0], block[0]):
                dg = np.concatenate([np.ones(len(held[1]), dg.dtype), dg])
                df = np.concatenate([held[1], df])
            out = edges_of((dg, df), (group[~is_data], fp[~is_data]))
            if out is not None:
                yield out
            held = ((part[-1], key[-1], block[-1]), df[dg == group[-1]])

    return run


def near_edges(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK, nearest: int | None = None, sketches: int = 1) -> DataFrame:
    """nodes(fp), or (sketch, fp) for several independent fingerprints, distinct -> edges (u, v) that connect the same fingerprints as
    all links within ``radius`` of a sketch; with ``nearest`` each probe's nearest smaller fingerprint within so many bits, of
    those that meet in a partition."""
    if sketches == 1:
        nodes = nodes.select(F.lit(0).alias("sketch"), "fp")
    known = bit_statistics(nodes, sketches)
    groups = [choose_parts(n, both, radius) for n, both in known]
    chance = [np.diag(both) / max(n, 1) for n, both in known]
    # partitions are numbered through all sketches
    most = max(map(len, groups))
    masks = {k * most + i: _mask(g) for k in range(sketches) for i, g in enumerate(groups[k])}
    cuts = [
        F.array(*[F.struct(F.lit(k * most + i).alias("part"), F.col("fp").bitwiseAND(F.lit(masks[k * most + i])).alias("key")) for i in range(len(groups[k]))])
        for k in range(sketches)
    ]
    cut = cuts[0]
    for k in range(1, sketches):
        cut = F.when(F.col("sketch") == k, cuts[k]).otherwise(cut)
    keyed = nodes.select("sketch", "fp", F.inline(cut))
    sizes = stored(keyed.groupBy("part", "key").agg(F.count("*").alias("n")), "sizes")
    own = (
        keyed.join(sizes, ["part", "key"])
        .groupBy("sketch", "fp")
        .agg(*[F.max(F.when(F.col("part") % most == i, F.col("n"))).alias(f"n{i}") for i in range(most)])
    )

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for k in range(sketches):
            for i, bits in enumerate(groups[k]):
                for t in range(radius + 1):
                    if 8 * _probe_count(len(bits), t) < 200_000:
                        flips[k, i, t] = np.array(
                            [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(bits, d)], np.uint64
                        )
        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            all_fps = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            for k in np.unique(of).tolist():
                fps, parts, n = all_fps[of == k], len(groups[k]), known[k][0]
                exact = np.stack([c.to_numpy(zero_copy_only=False)[of == k] for c in batch.columns[2 : 2 + parts]], 1)
                costs = np.zeros((len(fps), parts, radius + 2))
                for i, bits in enumerate(groups[k]):
                    share = n * within(fps, bits, chance[k], radius)
                    share[:, 0] = exact[:, i]
                    share = np.maximum.accumulate(share, axis=1)
                    for t in range(radius + 1):
                        costs[:, i, t + 1] = share[:, t] + 8 * _probe_count(len(bits), t) if (k, i, t) in flips else np.inf
                thresholds = allocate(costs, radius - parts + 1)
                for i in range(parts):
                    part = k * most + i
                    mask = np.uint64(masks[part] & (2**64 - 1))
                    for t in range(radius + 1):
                        chosen = fps[thresholds[:, i] == t]
                        step = max(1, 200_000 // len(flips.get((k, i, t), [0])))
                        for start in range(0, len(chosen), step):
                            some = chosen[start : start + step]
                            keys = ((some & mask)[:, None] ^ flips[k, i, t][None, :]).ravel()
                            whose = np.repeat(some, len(flips[k, i, t]))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)), pa.array(whose.view(np.int64))],
                                ["part", "key", "fp"],
                            )

    many = F.ceil(F.col("n") / block).cast("int")
    data = keyed.join(sizes.where(F.col("n") > 1), ["part", "key"]).select(
        "part", "key", F.pmod(F.xxhash64("fp"), many).cast("int").alias("block"), F.lit(0).alias("role"), "fp"
    )
    asked = own.mapInArrow(probes, "part int, key long, fp long").join(sizes, ["part", "key"])
    # a value that one fingerprint alone has is met by its owner only
    asked = asked.where((F.col("n") > 1) | (F.col("fp").bitwiseAND(_own_mask(masks)) != F.col("key")))
    lone = keyed.join(sizes.where(F.col("n") == 1), ["part", "key"]).select(
        "part", "key", F.lit(0).alias("block"), F.lit(0).alias("role"), "fp"
    )
    asked = asked.select("part", "key", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), F.lit(1).alias("role"), "fp")
    met = data.unionByName(lone).unionByName(asked).repartition("part", "key", "block").sortWithinPartitions("part", "key", "block", "role")
    return met.select("part", "key", "block", "role", "fp").mapInArrow(_meet(radius, nearest), "u long, v long")


def _own_mask(masks: dict[int, int]) -> F.Column:
    out = F.lit(0).cast("long")
    for i, m in masks.items():
        out = F.when(F.col("part") == i, F.lit(m).cast("long")).otherwise(out)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id): every row of ``docs`` with the least doc_id that it is linked to,
    directly or through others, by fingerprints that differ in ``radius`` bits or fewer."""
    fps = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comps = stored(connected_components(near_edges(nodes.select("fp"), radius)), "components")
    joined = nodes.join(comps, nodes.fp == comps.node, "left")
    linked = joined.where(F.col("component").isNotNull())
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = stored(
        nodes.join(
            linked.select("fp", "component").join(named, "component").select("fp", "component_id"), "fp", "left"
        ).select("fp", F.coalesce("component_id", "least").alias("component_id")),
        "labels",
    )
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


_SALTS = np.random.default_rng(SEED).integers(0, 2**64, SKETCHES, np.uint64)


def _sketch(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes for the k-th independent fingerprint."""
    if not k:
        return hashes
    x = (hashes ^ _SALTS[k]) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _shingle_set(body: bytes) -> np.ndarray:
    return np.unique(np.array(_shingle_hashes(body, SET_WORDS), np.uint64))


def _set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, row, body) -> (did, row, key of the shingle set, its fingerprints)."""
    names = ["did", "row", "key", *(f"f{k}" for k in range(SKETCHES))]
    for batch in batches:
        start, n, sets, held = 0, batch.num_rows, [], 0
        for i, body in enumerate(batch.column(2)):
            sets.append(_shingle_set(body.as_py()))
            held += len(sets[-1])
            if held > 500_000 or i == n - 1:
                sizes, flat = np.array(list(map(len, sets))), np.concatenate(sets)
                fps = [pa.array(majority_bits(_sketch(flat, k), sizes).view(np.int64)) for k in range(SKETCHES)]
                part = batch.slice(start, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(_set_key, sets)), pa.int64()), *fps], names)
                start, sets, held = i + 1, [], 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [_shingle_set(b.as_py()).view(np.int64) for b in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], ["key", "hashes"])


def _candidates(nodes: DataFrame) -> DataFrame:
    """nodes(key, f0..) -> pairs (u, v) of keys: each with the first of its own fingerprint, the firsts with those of near ones."""
    each = nodes.select("key", F.posexplode(F.array(*[f"f{k}" for k in range(SKETCHES)])).alias("sketch", "fp"))
    first = stored(each.groupBy("sketch", "fp").agg(F.min("key").alias("key"), F.count("*").alias("n")), "fingerprints")
    met = near_edges(first.select("sketch", "fp"), SET_RADIUS, nearest=NEAREST, sketches=SKETCHES)
    # one candidate a fingerprint, the nearest that any of its partitions has found
    edges = met.groupBy("u").agg(F.min(F.struct(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("d"), "v")).alias("m")).select("u", "m.v")
    # fingerprints of two sketches that happen to be equal give one candidate more, which is refused like others
    near = edges.join(first.select(F.col("fp").alias("u"), F.col("key").alias("a")), "u").join(
        first.select(F.col("fp").alias("v"), F.col("key").alias("b")), "v"
    )
    many = first.where("n > 1").select("sketch", "fp", F.col("key").alias("b"))
    same = each.join(many, ["sketch", "fp"]).where("key <> b").select(F.col("key").alias("a"), "b")
    both = near.select("a", "b").unionByName(same).where("a <> b")
    return both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _rest_of(length: int, least: float) -> int:
    """Elements of a set of which another of Jaccard similarity ``least`` must have one, whatever the order they are taken in."""
    return length - int(np.ceil(least * length - 1e-9)) + 1


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls to each of 256 places, as four longs: two sets differ in as many elements at least as
    these differ in bits."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(frequent: np.ndarray, least: float):
    """(did, row, body) -> (did, row, size, first, low, p0..p3): the size of the shingle set, 32 bits of its first shingles, the frequent ones
    last, the different values of 16 bits of all of them and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, low, sizes, odd = [], [], [], []
            for body in batch.column(2):
                s = _shingle_set(body.as_py())
                late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                some = np.concatenate([s[~late], s[late]])[: _rest_of(len(s), least) if len(s) else 0]
                first.append(some.astype(np.uint32).view(np.int32))
                low.append(np.unique(s.astype(np.uint16)).view(np.int16))
                sizes.append(len(s))
                odd.append(_parities(s))
            cols = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array(low, pa.list_(pa.int16()))]
            bits = [pa.array(c, pa.int64()) for c in np.array(odd, np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([*cols, *bits], ["did", "row", "size", "first", "low", *PARITIES])

    return run


def _shared_prefixes(bodies: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """bodies(did, row, body) and named(key, component, did, row), a row for each shingle set -> all pairs (u, v) of different components
    that may have the similarity: two such sets share a shingle among their first ones in any common order.  The order only decides
    how many pairs there are; it puts those last that are frequent in a sample of the sets.  Texts are not shuffled but for the
    sample, and shingles go by 32 bits, so that unequal ones may make a pair more but none less."""
    part = F.pmod(F.xxhash64("did", "row"), F.lit(SAMPLED)) == 0
    sample = bodies.where(part).join(named.where(part).select("did", "row"), ["did", "row"], "left_semi")
    hashes = sample.select("row", "body").mapInArrow(_sets, "key long, hashes array<bigint>")
    counted = hashes.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    often = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow().column(0).to_numpy()
    frequent = np.sort(np.ascontiguousarray(often).astype(np.int64).view(np.uint64))
    fields = ", ".join(f"{p} long" for p in PARITIES)
    begun = bodies.mapInArrow(_prefixes(frequent, least), f"did long, row long, size int, first array<int>, low array<smallint>, {fields}")
    # equal rows have one name
    held = stored(begun.join(named, ["did", "row"]).dropDuplicates(["did", "row"]).select("key", "component", "size", "first", "low", *PARITIES), "prefixes")
    # a shingle of one component alone links nothing new
    each = held.select("component", F.explode("first").alias("token"))
    across = each.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    placed = held.select("key", "component", "size", *PARITIES, F.posexplode("first").alias("at", "token"))
    some = stored(placed.join(across, "token", "left_semi").select("token", "key", "component", "size", (F.col("size") - F.col("at")).alias("left"), *PARITIES), "across")
    a, b = (some.toDF("token", x, f"c{x}", f"n{x}", f"l{x}", *[f"{p}{x}" for p in PARITIES]) for x in "uv")
    # at the first shingle that a pair shares, no more than what is left of both can be shared; nor more than half of what is in both beside
    # the shingles in which their parities show them to differ
    differ = sum((F.bit_count(F.col(f"{p}u").bitwiseXOR(F.col(f"{p}v"))) for p in PARITIES), F.lit(0))
    most = F.least("lu", "lv", (F.col("nu") + F.col("nv") - differ) / 2)
    fits = most >= F.lit(least / (1 + least)) * (F.col("nu") + F.col("nv")) - 1e-9
    pairs = stored(a.join(b, "token").where((F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv")) & fits).select("u", "v").distinct(), "pairs")
    return _likely(pairs, held, least)


def _likely(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets can have the similarity by 16 bits of their shingles: no more are shared than values of both, and
    than the shingles that either has beyond one a value."""
    u = held.select(F.col("key").alias("u"), F.col("size").alias("nu"), F.col("low").alias("x"))
    v = held.select(F.col("key").alias("v"), F.col("size").alias("nv"), F.col("low").alias("y"))
    most = F.size(F.array_intersect("x", "y")) + F.least(F.col("nu") - F.size("x"), F.col("nv") - F.size("y"))
    return pairs.join(u, "u").join(v, "v").where(most >= F.lit(least / (1 + least)) * (F.col("nu") + F.col("nv")) - 1e-9).select("u", "v")


def _linked(pairs: DataFrame, bodies: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have the similarity."""
    wanted = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    where = stored(nodes.join(wanted, "key", "left_semi").select("key", "first.did", "first.row"), "wanted")
    # equal rows have one name
    some = bodies.join(where, ["did", "row"]).dropDuplicates(["did", "row"])
    sets = stored(some.select("key", "body").mapInArrow(_sets, "key long, hashes array<bigint>"), "sets")
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("key").alias("u"), F.col("hashes").alias("x")), "u")
        .join(sets.select(F.col("key").alias("v"), F.col("hashes").alias("y")), "v")
        .where(both >= least * (F.size("x") + F.size("y") - both))
        .select("u", "v")
    )


def first_of_groups(docs: DataFrame, columns: tuple[str, ...], least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, reduced to ``columns`` (doc_id and text among them), that come first in their group of near
    copies: least doc_id, null last.  Groups are linked by all pairs of shingle sets (five words, no repeats) of Jaccard similarity
    ``least`` or more.  Different rows with one id are documents of their own, of equal rows one stays."""
    small_batches(docs.sparkSession)
    none = F.lit(2**63 - 1).cast("long")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), none).alias("_did"),
        row_key(columns).alias("_row"),
        *columns,
    )
    bodies = rows.select(
        F.col("_did").alias("did"), F.col("_row").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")
    )
    fields = ", ".join(f"f{k} long" for k in range(SKETCHES))
    signed = bodies.mapInArrow(_sketches, f"did long, row long, key long, {fields}")
    nodes = stored(
        signed.groupBy("key").agg(F.min(F.struct("did", "row")).alias("first"), *[F.first(f"f{k}").alias(f"f{k}") for k in range(SKETCHES)]),
        "nodes",
    )
    pairs = stored(_candidates(nodes.drop("first")), "candidates")
    # most near copies are linked by their fingerprints; what these miss is looked for between the components that they leave
    links = stored(_linked(pairs, bodies, nodes, least), "links")
    near = stored(connected_components(links), "components")
    named = nodes.join(near, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("component"), "first.did", "first.row")
    more = stored(_shared_prefixes(bodies, named, least), "candidates")
    links = links.unionByName(_linked(more, bodies, nodes, least))
    comps = stored(connected_components(links), "components")
    group = F.coalesce("component", "key")
    kept = stored(
        nodes.select("key", "first").join(comps, F.col("key") == F.col("node"), "left").groupBy(group.alias("group")).agg(F.min("first").alias("first")).select("first.*"),
        "firsts",
    )
    kept = kept.select(F.col("did").alias("_did"), F.col("row").alias("_row"))
    return rows.join(kept, ["_did", "_row"], "left_semi").dropDuplicates(["_did", "_row"]).select(*columns)
