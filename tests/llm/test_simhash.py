import random

import numpy as np
import xxhash

from parchment.llm import graph, simhash
from tests.llm.fixtures import documents, empty


def brute_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_components_match_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fp"] % 2**64) for r in got if r["doc_id"] is not None) == sorted(
        (False, r["doc_id"], f) for r, f in zip(rows, fps) if r["doc_id"] is not None
    )
    labels = brute_components(fps)
    least = {}
    for r, k in zip(rows, labels):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = {(r["doc_id"], least.get(k)) for r, k in zip(rows, labels)}
    assert {(r["doc_id"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_dense_fingerprints_and_blocks(spark):
    # many fingerprints within a few bits of each other, and blocks far smaller than the groups
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = set()
    for _ in range(300):
        f = centre
        for b in r.sample(range(64), r.randint(0, 6)):
            f ^= 1 << b
        fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(e["u"] % 2**64, e["v"] % 2**64) for e in simhash.near_edges(nodes, block=16).collect()]
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        assert (u ^ v).bit_count() <= 64
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    want = brute_components(fps)
    assert [root(f) for f in fps] == [min(f for f, k in zip(fps, want) if k == w) for w in want]


def test_thresholds_add_up_and_are_cheapest():
    r = np.random.default_rng(1)
    costs = r.random((50, 4, 5)) * 10
    t = simhash.allocate(costs, 0)
    assert (t.sum(axis=1) == 0).all() and (t >= -1).all()
    from itertools import product

    for q in range(10):
        best = min(sum(costs[q, i, x + 1] for i, x in enumerate(c)) for c in product(range(-1, 4), repeat=4) if sum(c) == 0)
        assert abs(sum(costs[q, i, x + 1] for i, x in enumerate(t[q])) - best) < 1e-9


def test_graph_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and 200 not in got


def test_no_pair_of_the_similarity_is_left_out(spark):
    """Texts at and just above 0.8, below it, and chains, against all pairs."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    sets = {i: frozenset(simhash._shingle_set(t.encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.first_of_groups(docs, ("doc_id", "text")).collect())
    assert got == sorted({find(i) for i in sets})


def test_pairs_below_the_similarity_are_sorted_out_by_few_bits(spark):
    """No pair of the similarity is lost; of sets that share only a part most go before whole sets are compared."""
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**64, 30_000, np.uint64)
    sets = [np.unique(r.choice(pool, 6000)) for _ in range(8)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * k)], r.integers(0, 2**64, 500, np.uint64)])) for s in sets[:4] for k in (0.8, 0.9, 0.95)]
    rows = [(i, len(s), np.unique(s.astype(np.uint16)).view(np.int16).tolist()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "key long, size int, low array<smallint>")
    every = [(u, v) for u in range(len(sets)) for v in range(u)]
    got = {(x["u"], x["v"]) for x in simhash._likely(spark.createDataFrame(every, "u long, v long"), held, 0.8).collect()}
    alike = {(u, v) for u, v in every if len(np.intersect1d(sets[u], sets[v])) >= 0.8 * len(np.union1d(sets[u], sets[v]))}
    assert alike and alike <= got and len(got) < len(every) // 4


def test_what_near_copies_shuffle_is_bounded_by_the_texts(spark):
    """Texts go over the wire for the sets of either kind of candidate and for the rows that stay, where Spark can't send the names to them."""
    import random

    rng = random.Random(7)
    docs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))) for i in range(200)]
    docs += [(1000 + i, t + " more") for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    executor = spark.sparkContext._jsc.sc().statusStore().executorSummary
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = executor("driver").totalShuffleWrite()
        assert simhash.first_of_groups(frame, ("doc_id", "text")).count() == 200
        written = executor("driver").totalShuffleWrite() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert written < 6 * sum(len(t) for _, t in docs)


def test_parities_show_no_more_differences_than_there_are():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (set(rng.integers(0, 400, rng.integers(0, 300)).tolist()) for _ in "ab")
        x, y = (np.array([xxhash.xxh64_intdigest(str(v)) for v in sorted(s)], np.uint64) for s in (a, b))
        assert int(np.bitwise_count((simhash._parities(x) ^ simhash._parities(y)).view(np.uint64)).sum()) <= len(a ^ b)


def test_a_fingerprint_of_a_large_group_makes_one_candidate(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(250):
        words = list(base)
        for at in rng.sample(range(400), 4):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    bodies = spark.createDataFrame(rows, "did long, text string").selectExpr("did", "did AS row", "cast(text AS binary) AS body")
    fields = ", ".join(f"f{k} long" for k in range(simhash.SKETCHES))
    nodes = bodies.mapInArrow(simhash._sketches, f"did long, row long, key long, {fields}").drop("did", "row")
    found = simhash._candidates(nodes.dropDuplicates(["key"])).count()
    assert 0 < found <= simhash.SKETCHES * 250
