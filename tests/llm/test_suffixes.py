import random
import re
from collections import Counter

import numpy as np
import pytest

from parchment.llm import suffixes
from tests.llm.fixtures import documents, empty


def brute(bodies, n):
    seen = Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        g = np.cumsum(gone[: len(b)]) > 0
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_matches_brute_force(spark, group):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(brute([(r["text"] or "").encode() for r in rows], 400))
    got = suffixes.remove_repeats(docs, group=group, carry=("lang",)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert sum(w[1] for w in want) > 2000


def test_short_repeats_of_few_letters(spark):
    r = random.Random(2)
    bodies = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = suffixes.remove_repeats(docs, min_bytes=12).collect()
    assert sorted((x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == sorted(brute([b.encode() for b in bodies], 12))


def brute_words(bodies, n):
    """Kept text without word runs that repeat; words by white space, case of A-Z aside."""
    words = [b.lower().split() for b in bodies]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for b, w in zip(bodies, words):
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        places = [m.span() for m in re.finditer(rb"[^ \t-\r]+", b)]
        drop = set()
        for k in gone:
            drop.update(range(*places[k]))
            if k + 1 in gone:
                drop.update(range(places[k][1], places[k + 1][0]))
        out.append(bytes(x for i, x in enumerate(b) if i not in drop))
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_words_match_brute_force(spark, group):
    r = random.Random(5)
    shared = [" ".join(r.choice("ab cd efg h".split()) for _ in range(r.randint(8, 30))) for _ in range(6)]
    bodies = []
    for i in range(60):
        x = " ".join(r.choice("ab cd efg h ij kl mn".split()) for _ in range(r.randint(0, 60)))
        bodies.append(f"{x}\n {r.choice(shared).upper() if i % 3 else r.choice(shared)}  {x[: r.randint(0, 40)]}")
    bodies += ["", " \n ", bodies[0], None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffixes.remove_repeats(docs, min_words=10, group=group).collect()}
    want = brute_words([(b or "").encode() for b in bodies], 10)
    assert [got[i] for i in range(len(bodies))] == want
    assert sum(map(len, want)) < sum(len(b or "") for b in bodies)


def test_words_of_scripts_without_spaces():
    body = "ab 日本x y　z".encode()
    starts, stops = suffixes.word_places(body)
    assert [body[a:b].decode() for a, b in zip(starts, stops)] == ["ab", "日", "本", "x", "y", "　", "z"]


def test_empty_table(spark):
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_rounds_give_common_prefixes():
    r = np.random.default_rng(0)
    cells = r.integers(1, 3, (60, 24)).astype(np.uint16)
    cells[10] = cells[3]
    cells[5, 20:] = 0
    low, high = suffixes.sort_rounds(cells, 9, 16)
    for i in range(60):
        hits = [c for c in range(16) if any((cells[i, c : c + 9] == cells[j, c : c + 9]).all() and cells[i, c : c + 9].all() for j in range(60) if j != i) and c + 9 <= 24]
        assert (low[i], high[i]) == ((min(hits), max(hits)) if hits else (-1, -1))
