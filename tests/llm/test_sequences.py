"""Phrases, SentencePiece ids and conversation tries against brute force or the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from parchment.llm import phrases, pieces, trie
from tests.llm.fixtures import documents, empty

PATH = public_tokenizers.path(pieces.VOCABULARY)


# phrases


def brute_phrases(rows, least, top=2000):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if 2 <= len(p) and a >= least}
        inside = defaultdict(int)
        for p, a in cands.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s : s + m]] = max(inside[p[s : s + m]], a)
        scored = []
        for p, a in cands.items():
            cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not inside[p] >= a:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("period,bits", [(2, 1 << 27), (16, 64)])
def test_phrases_equal_brute_force(spark, period, bits):
    r = random.Random(4)
    stems = ("the", "of", "a", "In", "to", "né", "　x")
    rows = [(i, r.choice(["en", "fr", None, "und"]), " ".join(r.choice(stems) + r.choice(["", "", "", ",", "\t", ".", "\n"]) for _ in range(r.choice([0, 3, 40, 300])))) for i in range(60)]
    rows += [(1, "en", "one two three four five six " * 30)] * 3 + [(None, None, None), (7, "de", ""), (8, "en", " \t. ;"), (9, "en", "la " * 4000)]
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, lang, t in rows], "doc_id long, text string, lang string, chunk string, freq int")
    got = phrases.collocations(df, least=5, top=50, period=period, bits=bits).collect()
    assert sorted(tuple(x) for x in got) == brute_phrases([(lang, t) for _, lang, t in rows], 5, 50)


def test_phrases_of_the_awkward_documents(spark):
    docs = documents(spark)
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=3).collect())
    assert got == brute_phrases([(x["lang"], x["text"]) for x in docs.collect()], 3) and got
    assert phrases.collocations(empty(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**13
    df = spark.createDataFrame([(big, 10 * big, big, big)], "a long, n long, l long, r long")
    exact = df.selectExpr("(cast(a as decimal(19,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s")
    assert exact.first()["s"] == 10_000


# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(spark, library):
    docs = documents(spark)
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    want = Counter()
    for x in docs.collect():
        ids = library.encode(x["text"] or "", add_eos=True)
        want[x["doc_id"], tuple(ids), library.decode(ids)] += 1
    assert Counter((x["doc_id"], tuple(x["ids"]), x["decoded"]) for x in got) == want
    assert Counter((x["doc_id"], tuple(x["ids"]), x["decoded"]) for x in pieces.encode(docs, PATH, decoded=True).collect()) == want
    assert pieces.encode(empty(spark), PATH).count() == 0
    assert pieces.decode(pieces.encode(empty(spark), PATH), PATH).columns == ["doc_id", "ids", "decoded"]


def test_ids_of_random_texts(library):
    model, r = pieces.PieceModel(PATH), random.Random(5)
    pools = ["thereinonesou    ", "日本語の文章 Привет αβγ مرحبا हिन्दी ক্ষ ொ", "é İıſK ﬁ ½  　\x1c\x00​ 🙂👩‍👧 🇩🇪 \n\t▁ <s></s><unk><0x0A>", "aaaabbb   \n\n", "qzxvjk{}()[]=+-*/\\"]
    for k in range(1500):
        t = "".join(r.choice(r.choice(pools)) if k % 2 else r.choice(pools[k % 5]) for _ in range(r.randint(0, 50)))
        ids = library.encode(t)
        assert model.encode(t).tolist() == ids
        assert model.decode([*ids, 2]) == library.decode([*ids, 2])
    long = "".join(r.choice("therinonesou日本語") for _ in range(60_000)) + "a" * 20_000
    assert model.encode(long).tolist() == library.encode(long)


def test_decoding_any_ids(spark, library):
    model, r = pieces.PieceModel(PATH), random.Random(6)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32000), r.randrange(262), r.choice([0, 1, 2, 259, 13])]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError):
        model.decode([32000])
    df = spark.createDataFrame([(None, "kept"), ([], "x")], "ids array<int>, decoded string")
    assert [tuple(x) for x in pieces.decode(df, PATH).collect()] == [(None, None), ([], "")]


def test_failed_positions_are_not_tried_again(library):
    model = pieces.PieceModel(PATH)
    asked = Counter()
    inner = model.next_shorter
    model.next_shorter = lambda t: asked.update(["n"]) or inner(t)
    text = "▁" + "aaaaaaaab" * 500
    assert model.encode_segment(text)
    assert asked["n"] < 20 * len(text)


# conversations


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in own:
        own[c].sort()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(x[2:] for x in [*own.get(c - c % 100, [])[:h], *turns[h:]])
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    leaves, saved, kids = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ended = ",".join(str(c) for c in m if len(seqs[c]) == len(p))
        parent = members[p[:-1]][0] if p else -1
        out.append((m[0], len(p), parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, depth int, pos string")
    return sorted(tuple(-1 if v is None else v for v in x) for x in trie.prefix_trie(df).collect())


def test_trie_equals_brute_force(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(205, 230), 1003]:  # 200 and 1000 are absent
        for t in range(r.choice([1, 2, 3, 9])):
            rows.append((c, t, r.choice(["user", None, ""]), r.choice(["a", "b", None, "", "é\U0001f642"])))
    rows += rows[:9] + [(3, None, "user", "first"), (None, 0, "user", "lost"), (300, 0, "u", "long " * 20_000)]
    rows += [(c, t, "u", f"turn {t}") for c in (300, 301, 302) for t in range(40)]  # a deep chain, shared and then not
    rows += [(301, 90, "u", "other")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie_of(spark, []) == []
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    assert trie_of(spark, [(turnless, 0, "u", "gone")]) == brute_trie([(turnless, 0, "u", "gone")])


@pytest.mark.parametrize("shape", ["path", "star", "random", "forest"])
def test_contraction(spark, shape):
    r, n = random.Random(2), 90
    up = {
        "path": [i - 1 for i in range(n)], "star": [-1] + [0] * (n - 1),
        "random": [-1] + [r.randrange(i) for i in range(1, n)],
        "forest": [-1 if i % 30 == 0 else i - 1 - (i % 30 > 12) * (i % 7 == 0) for i in range(n)],
    }[shape]
    value = [r.randint(-5, 9) for _ in range(n)]
    want = value[:]
    for i in range(n - 1, 0, -1):
        if up[i] >= 0:
            want[up[i]] += want[i]
    rows = [(0, i, None if u < 0 else 0, None if u < 0 else u, v) for i, (u, v) in enumerate(zip(up, value))]
    tree = spark.createDataFrame(rows, "depth long, conv_id long, up_depth long, up_conv long, w long")
    got = {x["conv_id"]: x["w"] for x in trie.subtree_sums(tree, ("w",)).collect()}
    assert got == dict(enumerate(want))


def test_end_digests_in_blocks(spark):
    ids = random.Random(1).sample(range(10**6), 3000)
    df = spark.createDataFrame([(2, 5, i) for i in ids] + [(1, 5, 7)], "depth long, conv_id long, member long")
    got = {(x[0], x[1]): x[2] for x in trie.end_digests(df, block_bytes=100).collect()}
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert got == {(2, 5): want, (1, 5): hashlib.sha256(b"7").hexdigest()}
