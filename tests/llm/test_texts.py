"""Token counts, media, languages, toxicity, language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from parchment.llm import gif, langid, lm, tokens, toxicity
from tests.llm.fixtures import documents, empty, words

PATH = public_tokenizers.path(tokens.VOCABULARY)


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = documents(spark)
    got = tokens.prefix_counts(docs, PATH).collect()
    want = Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert tokens.prefix_counts(empty(spark), PATH).count() == 0


def test_every_prefix_and_budget(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    cases = ["Hello  WORLD it's<|endoftext|>x", "İst ΑΣ éx can'LL 12a", "don''t 'S #!x é’s", "日本語 <|startoftext|", "thanedble&&& inoring***", "\n\n  "]
    counter = tokens.PrefixCounter(PATH)
    for t in cases:
        want = [len(library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))]
        assert np.cumsum(counter.text_steps(t), dtype=int).tolist() == want
    docs = spark.createDataFrame([(1, "the quick brown foxes jumped")], "doc_id long, text string")
    counts = tokens.prefix_counts(docs, PATH)
    assert counts.select(tokens.tokens_at("steps", "n_bytes").alias("n")).first()["n"] == counts.first()["n_tokens"]
    cut = tokens.truncated(docs, counts, 3).first()["text"]
    assert len(library.encode(cut, add_special_tokens=False).ids) <= 3 and cut.startswith("the quick brown")


def test_every_prefix_in_every_script():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    counter = tokens.PrefixCounter(PATH)
    pools = [
        "don't we're they've i'll 'sab ''s 'r 're're 'l 'lle !'s it's'd 'Tis O'RE 've' ' ''",
        "<|endoftext|> <|startoftext|>x !!<|endoftext|>!! <|endoftext <|<|endoftext|>",
        "日本語の文章と漢字かな交じり Привет мир ДЕЛА αβγ ΣΑΣ ς مرحبا ١٢٣ हिन्दी ক্ষ ொ",
        "e\u0301a\u0323\u0302 o\u0302\u0301 q\u0323\u0307 \u1112\u1161\u11ab\u1100\u1173\u11af 한국어",
        "İIıſK ßẞ ﬁ Ⅷ ½ ² ٣ १ \u00a0\u3000\u2028\u0085\x1c\x00\u200b\u00ad 🙂👩\u200d👧 🇩🇪 abc ABC 123 x1y2 ---",
    ]
    parts, r = [w for p in pools for w in p.split(" ")], random.Random(6)
    for k in range(400):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 5))) if k % 2 else "".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 25)))
        want = [len(e.ids) for e in library.encode_batch([t[: i + 1] for i in range(len(t))], add_special_tokens=False)]
        assert np.cumsum(counter.text_steps(t), dtype=int).tolist() == want, t


@pytest.mark.parametrize("letters", [(0x4E00, 0x9FFF), (0x430, 0x44F), (97, 97), (39, 40)])
def test_very_long_words(letters):
    import time

    from tokenizers import Tokenizer

    r = random.Random(2)
    t = "".join(chr(r.randint(*letters)) for _ in range(60_000))
    began = time.time()
    assert int(tokens.PrefixCounter(PATH).text_steps(t).sum(dtype=int)) == len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids)
    assert time.time() - began < 30


def test_steps_of_any_width():
    for most in (1, 127, 128, 40_000, 1 << 40):
        a = np.array([0, most, -most, 3])
        assert tokens.unpack_steps(tokens.pack_steps(a)).tolist() == a.tolist()
    assert len(tokens.unpack_steps(tokens.pack_steps(np.zeros(0, np.int8)))) == 0


def test_gif_round_trip(spark):
    docs = documents(spark)
    got = gif.media_columns(docs).collect()
    want = Counter()
    for r in docs.collect():
        b = (r["text"] or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want[r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert gif.media_columns(empty(spark)).count() == 0
    assert gif.frames(gif.to_media(docs)).count() >= docs.count()


def test_gif_long_payload_has_timed_frames():
    r = random.Random(1)
    p = bytes(r.randrange(256) for _ in range(192 * 2100))
    fs = [(f.height, f.delay, f.shown[..., 0].tobytes()) for f in gif.decode(gif.encode(p))]
    assert len(fs) == 3 and b"".join(f[2] for f in fs) == p and all(f[1] == gif.DELAY for f in fs)


def _image(left, top, w, h, samples, disposal=0, clear=None, interlace=False, palette=None):
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
    flags = (0x40 if interlace else 0) | (0x80 | 7 if palette else 0)
    import struct

    body = b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (palette or b"") + b"\x08" + gif._chunks(gif.lzw_encode(bytes(samples)))
    return control + body


def test_gif_disposal_transparency_interlace():
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0xF7, 0, 0) + gif._RAMP
    rows = gif._interlaced(8)
    stored = [v for k in rows for v in (int(k) + 1, int(k) + 11)]
    red = bytes([255, 0, 0]) + bytes(3 * 255)
    media = head + _image(0, 0, 2, 8, stored, 1, interlace=True) + _image(0, 0, 2, 1, [0, 9], 3, clear=9, palette=red) + _image(1, 1, 1, 1, [77], 2) + _image(0, 7, 1, 1, [5]) + b"\x3b"
    canvases = [f.canvas[..., :3].copy() for f in gif.decode(media)]
    assert canvases[0][:, 0, 0].tolist() == list(range(1, 9)) and canvases[0][3, 1].tolist() == [14, 14, 14]
    assert canvases[1][0, 0].tolist() == [255, 0, 0] and canvases[1][0, 1].tolist() == [11, 11, 11]  # transparent keeps what was
    assert canvases[2][0, 0].tolist() == [1, 1, 1] and canvases[2][1, 1].tolist() == [77, 77, 77]  # restored before
    assert canvases[3][1, 1].tolist() == [0, 0, 0] and canvases[3][7, 0].tolist() == [5, 5, 5]  # cleared
    assert gif.lzw_decode(gif.lzw_encode(b"\0" * 70000), 8, 70000) == b"\0" * 70000


def test_language_spans(spark):
    r = random.Random(4)
    en, de = ("the", "ing", "that", "and", "with"), ("der", "ung", "schön", "über", "und")
    ru = ("это", "как", "что", "нет")
    rows = []
    for i in range(120):
        stems, lang = ((en, "en"), (de, "de"), (ru, "ru"))[i % 3]
        rows.append((i, words(r, 60, stems), lang))
    mixed = words(r, 80, en) + " " + words(r, 80, de)
    rows += [(1000, mixed, None), (1001, None, "en"), (1002, "123 !!", "de"), (1003, "", None), (1004, words(r, 2000, ru), None), (None, words(r, 9, en), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.label_spans(docs, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert [s["lang"] for s in got[1000]["spans"]] == ["en", "de"]
    assert abs(got[1000]["spans"][1]["first_word"] - 80) <= 2
    assert got[1001]["lang_pred"] == got[1002]["lang_pred"] == got[1003]["lang_pred"] == "und"
    assert got[1004]["lang_pred"] == "ru" and got[None]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    none = docs.where("false")
    assert langid.train(none) is None and langid.label_spans(docs, None).where("lang_pred <> 'und'").count() == 0


def test_viterbi_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(10):
        k = 3
        e = np.concatenate([-r.random((20, k)) * 8, np.zeros((1, k))]).astype(np.float32)
        sizes = r.integers(0, 400, 6)
        codes = r.integers(0, 20, sizes.sum())
        labels, a = langid.viterbi(e, codes, sizes, 3.0), 0
        for n in sizes:
            c, lab = e[codes[a : a + n]].astype(float), labels[a : a + n]
            a += n
            if n:
                v = c[0].copy()
                for t in range(1, n):
                    v = np.maximum(v, v.max() - 3.0) + c[t]
                assert abs(c[np.arange(n), lab].sum() - 3.0 * (lab[1:] != lab[:-1]).sum() - v.max()) < 1e-2


def test_toxicity_gradients_and_lean_pass():
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network(1).items()}
    r = np.random.default_rng(0)
    x = r.standard_normal((9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    x[-1] = 0
    cells = r.integers(0, 8, (3, toxicity.WINDOW))
    inside = np.ones_like(cells, bool)
    inside[1, 10:] = False
    cells[~inside] = 8
    y = np.array([1.0, 0, 1])

    def loss():
        z = toxicity.forward(net, x, cells, inside)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    cache = {}
    z = toxicity.forward(net, x, cells, inside, cache)
    g, dx = toxicity.backward(net, x, cells, inside, cache, (toxicity._sigmoid(z) - y) / 3)
    for k in ("Wf", "Wb", "Uf", "Ub", "A", "v", "o"):
        at = tuple(r.integers(0, s) for s in net[k].shape)
        old = net[k][at]
        net[k][at] = old + 1e-3
        up = loss()
        net[k][at] = old - 1e-3
        down = loss()
        net[k][at] = old
        assert abs(g[k][at] - (up - down) / 2e-3) < 1e-5
    lean = toxicity.lean_logits(net, toxicity.projections(net, x), cells, inside)
    assert np.allclose(lean, z, atol=1e-4)


def test_toxicity_held_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        w = words(r, r.randint(20, 150)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["moron", "scum", "grubful", "grubish"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.train_model(docs, spark.createDataFrame(labels + [(900, None)], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, net).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.9 and got[900] == got[901] == 0
    assert toxicity.score(docs, None).where("score > 0").count() == 0
    assert toxicity.train_model(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_language_model_counts_and_scores(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update((r["text"] or "").encode().lower().split())
            counts[b"\0end"] += 1
    n, v = sum(counts.values()), len(counts)
    got = Counter()
    for x in lm.score(docs).collect():
        got[x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)] += 1
        assert math.isfinite(x["score"]) and x["score"] < 0
    want = Counter()
    for r in rows:
        ts = [*(r["text"] or "").encode().lower().split(), b"\0end"]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        want[r["doc_id"], len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)] += 1
    assert got == want
    assert lm.score(empty(spark)).count() == 0


def test_language_model_is_normalised():
    net = lm.new_parameters(40, np.ones(40))
    z = lm.log_normalisers(net)
    h = net["R1"][3] + net["R2"][5]
    assert abs(np.exp(h @ net["Q"].T + net["b"] - z[3, 5]).sum() - 1) < 1e-5
    target, c1, c2 = lm.contexts(np.array([7, 8, 9], np.int32), np.array([2, 0, 1]))
    assert target.tolist() == [7, 8, 0, 0, 9, 0] and c1.tolist() == [0, 7, 8, 0, 0, 9] and c2.tolist() == [0, 0, 7, 0, 0, 0]


@pytest.mark.parametrize("op", ["tox", "lang"])
def test_empty_tables(spark, op):
    e = empty(spark)
    out = toxicity.score(e, None) if op == "tox" else langid.label_spans(e, None)
    assert out.count() == 0


def test_toxicity_inputs_take_bounded_memory():
    """Words are hashed some at a time; the memory of a step does not follow all letters of the distinct words."""
    import tracemalloc

    r = random.Random(3)
    body = " ".join("".join(r.choices("abcdefghij", k=30)) for _ in range(60_000))
    net = toxicity.new_network(1)
    tracemalloc.start()
    codes, words, sizes = toxicity._numbered([body, "", body])
    got = words.inputs(net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert sizes.tolist() == [60_000, 0, 60_000] and (codes[:60_000] == codes[60_000:]).all()
    some = [0, 1, 16_383, 16_384, 59_999]
    alone = toxicity.Words([body.split()[i] for i in some])
    assert (alone.inputs(net)[:-1] == got[some]).all() and not got[-1].any()


def test_toxicity_fit_reads_every_window_of_the_labelled_texts(monkeypatch):
    """Long texts too: those of label 0 in every word, and all windows of both labels are ranked in each round."""
    texts = [" ".join(f"w{i}x{k}" for k in range(700)) for i in range(20)]
    labels = [i % 2 for i in range(20)]
    kept = [i for i in range(20) if i % 5 == 4]
    monkeypatch.setattr(toxicity, "HIDE", 0.0)
    monkeypatch.setattr(toxicity, "LEAST_ROWS", 1)
    read, ranked = set(), []
    step, logits = toxicity.Fitter.step, toxicity.window_logits

    def stepping(self, words, cells, inside, target, weight):
        read.update(cells[inside].tolist())
        step(self, words, cells, inside, target, weight)

    def ranking(net, words, codes, start, stop):
        ranked.append(start.tolist())
        return logits(net, words, codes, start, stop)

    monkeypatch.setattr(toxicity.Fitter, "step", stepping)
    monkeypatch.setattr(toxicity, "window_logits", ranking)
    toxicity.fit(texts, np.array(labels), 0.5)
    # words are numbered in the order of the texts, 700 each
    assert {i * 700 + k for i in range(20) if labels[i] == 0 and i not in kept for k in range(700)} <= read
    assert not read & {i * 700 + k for i in kept for k in range(700)}
    _, start = toxicity.windows_of(np.full(20, 700))
    fitted = sorted(x for x in start.tolist() if x // 700 not in kept)
    assert len(fitted) > 12 * 16 and [sorted(x) for x in ranked[:-1]] == [fitted] * toxicity.ROUNDS
