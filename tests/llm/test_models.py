"""Language ID, quality and language-model scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from placewise.llm import langid, lm, quality
from placewise.llm.common import fold, least_hashed, steps, table, utf8, within_bytes, word_bounds

from .conftest import DATA


def test_least_hashed(spark):
    ids = spark.range(0, 5000, 1, 7).select(F.col("id").alias("doc_id")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS doc_id UNION ALL SELECT 3L"))
    want = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
    for size in (1, 300, 6000):
        assert least_hashed(ids, size).collect() == want.limit(size).collect()
    assert least_hashed(ids.limit(0), 5).count() == 0
    often = spark.range(5000).select((F.col("id") % 4).alias("doc_id"))
    assert least_hashed(often, 3).collect() == often.distinct().orderBy(F.xxhash64("doc_id")).limit(3).collect()


def test_within_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, "x" * 10) for i in range(40)] + [(99, 2, "x" * 10)], "doc_id long, kind int, text string")
    got = within_bytes(rows, F.octet_length("text"), ["kind"], 110).collect()
    assert len(got) == 11 and sorted(r.kind for r in got) == [0] * 5 + [1] * 5 + [2]


def test_fold_is_crc32(spark):
    got = {r["id"]: r["f"] for r in spark.range(50).select("id", fold("id", 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_words_of_steps():
    import pyarrow as pa

    data, bounds = utf8(pa.array(["a bb", None, "", "ccc\x0bd", " e ", "f"]))
    starts, ends, n = word_bounds(data, bounds)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bb", "ccc", "d", "e", "f"]
    assert n.tolist() == [2, 0, 0, 2, 1, 1]
    assert list(steps(bounds, 4)) == [(0, 3), (3, 4), (4, 6)]


def test_language_held_out(spark):
    got = langid.op1_language_id(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 200 and len(held) > 10
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_scores_are_the_dot_product():
    r = np.random.default_rng(1)
    w = r.standard_normal((len(langid.ORDERS) * langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], w, r.standard_normal(3), 1.7)
    texts = ["Hello world", "", "é", "ab " * 50]
    for t, p in zip(texts, model.scores(texts), strict=True):
        logits = model.bias.copy()
        for k, h, a, b in langid.grams([t]):
            for x in h[a[0] : b[0]]:
                logits += w[k * langid.BUCKETS + x] / (b[0] - a[0])
        assert p == pytest.approx(langid.softmax(logits / 1.7), abs=1e-5)


def test_ftrl_is_sparse_and_temperature_calibrates():
    r = np.random.default_rng(0)
    rows = []
    for i in range(300):
        c = i % 2
        rows.append((np.array([c, 2 + int(r.integers(50))]), np.array([1.0, 0.01]), c))
    w = langid.ftrl(rows, 60, 2, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[2:] == 0).mean() > 0.9
    logits = r.standard_normal((4000, 3)) * 2
    labels = np.array([r.choice(3, p=p) for p in langid.softmax(logits)])
    assert langid.fit_temperature(logits * 3, labels) == pytest.approx(3, rel=0.15)
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_rare_language_is_learned(spark):
    common = table(spark, DATA, "documents").where("lang IN ('en', 'de')").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**6 + i, f"kiel vi fartas hodiaŭ mia kara amiko {i}", "eo") for i in range(3)], "doc_id long, text string, lang string")
    model = langid.train(common.unionByName(rare), F.lit(True), sample=1)
    assert model.classes == ["de", "en", "eo"]
    ids = langid.least_of_each(common.select("doc_id", "lang"), 2)
    assert sorted(r.lang for r in common.join(ids, "doc_id").collect()) == ["de", "de", "en", "en"]


def test_language_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    assert model.classes == ["de", "en", "es", "fr"]
    got = {r["doc_id"]: r for r in langid.predict(odd_docs.withColumn("_judged", F.lit("kept")), model).collect()}
    assert {r["_judged"] for r in got.values()} == {"kept"}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 8))
    assert got[1].lang_pred == "en" and got[1].score == got[7].score and got[6].lang_pred in model.classes
    assert got[1]["key"] == "clash"
    nothing = langid.train(no_docs, F.lit(True))
    assert nothing.classes == [] and langid.predict(no_docs, nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def test_quality_gradients():
    net = quality.Net.new(2)
    r = np.random.default_rng(3)
    for p in net.params():
        p[:] = r.standard_normal(p.shape) * 0.3
    chunks = r.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8)
    n, labels = np.array([2, 3]), np.array([1.0, 0.0], np.float32)

    def loss() -> float:
        z = net.odds(net.pooled(chunks), n)
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    for p, g in zip(net.params(), quality._gradients(net, chunks, n, labels), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, h = p[i], 2e-3
        p[i] = old + h
        up = loss()
        p[i] = old - h
        down = loss()
        p[i] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g[i]), rel=0.1, abs=2e-3)


def test_quality_scores_against_a_naive_pass():
    """Byte by byte, filter by filter, chunk by chunk."""
    net = quality.Net.new(4)
    r = np.random.default_rng(6)
    for p in net.params():
        p[:] = r.standard_normal(p.shape) * 0.3
    net.shift = 0.25
    texts = [b"", b"a", "Ünï çödé text".encode(), bytes(r.integers(1, 256, 255).astype(np.uint8)), bytes(r.integers(1, 256, 256).astype(np.uint8)), bytes(r.integers(1, 256, 1500).astype(np.uint8))]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for text, score in zip(texts, got, strict=True):
        units, start = [], 0
        while True:
            chunk = text[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            best = []
            for f in range(quality.FILTERS):
                answers = []
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                    answers.append(sum(float(net.embed[chunk[at + i], e]) * float(net.filters[i * quality.EMBED + e, f]) for i in range(quality.WIDTH) for e in range(quality.EMBED)))
                best.append(max(0.0, max(answers) + float(net.bias[f])))
            units.append([math.tanh(sum(b * float(net.hidden[f, h]) for f, b in enumerate(best)) + float(net.hidden_bias[h])) for h in range(quality.HIDDEN)])
            if start + quality.CHUNK >= len(text):
                break
            start += quality.HOP
        pooled = [sum(u[h] for u in units) / len(units) for h in range(quality.HIDDEN)] + [max(u[h] for u in units) for h in range(quality.HIDDEN)]
        z = sum(p * float(w) for p, w in zip(pooled, net.out[:, 0], strict=True)) + float(net.out_bias[0]) + 0.25
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_quality_training_sees_whole_texts_in_steps(monkeypatch):
    """The gradients of many chunks are the same whatever the size of a step."""
    net, r = quality.Net.new(2), np.random.default_rng(3)
    chunks, n, labels = r.integers(0, 256, (40, quality.CHUNK)).astype(np.uint8), np.array([30, 10]), np.array([1.0, 0.0], np.float32)
    want = quality._gradients(net, chunks, n, labels)
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    for a, b in zip(quality._gradients(net, chunks, n, labels), want, strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_quality_chunks_cover_every_byte():
    for size in (0, 1, 255, 256, 257, 496, 497, 5000):
        starts, n = quality.chunks_of(np.zeros(size, np.uint8), np.array([0, size]))
        covered = np.zeros(size, bool)
        for s in starts:
            covered[s : s + quality.CHUNK] = True
        assert covered.all() and n.tolist() == [len(starts)]


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    rank = held.score.rank()
    ones, zeros = (held.quality == 1).sum(), (held.quality == 0).sum()
    assert (rank[held.quality == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    net = quality.train(odd_docs, labels, F.lit(True), sample=10)
    got = [(r["doc_id"], r["score"]) for r in quality.predict(odd_docs, net).collect()]
    score = dict(got)
    assert len(got) == 14 and all(0 <= s <= 1 for _, s in got) and score[2] == score[3] and score[1] == score[7]
    assert quality.predict(no_docs, quality.train(no_docs, labels, F.lit(True))).count() == 0


def _brute(rows):
    """Tokens, counts and base scores in plain Python."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    tokens = [(i, learn, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t, learn in rows]
    count = Counter(w for _, learn, ws in tokens if learn for w in ws)
    n, v = sum(count.values()), len(count)
    base = [(i, len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, _, ws in tokens]
    return n, base


def test_lm_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in table(spark, DATA, "documents").collect()]
    n, base = _brute(rows)
    got = {r["doc_id"]: r for r in lm.op10_lm_score(spark, DATA).collect()}
    assert len(got) == len(rows)
    for (i, tokens, known, score), (_, _, learn) in zip(base, rows, strict=True):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (tokens, known, n, not learn)
        assert got[i].base_score == pytest.approx(score, abs=1e-6)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_lm_odd_rows(odd_docs, no_docs):
    slim = odd_docs.where("doc_id IS NULL OR doc_id != 5")
    learn = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    rows = [(r["doc_id"], r["text"], r["doc_id"] is not None and r["doc_id"] % 2 == 1) for r in slim.collect()]
    n, base = _brute(rows)
    got = sorted((r["doc_id"] or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score_documents(slim, learn, group_bytes=1000).collect())
    assert got == sorted((i or -1, t, k, round(s, 6)) for i, t, k, s in base)
    assert lm.score_documents(no_docs, F.lit(True)).count() == 0
    none = lm.score_documents(slim, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none)


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    pairs = np.zeros((lm.SYMBOLS, lm.SYMBOLS))
    types = np.zeros(lm.SYMBOLS)
    own = [*range(20), lm.TOP, lm.TOP + 1, lm.TOP + 3, lm.END]
    for a in own:
        pairs[a, own] = r.integers(0, 9, len(own))
    types[:20], types[lm.END], types[lm.TOP], types[lm.TOP + 1], types[lm.TOP + 3] = 1, 1, 30, 11, 4
    model = lm.fit(pairs, types, 20)
    counts = pairs.sum(0)
    for before in (0, 7, lm.TOP, lm.END, lm.UNKNOWN):
        total = 0.0
        for s in [*own, lm.UNKNOWN]:
            p = 10 ** (model.step[model.cls[before], model.cls[s]] - model.under[s])
            total += p * (1 if s == lm.UNKNOWN else counts[s] + types[s])
        assert total == pytest.approx(1)


def test_lm_places_words_by_their_neighbours():
    import pyarrow as pa

    texts = ["a x b", "A y b x", "", "b z", "z"]
    h = {w: int(lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([1])).view(np.int64)[0]) for w in "abxyz"}
    top, cls = np.array([h["a"], h["b"]]), np.array([0, 1])
    z = [zstandard.compress("".join(t).encode()) for t in (texts[:3], texts[3:])]
    docs = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([[len(t) for t in texts[:3]], [len(t) for t in texts[3:]]]), pa.array(z)], ["grp", "sizes", "z"])
    got = pa.Table.from_batches(lm._neighbours(top, cls, np.array([h["x"], h["y"]]), np.array([True, False]))(iter([docs.slice(0, 1), docs.slice(1)]))).to_pylist()
    near = {(r["h"], r["salt"]): sorted(zip(r["near"][::2], r["near"][1::2], strict=True)) for r in got}
    other, end, right = lm.OTHER_SIDE, lm.END_SIDE, lm.RIGHT
    assert near == {(h["x"], 8): [(0, 1 + right), (1, end + right)], (h["z"], -1): [(1, end + right), (end, end + right)]}
    seen = next(lm._top_pairs(top)(iter([docs.select(["sizes", "z"])])))
    n = {divmod(p, lm.SYMBOLS): k for p, k in zip(*(c.to_pylist() for c in seen.columns), strict=True)}
    assert n == {(lm.END, 0): 2, (0, lm.TOP): 2, (lm.TOP, 1): 2, (1, lm.END): 1, (1, lm.TOP): 2, (lm.TOP, lm.END): 3, (lm.END, lm.END): 1, (lm.END, 1): 1, (lm.END, lm.TOP): 1}
    # a word's rows may lie in two batches; rare words go; a salted word's sums are kept
    prefer = np.zeros((256, 2))
    prefer[0, 0] = prefer[1, 1] = 1.0
    rows = [([4, 5, 7], [-1, -1, -1], [bytes(2), bytes(4), bytes([1] * 4)]), ([7, 7], [-1, -1], [bytes(4), bytes(4)]), ([9, 9], [-1, 3], [bytes([1] * 9 + [0]), bytes([1, 0])])]
    made = [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c)], ["h", "salt", "near"]) for a, b, c in rows]
    assert pa.Table.from_batches(lm._placed(prefer)(iter(made))).to_pylist() == [
        {"h": 5, "k": 0, "sums": None}, {"h": 7, "k": 0, "sums": None}, {"h": 9, "k": 1, "sums": None}, {"h": 9, "k": -1, "sums": [1.0, 1.0]},
    ]


def _naive_scores(rows):
    """The model word by word in plain Python; only the exchange of the top words is the operator's own."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    end = ("end",)
    texts = [(i, learn, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))) for i, t, learn in rows]
    count = Counter(w for _, learn, ws in texts if learn for w in ws)
    name = {w: int(lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)[0]) for w in count}
    top = sorted(count, key=lambda w: (-count[w], name[w]))[: lm.TOP]
    rank = {w: i for i, w in enumerate(top)}
    follow = Counter()
    for _, learn, ws in texts:
        if learn:
            run = [end, *ws, end]
            follow.update(zip(run, run[1:], strict=False))
    coarse = np.zeros((lm.SYMBOLS, lm.SYMBOLS))
    at = lambda w: lm.END if w == end else rank.get(w, lm.TOP)
    for (a, b), n in follow.items():
        coarse[at(a), at(b)] += n
    own = lm.exchange(coarse, len(top))
    kinds = int(own[: len(top)].max()) + 1
    side = lambda w: "end" if w == end else int(own[rank[w]]) if w in rank else "other"
    sides = Counter()
    for (a, b), n in follow.items():
        sides[side(a), side(b)] += n
    labels = [*range(lm.CLASSES), "other", "end"]
    heads, tails = Counter(), Counter()
    for (a, b), n in sides.items():
        heads[a] += n
        tails[b] += n
    whole = sum(sides.values())

    def right(k, b):  # log P(b follows | class k)
        share = (tails[b] + 1) / (whole + len(labels))
        return math.log((sides[k, b] + lm.SMOOTHING * share) / (heads[k] + lm.SMOOTHING))

    def left(k, a):
        share = (heads[a] + 1) / (whole + len(labels))
        return math.log((sides[a, k] + lm.SMOOTHING * share) / (tails[k] + lm.SMOOTHING))

    cls = {w: ("top", int(own[r])) for w, r in rank.items()} | {end: end}
    before, after = {}, {}
    for (a, b), n in follow.items():
        before.setdefault(b, Counter())[side(a)] += n
        after.setdefault(a, Counter())[side(b)] += n
    for w in count:
        if w not in cls:
            if count[w] >= lm.PLACED_FROM:
                gain = [sum(n * left(k, a) for a, n in before[w].items()) + sum(n * right(k, b) for b, n in after[w].items()) for k in range(kinds)]
                cls[w] = ("top", int(np.round(gain, 6).argmax()))
            else:
                cls[w] = ("band", math.ceil(math.log2(count[w])))
    count[end] = sum(learn for _, learn, _ in texts)
    types = Counter(cls[w] for w in count)
    size, pairs = Counter(), Counter()
    for (a, b), n in follow.items():
        pairs[cls[a], cls[b]] += n
        size[cls[b]] += n
    heads = Counter()
    for (a, _), n in pairs.items():
        heads[a] += n
    mass = sum(size[c] + types[c] for c in types)
    once, n1, n2 = ("band", 0), types["band", 0], sum(n == 2 for w, n in count.items() if w not in rank and w != end)
    part = (n1 + 1) / (n1 + 2 * n2 + 2) if n1 else None

    def step(a, b):
        share = (size[b] + types[b]) / mass
        return (pairs[a, b] + lm.SMOOTHING * share) / (heads[a] + lm.SMOOTHING)

    def p(a, w):
        a = cls.get(a, "unknown")
        if w in cls:
            c = cls[w]
            q = step(a, c) * (1 if part is None else 1 - part if c == once else 1)
            return q * (count[w] + 1) / (size[c] + types[c])
        return step(a, once) * part

    return {i: sum(math.log10(p(a, b)) for a, b in zip([end, *ws], [*ws, end], strict=True)) for i, _, ws in texts}


@pytest.mark.parametrize(("hot", "group_bytes"), [(lm.HOT, lm.GROUP_BYTES), (500, 100_000)])
def test_lm_scores_against_brute_force(spark, hot, group_bytes):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in docs.collect()]
    want = _naive_scores(rows)
    got = lm.score_documents(docs, fold("doc_id", 7) != 2, group_bytes, hot).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-4)


def test_lm_words_beyond_the_top_have_classes(spark):
    got = lm.op10_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-got.s / got.n) < 1400  # 1,698 with classes for the 1,024 most frequent words only


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(5)
    hidden = np.arange(24) % 3
    pairs = np.where(hidden[:, None] == (hidden[None, :] + 1) % 3, 20, 1) + r.integers(0, 2, (24, 24))
    full = np.zeros((26, 26))
    full[:24, :24] = pairs
    cls = lm.exchange(full, 24, 3, 10)
    assert len(set(zip(hidden.tolist(), cls[:24].tolist(), strict=True))) == 3 and len(set(cls[24:].tolist())) == 2
