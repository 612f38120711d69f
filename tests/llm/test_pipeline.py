"""The stages of the corpus pipeline, each against a brute-force version on the rows it was given."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from placewise.llm import langid, mixing, packing, quality
from placewise.llm.common import fold, table

from .conftest import DATA
from .test_dedup import _brute as near_copies


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and what it gave, as rows."""
    docs, out = table(spark, DATA, "documents"), {}
    for name, stage in p.STAGES:
        got = stage(spark, docs, DATA)
        if name != "best-fit packing":
            assert got.columns == docs.columns, name
        rows = got.collect()
        out[name] = docs, rows
        docs = spark.createDataFrame(rows, got.schema) if name != "best-fit packing" else None
    return out


def test_language(steps):
    docs, kept = steps["language ID"]
    model = langid.train(docs, fold("doc_id", 5) != 0)
    want = set()
    for r in docs.collect():
        text = r.text or ""
        z = model.bias.astype(float)
        for k, order in enumerate(langid.ORDERS):  # n-gram by n-gram
            (_, h, a, b) = list(langid.grams([text]))[k]
            own = h[a[0] : b[0]]
            assert len(own) == max(0, len(f" {text.lower()} ") - order + 1)
            for x, n in Counter(own.tolist()).items():
                z = z + model.weights[k * langid.BUCKETS + x] * (n / len(own))
        q = np.exp(z / model.temperature - (z / model.temperature).max())
        if any(map(str.isalpha, text)) and (q / q.sum()).max() >= p.LANGUAGE_FROM:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)


def test_quality(spark, steps):
    docs, kept = steps["quality classifier"]
    net = quality.train(docs, table(spark, DATA, "labels"), fold("doc_id", 4) != 2)
    want = set()
    for r in docs.collect():
        data = (r.text or "").encode()
        units, start = [], 0
        while True:
            chunk = np.frombuffer(data[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
            windows = [net.embed[chunk[a : a + quality.WIDTH]].reshape(-1) @ net.filters for a in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            units.append(np.tanh(np.maximum(np.max(windows, axis=0) + net.bias, 0) @ net.hidden + net.hidden_bias))
            if start + quality.CHUNK >= len(data):
                break
            start += quality.HOP
        z = np.concatenate((np.mean(units, axis=0), np.max(units, axis=0))) @ net.out[:, 0] + net.out_bias[0] + net.shift
        if 1 / (1 + np.exp(-z)) >= quality.THRESHOLD:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)
    clean = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    assert len(clean - want) <= 0.05 * len(clean)


def test_near_copies(steps):
    docs, kept = steps["MinHash near-dedup"]
    want = {d for d, _, _, own in near_copies([(r.doc_id, r.text) for r in docs.collect()]) if own}
    assert sorted(r.doc_id for r in kept) == sorted(want) and len(kept) < docs.count()


def test_mix(spark, steps):
    docs, taken = steps["mixing sources"]
    # the same draw as the operator's, then rates by bisection
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), (F.pmod(F.xxhash64("doc_id", mixing._key(F.col("source"))), F.lit(1 << 30)) / float(1 << 30)).alias("u")).toPandas()
    copies = Counter(r.doc_id for r in taken)
    total, names = rows["size"].sum(), sorted(rows.source.unique())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = rows.groupby("source")["size"].sum().to_dict()
    fixed: dict[str, float] = {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (1.5 * total - sum(fixed.values())) * weight[s] / sum(weight[f] for f in free) for s in free}
        if not (over := [s for s in free if share[s] > 2 * own[s]]):
            break
        fixed |= {s: 2.0 * own[s] for s in over}
    for s, goal in (fixed | share).items():
        part = rows[rows.source == s]
        size = part["size"].to_numpy(float)
        low, high = -1.0, 1.0
        for _ in range(200):
            lam = (low + high) / 2
            rate = np.minimum(2, np.exp(np.minimum(lam * size, 1)))
            low, high = (lam, high) if (rate * size).sum() < goal else (low, lam)
        got = np.array([copies[i] for i in part.doc_id])
        assert abs((got * size).sum() - goal) <= max(0.01 * goal, size.max())
        # the common shift, of all there are, whose words come nearest
        first = np.floor((1 - (np.full(len(part), 2.0) if s in fixed else rate) - part.u.to_numpy()) * mixing.BINS)
        made = lambda shift, first=first: sum((first + i * mixing.BINS <= shift).astype(int) for i in range(2))
        shifts = sorted({-(1 << 40), *first.tolist(), *(first + mixing.BINS).tolist()})
        best = min(shifts, key=lambda x: (abs((made(x) * size).sum() - goal), x))
        assert got[size > 0].tolist() == made(best)[size > 0].tolist()


def test_packed(steps):
    from tokenizers import Tokenizer

    docs, pieces = steps["best-fit packing"]
    whole, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 4096):
            want[r.doc_id, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    places: dict[int, list] = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= -(-sum(r.length for r in pieces) // 4096) * 1.02 + 1


def test_run_is_the_stages_in_turn(spark, steps):
    got = Counter((r.doc_id, r.piece, r.length) for r in p.run(spark, DATA).collect())
    assert got == Counter((r.doc_id, r.piece, r.length) for r in steps["best-fit packing"][1])


def test_odd_rows(spark, odd_docs):
    for _, stage in p.STAGES:
        stage(spark, odd_docs, DATA).collect()
        assert stage(spark, odd_docs.limit(0), DATA).count() == 0
    alone = p.dedup_stage(spark, odd_docs, DATA).collect()
    assert sorted(r.doc_id or 0 for r in alone) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 12] and alone[0]["_doc"] == "clash"


def test_near_copies_are_told_by_row(spark):
    """Repeated and null ids: different texts stay, equal ones once; a unique text isn't lost with its id's other row."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long + " end"), (2, "another text that is unique and has enough words"), (3, None), (3, None), (None, "no id but words of its own here"), (None, "no id but words of its own here"), (None, long), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("a"))
    got = Counter((r.doc_id, r.text) for r in p.dedup_stage(spark, docs, DATA).collect())
    assert sum(n for (_, t), n in got.items() if t and t.startswith("w0")) == 1
    assert got[2, rows[2][1]] == 1 and got[None, rows[5][1]] == 1 and got[4, ""] == 1 and got[3, None] == 1 and got[None, None] == 1
