from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import common, dedup, graph
from placewise.llm.shingles import permutations, shingle_sets, signature

from .conftest import DATA


def _brute(rows):
    """Components by comparing every pair of sets of strings."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows))


def _got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect())


def test_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = _got(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert got == _brute(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert got == sorted(con.sql(dedup.OP8_SQL).fetchall())


def test_chains_and_blocks(spark, monkeypatch):
    """A chain of texts, each alike the next one only, and a large group dealt into small blocks."""
    monkeypatch.setattr(dedup, "BLOCK", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    chain = [(100 + k, " ".join(words[8 * k : 8 * k + 100])) for k in range(30)]
    base = [f"v{i}" for i in range(120)]
    group = []
    for k in range(25):
        own = list(base)
        for _ in range(int(r.integers(1, 4))):
            own[int(r.integers(120))] = f"x{k}"
        group.append((500 + k, " ".join(own)))
    rows = [*chain, *group, (1, "a b"), (2, "A  b"), (3, None), (4, "")]
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_pairs_under_the_distance_share_a_key():
    r = np.random.default_rng(1)
    size = dedup.CHUNKS * dedup.WIDTH
    least = dedup.CHUNKS * (dedup.ERRORS + 1)
    for _ in range(200):
        a = r.integers(0, 65536, size).astype(np.uint16)
        b = a.copy()
        at = r.choice(size, least - 1, replace=False)
        b[at] ^= 1
        keys = dedup.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()
    far = dedup.chunk_keys(r.integers(0, 65536, (2, size)).astype(np.uint16))
    assert not (far[0] == far[1]).any()


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(2).integers(0, 2**63, 4000).astype(np.uint64))
    p = permutations(400)
    one, two = signature(a[:3000], *p), signature(a[1000:], *p)
    assert (one == two).mean() == pytest.approx(2000 / len(a), abs=0.1)


def test_shingles_of_short_and_odd_rows():
    data = b"a b c dA B C Dx y\tz\n1 2 3"
    sets = list(shingle_sets(np.frombuffer(data, np.uint8), np.array([0, 7, 14, 14, len(data)])))
    assert [len(s) for s in sets] == [1, 1, 0, 2] and sets[0][0] == sets[1][0]


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in dedup.near_duplicates(odd_docs).collect()}
    assert got[7].component_id == 1 and not got[7].kept and got[1].kept
    assert got[11].component_id == 10 and got[5].n_shingles == 29_996 and got[6].n_shingles == 1
    assert all(got[i].n_shingles == 0 and got[i].component_id == i and got[i].kept for i in (2, 3, 4))
    assert got[None].component_id is None and got[None].kept
    assert dedup.near_duplicates(odd_docs).count() == 14 and dedup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100 and len(got) == 61
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gone_rows_name_a_kept_one(spark):
    out = dedup.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"))
    kept = out.where("kept").select(F.col("doc_id").alias("component_id"))
    assert out.join(kept, "component_id", "left_anti").count() == 0


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    """Few members with many shingles are dealt into blocks as well."""
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 500)
    r = np.random.default_rng(3)
    rows = []
    for k in range(12):
        own = [f"v{i}" for i in range(300)]
        for _ in range(int(r.integers(0, 12))):
            own[int(r.integers(300))] = f"x{k}"
        rows.append((k, " ".join(own)))
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


@pytest.mark.parametrize("crossing", [False, True])
def test_linked_stars_against_every_pair(crossing):
    r = np.random.default_rng(4)
    for _ in range(30):
        n = int(r.integers(2, 30))
        base = [np.arange(60) + 1000 * k for k in range(3)]
        sets = [np.unique(np.concatenate((b[r.random(60) < 0.9], r.integers(5000, 9000, 3)))).astype(np.uint64) for b in (base[int(r.integers(3))] for _ in range(n))]
        ids, sides = r.permutation(100)[:n], r.integers(0, 2, n)
        parent = list(range(n))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and not (crossing and sides[i] == sides[j]):
                    parent[root(i)] = root(j)
        least = {}
        for i in range(n):
            least[root(i)] = min(int(ids[i]), least.get(root(i), 10**9))
        want = {(int(ids[i]), least[root(i)]) for i in range(n) if ids[i] != least[root(i)]}
        assert set(dedup.linked_stars(ids, sides, sets, crossing)) == want


def test_long_near_copies_need_little():
    """256 near copies of 20,000 words are one pass over the postings."""
    import time

    base = np.arange(20_000, dtype=np.uint64)
    sets = [np.sort(np.append(base[np.arange(20_000) != k], np.uint64(10**6 + k))) for k in range(256)]
    began = time.perf_counter()
    assert len(dedup.linked_stars(np.arange(256), np.zeros(256), sets, False)) == 255
    assert time.perf_counter() - began < 10


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(400).select((F.col("id") % 7).alias("k"), F.col("id").alias("r")).unionByName(spark.sql("SELECT 1000L AS k, 5000L AS r")).unionByName(spark.range(300).select(F.lit(50).cast("long").alias("k"), (F.col("id") + 9000).alias("r")))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("r").alias("least")).where("k != 1000")
    got = common.join_hot(rows, counted, "k", ["n", "least"], F.col("n"), 100, "r")
    assert got.columns == ["k", "r", "n", "least"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(counted, "k").collect()))
