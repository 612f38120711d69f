"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

1. Each text becomes its set of five-word shingles, a signature of CHUNKS * WIDTH MinHash values cut to 16 bits,
   and a 128-bit name of the whole set. Texts with equal sets form a class; one representative goes on.
2. The signature is split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in fewer
   than CHUNKS * (ERRORS + 1) values have a chunk with at most ERRORS differing values; each chunk is indexed
   once for every way to leave ERRORS of its values out, so every pair under that distance shares a key. (With
   the defaults that is 23 of 60 values; pairs beyond it are found as well where one chunk agrees: a pair of
   similarity 0.75 goes unnoticed with a probability of 6e-6.)
3. The least representative of a key's holders is their hub. A representative joins the group of each of its
   hubs, so that every pair sharing a key meets in a group, without a row per pair. In a group of more than a
   block's members or shingles those linked with the hub are found first, in blocks; only the rest then meet them and one another,
   every two blocks in a task of their own, of bounded size.
4. There, intersections of full shingle sets are counted exactly by postings, and linked texts merged; only a
   spanning star of each merged set leaves the task. Components over all stars give the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.common import compressed, forget, join_hot, mix, save, table, utf8
from placewise.llm.graph import components
from placewise.llm.shingles import permutations, shingle_sets, signature

CHUNKS, WIDTH, ERRORS = 12, 5, 1
#: Linked from this similarity on, in percent.
PERCENT = 75
#: Most members of a block, and shingles of them, about; a task holds the texts of two.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Shingles whose postings are counted in one step.
POSTINGS = 4096


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = permutations(CHUNKS * WIDTH)
    for batch in batches:
        n, one, two, sigs = [], [], [], []
        for own in shingle_sets(*utf8(batch.column(1))):
            n.append(len(own))
            one.append(int(mix(own).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            two.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            sigs.append(signature(own, a, b).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of each signature: a column for each chunk and each choice of ERRORS values left out."""
    seeds, out = iter(range(1, 1 << 20)), []
    for c in range(CHUNKS):
        chunk = sigs[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for left_out in combinations(range(WIDTH), ERRORS):
            h = np.full(len(sigs), mix(np.array([next(seeds)], np.uint64))[0])
            for i in range(WIDTH):
                if i not in left_out:
                    h = mix(h ^ chunk[:, i])
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1]), pa.int64())], ["key", "rep"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that moving them costs less."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), compressed(batch.column(1))], ["rep", "z"])


def linked_stars(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], crossing: bool) -> list[tuple[int, int]]:
    """Merge rows whose sets are alike by PERCENT; (id, least id of its merged set) for each merged row.

    crossing: only pairs from two sides count (pairs of one side meet elsewhere).
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    by_hash, holders = flat[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    cut = np.flatnonzero(np.concatenate(([True], by_hash[1:] != by_hash[:-1])))
    length = np.diff(np.append(cut, len(by_hash)))
    place = np.empty(len(flat), np.int32)
    place[order] = np.repeat(np.arange(len(cut), dtype=np.int32), length)
    del flat, by_hash, order
    at = np.concatenate(([0], np.cumsum(sizes)))
    alone = np.ones(n, bool)  # not merged with any row yet
    found: list[tuple[int, int]] = []
    for first in range(n):
        if not alone[first]:
            continue
        alone[first], merged = False, [first]
        for i in merged:  # grows; each row is held once against those not merged yet
            if not alone.any():
                break
            own = place[at[i] : at[i + 1]]
            own = own[length[own] > 1]
            both = np.zeros(n, np.int64)
            for k in range(0, len(own), POSTINGS):
                a, m = cut[own[k : k + POSTINGS]], length[own[k : k + POSTINGS]]
                index = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                both += np.bincount(holders[index], minlength=n)
            hit = alone & (100 * both >= PERCENT * (sizes[i] + sizes - both))
            if crossing:
                hit &= sides != sides[i]
            alone &= ~hit
            merged += np.flatnonzero(hit).tolist()
        least = min(int(ids[i]) for i in merged)
        found += [(int(ids[i]), least) for i in merged if ids[i] != least]
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (hub, i, j): columns hub, i, j, side, rep, z. Edges of each task's merged sets."""
    of = zstandard.ZstdDecompressor()
    key, held, edges = None, [], []

    def settle() -> None:
        if len(held) > 1:
            data = [of.decompress(z) for _, _, z in held]
            sets = list(shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))))
            edges.extend(linked_stars(np.array([r for r, _, _ in held]), np.array([s for _, s, _ in held]), sets, key[1] != key[2]))

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for hub, i, j, side, rep, z in zip(*columns, strict=True):
            if (hub, i, j) != key:
                settle()
                key, held = (hub, i, j), []
            held.append((rep, side, z))
        if len(edges) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
            edges.clear()
    settle()
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def _edges(member: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Edges that join up all linked texts of each hub's group, and the saved tables they come from.

    member: hub, rep, n (shingles of rep); verify: edges of tasks (hub, i, j, side, rep). A group that fits a block is
    one task. In a larger one the members are first held against the hub, in blocks that each get the hub's text; those
    linked with it are of one component and need not meet each other. The rest are dealt into blocks that meet one
    another and the blocks of the linked ones.
    """
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    dealt = lambda b: F.pmod(F.xxhash64("rep"), b).cast("int")
    upto = lambda b: F.sequence(F.lit(0), b - 1)
    columns = ["rep", "hub", "i", "j", "side"]
    total = member.count()
    sizes = member.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).withColumn("b", blocks(F.col("rows"), F.col("shingles")))
    sized = join_hot(member, sizes, "hub", ["b"], F.col("rows"), total, "rep")
    small = sized.where("b = 1").select("rep", "hub", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    large = save(sized.where("b > 1"))
    spokes = large.where("rep != hub").select("rep", "hub", F.lit(-1).alias("i"), dealt(F.col("b")).alias("j"), F.lit(1).alias("side"))
    hubs = large.where("rep = hub").select("rep", "hub", F.lit(-1).alias("i"), F.explode(upto(F.col("b"))).alias("j"), F.lit(0).alias("side"))
    star = save(verify(spokes.unionByName(hubs)))
    near = star.select(F.col("a").alias("rep"), F.col("b").alias("hub"), F.lit(True).alias("linked")).distinct()
    # the hub itself counts as linked
    split = large.join(near, ["hub", "rep"], "left").withColumn("linked", F.coalesce("linked", F.col("rep") == F.col("hub")))
    weigh = lambda c: (F.count_if(c), F.sum(F.when(c, F.col("n")).otherwise(0)))
    counts = split.groupBy("hub").agg(F.count("*").alias("rows"), blocks(*weigh(F.col("linked"))).alias("in"), blocks(*weigh(~F.col("linked"))).alias("out"), F.count_if(~F.col("linked")).alias("apart"))
    split = join_hot(split.select("hub", "rep", "linked"), counts.where("apart > 0"), "hub", ["in", "out"], F.col("rows"), total, "rep")
    shift = F.col("out")
    rest = split.where(~F.col("linked")).withColumn("own", dealt(F.col("out")))
    apart = rest.withColumn("other", F.explode(upto(F.col("out")))).select("rep", "hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"))
    across = rest.select("rep", "hub", F.col("own").alias("i"), F.explode(F.transform(upto(F.col("in")), lambda x: x + shift)).alias("j"), F.lit(-1).alias("side"))
    inner = split.where("linked").withColumn("j", dealt(F.col("in")) + shift).select("rep", "hub", F.explode(upto(F.col("out"))).alias("i"), "j", F.lit(-2).alias("side"))
    tasks = small.select(columns).unionByName(apart.select(columns)).unionByName(across.select(columns)).unionByName(inner.select(columns))
    return verify(tasks).unionByName(star), [large, star]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (it is the document's own).

    A text without words, or null, has no shingles and is linked with nothing. Repeated rows link with each other.
    A row without doc_id keeps to itself: component_id null, kept true. An empty table gives an empty result;
    other columns don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = save(docs.mapInArrow(_sketches, "doc_id long, n long, h1 long, h2 long, sig binary"))
    linkable = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = save(linkable.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "sig")).alias("least")).select("n", "h1", "h2", F.col("least.doc_id").alias("rep"), F.col("least.sig").alias("sig")))
    keys = classes.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    total = classes.count() * CHUNKS * math.comb(WIDTH, ERRORS)
    grouped = join_hot(keys, shared, "key", ["hub"], F.col("m"), total, "rep").select("hub", "rep").distinct()
    member = save(grouped.join(classes.groupBy("rep").agg(F.max("n").alias("n")), "rep").select("hub", "rep", "n"))
    # texts of the members only; both sides grow with the corpus, so they are sorted and merged at every size
    texts = docs.where("doc_id IS NOT NULL").mapInArrow(_packed, "rep long, z binary")
    texts = save(texts.hint("merge").join(member.select("rep").distinct(), "rep"))

    def verify(tasks: DataFrame) -> DataFrame:
        held = tasks.hint("merge").join(texts, "rep").select("hub", "i", "j", "side", "rep", "z")
        return held.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rep").mapInArrow(_verified, "a long, b long")

    edges, tables = _edges(member, verify)
    found = components(edges)
    for done in (member, texts, *tables):
        forget(done)
    named = sketches.join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    named = named.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.y FROM reach r JOIN ways l ON l.x = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""
