"""Packing documents into token sequences by best-two-fit.

Lengths are at most CAPACITY, so the corpus is packed as a histogram of lengths: a bin is filled greedily with
the longest piece that still fits; if a gap remains, its smallest piece is replaced by the two unpacked pieces
that fill the widened gap most tightly. A filling is repeated for as long as the histogram holds its pieces,
which is what packing bin after bin would do, so the plan has a size bounded by CAPACITY, not by the corpus. Each
piece then finds its place from its length and its rank among pieces of that length; ranks of frequent lengths
are counted in parts, to which pieces are dealt by their numbers, copies and pieces without id too.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.llm.common import save, table

CAPACITY, END_ID = 4096, 1
#: Rows of one length that a salted part has, about.
PART = 20_000
#: Words whose ids a worker keeps (about 250 bytes each), and new ones that are encoded in one call.
WORDS_KEPT, WORDS_AT_ONCE = 1_000_000, 64
#: Lower-case Latin letters, all composed, and perhaps one mark.
_LETTERS = re.compile(r"[a-zß-öø-ſ]+[,.]?")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Kept(dict):
    """Ids by word, in two generations: words of the one before come back when they are asked for. A word in neither gets
    an empty place at once and is noted as new, so that a text is looked up in one pass."""

    def __init__(self) -> None:
        super().__init__()
        self.before: dict[bytes, bytes] = {}
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes | bytearray:
        place = self.before.get(word)
        if place is None:
            place = bytearray()
            self.new.append(word)
        self[word] = place
        return place

    def age(self) -> None:
        self.before = dict(self)
        self.clear()

    def fill(self, word: bytes, raw: bytes) -> None:
        self[word][:] = raw
        self[word] = raw


class WordIds:
    """Ids of whole texts, word by word: this tokenizer drops white space, so a text's ids are those of its words in turn.

    It also lower-cases, and takes a run of letters as one and a comma or full stop after it as another. Words of that
    shape skip its normalizer and its pattern: `plain` is its model behind a split at spaces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.of, self.kept = Tokenizer.from_file(path), _Kept()
        self.plain = Tokenizer(self.of.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bar = self.of.encode("|", add_special_tokens=False).ids[0]

    def _encode(self) -> None:
        """Fill the places of new words. Many share a call, with bars between them; words with bars of their own go alone."""
        plain, spaced, other, alone = [], [], [], []
        for w in self.kept.new:
            text = w.decode("utf-8", "surrogatepass")
            if b"|" in w:
                alone.append(w)
            elif _LETTERS.fullmatch(low := text.lower()):
                plain.append(w)
                spaced.append(low if low[-1] not in ",." else f"{low[:-1]} {low[-1]}")
            else:
                other.append(w)
        self._fill(self.plain, plain, spaced, WORDS_AT_ONCE)
        self._fill(self.of, other, [w.decode("utf-8", "surrogatepass") for w in other], WORDS_AT_ONCE)
        self._fill(self.of, alone, [w.decode("utf-8", "surrogatepass") for w in alone], 1)
        self.kept.new = []

    def _fill(self, of, words: list[bytes], texts: list[str], n: int) -> None:
        starts = range(0, len(words), n)
        for i, e in zip(starts, of.encode_batch_fast([" | ".join(texts[i : i + n]) for i in starts], add_special_tokens=False), strict=True):
            ids = e.ids
            raw = array("I", ids).tobytes()
            cut = [k for k, x in enumerate(ids) if x == self.bar] if n > 1 else []
            for w, a, b in zip(words[i : i + n], [-1, *cut], [*cut, len(ids)], strict=True):
                self.kept.fill(w, raw[4 * a + 4 : 4 * b])

    def __call__(self, texts: list[bytes], words_kept: int = WORDS_KEPT) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. At most words_kept words stay, and those of the last call."""
        if len(self.kept) > words_kept // 2:
            self.kept.age()
        found = [list(map(self.kept.__getitem__, t.split())) for t in texts]
        try:
            self._encode()
        except BaseException:  # leave no empty places to the worker's next task
            self.kept.clear()
            self.kept.new = []
            raise
        return [b"".join(f) for f in found]


_WORKERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each process: a worker's tasks share what it has encoded."""
    if path not in _WORKERS:
        _WORKERS[path] = WordIds(path)
    return _WORKERS[path]


def _pieces(path: str, capacity: int, words_kept: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                doc, out = [], []
                for k, ids in enumerate(ids_of([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()], words_kept)):
                    ids += end
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        doc.append(k)
                        out.append((p, a // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*out, strict=True)) or [[]] * 4
                rows = pa.array(number + np.arange(len(doc)))
                number += len(doc)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], rows], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return cut


def fill(count: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit over count[length]: (lengths in a bin, longest first; number of such bins)."""
    left, bins = count.astype(np.int64).copy(), []
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:
        gap, own, used = capacity, [], {}
        at = len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at)):
            size = lengths[at - 1]
            n = min(gap // size, int(left[size]))
            own += [size] * n
            used[size] = n
            gap -= n * size
            at -= 1
        while gap:
            small = own[-1]
            room = gap + small
            free = left[: room + 1].copy()
            for size, n in used.items():
                if size <= room:
                    free[size] -= n
            have = np.flatnonzero(free > 0)
            if not len(have):
                break
            below = np.zeros(room + 1, np.int64)
            below[have] = have
            below = np.maximum.accumulate(below)
            mate = below[np.minimum(have, room - have)]
            alone = (mate == have) & (free[have] < 2)
            mate[alone] = below[have[alone] - 1]
            total = np.where(mate > 0, have + mate, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            own.pop()
            used[small] -= 1
            for size in (int(have[best]), int(mate[best])):
                own.append(size)
                used[size] = used.get(size, 0) + 1
            own.sort(reverse=True)
            gap = capacity - sum(own)
        used = {s: n for s, n in used.items() if n}
        times = min(int(left[s]) // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
        bins.append((own, times))
        if any(not left[s] for s in used):
            lengths = [s for s in lengths if left[s]]
    return bins


@dataclass
class Places:
    """For each length, runs of ranks: first rank, first bin, pieces a bin, and where their offsets start."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    offsets: np.ndarray

    @classmethod
    def of(cls, bins: list[tuple[list[int], int]]) -> Places:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        offsets: list[int] = []
        number = 0
        for own, times in bins:
            at, k = 0, 0
            while k < len(own):
                n = own.count(own[k])
                runs.setdefault(own[k], []).append((seen.get(own[k], 0), number, n, len(offsets)))
                seen[own[k]] = seen.get(own[k], 0) + n * times
                offsets += [at + i * own[k] for i in range(n)]
                at += n * own[k]
                k += n
            number += times
        return cls({s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}, np.array(offsets, np.int64))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the pieces of these lengths and ranks (from 0)."""
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            first, start, n, at = self.runs[int(length[own[0]])]
            k = np.searchsorted(first, rank[own], "right") - 1
            r = rank[own] - first[k]
            bins[own] = start[k] + r // n[k]
            offsets[own] = self.offsets[at[k] + r % n[k]]
        return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, words_kept: int = WORDS_KEPT) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece that holds the end id alone. Rows that repeat a doc_id are packed each on its
    own. An empty table gives an empty result; other columns don't matter.
    """
    spark = docs.sparkSession
    kind = docs.select("doc_id").schema.simpleString()[7:-1]
    pieces = save(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, words_kept), f"{kind}, piece int, start long, length long, ids_crc32 long, row long"))
    rows = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["count"]
    sent = spark.sparkContext.broadcast(Places.of(fill(count, capacity)))
    parts = F.broadcast(spark.createDataFrame([(int(r["length"]), -(-r["count"] // PART)) for r in rows], "length long, _parts long"))
    salted = pieces.join(parts, "length").withColumn("_part", F.pmod(F.xxhash64("row"), F.col("_parts")))
    before = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = before.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("row")) - 1
    ranked = salted.withColumn("_within", within).join(before, ["length", "_part"]).select(*pieces.columns[:-1], (F.col("_before") + F.col("_within")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = sent.value.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
