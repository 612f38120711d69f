"""Language-model scores by Brown's class-based bigrams.

Words are counted over all training documents. The TOP most frequent ones are dealt into CLASSES classes by
exchange clustering (each word moves to the class that raises the likelihood of class bigrams most). Every other word
of PLACED_FROM occurrences or more, however large the vocabulary, is then placed into the class that makes its own neighbours likeliest; the counts of
a word's neighbours by class are added up by word, so that the vocabulary grows with the corpus. Words seen once, whose
single neighbours say little, share a class (the band of their count), the end token has a class of its own.
P(w | before) = P(class of w | class before) * P(w | its class); transitions are smoothed towards the classes'
own shares, emissions by add-one. Unknown words share one class, whose probability is split off that of the
words seen once by the Good-Turing ratio. All counts, of words and of neighbouring symbols, cover all training
documents.

Documents form groups of about GROUP_BYTES where they lie. Each group's distinct words are counted there; corpus counts
are sums of these, combined before the shuffle. They come back to the groups by a join, so that no task holds the
whole vocabulary; the HOT words of most groups, which would meet in one task there, are known to all tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from placewise.llm.common import fold, forget, lower_ascii, save, steps, table, utf8, word_bounds, word_hashes

TOP, CLASSES, SWEEPS = 1024, 48, 4
#: Bands of counts: 1, 2, 3-4, ... up to 2**(BANDS - 1) and more.
BANDS = 40
#: Bytes of text of a group, and what a row adds to them; groups that a task works on.
GROUP_BYTES, ROW_BYTES, TASK_GROUPS = 8 << 20, 64, 8
#: The words of most groups, whose counts and classes every task knows, and the parts that their neighbours are added up in first.
HOT, SALTS = 1 << 16, 64
#: Bytes of a slice of documents, and words beyond the top ones whose neighbours a task holds at a time, about.
SLICE_BYTES, OCCURRENCES = 256 << 10, 3_000_000
#: Pseudo-counts with which a class's own share weighs in its transitions.
SMOOTHING = 20.0
END, UNKNOWN, SYMBOLS = TOP + BANDS, TOP + BANDS + 1, TOP + BANDS + 2
#: Words from this count on are placed by their neighbours; those of a class share a symbol, SYMBOLS + class.
PLACED_FROM = 2
CODES = SYMBOLS + CLASSES
#: What the bytes of a word's neighbours are: a class of the TOP words, another word or the end; RIGHT is added for those after it.
OTHER_SIDE, END_SIDE, RIGHT = CLASSES, CLASSES + 1, 64


def tokens(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each step of rows i to j: hashes of their words end to end, and the number of words of each row."""
    for i, j in steps(bounds):
        part, own = lower_ascii(data[bounds[i] : bounds[j]]), bounds[i : j + 1] - bounds[i]
        starts, ends, n = word_bounds(part, own)
        yield i, j, word_hashes(part, starts, ends).view(np.int64), n


def _packed(kind: pa.DataType, group_bytes: int):
    """Columns doc_id, learn and text -> learn, grp, ids, sizes, z: documents in slices, whose texts are compressed together.
    A task's rows in turn, about group_bytes of them, are a group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        to = zstandard.ZstdCompressor(level=3)
        open_: dict[bool, list[tuple]] = {False: [], True: []}
        out: list[tuple] = []

        def close(learn: bool) -> None:
            if rows := open_[learn]:
                out.append((learn, number, [i for i, _ in rows], [len(t) for _, t in rows], to.compress(b"".join(t for _, t in rows))))
                open_[learn] = []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.bool_(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["learn", "grp", "ids", "sizes", "z"])
            out.clear()
            return made

        size_of = {False: 0, True: 0}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, learn, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if held and held + len(data) > group_bytes:
                        close(False)
                        close(True)
                        number, held, size_of = number + 1, 0, {False: 0, True: 0}
                    held += len(data) + ROW_BYTES
                    size_of[learn] += len(data) + ROW_BYTES
                    open_[learn].append((doc, data))
                    if size_of[learn] > SLICE_BYTES:
                        close(learn)
                        size_of[learn] = 0
                if len(out) > 16:
                    yield batch_of()
        close(False)
        close(True)
        if out:
            yield batch_of()

    return pack


def _unpacked(z: pa.Array, sizes: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and bounds of each slice's texts."""
    of = zstandard.ZstdDecompressor()
    for data, own in zip(z.to_pylist(), sizes.to_pylist(), strict=True):
        yield np.frombuffer(of.decompress(data), np.uint8), np.concatenate(([0], np.cumsum(own))).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches' runs of rows of one group: its number and the rows."""
    for batch in batches:
        groups = batch.column(by).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)])) if len(groups) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(groups[a]), batch.slice(a, b - a)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[cut], np.add.reduceat(n, cut) if len(cut) else n


def _group_words(hot: np.ndarray | None = None):
    """Columns grp, learn, sizes, z. Each group's distinct words (but the hot ones) and how often training documents of the
    group hold them."""
    place = _ranks(np.zeros(0, np.int64) if hot is None else hot)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, kept = None, [], 0

        def out() -> pa.RecordBatch:
            h, n = _merge(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), grp, np.int64)), pa.array(h), pa.array(n, pa.int64())], ["grp", "h", "n"])

        for number, rows in _runs(batches, 0):
            if number != grp:
                if held:
                    yield out()
                grp, held, kept = number, [], 0
            for learn, text in zip(rows.column(1).to_pylist(), _unpacked(rows.column(3), rows.column(2)), strict=True):
                for _, _, h, _ in tokens(*text):
                    h = h[place(h) < 0]
                    held.append((h, np.full(len(h), int(learn))))
                    kept += len(h)
                    if kept > 2_000_000:
                        held = [_merge(held)]
                        kept = len(held[0][0])
        if held:
            yield out()

    return words


def _ranks(top: np.ndarray):
    """For words' hashes: their places in top, -1 for other words."""
    order = np.argsort(top)
    sorted_top = top[order]

    def ranks(h: np.ndarray) -> np.ndarray:
        if not len(top):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(sorted_top, h), len(top) - 1)
        return np.where(sorted_top[at] == h, order[at], -1)

    return ranks


def _top_pairs(top: np.ndarray):
    """How often the top words follow one another, in rows (pair, n); TOP stands for any other word."""
    ranks = _ranks(top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for text in _unpacked(batch.column(1), batch.column(0)):
                for _, _, own, n in tokens(*text):
                    place = ranks(own)
                    flat, _ = _ended(np.where(place < 0, TOP, place), n, END)
                    total += np.bincount(flat[:-1] * SYMBOLS + flat[1:], minlength=len(total))
                    total[END * SYMBOLS + END] -= len(n) - 1  # between two documents there is no pair
        nz = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(nz, pa.int32()), pa.array(total[nz])], ["pair", "n"])

    return count


def _ended(values: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' values, each row between two end values of its own; and where the values went."""
    at = np.arange(len(values)) + np.repeat(2 * np.arange(len(n)) + 1, n)
    flat = np.full(len(values) + 2 * len(n), end, np.int64)
    flat[at] = values
    return flat, at


def _neighbours(top: np.ndarray, cls: np.ndarray, hot: np.ndarray, hot_places: np.ndarray):
    """Columns grp, sizes, z of training documents. For each word but the top ones: its neighbours in up to OCCURRENCES of a
    task's words, two bytes each, and a salt: from a group's number where the word is hot (of these only where hot_places
    holds), else -1."""
    ranks, place = _ranks(top), _ranks(hot)
    sides = np.append(cls[: len(top)], OTHER_SIDE)  # the last one for place -1
    wanted = np.append(hot_places, True)

    def out(grp: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own, near = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.argsort(own, kind="stable")
        own, near = own[order], near[order]
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        bounds = (2 * np.append(cut, len(own))).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(near.tobytes())])
        salt = np.where(place(own[cut]) >= 0, grp % SALTS, -1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(own[cut]), pa.array(salt), cells], ["h", "salt", "near"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, kept = 0, [], 0
        for grp, rows in _runs(batches, 0):  # a task's groups together
            for text in _unpacked(rows.column(2), rows.column(1)):
                for _, _, own, n in tokens(*text):
                    rank = ranks(own)
                    side, where = _ended(sides[rank], n, END_SIDE)
                    mine = (rank < 0) & wanted[place(own)]
                    where = where[mine]
                    held.append((own[mine], np.stack((side[where - 1], side[where + 1] + RIGHT), axis=1).astype(np.uint8)))
                    kept += len(where)
                    if kept > OCCURRENCES:
                        yield out(grp, held)
                        held, kept = [], 0
        if held:
            yield out(grp, held)

    return gather


def preferences(pairs: np.ndarray, cls: np.ndarray, n_top: int) -> np.ndarray:
    """log P(neighbour's side | class) for each byte of a word's neighbours (rows) and each class of the top words."""
    k = int(cls[:n_top].max()) + 1
    side = np.full(len(cls), OTHER_SIDE)
    side[:n_top], side[END] = cls[:n_top], END_SIDE
    q = np.zeros((END_SIDE + 1, END_SIDE + 1))
    np.add.at(q, (side[:, None].repeat(len(cls), 1), side[None, :].repeat(len(cls), 0)), pairs)
    out = np.zeros((256, k))
    for first, x in ((0, q.T), (RIGHT, q)):  # x: class before or after which the side stands, side
        share = (x.sum(0) + 1) / (x.sum() + len(x))
        out[first : first + len(x)] = np.log((x[:k] + SMOOTHING * share) / (x[:k].sum(1, keepdims=True) + SMOOTHING)).T
    return out


def _placed(prefer: np.ndarray):
    """Rows sorted by h and salt: h, salt, near. The likeliest class of each word's neighbours, of equal ones the lowest; for
    a salted word the classes' sums instead. Words of fewer than PLACED_FROM occurrences are left out."""
    size = prefer.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        left, seen = np.zeros(size), 0

        def out(h: np.ndarray, salt: np.ndarray, n: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            keep = (salt >= 0) | (n >= PLACED_FROM)
            h, salt, scores = h[keep], salt[keep], scores[keep]
            k = np.where(salt >= 0, -1, _likeliest(scores))
            sums = [s if x >= 0 else None for s, x in zip(scores, salt, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["h", "k", "sums"])

        for batch in batches:
            if not len(batch):
                continue
            h, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, bounds = utf8(batch.column(2))
            cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))))
            edges = np.append(bounds[cut], bounds[-1])
            scores, n = np.zeros((len(cut), size)), np.diff(edges) // 2
            for i in range(0, len(cut), 4096):  # 256 counts of a word
                j = min(len(cut), i + 4096)
                word = np.repeat(np.arange(j - i), np.diff(edges[i : j + 1]))
                scores[i:j] = np.bincount(word * 256 + data[edges[i] : edges[j]], minlength=(j - i) * 256).reshape(-1, 256) @ prefer
            own_h, own_salt = h[cut], salt[cut]
            if last == (own_h[0], own_salt[0]):
                scores[0] += left
                n[0] += seen
            elif last is not None:
                yield out(np.array([last[0]]), np.array([last[1]]), np.array([seen]), left[None])
            last, left, seen = (own_h[-1], own_salt[-1]), scores[-1], int(n[-1])
            if len(cut) > 1:
                yield out(own_h[:-1], own_salt[:-1], n[:-1], scores[:-1])
        if last is not None:
            yield out(np.array([last[0]]), np.array([last[1]]), np.array([seen]), left[None])

    return place


def _likeliest(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, 6).argmax(axis=1).astype(np.int32) if len(scores) else np.zeros(0, np.int32)


def _code(top: np.ndarray, n_ends: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """For a group's documents and its words' corpus counts and classes, those of the hot words being known: each document's
    symbols and sums."""
    ranks = _ranks(top)

    def code(docs: pa.Table, words: pa.Table) -> pa.Table:
        h, c, k = (np.concatenate((known, words[name].to_numpy())) for known, name in zip(hot, "hck", strict=True))
        by = np.argsort(h)
        h, c, k = h[by], c[by], k[by]
        band = np.minimum(np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64), BANDS - 1)
        symbol = np.where(c > 0, TOP + band, UNKNOWN)
        symbol = np.where(k >= 0, SYMBOLS + k, symbol)
        place = ranks(h)
        symbol = np.where(place >= 0, place, symbol)
        logs = np.log10(c + 1.0)
        to = zstandard.ZstdCompressor(level=1)
        end_known = int(n_ends > 0)
        n_tokens, n_known, sums, codes = [], [], [], []
        for text in _unpacked(docs["z"].combine_chunks(), docs["sizes"].combine_chunks()):
            for _, _, own, n in tokens(*text):
                at = np.searchsorted(h, own)
                s, known, log = symbol[at].astype("<u2"), c[at] > 0, logs[at]
                edge = np.concatenate(([0], np.cumsum(n)))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    n_tokens.append(int(b - a) + 1)
                    n_known.append(int(known[a:b].sum()) + end_known)
                    sums.append(float(log[a:b].sum()) + float(np.log10(n_ends + 1.0)))
                    codes.append(to.compress(s[a:b].tobytes()))
        ids = docs["ids"].combine_chunks()
        learn = np.repeat(docs["learn"].to_numpy(), np.array([len(x) for x in ids], np.int64)) if len(ids) else np.zeros(0, bool)
        arrays = [ids.flatten(), pa.array(learn, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(codes, pa.binary())]
        return pa.table(arrays, names=["doc_id", "learn", "n_tokens", "n_known", "log_sum", "codes"])

    return code


def _symbols(z: bytes, of: zstandard.ZstdDecompressor) -> np.ndarray:
    """A document's symbols between two end tokens."""
    return np.concatenate(([END], np.frombuffer(of.decompress(z), "<u2"), [END])).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two symbols follow one another, a row for each pair that a task has seen."""
    of, total = zstandard.ZstdDecompressor(), np.zeros(CODES * CODES, np.int64)
    for batch in batches:
        held, size = [], 0
        for z in batch.column(0).to_pylist():
            s = _symbols(z, of)
            held.append(s[:-1] * CODES + s[1:])
            size += len(s)
            if size > 1_000_000:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
    nz = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(nz, pa.int32()), pa.array(total[nz])], ["pair", "n"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, n_top: int, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every symbol. The first n_top symbols start in classes by rank and move while the likelihood of
    class bigrams rises, ties to the lower class; all others keep classes of their own."""
    size = len(pairs)
    k = min(n_classes, max(1, n_top))
    cls = np.concatenate((np.arange(n_top) % k, k + np.arange(size - n_top))).astype(np.int64)
    total = k + size - n_top
    grouped = np.zeros((total, size))
    np.add.at(grouped, cls, pairs)
    q = np.zeros((total, total))
    np.add.at(q.T, cls, grouped.T)
    rows, columns = q.sum(1), q.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n_top):
            out, into, own = np.bincount(cls, pairs[w], total), np.bincount(cls, pairs[:, w], total), pairs[w, w]
            a = cls[w]
            out[a] -= own
            into[a] -= own
            r, c = out.sum() + own, into.sum() + own
            if not r and not c:
                continue
            q[a] -= out
            q[:, a] -= into
            q[a, a] -= own
            rows[a] -= r
            columns[a] -= c
            gain = (_f(q[:k] + out) - _f(q[:k])).sum(1) + (_f(q[:, :k] + into[:, None]) - _f(q[:, :k])).sum(0)
            i = np.arange(k)
            here = q[i, i]
            gain += _f(here + out[:k] + into[:k] + own) + _f(here) - _f(here + out[:k]) - _f(here + into[:k])
            gain -= _f(rows[:k] + r) - _f(rows[:k]) + _f(columns[:k] + c) - _f(columns[:k])
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 * (1 + abs(gain[a])) else a
            moved += b != a
            cls[w] = b
            q[b] += out
            q[:, b] += into
            q[b, b] += own
            rows[b] += r
            columns[b] += c
        if not moved:
            break
    return cls


@dataclass
class Model:
    cls: np.ndarray
    #: log10 P(class | class before)
    step: np.ndarray
    #: log10 of what a symbol's count + 1 is divided by
    under: np.ndarray

    def score(self, symbols: np.ndarray) -> float:
        c = self.cls[symbols]
        return float(self.step[c[:-1], c[1:]].sum() - self.under[symbols[1:]].sum())


def fit(pairs: np.ndarray, types: np.ndarray, n_top: int, cls: np.ndarray | None = None, twice: int | None = None) -> Model:
    """pairs: counts of neighbouring symbols; types: words of each symbol (0 for the unknown one); cls: their classes, if
    known; twice: words beyond the top ones that were seen twice, if their band doesn't say so."""
    cls = exchange(pairs, n_top) if cls is None else cls
    total = int(cls.max()) + 1
    if not pairs.any():  # nothing was learnt: all tokens are the one unknown word
        return Model(cls, np.zeros((total, total)), np.zeros(len(cls)))
    tokens_of, types_of = np.bincount(cls, pairs.sum(0), total), np.bincount(cls, types, total)
    q = np.zeros((total, total))
    np.add.at(q, (cls[:, None].repeat(len(cls), 1), cls[None, :].repeat(len(cls), 0)), pairs)
    share = tokens_of + types_of
    unknown, once = cls[UNKNOWN], cls[TOP]
    share[unknown] = 0
    share = share / share.sum()
    step = (q + SMOOTHING * share[None, :]) / (q.sum(1, keepdims=True) + SMOOTHING)
    n1, n2 = types[TOP], types[TOP + 1] if twice is None else twice
    if n1:
        part = (n1 + 1) / (n1 + 2 * n2 + 2)
        step[:, unknown], step[:, once] = step[:, once] * part, step[:, once] * (1 - part)
    else:  # no word was seen once: one token's worth for the unknown
        part = 1 / (tokens_of.sum() + 1)
        step *= 1 - part
        step[:, unknown] += part
    with np.errstate(divide="ignore"):
        under = np.where(np.arange(len(cls)) == UNKNOWN, 0.0, np.log10(np.maximum(1, (tokens_of + types_of)[cls])))
        return Model(cls, np.log10(step), under)


def _gathered(pairs: DataFrame, size: int) -> np.ndarray:
    """The counts of rows (pair, n), size ** 2 pairs at most."""
    out = np.zeros(size * size)
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def score_documents(docs: DataFrame, may_learn: Column, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score (both log10).

    A null text is empty: its only token is the end. Without training documents every token is unknown and all
    scores are 0. Repeated rows are scored alike and, if they are for training, counted each. An empty table gives
    an empty result; other columns don't matter.
    """
    spark = docs.sparkSession
    kind = docs.select("doc_id").schema.simpleString()[7:-1]
    keyed = docs.select("doc_id", F.coalesce(may_learn, F.lit(False)).alias("learn"), "text")
    id_type = dict(keyed.dtypes)["doc_id"]
    arrow_type = to_arrow_type(keyed.schema["doc_id"].dataType)
    packed = save(keyed.mapInArrow(_packed(arrow_type, group_bytes), f"learn boolean, grp long, ids array<{id_type}>, sizes array<long>, z binary"))
    learnt = packed.where("learn")
    own = packed.select("grp", "learn", "sizes", "z").mapInArrow(_group_words(), "grp long, h long, n long")
    types = save(own.groupBy("h").agg(F.sum("n").alias("c"), F.count("*").alias("groups")))
    n_ends = learnt.agg(F.sum(F.size("ids"))).first()[0] or 0
    sums = types.where("c > 0").agg(F.count("*"), F.sum("c")).first()
    total, distinct = (sums[1] or 0) + n_ends, sums[0] + int(n_ends > 0)
    top = types.where("c > 0").orderBy(F.desc("c"), "h").select("h", "c").limit(TOP).collect()
    top_h = np.array([r["h"] for r in top], np.int64)
    hot_h, hot_c = (c.to_numpy() for c in types.orderBy(F.desc("groups"), "h").select("h", "c").limit(hot).toArrow().columns)
    seen = learnt.select("sizes", "z").mapInArrow(_top_pairs(top_h), "pair int, n long")
    pairs = _gathered(seen, SYMBOLS)
    cls = exchange(pairs, len(top))
    # the top words' own classes; what is placed shares them
    cls = np.append(cls, np.minimum(np.arange(CLASSES), max(len(top), 1) - 1))
    others = types.where(~F.col("h").isin([int(h) for h in top_h]))
    if len(top) == TOP:
        prefer = preferences(pairs, cls[:SYMBOLS], len(top))
        near = learnt.select("grp", "sizes", "z").mapInArrow(_neighbours(top_h, cls, hot_h, hot_c >= PLACED_FROM), "h long, salt int, near binary")
        by_word = near.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_placed(prefer), "h long, k int, sums array<double>")
        parts = save(by_word)  # a row for each word, or SALTS of a hot one
        added = parts.where("k < 0").groupBy("h").agg(*[F.round(F.sum(F.col("sums")[i]), 6).alias(f"s{i}") for i in range(prefer.shape[1])])
        best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(prefer.shape[1])]))
        hot_k = dict(zip(*(c.to_pylist() for c in added.select("h", (-best["i"]).alias("k")).toArrow().columns), strict=True))
        placed = parts.where("k >= 0").select("h", "k")
    else:  # all words are among the top ones
        hot_k, placed, parts = {}, types.select("h", F.lit(0).alias("k")).limit(0), None
    known = (hot_h, hot_c, np.array([hot_k.get(h, -1) for h in hot_h.tolist()], np.int64))
    # hot words stay where they are; the others meet their counts
    cold = packed.select("grp", "learn", "sizes", "z").mapInArrow(_group_words(hot_h), "grp long, h long, n long")
    words = cold.select("grp", "h").join(types.select("h", "c").join(placed, "h", "left"), "h")
    words = words.select("grp", "h", "c", F.coalesce("k", F.lit(-1)).alias("k"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (TASK_GROUPS * group_bytes)))
    packed_by, words_by = packed.repartition(tasks, "grp"), words.repartition(tasks, "grp")
    schema = f"{kind}, learn boolean, n_tokens long, n_known long, log_sum double, codes binary"
    coded = save(packed_by.groupBy("grp").cogroup(words_by.groupBy("grp")).applyInArrow(_code(top_h, n_ends, known), schema))
    pairs = _gathered(coded.where("learn").select("codes").mapInArrow(_pairs, "pair int, n long"), CODES)
    few = {r["c"]: r["count"] for r in others.where(F.col("c").between(1, max(2, PLACED_FROM - 1))).groupBy("c").count().collect()}
    n_types = np.zeros(CODES)
    n_types[: len(top)], n_types[END] = 1, int(n_ends > 0)
    for c in range(1, PLACED_FROM):
        n_types[TOP + int(np.ceil(np.log2(c)))] += few.get(c, 0)
    for r in placed.groupBy("k").count().collect():
        n_types[SYMBOLS + r["k"]] = r["count"]
    np.add.at(n_types, SYMBOLS + np.array(list(hot_k.values()), np.int64), 1)
    for done in (packed, types, *([parts] if parts else [])):
        forget(done)
    sent = spark.sparkContext.broadcast(fit(pairs, n_types, len(top), cls, few.get(2, 0)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = zstandard.ZstdDecompressor()
        for batch in batches:
            scores = [s + sent.value.score(_symbols(z, of)) for s, z in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.float64())], [*batch.schema.names[:5], "score"])

    out = coded.mapInArrow(scored, f"{kind}, learn boolean, n_tokens long, n_known long, log_sum double, score double")
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return out.select("doc_id", F.col("learn").alias("learnt"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
