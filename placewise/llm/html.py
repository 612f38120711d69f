"""Main text of web pages by equivalence-class template deduction.

Every element of a page is a token, told apart by its path (names, classes and ids of the open elements). Pages of a
host with the same article and main elements are taken to be of one template. Tokens with the same vector of
occurrences over all its pages form an equivalence class; that of the tokens which stand once on every page is the
skeleton, where a token is valid if it has the same place among the class's tokens on every page. Other classes (list
items and their links, the paragraphs) nest inside the skeleton's elements as repeated parts. What lies between is
the slots. Parts that are set apart by their element's name or by words of its marks (menus, notices, adverts and so
on) are left out first. The main slot is the deepest element of the skeleton that holds all the text that differs
between the pages, or an article or main element of the skeleton that holds most of it. Its blocks are the page's text,
without the template's own text at either end of a slot that is no such element. Copies count as one page.

Pages are parsed where they lie; vectors, texts and volumes are sums by token over all pages of a template, so that no
task holds a host's pages and no page's text hangs on which others lie near it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.common import BASE, forget, join_hot, mix, save, table, utf8, word_bounds, word_hashes
from placewise.llm.url_filter import url_parts

#: Share of the differing text that a skeleton's article or main element holds where it is the main slot.
MOST = 0.6
#: Text is the template's if so many different pages, and this share of them, have it at one place.
LEAST, ALIKE = 5, 0.8
#: Words of the runs by which copies are told.
RUN = 3

# Element names and words of classes, ids and roles.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
SET_APART = set("nav aside footer form script style noscript iframe template svg button select textarea dialog menu object canvas audio video head title noembed noframes xmp".split())
SPACED = set("br td th img input hr".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "caption", "option", "tbody", "tfoot", "thead", "tr"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
APART_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies related share sharing social newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar copyright contentinfo complementary search".split())
OUTSIDE_WORDS = set("header masthead topbar".split())
# words that hold for all that is inside, an article too; and words that say how a page is laid out, not what an element is
FIRM_WORDS = set("ad ads advert adverts advertisement sponsor sponsored promo comment comments disqus reply replies related".split())
LAYOUT_WORDS = set("with without has have no".split())

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>)", re.S)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements (token, parent, apart) in page order, and blocks of text (element, text) outside of parts set apart.

    apart: 0 for what may be main text, 1 where words of a class, id or role speak against it (an article or main
    element inside may be main text all the same), 2 where the element or a firm word does.
    """

    __slots__ = ("blocks", "elements", "main")

    def __init__(self, source: str):
        self.elements: list[tuple[str, int, int]] = [("", -1, 0)]
        self.blocks: list[tuple[int, str]] = []
        self.main: set[int] = set()
        open_: list[tuple[str, int]] = [("", 0)]
        text: list[str] = []

        def end_block() -> None:
            if text:
                own = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if own and not self.elements[open_[-1][1]][2]:
                    self.blocks.append((open_[-1][1], own))

        def close(name: str, within: set[str] | None = None) -> bool:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == name:
                    end_block()
                    del open_[i:]
                    return True
                if within and open_[i][0] in within:
                    return False
            return False

        at, length = 0, len(source)
        lowered = None
        while at < length:
            tag = _TAG.search(source, at)
            if not tag:
                rest = source[at:]
                if (cut := re.search(r"<[a-zA-Z/][^<>]*\Z", rest)) is not None:
                    rest = rest[: cut.start()]  # a tag that the page breaks off in
                text.append(rest)
                break
            if tag.start() > at:
                text.append(source[at : tag.start()])
            at = tag.end()
            name = (tag[3] or "").lower()
            if not name:
                continue
            if name in SPACED:
                text.append(" ")
            if tag[2]:
                if name in BLOCKS or name in SET_APART:
                    if not close(name):
                        end_block()
                continue
            if name not in BLOCKS and name not in SET_APART:
                continue
            if name in VOID:
                end_block()
                continue
            end_block()
            if name == "body":
                close("head")
            if name in CLOSES_P:
                close("p", BLOCKS - {"p"})
            if name in CLOSES_SAME:
                close(name, CLOSES_SAME[name])
            if name in ("dt", "dd"):
                close("dd" if name == "dt" else "dt", {"dl"})
            parent = open_[-1][1]
            above, _, apart = self.elements[parent]
            marks = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _MARKS.finditer(tag[4])} if tag[4] else {}
            words = {w.lower() for v in marks.values() for w in _WORD.findall(v)}
            inside = any(n in ("article", "main") for n, _ in open_)
            outer = name == "header" or bool(words & OUTSIDE_WORDS)
            said = name not in ("html", "body") and not words & LAYOUT_WORDS
            if name in SET_APART or (said and words & FIRM_WORDS) or (name == "header" and not inside):
                own = 2
            else:
                own = int(said and bool(words & APART_WORDS or (outer and not inside)))
            apart = 0 if name in ("article", "main") and not own and apart == 1 else max(apart, own)
            number = len(self.elements)
            self.elements.append((f"{above}>{name}{'.' + '.'.join(sorted(words)) if words else ''}", parent, apart))
            if not apart and (name in ("article", "main") or "main" in marks.get("role", "")):
                self.main.add(number)
            if name in RAW:
                lowered = source.lower() if lowered is None else lowered
                stop = lowered.find(f"</{name}", at) if len(lowered) == length else source.find(f"</{name}", at)
                at = length if stop < 0 else stop
                open_.append((name, number))
                if at < length:
                    end = source.find(">", at)
                    at = length if end < 0 else end + 1
                open_.pop()
                continue
            if not tag[4].endswith("/") or name in BLOCKS:
                open_.append((name, number))
        end_block()

    def chain(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.elements[element][1]


_FACTORS = mix(np.arange(1, RUN + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def kinds(pages: list[Page]) -> list[int]:
    """For each page the least hash of the runs of RUN words of its blocks (of all its words, if it has fewer; 0 without):
    equal for copies, and near copies mostly share it."""
    data, bounds = utf8(pa.array(["\n".join(t for _, t in p.blocks) for p in pages], pa.large_string()))
    starts, ends, counts = word_bounds(data, bounds)
    words, out = word_hashes(data, starts, ends), []
    n = max(0, len(words) - RUN + 1)
    runs = mix(sum((words[k : k + n] * _FACTORS[k] for k in range(RUN)), np.zeros(n, np.uint64))).view(np.int64)
    for first, c in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
        if c >= RUN:
            out.append(int(runs[first : first + c - RUN + 1].min()))
        else:
            out.append(int(mix((words[first : first + c] * _FACTORS[:c]).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0]) if c else 0)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([v for r in rows for v in r], pa.int64()))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host, page_id, url, html -> a row's number, host, page_id, url, template, kind, once, mains, blocks."""
    number = TaskContext.get().partitionId() << 40
    known: dict[str, int] = {}

    def token(t: str) -> int:
        if t not in known:
            if len(known) > 100_000:
                known.clear()
            known[t] = _hash(t)
        return known[t]

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            pages = [Page(h or "") for h in part.column(3).to_pylist()]
            once, mains, templates, chains, texts, ends = [], [], [], [], [], [0]
            for p in pages:
                count = Counter(t for t, _, _ in p.elements)
                once.append([token(t) for t, _, _ in p.elements if count[t] == 1])
                marked = sorted({p.elements[e][0] for e in p.main})
                mains.append([token(t) for t in marked])
                templates.append(_hash("\n".join(marked)))
                for e, text in p.blocks:
                    chains.append([token(p.elements[a][0]) for a in p.chain(e)][::-1])
                    texts.append(text)
                ends.append(len(texts))
            blocks = pa.StructArray.from_arrays([_lists(chains), pa.array(texts, pa.string())], ["chain", "text"])
            columns = [
                pa.array(number + np.arange(len(pages))), *part.columns[:3], pa.array(templates, pa.int64()), pa.array(kinds(pages), pa.int64()),
                _lists(once), _lists(mains), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks),
            ]
            number += len(pages)
            yield pa.RecordBatch.from_arrays(columns, ["row", "host", "page_id", "url", "template", "kind", "once", "mains", "blocks"])


def templates(full: DataFrame, total: int) -> DataFrame:
    """key, pages, slot, told, fixed of every template: its main slot's token, whether that is an article or main element, and
    the hashes of (token, text) of its own text at skeleton tokens.

    full: the parsed pages that have blocks, total of them. Everything is summed by (template, token) or (template, token, text) and
    combined before it is shuffled; what is listed for a template is no more than a page holds.
    """
    pages = save(full.groupBy("key", "kind").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds")))
    # the class of tokens whose vector is one on every page; valid are those that have the same place in it on every page
    once = full.select("key", F.explode("once").alias("token")).groupBy("key", "token").agg(F.count("*").alias("n"))
    ones = join_hot(once, pages, "key", ["pages"], F.col("pages"), total, "token").where("n = pages")
    class_of = ones.groupBy("key").agg(F.collect_list("token").alias("ones"), F.max("pages").alias("pages"))
    placed = join_hot(full.select("key", "row", "once"), class_of, "key", ["ones"], F.col("pages"), total, "row")
    placed = placed.select("key", F.posexplode(F.array_intersect("once", "ones")).alias("at", "token"))
    skeleton = placed.groupBy("key", "token").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first = last").select("key", "token")
    # texts of one place, how many different pages have them, and so which are the template's
    block = full.select("key", "kind", F.explode("blocks").alias("b")).select("key", "kind", "b.chain", F.xxhash64("b.text").alias("text"), F.length("b.text").alias("size"))
    held = block.groupBy("key", "chain", "text", "kind").agg(F.sum("size").alias("size")).groupBy("key", "chain", "text").agg(F.sum("size").alias("size"), F.count("*").alias("holders"))
    held = join_hot(held, pages, "key", ["kinds"], F.col("pages"), total, "text")
    own = F.col("holders") >= F.greatest(F.lit(float(LEAST)), F.col("kinds") * F.lit(ALIKE))
    place = held.withColumn("own", own).groupBy("key", "chain").agg(
        F.sum("size").alias("size"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("size"))).alias("differs"), F.collect_set(F.when(F.col("own"), F.col("text"))).alias("fixed")
    )
    above = place.select("key", "size", "differs", "fixed", F.size("chain").alias("length"), F.posexplode("chain").alias("depth", "token"))
    above = above.withColumn("fixed", F.when(F.col("depth") == F.col("length") - 1, F.transform("fixed", lambda t: F.xxhash64("token", t))).otherwise(F.array().cast("array<long>")))
    volume = above.groupBy("key", "token", "depth").agg(F.sum("size").alias("size"), F.sum("differs").alias("differs"), F.flatten(F.collect_list("fixed")).alias("fixed"))
    mains = full.select("key", F.explode("mains").alias("token")).distinct().withColumn("main", F.lit(True))
    known = volume.join(skeleton, ["key", "token"]).join(mains, ["key", "token"], "left")
    listed = known.groupBy("key").agg(
        F.collect_list(F.struct("depth", "token", "size", "differs", F.coalesce("main", F.lit(False)).alias("main"))).alias("all"), F.flatten(F.collect_list("fixed")).alias("fixed"),
        F.max("size").alias("size"), F.max("differs").alias("differs"),
    )
    # the root holds the most; if no text differs, all text counts
    weight = lambda x: F.when(F.col("differs") > 0, x["differs"]).otherwise(x["size"])
    most = F.when(F.col("differs") > 0, F.col("differs")).otherwise(F.col("size"))
    by_depth = lambda xs: F.transform(xs, lambda x: F.struct(x["depth"], x["token"]))
    told = F.array_min(by_depth(F.filter("all", lambda x: x["main"] & (weight(x) >= most * F.lit(MOST)))))
    deepest = F.array_max(by_depth(F.filter("all", lambda x: weight(x) == most)))
    chosen = listed.select("key", "fixed", told.alias("told"), deepest.alias("deepest"))
    chosen = chosen.select("key", F.coalesce("told.token", "deepest.token").alias("slot"), F.col("told").isNotNull().alias("told"), "fixed")
    out = save(chosen.join(pages.select("key", "pages"), "key"))
    forget(pages)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text. Pages without a host (null url) share one. Repeated rows are kept, and
    count once where template text is looked for. A page's text depends on its host's pages only, not on their order.
    An empty table gives an empty result; other columns don't matter.
    """
    host, _ = url_parts(F.col("url"))
    column = pages.select("page_id").schema.simpleString()[7:-1]
    schema = f"row long, host string, {column}, url string, template long, kind long, once array<long>, mains array<long>, blocks array<struct<chain:array<long>,text:string>>"
    parsed = pages.select(host.alias("host"), "page_id", "url", "html").mapInArrow(_parsed, schema)
    parsed = save(parsed.withColumn("key", F.xxhash64("host", "template")).drop("host", "template"))
    full = parsed.where(F.size("blocks") > 0)
    total = full.count()
    found = join_hot(full.select("key", "row", "page_id", "url", "blocks"), templates(full, total), "key", ["slot", "told", "fixed"], F.col("pages"), total, "row")
    inside = F.filter("blocks", lambda b: F.array_contains(b["chain"], F.col("slot")))
    found = found.select("page_id", "url", "told", "fixed", inside.alias("blocks"))
    # the template's text before and after what differs; repeated parts, and what stands in between, are the page's
    keeps = F.transform("blocks", lambda b: ~F.array_contains("fixed", F.xxhash64(F.element_at(b["chain"], -1), F.xxhash64(b["text"]))))
    found = found.withColumn("keeps", F.when(F.col("told"), F.transform("blocks", lambda b: F.lit(True))).otherwise(keeps))
    first, last = F.array_position("keeps", True), F.array_position(F.reverse("keeps"), True)
    kept = F.when(first > 0, F.slice("blocks", first.cast("int"), (F.size("blocks") - first - last + 2).cast("int"))).otherwise(F.slice("blocks", 1, 0))
    texts = found.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text"))
    empty = parsed.where(F.size("blocks") == 0).select("page_id", "url", F.lit("").alias("text"))
    return texts.unionByName(empty).withColumn("n_chars", F.length("text").cast("long"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
