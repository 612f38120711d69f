"""The template rules page by page in plain Python, over all pages of one host at once."""

from __future__ import annotations

from collections import Counter, defaultdict

from placewise.llm import html


def classes(pages):
    """Equivalence classes: occurrence vector -> tokens."""
    counts = [Counter(t for t, _, _ in p.elements) for p in pages]
    by = defaultdict(set)
    for t in {t for c in counts for t in c}:
        by[tuple(c[t] for c in counts)].add(t)
    return by


def skeleton(pages):
    ones = classes(pages)[(1,) * len(pages)]
    orders = [[t for t, _, _ in p.elements if t in ones] for p in pages]
    return {t for t in ones if len({o.index(t) for o in orders}) == 1}


def template_texts(pages):
    kinds = [html.kinds([p])[0] for p in pages]
    holders = defaultdict(set)
    for p, k in zip(pages, kinds, strict=True):
        for e, text in p.blocks:
            holders[p.elements[e][0], text].add(k)
    return {x for x, held in holders.items() if len(held) >= max(html.LEAST, html.ALIKE * len(set(kinds)))}


def slot(pages):
    known, constant = skeleton(pages), template_texts(pages)
    volume = Counter()
    for differs in (True, False):
        for p in pages:
            for e, text in p.blocks:
                if not differs or (p.elements[e][0], text) not in constant:
                    for a in p.chain(e):
                        if p.elements[a][0] in known:
                            volume[p.elements[a][0]] += len(text)
        if volume:
            break
    told = {p.elements[e][0] for p in pages for e in p.main} & known
    if told := {t for t in told if volume[t] >= html.MOST * volume[""]}:
        return min(told, key=lambda t: (t.count(">"), html._hash(t))), True
    return max((t for t in known if volume[t] == volume[""]), key=lambda t: t.count(">")), False


def extract(sources):
    pages = [html.Page(s) for s in sources]
    groups = defaultdict(list)
    for p in pages:
        if p.blocks:
            groups[frozenset(p.elements[e][0] for e in p.main)].append(p)
    texts = {}
    for own in groups.values():
        (main, told), known, constant = slot(own), skeleton(own), template_texts(own)
        for p in own:
            inside = [(e, t) for e, t in p.blocks if any(p.elements[a][0] == main for a in p.chain(e))]
            if not told:
                fixed = [(p.elements[e][0], t) in constant and p.elements[e][0] in known for e, t in inside]
                while fixed and fixed[-1]:
                    fixed.pop()
                inside = inside[fixed.index(False) if fixed else 0 : len(fixed)]
            texts[id(p)] = "\n\n".join(t for _, t in inside)
    return [texts.get(id(p), "") for p in pages]
