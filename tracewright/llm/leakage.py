"""Evaluation texts leaking into training text: greedy string tiling against held-out items.

Word triples that a document shares with an item are its seeds. Seeds on one diagonal join to maximal matches, of which
the longest that does not overlap what is already marked is marked as a tile, again and again, until none of the seed's
length is left (running Karp-Rabin hashing of word windows finds the seeds). The share of an item's words under tiles
tells leaks even where passages were put in another order. One quoted passage is what every seed run, marked or not, reaches in both
directions by banded edit distance over the words.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

#: Words of items held in one broadcast (some 20,000 items); all of them are searched in one scan of the documents, and a larger set
#: of items takes one scan for every block of this size. It also keeps the codes of three words free of collisions.
BLOCK_WORDS = 1_000_000
#: Words of documents that a task searches at a time.
HELD_WORDS = 2_000_000
SHARE, EDITS, SEED = 0.4, 3, 3

_MARKUP = re.compile(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<[^<>\n]{1,200}>|\{\{([^{}]*)\}\}|\[\[([^\[\]]*)\]\]|&(?:[a-zA-Z]+|#\d+);", re.S)
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _plain(m: re.Match, aside: list[str]) -> str:
    whole = m.group(0)
    if m.group(1) is not None:
        kept = [a for a in m.group(1).split("|")[1:] if "=" not in a or len(a) > 40]
        return " " + " ".join(a.split("=", 1)[-1] for a in kept) + " "
    if m.group(2) is not None:
        head, _, shown = m.group(2).rpartition("|")
        if not re.match(r"\s*(?:Category|File|Image|Datei|Kategorie|Archivo|Categoría|Fichier|Catégorie):", head or shown):
            return shown
        aside.append(shown if head else "")
        return " "
    if whole[0] == "&":
        return html.unescape(whole)
    if whole.startswith("<!--"):
        aside.append(whole[4:-3])
    elif whole.startswith("<ref") and whole.endswith("</ref>"):
        aside.append(whole[whole.index(">") + 1 : -6])
    return " "


def parts_of(text: str) -> list[list[str]]:
    """The words of a text in lower case, without markup, and after them those of each note, comment and caption on its own.

    Links count as what they show, templates as their unnamed arguments, tags, files and categories not at all.
    """
    aside: list[str] = []
    if "{{" in text or "[[" in text or "<" in text or "&" in text:
        text = _MARKUP.sub(lambda m: _plain(m, aside), text)
    # What stands aside is no part of the running text, but may hold a passage itself.
    return [_WORDS.findall(text.casefold().replace("’", "'")), *(parts_of(a)[0] for a in aside if a.count(" ") > 1)]


def words_of(text: str) -> list[str]:
    """The words of the running text; see :func:`parts_of`."""
    return parts_of(text)[0]


class Seeds:
    """The seeds of one length of a block's items."""

    def __init__(self, length: int, coded: dict[int, np.ndarray]):
        self.length = length
        codes, item, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, c in coded.items():
            h = self.windows(c)
            codes.append(h)
            item.append(np.full(len(h), k))
            pos.append(np.arange(len(h)))
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.pos = code[order], np.concatenate(item)[order], np.concatenate(pos)[order]
        self.mask = (1 << max(16, (16 * len(code)).bit_length())) - 1
        self.table = np.zeros(self.mask + 1, bool)
        self.table[self.code & self.mask] = True

    def windows(self, c: np.ndarray) -> np.ndarray:
        """Karp-Rabin codes of all windows of this length; -1 where one holds a word no item has."""
        n = len(c) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        h, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(self.length):
            part = c[k : k + n]
            h = h * 1_000_003 + part
            bad |= part < 0
        h &= (1 << 62) - 1
        h[bad] = -1
        return h

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.windows(doc)
        at = np.flatnonzero((h >= 0) & self.table[h & self.mask])
        lo, hi = np.searchsorted(self.code, h[at], "left"), np.searchsorted(self.code, h[at], "right")
        n = hi - lo
        rep = np.repeat(np.arange(len(at)), n)
        idx = lo[rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n))
        return at[rep], self.item[idx], self.pos[idx]


class Items:
    """A block of items, coded for the search. Each has seeds of its own length, so no item's result hangs on the others."""

    def __init__(self, ids: list, texts: list[str], share: float, edits: int, seed: int):
        self.ids, self.share, self.edits = ids, share, edits
        words = [words_of(t) for t in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.coded = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in words]
        # Of a passage with so many changed words, a run of this length is left whole.
        self.seeds = [max(1, min(seed, (math.ceil(share * len(w)) - edits) // (edits + 1))) for w in words]
        self.parts = [Seeds(n, {k: c for k, c in enumerate(self.coded) if self.seeds[k] == n}) for n in sorted(set(self.seeds))]

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document position, item and item position of every seed in a coded document (or a joined batch of them)."""
        found = [p.hits(doc) for p in self.parts] or [(np.zeros(0, np.int64),) * 3]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def may_reach(self, k: int, pos: np.ndarray) -> bool:
        """Whether item ``k`` can reach the share with seeds at these places: as tiles, which cover no other words than the seeds do, or as a passage with all its edits, which keeps a number of them."""
        at, seed, need = np.unique(pos), self.seeds[k], math.ceil(self.share * len(self.coded[k]))
        covered = int(np.minimum(np.diff(at), seed).sum()) + seed
        return covered >= need or len(at) >= max(1, need - self.edits - (seed - 1) * (self.edits + 1))


def tiles(at: np.ndarray, pos: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed hits of one document and item: (document position, item position, length). No hits, no tiles."""
    if not len(at):
        return []
    order = np.lexsort((at, at - pos))
    a, p = at[order], pos[order]
    cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(p) != 1)) + 1
    matches = [(int(len(g) + seed - 1), int(a[g[0]]), int(p[g[0]])) for g in np.split(np.arange(len(a)), cut)]
    marked_d: set[int] = set()
    marked_i: set[int] = set()
    out = []
    import heapq

    heap = [(-n, x, y) for n, x, y in matches]
    heapq.heapify(heap)
    while heap:
        n, x, y = heapq.heappop(heap)
        n, free, runs = -n, 0, []
        for k in range(n + 1):
            if k < n and x + k not in marked_d and y + k not in marked_i:
                free += 1
            else:
                if free >= seed:
                    runs.append((k - free, free))
                free = 0
        if runs == [(0, n)]:
            out.append((x, y, n))
            marked_d.update(range(x, x + n))
            marked_i.update(range(y, y + n))
        else:
            for k, m in runs:
                heapq.heappush(heap, (-m, x + k, y + k))
    return sorted(out)


def passage(ts: list[tuple[int, int, int]], edits: int) -> int:
    """The most item words from first to last of a chain of tiles in order that at most ``edits`` changed, dropped or added words interrupt."""
    best = 0
    reach: list[dict[int, int]] = []
    for j, (x, y, n) in enumerate(ts):
        mine = {0: y}
        for i in range(j):
            px, py, pn = ts[i]
            gd, gi = x - px - pn, y - py - pn
            if gd < 0 or gi < 0 or max(gd, gi) > edits:
                continue
            cost = max(gd, gi)
            for e, start in reach[i].items():
                if e + cost <= edits and start < mine.get(e + cost, 1 << 60):
                    mine[e + cost] = start
        reach.append(mine)
        best = max(best, max(y + n - s for s in mine.values()))
    return best


def _reach(a: list[int], x: int, b: list[int], y: int, edits: int) -> list[int]:
    """How many words of ``b`` from ``y`` on up to 0, 1, .. ``edits`` edits reach against ``a`` from ``x`` on, ending on an equal word.

    The furthest place in ``b`` on each diagonal is kept for every number of edits; following equal words is never worse.
    """
    na, nb, best, out, row = len(a), len(b), 0, [], {0: y}
    for e in range(edits + 1):
        if e:
            above: dict[int, int] = {}
            for k, j in row.items():
                # A changed word, a word of b dropped, a word of a added.
                for kk, jj in ((k, j + 1), (k - 1, j + 1), (k + 1, j)):
                    if jj <= nb and x + jj - y + kk <= na and jj > above.get(kk, -1):
                        above[kk] = jj
            row = above
        for k, j in row.items():
            i, j0 = x + j - y + k, j
            while j < nb and i < na and a[i] == b[j]:
                i, j = i + 1, j + 1
            row[k] = j
            if j > j0:
                best = max(best, j - y)
        out.append(best)
    return out


def extent(doc: list[int], item: list[int], at: np.ndarray, pos: np.ndarray, seed: int, edits: int) -> int:
    """The most item words, from first to last equal word, of a passage with at most ``edits`` words changed, dropped or added that holds one of the seeds."""
    if not len(at):
        return 0
    order = np.lexsort((at, at - pos))
    a, p = at[order], pos[order]
    cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(p) != 1)) + 1
    best, back = 0, item[::-1]
    for g in np.split(np.arange(len(a)), cut):
        n, x, y = len(g) + seed - 1, int(a[g[0]]), int(p[g[0]])
        # No passage is longer than the item, and of the document only so much can lie in it.
        far = len(item) + edits
        right = _reach(doc[x + n : x + n + far], 0, item, y + n, edits)
        left = _reach(doc[max(0, x - far) : x][::-1], 0, back, len(item) - y, edits)
        best = max(best, n + max(left[e] + right[edits - e] for e in range(edits + 1)))
        if best == len(item):
            break
    return best


def leaks(documents: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text", share: float = SHARE, edits: int = EDITS, seed: int = SEED) -> DataFrame:
    """Pairs of documents and items that share tiles: (doc, item, passage_share, tile_share).

    ``passage_share`` is the part of the item's words in its longest quoted passage, in order and with at most ``edits``
    words changed, dropped or added; ``tile_share`` the part under tiles in any order and place. A pair is returned if
    either reaches ``share``. ``seed`` is the least length of a tile; items too short for it to find every passage have
    a shorter one of their own. Items are held in blocks of at most ``BLOCK_WORDS`` words; each block is searched in one
    scan of the documents, of which nothing is shuffled or gathered.

    Null and empty texts, and items without words, match nothing. Repeated rows give repeated pairs. Case, punctuation,
    line breaks and wiki markup are ignored; notes, comments and captions are searched apart from the text around them.
    """
    spark = documents.sparkSession
    ship(spark)
    kd, ki = (t.schema[c].dataType.simpleString() for t, c in ((documents, doc), (items, item)))
    schema = f"d {kd}, i {ki}, passage_share double, tile_share double"
    sized = items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    words = sized.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(words * 1.3 / BLOCK_WORDS))
    scan = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).where("t is not null")
    out = None
    for b in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], share, edits, seed))
        part = scan.mapInPandas(_search(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("d").alias(doc), F.col("i").alias(item), "passage_share", "tile_share")


def _search(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: Items = shared.value
        get = block.vocabulary.get
        for pdf in batches:
            found: list[tuple] = []
            rows, coded, n = [], [], 0
            for r, t in enumerate(pdf["t"]):
                ids = []
                for words in parts_of(t):
                    ids += [get(w, -1) for w in words]
                    ids.append(-1)
                rows.append(r)
                n += len(ids)
                coded.append(np.array(ids, np.int64))
                if n > HELD_WORDS:
                    found += [(pdf["d"].iloc[rows[k]], *f) for k, *f in _found(block, coded)]
                    rows, coded, n = [], [], 0
            if coded:
                found += [(pdf["d"].iloc[rows[k]], *f) for k, *f in _found(block, coded)]
            yield pd.DataFrame(found, columns=["d", "i", "passage_share", "tile_share"])

    return run


def _found(block: Items, coded: list[np.ndarray]) -> Iterator[tuple]:
    """(number of the document, item, passage share, tile share) of the pairs of some documents that reach the share."""
    first = np.cumsum([0] + [len(c) for c in coded[:-1]])
    at, item, pos = block.hits(np.concatenate(coded))
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((item, row))
    at, item, pos, row = at[order], item[order], pos[order], row[order]
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
    held, doc = -1, []
    for g in np.split(np.arange(len(at)), cut) if len(at) else ():
        k, r = int(item[g[0]]), int(row[g[0]])
        if not block.may_reach(k, pos[g]):
            continue
        size, seed = len(block.coded[k]), block.seeds[k]
        ts = tiles(at[g] - first[r], pos[g], seed)
        if r != held:
            held, doc = r, coded[r].tolist()
        most = passage(ts, block.edits)
        if most < size:
            most = extent(doc, block.coded[k].tolist(), at[g] - first[r], pos[g], seed, block.edits)
        whole, covered = most / size, sum(t[2] for t in ts) / size
        if max(whole, covered) >= block.share:
            yield r, block.ids[k], whole, covered
