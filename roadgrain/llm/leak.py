"""Problem 9: held-out test passages inside a training corpus.

Documents and passages become words of plain writing (markup, entities, look-alike letters, invisible characters and
case removed; scripts without blanks letter by letter), and a document's word that is a passage's with a small slip of
writing counts as that word. Greedy string tiling covers each passage with the longest word runs of a document that don't
overlap, marked again and again, found by Karp-Rabin hashes of shrinking length. A passage leaked into a document if its
tiles cover the asked share of it, in whatever order (``tile_cover``), or if an alignment finds the share in order and
close together (``carried``); ``p9_found`` are the pairs of the second kind, as the project's definition asks.

Nothing that can be a case is left out: a pair is tiled and aligned if the passage's words that stand anywhere in the
document, slips forgiven, make up the share, which both measures need.

Defined results: null, blank and empty texts and passages match nothing; the stem plays no part; passages under
``least_words`` words are never matched; equal documents are each reported; repeated item rows count once; texts are
read whole; an empty table on either side gives no rows.

The passages are a stated query set against all rows: they are sent to the workers in blocks of at most ``block``
passages (a bound on what is broadcast), one pass of the corpus per block, so the corpus is never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cyrillic and Greek letters and the Latin ones they are mistaken for.
LOOKALIKES = dict(zip(
    "абвгеёзикмнорстухіјѕԁһԛԝүАВЕКМНОРСТУХІЈЅαβεικνορτυχηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "a6bree3ukmhopctyxijsdhqwyabekmhopctyxijsabeiknoptuxnwabezhikmnoptyx",
))
LETTERS = re.compile("[" + "".join(LOOKALIKES) + "]")
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|\[/?[a-zA-Z]+(?:=[^\]\n]*)?\]")
BROKEN = re.compile(r"(?<=[a-z])-[ \t]*\n[>|: \t]*(?=[a-z])")
#: Letters of scripts that are written without blanks are words of their own: kana, Han, Thai, Lao, Khmer, Burmese.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
WORD = re.compile(rf"[{ALONE}]|[^\W_{ALONE}]+")
#: Combining marks of Latin, Greek, Cyrillic, Hebrew and Arabic letters, the kana's, and marks for symbols.
MARKS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x300, 0x3100) if unicodedata.combining(chr(c))) + "\ufe20-\ufe2f]")
#: Block of passages sent to the workers at once.
BLOCK = 2000


def words(text: str | None) -> list[str]:
    """The words of a text in plain writing."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(html.unescape(t))
    t = INVISIBLE.sub("", t)
    if "<" in t or "[" in t:
        t = TAG.sub(" ", t)
    if not t.isascii():
        t = LETTERS.sub(lambda m: LOOKALIKES[m.group()], unicodedata.normalize("NFKD", t))
        t = MARKS.sub("", t)
    t = t.lower()
    if "-" in t:
        t = BROKEN.sub("", t)
    return WORD.findall(t)


def tiles(p: list, t: list, least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in p, start in t, length) of non-overlapping common runs, longest first.

    A None in t is a word that equals none of p's.
    """
    mp, mt, out = bytearray(len(p)), bytearray(x is None for x in t), []
    hp, ht = [hash(x) & 0xFFFFFFF for x in p], [hash(x) & 0xFFFFFFF for x in t]
    mod, base = (1 << 61) - 1, 1_000_003

    def windows(h: list[int], marked: bytearray, s: int) -> Iterator[tuple[int, int]]:
        """Rolling hashes of length s in the unmarked runs."""
        top, z = pow(base, s, mod), 0
        while (a := marked.find(0, z)) >= 0:
            z = marked.find(1, a)
            z = len(h) if z < 0 else z
            if z - a < s:
                continue
            v = 0
            for x in h[a : a + s]:
                v = (v * base + x) % mod
            yield a, v
            for i in range(a + s, z):
                v = (v * base + h[i] - h[i - s] * top) % mod
                yield i - s + 1, v

    s = min(len(p), len(t), 32)
    while s >= least:
        table: dict[int, list[int]] = defaultdict(list)
        for j, v in windows(ht, mt, s):
            table[v].append(j)
        found = []
        longest = 0
        for i, v in windows(hp, mp, s):
            for j in table.get(v, ()):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k >= s:
                    found.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * s:  # restart with the length just seen, so that the longest are marked first
            s = longest
            continue
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not any(mp[i : i + k]) and not any(mt[j : j + k]):
                mp[i : i + k] = mt[j : j + k] = b"\1" * k
                out.append((i, j, k))
        s = s // 2 if s // 2 >= least else (least if s > least else 0)
    return out


def alike(a: str, b: str) -> bool:
    """Equal, or one small slip of writing apart (for words of four letters or more)."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1 or min(n, m) < 4 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def carried(p: list, t: list, slack: float = 2.0, near: dict | None = None) -> float:
    """Largest share of p's words that stand in t in order within a stretch of ``slack`` times p's length.

    ``near`` holds the words of t that count as words of p, as tuples of these; without it only equal words count.
    """
    reach, best = int(len(p) * slack) + 1, 0
    eq = defaultdict(list)
    for i, w in enumerate(p):
        eq[w].append(i)
    memo: dict = {}
    hits: list[tuple[int, list[int]]] = []
    for j, w in enumerate(t):
        pos = memo.get(w)
        if pos is None:
            pos = eq.get(w) or (sorted(i for x in near[w] for i in eq.get(x, ())) if near and w in near else [])
            memo[w] = pos
        if pos:
            hits.append((j, pos))
    at = [j for j, _ in hits]
    k = -(10**9)
    for n, s in enumerate(at):  # windows that step by a quarter of the passage
        if s - k < max(1, len(p) // 4):
            continue
        k = s
        end = bisect_left(at, s + reach)
        if end - n <= best:
            continue
        row: list[int] = []  # patience sorting: the least end of a chain of each length
        for _, pos in hits[n:end]:
            for i in reversed(pos):
                x = bisect_left(row, i)
                if x == len(row):
                    row.append(i)
                else:
                    row[x] = i
        best = max(best, len(row))
    return best / len(p)


def shortened(w: str) -> set[str]:
    """The word and, if a slip may be forgiven, the word without each of its letters: words that are ``alike`` share one."""
    return {w} if len(w) < 4 or w.isdigit() else {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


class Passages:
    """A block of passages with the places of their words."""

    #: Words of documents whose passage words are remembered.
    MEMO = 200_000

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.n_words = np.array([len(w) for _, w in items], dtype="float64")
        counts: dict[str, dict[int, int]] = defaultdict(dict)
        for k, (_, w) in enumerate(items):
            for x in w:
                counts[x][k] = counts[x].get(k, 0) + 1
        self.places = {x: np.array([list(c), list(c.values())]) for x, c in counts.items()}
        self.near: dict[str, list[str]] = defaultdict(list)
        for x in counts:
            for key in shortened(x):
                self.near[key].append(x)
        self.memo: dict[str, tuple[str, ...]] = {}

    def like(self, w: str) -> tuple[str, ...]:
        """The passages' words that a document's word counts as."""
        got = self.memo.get(w)
        if got is None:
            near = self.near
            got = tuple(sorted(x for x in {x for key in shortened(w) if key in near for x in near[key]} if alike(x, w)))
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[w] = got
        return got

    def matches(self, text: str | None, share: float) -> list[tuple[int, float, float]]:
        """(item, tile cover, carried) of the passages of which one of the two reaches the share."""
        w = words(text)
        known = {v: x for v in set(w) if (x := self.like(v))}
        if not known:
            return []
        # More of a passage than the words that stand anywhere in the text, slips forgiven, can't be covered or carried.
        there = np.zeros(len(self.items), dtype="int64")
        got = np.concatenate([self.places[x] for x in {x for xs in known.values() for x in xs}], axis=1)
        np.add.at(there, got[0], got[1])
        out = []
        for k in np.flatnonzero(there / self.n_words >= share):
            item, p = self.items[k]
            own = set(p)
            # The text in the passage's words, for the tiles: a word counts as itself before any other.
            t = [v if v in own else next((x for x in known.get(v, ()) if x in own), None) for v in w]
            cover = sum(n for _, _, n in tiles(p, t)) / len(p)
            c = carried(p, w, near=known)
            if max(cover, c) >= share:
                out.append((item, cover, c))
        return out


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.6, least_words: int = 5, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """(doc_id, item_id, tile_cover, carried) of every document that holds ``share`` of a passage in tiles or in order.

    ``partitions`` spreads a corpus of fewer splits than cores over so many tasks, which shuffles its texts; by default
    the scan's splits stay.

    Runs one small action per call: the passages (a stated query set) are read to the driver, block by block.
    """
    spark = documents.sparkSession
    rows = ((r["item_id"], words(r["passage"])) for r in items.select("item_id", "passage").where("item_id is not null and passage is not null").distinct().toLocalIterator())
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    for item, w in rows:
        if len(w) >= least_words:
            if len(blocks[-1]) >= block:
                blocks.append([])
            blocks[-1].append((item, w))
    schema = "doc_id long, item_id long, tile_cover double, carried double"
    texts, out = documents.select("doc_id", "text").where(F.col("text").isNotNull()), None
    texts = texts.repartition(partitions) if partitions else texts
    for b in blocks:
        sent = spark.sparkContext.broadcast(b)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            p = Passages(sent.value)
            for d in batches:
                got = [(i, *m) for i, t in zip(d["doc_id"], d["text"]) for m in p.matches(t, share)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "tile_cover", "carried"])

        part = texts.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
