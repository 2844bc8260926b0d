"""Problem 8: the whole corpus as token ids of a public byte-level BPE.

Texts are cut into pre-tokens by the vocabulary's public pattern; a pre-token that is a token is looked up, any other is
merged by a hierarchical-bitmap rank queue: a bucket per merge rank holds positions of a linked list of symbols, a
bitmap tree over the ranks finds the least rank that has entries by find-first-set, and entries whose pair has changed
meanwhile are skipped. This takes n log n steps for a pre-token of any length. Merged pre-tokens are remembered in a
bounded memo, as natural text repeats them.

Defined results: the ids of a null text and of an empty text are the empty list; special tokens' strings are ordinary
text; every character is encoded by its UTF-8 bytes, so nothing is lost; texts are never cut; one output row per input
row (repeated rows of a table count once when ``distinct`` is set); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabulary files lie; a parameter of every function that needs one.
VOCAB_DIR = os.environ.get("ROADGRAIN_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pattern of this vocabulary's pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries the memo may hold before it starts afresh, and the longest pre-token (bytes) it keeps.
MEMO, MEMO_BYTES = 200_000, 64


class RankQueue:
    """Least-rank-first queue: buckets by rank under a three-level bitmap of 64-bit words."""

    def __init__(self, n_ranks: int):
        self.l0 = [0] * (n_ranks // 64 + 1)
        self.l1 = [0] * (len(self.l0) // 64 + 1)
        self.l2 = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        b = self.buckets.get(rank)
        if b is None:
            self.buckets[rank] = [pos]
            i = rank >> 6
            self.l0[i] |= 1 << (rank & 63)
            self.l1[i >> 6] |= 1 << (i & 63)
            self.l2 |= 1 << (i >> 6)
        else:
            b.append(pos)

    def pop_bucket(self) -> tuple[int, list[int]] | None:
        """The entries of the least rank, or None."""
        if not self.l2:
            return None
        h = (self.l2 & -self.l2).bit_length() - 1
        w = self.l1[h]
        i = (h << 6) + (w & -w).bit_length() - 1
        w = self.l0[i]
        rank = (i << 6) + (w & -w).bit_length() - 1
        w &= w - 1
        self.l0[i] = w
        if not w:
            self.l1[h] &= ~(1 << (i & 63))
            if not self.l1[h]:
                self.l2 &= ~(1 << h)
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder of one rank file; ``split`` gives the pre-tokens, ``encode`` the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.size = max(self.ranks.values()) + 1
        self.pieces = [b""] * self.size
        for k, v in self.ranks.items():
            self.pieces[v] = k
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.queue = RankQueue(self.size)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token, by rank queue."""
        ranks, pieces = self.ranks, self.pieces
        ids = [ranks[raw[i : i + 1]] for i in range(len(raw))]
        n = len(ids)
        if n < 2:
            return ids
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        q = self.queue
        want: list[int] = [-1] * n  # the rank that position's pair has now
        for i in range(n - 1):
            r = ranks.get(pieces[ids[i]] + pieces[ids[i + 1]])
            if r is not None:
                want[i] = r
                q.push(r, i)
        while (top := q.pop_bucket()) is not None:
            rank, at = top
            at.sort()  # equal ranks merge from the left
            for i in at:
                if want[i] != rank:
                    continue  # stale: the pair has changed or is gone
                j = nxt[i]
                k = nxt[j]
                ids[i] = rank
                nxt[i], want[j] = k, -2
                want[i] = -1
                if k >= 0:
                    prev[k] = i
                    r = ranks.get(pieces[rank] + pieces[ids[k]])
                    if r is not None:
                        want[i] = r
                        q.push(r, i)
                h = prev[i]
                if h >= 0:
                    r = ranks.get(pieces[ids[h]] + pieces[rank])
                    want[h] = -1 if r is None else r
                    if r is not None:
                        q.push(r, h)
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = nxt[i]
        return out

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a pre-token, remembered if it is short."""
        got = self.memo.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            r = self.ranks.get(raw)
            got = [r] if r is not None else self.merge(raw)
            if len(raw) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, slow, out = self.memo, self.piece_ids, []
        for p in self.find(text):
            out += memo.get(p) or slow(p)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.pieces[i] for i in ids)


_LOADED: dict[str, ByteBPE] = {}


def send(spark: SparkSession, name: str, vocab_dir: str) -> None:
    """Sends the vocabulary file from the driver to the executors, once per application."""
    sc, path = spark.sparkContext, os.path.join(vocab_dir, f"{name}.tiktoken")
    sent = sc.__dict__.setdefault("_roadgrain_vocabularies", {})
    if name not in sent:
        sc.addFile(path)
    if sent.setdefault(name, path) != path:
        raise ValueError(f"another vocabulary of the name {name} was sent before: {sent[name]}")


def load(name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> ByteBPE:
    """The encoder of ``<vocab_dir>/<name>.tiktoken``, once per Python worker."""
    path = os.path.join(vocab_dir, f"{name}.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR, distinct: bool = False, partitions: int | None = None
) -> DataFrame:
    """(id, ids array<int>) of every document.

    ``partitions`` spreads a corpus of fewer splits than cores over so many tasks, which shuffles its texts; by default
    the scan's splits stay and nothing is shuffled.
    """
    send(documents.sparkSession, name, vocab_dir)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(name, SparkFiles.getRootDirectory())
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "ids": [enc.encode(t) for t in b[text_col]]})

    d = documents.select(id_col, text_col)
    d = d.repartition(partitions) if partitions else d
    return (d.dropDuplicates([id_col]) if distinct else d).mapInPandas(run, f"`{id_col}` long, ids array<int>")
