"""Problem 10: oversized texts cut into pieces at natural boundaries.

Recursive bisection over token counts: a text over the limit is cut at the strongest boundary near its middle
(paragraph, line, sentence, clause, word), and so is each half that still exceeds the limit less the overlap; then each
piece but the first gets the ``overlap`` tokens before it. Cuts lie between pre-tokens, so the halves' tokens are the
whole's; only a pre-token that is itself over the limit is cut inside, between characters where it can be.

Defined results: null and empty texts give one piece without tokens; a text within the limit gives one piece; sizes are
counts of the whole text's ids, without special tokens; texts are read whole and no token is lost: the pieces without
their overlaps, joined, are the text; repeated rows give repeated pieces; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.llm.bpe import VOCAB_DIR, ByteBPE, load, send

KINDS = ["inside", "word", "clause", "sentence", "line", "paragraph"]
CLOSERS = "\"')]}»”’"
SENTENCE_END, CLAUSE_END = tuple(".!?…。！？؟۔"), tuple(",;:،；，")
#: Marks after which scripts without blanks may be cut.
WIDE = tuple("。！？、，；：")
SCHEMA = "doc_id long, piece_no int, n_pieces int, doc_tokens long, first_token long, n_tokens int, overlap int, cut string, ids array<int>, text string, cut_bytes int"


def strength(before: str, after: str) -> int:
    """How natural a cut between two pre-tokens is, as an index of KINDS."""
    gap = (before if before.isspace() else "") + (after[: len(after) - len(after.lstrip())])
    breaks = gap.count("\n")
    if breaks >= 2:
        return 5
    if breaks == 1:
        return 4
    if not gap:
        if before.endswith(WIDE):
            return 3 if before.endswith(SENTENCE_END) else 2
        return 0 if before and after and before[-1].isalnum() and after[0].isalnum() else 1 if before.isspace() or after.isspace() else 0
    end = before.rstrip().rstrip(CLOSERS)
    return 3 if end.endswith(SENTENCE_END) else 2 if end.endswith(CLAUSE_END) else 1


def cuts(counts: list[int], kinds: list[int], limit: int, overlap: int, inside=None) -> list[tuple[int, int]]:
    """(token offset, kind) of the cuts. counts: tokens of each pre-token; kinds[i]: the boundary before pre-token i."""
    at = [0]
    for c in counts:
        at.append(at[-1] + c)
    total, body = at[-1], limit - overlap
    if total <= limit:
        return []
    out, todo = [], [(0, total)]
    while todo:
        a, z = todo.pop()
        if z - a <= body:
            continue
        mid, best = (a + z) / 2, None
        for part in (6, 3, 2.0001):  # the middle third, then two thirds, then anywhere
            w = (z - a) / part
            lo, hi = bisect_left(at, max(a + 1, mid - w)), bisect_right(at, min(z - 1, mid + w))
            for i in range(lo, hi):
                key = (kinds[i], -abs(at[i] - mid))
                if kinds[i] > 0 and (best is None or key > best[0]):
                    best = (key, at[i], kinds[i])
            if best:
                break
        if best is None:
            where = int(mid)
            i = min(range(max(0, bisect_left(at, a + 1)), bisect_right(at, z - 1)), key=lambda i: abs(at[i] - mid), default=None)
            if i is not None and abs(at[i] - mid) <= (z - a) / 6:
                where = at[i]
            elif inside:
                where = inside(where, a, z)
            best = (None, where, 0)
        out.append((best[1], best[2]))
        todo += [(a, best[1]), (best[1], z)]
    return sorted(out)


def split_text(text: str | None, enc: ByteBPE, limit: int, overlap: int) -> tuple[list[int], list[tuple[int, int, int, str]]]:
    """The text's ids and its pieces as (first token, end token, overlap, kind of the cut before it)."""
    if not text:
        return [], [(0, 0, 0, "start")]
    pre = enc.find(text)
    per = [enc.memo.get(p) or enc.piece_ids(p) for p in pre]
    ids = [i for x in per for i in x]
    if len(ids) <= limit:
        return ids, [(0, len(ids), 0, "start")]
    kinds = [0, *(strength(a, b) for a, b in zip(pre, pre[1:])), 0]

    def inside(where: int, a: int, z: int) -> int:
        for d in range(8):  # a character has at most four bytes, so a border is near
            for x in (where - d, where + d):
                if a < x < z and not 0x80 <= enc.pieces[ids[x]][0] < 0xC0:
                    return x
        return where

    c = cuts([len(x) for x in per], kinds, limit, overlap, inside)
    edges = [(0, "start"), *((o, KINDS[k]) for o, k in c), (len(ids), "")]
    return ids, [(max(0, a - overlap), z, a - max(0, a - overlap), kind) for (a, kind), (z, _) in zip(edges, edges[1:])]


def whole_characters(raw: bytes) -> tuple[str, int]:
    """The text of a piece's bytes and how many bytes at its ends are left out of it, being parts of characters."""
    a, z = 0, len(raw)
    while a < z and 0x80 <= raw[a] < 0xC0:
        a += 1
    k = z
    while k > a and 0x80 <= raw[k - 1] < 0xC0:
        k -= 1
    if k > a and raw[k - 1] >= 0xC0:  # the last character starts at k - 1
        need = 2 if raw[k - 1] < 0xE0 else 3 if raw[k - 1] < 0xF0 else 4
        z = z if z - (k - 1) == need else k - 1
    return raw[a:z].decode("utf-8", "surrogatepass"), len(raw) - (z - a)


def split_documents(documents: DataFrame, limit: int = 512, overlap: int = 64, name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR, partitions: int | None = None, content: bool = True) -> DataFrame:
    """One row per piece: its place, ids (with the overlap in front), text and the kind of cut before it.

    An overlap starts at a token, which may be inside a character: ``text`` then starts with the next one, and
    ``cut_bytes`` counts the bytes left out of it (``ids`` are whole). Without ``content`` ids and text are null, where only the pieces' places are asked for.
    ``partitions`` is as in ``encode_corpus``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be under the limit")
    send(documents.sparkSession, name, vocab_dir)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(name, SparkFiles.getRootDirectory())
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids, parts = split_text(text, enc, limit, overlap)
                for n, (a, z, o, kind) in enumerate(parts):
                    if not content:
                        rows.append((doc_id, n, len(parts), len(ids), a, z - a, o, kind, None, None, None))
                        continue
                    # An uncut text needs no decoding: it is the piece.
                    words, gone = (text or "", 0) if len(parts) == 1 else whole_characters(enc.decode(ids[a:z]))
                    rows.append((doc_id, n, len(parts), len(ids), a, z - a, o, kind, ids[a:z], words, gone))
            yield pd.DataFrame(rows, columns=[re.split(r"\s", c)[0] for c in SCHEMA.split(", ")], dtype=None if content else object)

    d = documents.select("doc_id", "text")
    return (d.repartition(partitions) if partitions else d).mapInPandas(run, SCHEMA)


def oversized(documents: DataFrame, **kw) -> DataFrame:
    """(doc_id) of the documents that had to be split."""
    return split_documents(documents, content=False, **kw).where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("doc_id")
