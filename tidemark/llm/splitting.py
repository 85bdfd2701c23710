"""Splitting of oversized texts at natural boundaries by agglomerative merging.

The atoms of a text are its sentences; a sentence over the limit is cut at white space, a word over the limit after any
character. Every boundary between two atoms has a strength (paragraph > sentence > clause > word > inside a word). Adjacent
pieces are held in a heap by the strength of the boundary between them and are merged, weakest boundary first, while the
merged piece with the overlap it repeats fits the limit. Each piece but the first then repeats the last whole sentences, or
else words, of the piece before it, at most ``overlap`` characters.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 120
#: A sentence ends after a run of these signs before white space or the end of the text, and at a line feed.
SENTENCE_END = re.compile(r"[.!?…]+(?=\s|\Z)|\n")
SPACE = re.compile(r"\s+")
CLAUSE = re.compile(r"[,;:)\]—–-]\s*\Z")


def sentence_ends(text: str) -> list[int]:
    """Offsets at which the sentences of ``text`` end, the end of the text included."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def atoms(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the atomic segments, in order and without holes."""
    out, at = [], 0
    ends = sentence_ends(text)
    # White space after a sentence's end belongs to the next sentence, so that cuts lie exactly at the ends.
    for end in ends:
        strength = 4 if text[end - 1 : end] == "\n" and text[end - 2 : end - 1] == "\n" else 3
        if end - at <= limit:
            out.append((at, end, strength))
        else:
            begin = at
            marks = [m.end() for m in SPACE.finditer(text, at, end)] + [end]
            for mark in marks:
                while mark - begin > limit:
                    out.append((begin, begin + limit, 0))
                    begin += limit
                if mark > begin:
                    last = mark == end
                    out.append((begin, mark, strength if last else 2 if CLAUSE.search(text[max(begin, mark - 8) : mark]) else 1))
                    begin = mark
        at = end
    return out


def tail_overlap(text: str, start: int, end: int, most: int) -> int:
    """Where the overlap begins that the piece text[start:end] hands on: whole sentences if they fit, else whole words, else none."""
    room = max(start, end - most)
    inner = [e for e in sentence_ends(text[start:end])[:-1]]
    for e in inner:
        if start + e >= room and text[start + e : end].strip():
            return start + e
    marks = [m.end() for m in SPACE.finditer(text, room, end) if m.end() < end]
    return next((m for m in marks if m > start), end)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (core start, core end, start with overlap) of a text; the cores cover the text, each piece has at most ``limit`` characters."""
    segs = atoms(text, limit)
    n = len(segs)
    start, end = [s for s, _, _ in segs], [e for _, e, _ in segs]
    after, before, alive = list(range(1, n)) + [-1], [-1, *range(n - 1)], [True] * n
    room = limit - overlap
    heap = [(segs[i][2], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    strength = [s for _, _, s in segs]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue
        # The first piece repeats nothing, so that it may use the whole limit.
        if size > (limit if before[i] < 0 else room):
            continue
        end[i], strength[i], alive[j] = end[j], strength[j], False
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (strength[i], end[after[i]] - start[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength[before[i]], end[i] - start[before[i]], before[i], i))
    out, i, prior = [], 0 if n else -1, None
    while i >= 0:
        head = start[i]
        if prior is not None:
            head = tail_overlap(text, prior, start[i], min(overlap, limit - (end[i] - start[i])))
        out.append((start[i], end[i], head))
        prior, i = start[i], after[i]
    return out


def cut_kind(text: str, pieces: list[tuple[int, int, int]]) -> str:
    """``natural`` if every piece ends where a sentence ends (or the text), else ``forced``.

    Atoms are whole sentences unless one is longer than the limit, so that a cut inside a sentence means that no way around it was left.
    """
    ends = set(sentence_ends(text))
    return "natural" if all(end in ends for _, end, _ in pieces) else "forced"


SCHEMA = "piece int, n_pieces int, text string, char_start int, char_end int, overlap_chars int, t_start_s double, t_end_s double, cut string"


def split_oversized(df: DataFrame, key: str, text: str, start: str, end: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text of more than ``limit`` characters: ``key, piece, n_pieces, text, char_start, char_end, overlap_chars, t_start_s, t_end_s, cut``.

    A piece's times are its core's share of the text's span by characters; null where a time is missing or not finite or
    the end is not after the start. ``cut`` tells whether every piece ends at a sentence's end. Repeated rows of a key count once; null and short
    texts give no piece; an empty input gives an empty result. The rows stay where they are read but for that removal.
    """
    c = {"key": F.col(key), "body": F.col(text).cast("string"), "t0": F.col(start).cast("double"), "t1": F.col(end).cast("double")}
    rows = df.select(*[v.alias(k) for k, v in c.items()]).where(F.col("key").isNotNull() & (F.char_length("body") > limit)).dropDuplicates(["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, body, t0, t1 in zip(pdf["key"], pdf["body"], pdf["t0"], pdf["t1"]):
                good = t0 is not None and t1 is not None and abs(t0) < float("inf") and abs(t1) < float("inf") and t1 > t0
                pieces = split_text(body, limit, overlap)
                cut = cut_kind(body, pieces)
                for p, (a, b, head) in enumerate(pieces):
                    share = (t0 + (t1 - t0) * a / len(body), t0 + (t1 - t0) * b / len(body)) if good else (None, None)
                    out.append((k, p, len(pieces), body[head:b], a, b, a - head, *share, cut))
            yield pd.DataFrame(out, columns=["key", "piece", "n_pieces", "text", "char_start", "char_end", "overlap_chars", "t_start_s", "t_end_s", "cut"])

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)
