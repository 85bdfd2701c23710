"""Byte-level BPE encoding by a deterministic automaton over tokens.

States are "the last token read"; an arc (state, token) exists where the merges leave the two tokens side by side. The arcs
come from successive merge gadgets: processing the merges in rank order, the gadget of merge (a, b) takes the arc a -> b out
of every state that still shows ``a`` at its right end and every token that still shows ``b`` at its left end at that rank,
and adds the arc of the merged token, which inherits the restrictions of both ends. The gadgets are kept as three tables
(pair -> rank, and each token's right and left spine with the rank that hides each spine element), from which the arcs met are
compiled and kept. A table over bytes gives the tokens that end at a place. Each byte of a pre-split word moves the automaton to
exactly one state, without backtracking; the labels of its path are the ids, and decoding emits the labels' bytes.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: The vocabulary: ranks of a byte-level BPE, one "base64 rank" a line. A parameter; never copied into the repository.
VOCABULARY = "byte_bpe_50k"
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The published pattern that splits text before the merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids one worker keeps; beyond it the memory is emptied, which costs time only.
MEMORY = 300_000
NEVER = 1 << 40


class Automaton:
    """The compiled merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        #: gadget (a, b) -> rank; spine elements as (token, rank of the merge that hides it).
        self.gadget: dict[tuple[int, int], int] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._merge(token, i)
        self.step = self._compile()
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def _merge(self, token: bytes, i: int) -> None:
        """Adds one token: a byte opens a state; a longer token is the merge of the accepted path of its bytes so far."""
        self.right[i], self.left[i] = [(i, NEVER)], [(i, NEVER)]
        if len(token) == 1:
            return
        parts = self._parts(token, i)
        if len(parts) != 2:  # not reachable by merges; such a token is never emitted
            self.right[i] = self.left[i] = []
            return
        a, b = parts
        self.gadget[a, b] = i
        self.right[i] += [(t, min(r, i)) for t, r in self.right[b]]
        self.left[i] += [(t, min(r, i)) for t, r in self.left[a]]

    def _parts(self, token: bytes, below: int) -> list[int]:
        """Merges of a rank below ``below`` applied to the bytes of ``token``, lowest rank first."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.ids.get(parts[k] + parts[k + 1])
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def arc(self, u: int, v: int) -> bool:
        """Whether token ``v`` may follow in the state of token ``u``."""
        known = self.arcs.get((u, v))
        if known is None:
            known = bool(self.left[v])
            gadget = self.gadget
            for x, hidden_x in self.right[u]:
                for y, hidden_y in self.left[v]:
                    r = gadget.get((x, y))
                    if r is not None and r < hidden_x and r <= hidden_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            self.arcs[u, v] = known
        return known

    def _compile(self) -> dict[int, int]:
        """The transition table over bytes read backwards: (node, byte) -> node, with the token that ends the walk in ``self.accept``."""
        step: dict[int, int] = {}
        accept = [-1]
        for token, i in self.ids.items():
            if not self.left[i]:  # never emitted
                continue
            node = 0
            for byte in reversed(token):
                at = node << 8 | byte
                node = step.get(at, -1)
                if node < 0:
                    node = step[at] = len(accept)
                    accept.append(-1)
            accept[node] = i
        self.accept = accept
        return step

    def path(self, word: bytes) -> list[int]:
        """The ids of the one accepted path of a word.

        A prefix of an accepted path is the accepted path of its own bytes, so that the state after each byte is one token: that of
        the arcs ending there (found by walking the table back from it) which may follow the state at its beginning. One pass sets
        all states; the labels are emitted from the last one backwards.
        """
        whole = self.ids.get(word)
        if whole is not None and self.left[whole]:
            return [whole]
        step, accept, arc = self.step, self.accept, self.arc
        state, begin = [-1], [0]
        for i in range(1, len(word) + 1):
            node, found, start = 0, -1, i
            for j in range(i - 1, -1, -1):
                node = step.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                t = accept[node]
                if t >= 0 and (not j or arc(state[j], t)):
                    found, start = t, j
                    break  # there is no other
            state.append(found)
            begin.append(start)
        out, i = [], len(word)
        while i:
            out.append(state[i])
            i = begin[i]
        return out[::-1]

    def encode(self, words: list[str]) -> list[int]:
        """Ids of pre-split words."""
        memory, out = self.words, []
        for w in words:
            got = memory.get(w)
            if got is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                got = self.path(w.encode("utf-8", "replace"))
                if len(w) < 64:
                    memory[w] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: the arc labels' bytes, one after the other."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def load(name: str = VOCABULARY, folder: str = FOLDER) -> Automaton:
    """The automaton of a vocabulary file, once per process (kept on ``sys``, so that worker reuse keeps it)."""
    kept = sys.__dict__.setdefault("_tidemark_automata", {})
    if (name, folder) not in kept:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            kept[name, folder] = Automaton({base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())})
    return kept[name, folder]


def splitter():
    """The compiled pre-split pattern."""
    import regex

    return regex.compile(PATTERN)


def encode_texts(df: DataFrame, key: Column, text: Column, name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``key, ids``: the ids of every row's text as it stands, without special tokens; null and empty texts give [].

    One narrow stage: rows stay where they are read, whatever the size of their source; repeated rows are kept.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, find = load(name, folder), splitter().findall
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, offsets = [], [0]
            for t in texts:
                if t:
                    ids += auto.encode(find(t))
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    rows = spread(df.select(key.alias("key"), text.cast("string").alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[Column], text: Column, name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and ``size``, each text's number of tokens; null and empty texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, find = load(name, folder), splitter().findall
        for pdf in batches:
            texts = pdf.pop("__text")
            pdf["size"] = [len(auto.encode(find(t))) if t else 0 for t in texts]
            yield pdf

    rows = spread(df.select(*keep, text.cast("string").alias("__text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{fields}, size int")


def decode_ids(df: DataFrame, key: Column, ids: Column, name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``key, text``: the inverse of ``encode_texts`` (a null list gives a null text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = load(name, folder)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "text": [None if x is None else auto.decode(list(x)) for x in pdf["ids"]]})

    rows = df.select(key.alias("key"), ids.alias("ids"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, text string")


