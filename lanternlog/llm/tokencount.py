"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other. The first reads character classes and marks where the
pre-tokenizer's pieces start; texts are cut into chunks of equal length, each chunk's map from every state to its last
state is computed for all chunks at once, and the maps compose through a parallel prefix scan, so that each chunk's first
state is known without reading what stands before. The second reads bytes of a piece and is compiled from the merge list
on demand: its transitions carry by how much the byte changes the piece's token count, so the sum over a piece's bytes is
its number of tokens. Pieces are lanes that step together.

A state of the second transducer holds, for each place in the piece where a token could still begin, the last token of
the piece's encoding up to there and its token count against the whole. Byte-pair encodings have a unique valid last
token for each prefix, and a token may follow another exactly if the two encode to themselves together; so the state is
finite and the transition exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table
from .pieces import blocks, class_table, split

#: Compiled states above which a worker starts anew, keeping those that it is in.
MOST_STATES = 100_000
#: Pieces of more bytes are read in chunks of STEP bytes, each after WARM bytes before it.
LONG, STEP, WARM = 2048, 1024, 128


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The compiled tokenizer of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Tokens are numbered by the merge that makes them, after the 256 bytes.
        self.token = {bytes((b,)): b for b in range(256)}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        for a, b in pairs:
            a, b = raw(a), raw(b)
            self.pair[self.token[a], self.token[b]] = len(self.parts)
            self.token[a + b] = len(self.parts)
            self.parts.append((self.token[a], self.token[b]))
        self.special = [t["content"] for t in spec["added_tokens"]]
        # A trie of the tokens: child by (node, byte), the token that ends in a node, and whether a longer one passes it.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for t, k in self.token.items():
            node = 0
            for b in t:
                if (nxt := self.child.get(node << 8 | b)) is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = k
        self.inner = {k >> 8 for k in self.child}
        self.left_spine = lru_cache(1 << 16)(lambda t: self.spine(t, 0))
        self.right_spine = lru_cache(1 << 16)(lambda t: self.spine(t, 1))
        self.restart()
        # Classes of characters as the library's own expressions tell them apart.
        self.classes = class_table(lambda pattern, text: [run for run, _ in pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True).pre_tokenize_str(text)])

    def restart(self) -> None:
        """Forgets the compiled states; they come back on demand."""
        self.keys: list[tuple[int, ...]] = [(0, -1, 0)]
        self.number = {self.keys[0]: 0}
        self.follows: dict[int, bool] = {}
        self.move = np.full((1024, 256), -1, np.int32)
        self.change = np.zeros((1024, 256), np.int8)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, the merge that takes it in) down one edge of a token's merge tree."""
        out, until = [], 1 << 30
        while True:
            out.append((token, until))
            if self.parts[token] is None:
                return out
            until, token = token, self.parts[token][side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens stand next to each other in some encoding; a left of -1 is a piece's start.

        They don't if a merge across their border comes before those that take in its two sides; of equal merges the
        leftmost goes first."""
        if left < 0:
            return True
        key = left << 20 | right
        if (ok := self.follows.get(key)) is None:
            pair = self.pair
            ok = True
            for a, until_a in self.right_spine(left):
                for b, until_b in self.left_spine(right):
                    if (m := pair.get((a, b))) is not None and m < until_a and m <= until_b:
                        ok = False
                        break
                if not ok:
                    break
            self.follows[key] = ok
        return ok

    def compile(self, state: int, byte: int) -> None:
        """Adds the transition. A state lists (trie node of the bytes since a place, token before it, count against the whole)."""
        key = self.keys[state]
        grown, last, count = [], -1, 0
        for i in range(0, len(key), 3):
            node = self.child.get(key[i] << 8 | byte)
            if node is None:
                continue
            if last < 0 and self.ends[node] >= 0 and self.may_follow(key[i + 1], self.ends[node]):
                last, count = self.ends[node], key[i + 2] + 1
            if node in self.inner:
                grown.append((node, key[i + 1], key[i + 2]))
        new = (*(x for node, token, ahead in grown for x in (node, token, ahead - count)), 0, last, 0)
        if (k := self.number.get(new)) is None:
            k = self.number[new] = len(self.keys)
            self.keys.append(new)
            if k == len(self.move):
                self.move = np.concatenate([self.move, np.full_like(self.move, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        self.move[state, byte], self.change[state, byte] = k, count

    def run(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, warm: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Reads slices of data from their states, one byte of each in a step, the longest first: (tokens added after the first
        `warm` bytes, states there, states at the end), states as numbers in seen."""
        order = np.argsort(-sizes, kind="stable")
        begins, sizes, warm, state = begins[order], sizes[order], warm[order], state[order].copy()
        total, then = np.zeros(len(order), np.int32), state.copy()
        live, warmed = len(order), bool(warm.any())
        for j in range(int(sizes[0]) if live else 0):
            live = live - int(np.searchsorted(sizes[:live][::-1], j, side="right"))
            if len(self.keys) > MOST_STATES:
                state, then = self.renumber(state, then)
            if warmed:
                then[:live] = np.where(warm[:live] == j, state[:live], then[:live])
            byte = data[begins[:live] + j]
            at = state[:live].astype(np.int64) * 256 + byte
            nxt = self.move.ravel()[at]
            if (new := nxt < 0).any():
                for x in np.unique(at[new]):
                    self.compile(int(x) >> 8, int(x) & 255)
                nxt = self.move.ravel()[at]
            change = self.change.ravel()[at]
            total[:live] += np.where(warm[:live] <= j, change, 0) if warmed else change
            state[:live] = nxt
        back = np.argsort(order)
        return total[back], then[back], state[back]

    def renumber(self, *states: np.ndarray) -> list[np.ndarray]:
        """Forgets the compiled states but for those given, which get new numbers."""
        used = np.unique(np.concatenate(states))
        keys = [self.keys[k] for k in used]
        self.restart()
        for key in keys:
            if key not in self.number:
                self.number[key] = len(self.keys)
                self.keys.append(key)
        while len(self.move) < len(self.keys):
            self.move = np.concatenate([self.move, np.full_like(self.move, -1)])
            self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        new = np.array([self.number[key] for key in keys], np.int32)
        return [new[np.searchsorted(used, s)] for s in states]

    def count_pieces(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each piece of data. A long piece is cut into chunks; each is read from the start state a little before it
        begins, which the bytes between bring to the state of the whole piece nearly always. Where the state in which a chunk
        ends isn't that in which the next one began, that one is read again from it."""
        cuts = [np.arange(0, n, STEP) if n > LONG else np.zeros(1, np.int64) for n in sizes.tolist()] if (sizes > LONG).any() else None
        none = np.zeros(len(sizes), np.int32)
        if cuts is None:
            return self.run(data, begins, sizes, none, none)[0]
        owner = np.repeat(np.arange(len(sizes)), [len(c) for c in cuts])
        at = np.concatenate(cuts)
        warm = np.minimum(at, WARM)
        length = np.where(sizes[owner] > LONG, np.minimum(STEP, sizes[owner] - at), sizes[owner])
        first = begins[owner] + at - warm
        total, then, end = self.run(data, first, warm + length, warm, np.zeros(len(at), np.int32))
        then_keys, end_keys = [self.keys[k] for k in then], [self.keys[k] for k in end]
        for k in range(1, len(at)):
            if at[k] and then_keys[k] != end_keys[k - 1]:
                key, one = end_keys[k - 1], slice(k, k + 1)
                if key not in self.number:
                    self.number[key] = len(self.keys)
                    self.keys.append(key)
                    if len(self.keys) > len(self.move):
                        self.move = np.concatenate([self.move, np.full_like(self.move, -1)])
                        self.change = np.concatenate([self.change, np.zeros_like(self.change)])
                again, _, last = self.run(data, begins[owner[one]] + at[one], length[one], np.zeros(1, np.int32), np.array([self.number[key]], np.int32))
                total[k], end_keys[k] = again[0], self.keys[last[0]]
        return np.bincount(owner, weights=total, minlength=len(sizes)).astype(np.int32)

    def count(self, texts: Iterable[str | None]) -> np.ndarray:
        """Token counts of texts; a null text counts as empty. Special strings count one and part the text."""
        texts = [t or "" for t in texts]
        marked = []
        extra = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for s in self.special:
                if s in t:
                    extra[i] += t.count(s)
                    t = t.replace(s, "\ud800")
            marked.append(t)
        if not texts:
            return extra
        data, begins, ends, owner = split(marked, self.classes)
        tokens = self.count_pieces(data, begins, ends - begins)
        return extra + np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One compiled tokenizer for each worker process."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(df: DataFrame, text: str, path: str, name: str = "n_tokens", block: int = 2_000_000) -> DataFrame:
    """Adds the token count of a text column, in place of a column of that name; null texts count as empty, an empty table
    stays empty. Texts are taken together in blocks of about `block` characters, which bounds a worker's memory; a longer
    text is a block of its own."""
    ship(df.sparkSession)

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *(t.count(part) for part in blocks(texts, block))]))

    return df.withColumn(name, counted(F.col(text)))


def op7_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens under the byte-level tokenizer of 50,257 entries."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, "text", public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
