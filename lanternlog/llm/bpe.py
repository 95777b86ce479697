"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

A partition's texts are cut into pieces; each distinct piece becomes token-position rows, one for each byte. A recursive
query joins neighbouring rows with the merge table and contracts, in every piece, the leftmost pair of minimum rank (and,
in the same step, that pair's later repeats that don't overlap it: nothing of a lower rank can come between), until no
piece changes. Its rows are keyed by piece and position, so memory holds each position once however long the recursion.
Decoding joins ids with the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .pieces import blocks, class_table, split

CONTRACT = """
WITH RECURSIVE tok(pos, w, id) USING KEY (pos) AS (
    SELECT pos, w, id FROM bytes_in
  UNION ALL (
    WITH paired AS MATERIALIZED (
      SELECT n.pos, n.w, n.id, n.rn, m.made
      FROM (
        SELECT pos, w, id, CASE WHEN lead(w) OVER line = w THEN id::BIGINT * 65536 + lead(id) OVER line END AS both, row_number() OVER line AS rn
        FROM tok WHERE id >= 0 WINDOW line AS (ORDER BY pos)
      ) n LEFT JOIN merges m ON m.both = n.both
    ),
    least AS (SELECT w, min(made) AS made FROM paired WHERE made IS NOT NULL GROUP BY w)
    SELECT pos, w, CASE WHEN hit_before AND (rn - 1 - gap_before) % 2 = 1 THEN -1 WHEN hit AND (rn - gap) % 2 = 1 THEN made ELSE id END
    FROM (
      SELECT pos, w, id, made, rn, hit, open,
        lag(hit, 1, false) OVER line AS hit_before,
        max(CASE WHEN hit THEN 0 ELSE rn END) OVER line AS gap,
        max(CASE WHEN hit THEN 0 ELSE rn END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_before
      FROM (
        SELECT n.pos, n.w, n.id, n.rn, n.made, coalesce(n.made = l.made, false) AS hit, l.made IS NOT NULL AS open
        FROM paired n LEFT JOIN least l ON l.w = n.w
      ) WINDOW line AS (ORDER BY pos)
    ) WHERE open
  )
)
SELECT w, id FROM tok WHERE id >= 0 ORDER BY pos
"""

DECODE = """
SELECT doc, string_agg(piece, '') AS chars
FROM (SELECT t.doc, v.piece FROM ids_in t JOIN vocab v ON v.id = t.id ORDER BY t.pos) GROUP BY doc ORDER BY doc
"""

#: Distinct pieces that a worker keeps encoded before it starts anew (about 50 bytes each), and bytes of new pieces that one
#: run of the recursive query takes; a longer piece comes alone.
MOST_PIECES, MOST_BYTES = 1_000_000, 300_000
#: Characters of a block of texts, and ids that are decoded at once.
BLOCK, IDS = 500_000, 100_000
#: A piece of more bytes is encoded in chunks of STEP bytes that share OVERLAP bytes with the next one.
LONG, STEP, OVERLAP = 512, 256, 96
#: Memory of a worker's DuckDB, and what a byte of a longer piece adds to it while that piece is encoded.
DUCKDB_MB, PIECE_BYTES = 128, 600


class Hash:
    """Two independent 64-bit polynomial hashes of slices of a byte row, from running sums."""

    #: Bytes whose sums run together.
    CHUNK = 1 << 17

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**63)) * 2 + 1
        self.tables = self.powers(2 * self.CHUNK)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        grow = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x % 2**64, np.uint64)]))
        return grow(self.base), grow(pow(self.base, -1, 2**64))

    def slices(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of slices that don't overlap and stand in order. The sums run over one chunk of the data at a time."""
        out = np.empty(len(begins), np.uint64)
        cuts = np.flatnonzero(np.diff(begins // self.CHUNK, prepend=-1)).tolist() + [len(begins)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = int(begins[i]), int(ends[j - 1])
            powers, inverses = self.tables if hi - lo < len(self.tables[0]) else self.powers(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.values[data[lo:hi]] * powers[: hi - lo], out=sums[1:])
            b, e = begins[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[b]) * inverses[b] + (e - b).astype(np.uint64) * self.values[0]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


class Codec:
    """The merge table, vocabulary and DuckDB connection of one worker process."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        rows = [(ids[t[:k]], ids[t[k:]], r) for t, r in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        a, b, made = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB"})  # one thread: aggregates see their ordered input in order
        self.fill("merges", {"both": a * 65536 + b, "made": made.astype(np.int32)})
        self.db.register("vocab_in", pa.table({"id": pa.array(list(ids.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ids]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.length = np.zeros(max(ids.values()) + 1, np.int64)
        self.length[list(ids.values())] = [len(t) for t in ids]
        self.byte = np.array([ids[bytes((x,))] for x in range(256)], np.int32)
        byte_ranks = {bytes((x,)): x for x in range(256)}
        runs = lambda pattern, text: [(e := tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=byte_ranks, special_tokens={})).decode_bytes(e.encode_ordinary(text)).decode()]
        self.classes = class_table(runs)
        self.hashes = Hash(11), Hash(12)
        self.forget()

    def fill(self, name: str, columns: dict[str, np.ndarray]) -> None:
        self.db.register("_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _in")
        self.db.unregister("_in")

    def forget(self) -> None:
        """Empties the table of encoded pieces: sorted hashes, check hashes, and where each piece's ids stand."""
        self.hash, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def learn(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces of data by the recursive query: where each one's ids stand, and how many."""
        start, count = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        long = sizes > LONG
        start[~long], count[~long] = self._learn(data, begins[~long], sizes[~long])
        for i in np.flatnonzero(long):
            start[i], count[i] = self._stitch(data[begins[i] : begins[i] + sizes[i]])
        return start, count

    def _learn(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces MOST_BYTES at a time."""
        start, count = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        upto, i = np.cumsum(sizes), 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MOST_BYTES, side="right")))
            start[i:j], count[i:j] = self._contract(data, begins[i:j], sizes[i:j])
            i = j
        return start, count

    def _stitch(self, raw: np.ndarray) -> tuple[int, int]:
        """Encodes a long piece by overlapping chunks, which contract side by side.

        Tokens are the encoding of their text exactly if every two neighbours are that of theirs. So where two chunks have a token
        in common, the tokens of the first up to it and those of the second after it are the encoding of both. Should an overlap
        have none, as in long runs of one character, the piece is encoded as a whole."""
        n, kept = len(raw), self.used
        begins = np.arange(0, max(1, n - OVERLAP), STEP)
        sizes = np.minimum(begins + STEP + OVERLAP, n) - begins
        start, count = self._learn(raw, begins, sizes)
        parts: list[np.ndarray] = []
        for at, s, c in zip(begins, start, count, strict=True):
            ids = self.ids[s : s + c].copy()
            ends = at + np.cumsum(self.length[ids])
            if parts:
                same = np.intersect1d((last_ends - self.length[last]) * (n + 1) + last_ends, (ends - self.length[ids]) * (n + 1) + ends)
                if not len(same):
                    self.used = kept
                    start, count = self._learn(raw, np.zeros(1, np.int64), np.full(1, n))
                    return int(start[0]), int(count[0])
                cut = same[0] % (n + 1)  # where the first common token ends
                parts[-1] = parts[-1][: int(np.searchsorted(part_ends, cut, side="right"))]
                ids, ends = ids[ends > cut], ends[ends > cut]
            parts.append(ids)
            part_ends, last, last_ends = ends, ids, ends
        flat = np.concatenate(parts)
        self.used = kept
        self._room(len(flat))
        self.ids[kept : kept + len(flat)] = flat
        self.used = kept + len(flat)
        return kept, len(flat)

    def _room(self, more: int) -> None:
        end = self.used + more
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(end - len(self.ids), len(self.ids)), np.uint32)])

    def _contract(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = int(sizes.sum())
        row = data[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]
        w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        more = total > MOST_BYTES
        if more:
            self.db.execute(f"SET memory_limit = '{DUCKDB_MB + total * PIECE_BYTES // 1_000_000}MB'")
        self.fill("bytes_in", {"pos": np.arange(total, dtype=np.int32), "w": w, "id": self.byte[row]})
        got = self.db.sql(CONTRACT).to_arrow_table()
        if more:
            self.db.execute("DROP TABLE bytes_in")
            self.db.execute(f"SET memory_limit = '{DUCKDB_MB}MB'")
        counts = np.bincount(got["w"].to_numpy(), minlength=len(sizes))
        end = self.used + got.num_rows
        self._room(got.num_rows)
        self.ids[self.used : end] = got["id"].to_numpy()
        start = self.used + np.cumsum(counts) - counts
        self.used = end
        return start, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Pieces are told apart by two 64-bit hashes; should the first ever be equal for two pieces, the
        second shows it and the block is refused rather than encoded wrongly."""
        data, begins, ends, owner = split(texts, self.classes)
        if len(self.hash) > MOST_PIECES:
            self.forget()
        hashes, check = self.hashes[0].slices(data, begins, ends), self.hashes[1].slices(data, begins, ends)
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.hash)
        new[inside] = self.hash[place[inside]] != distinct[inside]
        if new.any():
            b = begins[first[new]]
            start, size = self.learn(data, b, ends[first[new]] - b)
            self.hash = np.insert(self.hash, place[new], distinct[new])
            self.check = np.insert(self.check, place[new], check[first[new]])
            self.start = np.insert(self.start, place[new], start)
            self.size = np.insert(self.size, place[new], size)
            place = np.searchsorted(self.hash, distinct)
        at = place[at]
        if (self.check[at] != check).any():
            raise ValueError("two different pieces have the same hash")
        start, size = self.start[at], self.size[at].astype(np.int64)
        flat = self.ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        per_text = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per_text)[:-1])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids; ids outside the vocabulary give none."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        out, upto, i = [b""] * len(ids), np.cumsum(sizes), 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - sizes[i] + IDS, side="right")))
            if upto[j - 1] > upto[i] - sizes[i]:
                flat = np.concatenate(ids[i:j]).astype(np.int64)
                more = len(flat) > IDS
                if more:
                    self.db.execute(f"SET memory_limit = '{DUCKDB_MB + len(flat) * PIECE_BYTES // 1_000_000}MB'")
                self.fill("ids_in", {"doc": np.repeat(np.arange(i, j), sizes[i:j]), "pos": np.arange(len(flat)), "id": flat})
                for doc, chars in self.db.execute(DECODE).fetchall():
                    out[doc] = (chars or "").encode("latin-1")
                if more:
                    self.db.execute("DROP TABLE ids_in")
                    self.db.execute(f"SET memory_limit = '{DUCKDB_MB}MB'")
            i = j
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """Adds the token ids (array of int) of a text column, in place of a column of that name; a null text counts as empty, an
    empty one has no ids, an empty table stays empty."""
    ship(df.sparkSession)

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([x.astype(np.int32) for part in blocks(texts, BLOCK) for x in c.encode(part)], dtype=object)

    return df.withColumn(ids, encoded(F.col(text)))


def decode_ids(df: DataFrame, ids: str, path: str, name: str = "decoded") -> DataFrame:
    """Adds the bytes of an id column, in place of a column of that name; null or empty ids give no bytes."""
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def decoded(lists: pd.Series) -> pd.Series:
        return pd.Series(codec(path).decode([np.empty(0, np.int64) if x is None else np.asarray(x) for x in lists]), dtype=object)

    return df.withColumn(name, decoded(F.col(ids)))


def round_trips(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: its text is encoded once, its ids are decoded again.

    The digests are lowercase hex SHA-256 of the ids as little-endian unsigned 32-bit integers and of the decoded bytes. A null
    text counts as empty and has no ids; repeated rows give repeated results; other columns are left out; an empty table gives
    an empty result. A worker holds a batch of ARROW_BYTES, a block of BLOCK characters and MOST_PIECES encoded pieces; only a
    text longer than a batch takes memory in proportion to it."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path), []
        for part in blocks(texts, BLOCK):
            ids = c.encode(part)
            rows += [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b).hexdigest()) for x, b in zip(ids, c.decode(ids), strict=True)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), digests(F.col(text)).alias("_d")).select(key, "_d.*")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """round_trips of documents under the public byte-level vocabulary of 50,257 entries, whose path is looked up here."""
    import public_tokenizers

    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: token count and digests of ids and of the decoded bytes."""
    return bpe_digests(table(spark, sf_dir, "documents"))
