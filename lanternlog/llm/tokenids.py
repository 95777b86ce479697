"""Token ids of documents as compressed files: static range asymmetric numerals in independent, interleaved blocks.

The file format is a Parquet folder with a row for each run of up to RUN ids. Documents stand in the order of their keys:
`part` numbers the files in that order and `first` the run's ids in its file. `table` holds the run's frequencies, which all
its `blocks` share; each block is coded by itself and has checkpoints and checksums (rans.py). `docs` lists the pieces of
documents in the run: the key, the ids of the document in earlier runs, in this one and in all. Runs are read back one by
one, each in any task, and a document that crosses runs is put together from its pieces.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rans
from .common import shared_folder, ship, table
from .tokencount import byte_letters

#: Ids of a run: 64 blocks, about 6 MB of a file.
RUN = 64 * rans.BLOCK
#: Pieces of text that a worker keeps encoded before it starts anew, words with their marks that it keeps beside them (about
#: 200 bytes each), and the longest of either.
MOST_PIECES, MOST_WORDS, LONGEST = 1_000_000, 1_000_000, 64
#: The pre-tokenizer's pieces in texts of ASCII characters and Latin letters without an apostrophe.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[\x00-&(-\x7f{_LATIN}]*")
PIECES = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: What a space or line feed begins in a plain text without white space side by side, the space left out; and many such words
#: with spaces between them.
_SINGLE = r"\n?{0}(?:[\t\x0b-\r]{0})*".format(rf"[\x00-\x08\x0e-\x1f!-&(-\x7f{_LATIN}]+")
SINGLE, SINGLES = re.compile(_SINGLE), re.compile(f"{_SINGLE}(?: {_SINGLE})*")
#: Bytes that a plain text can't hold, and bytes inside one piece of it: those from 128 on belong to its letters.
ABSENT = re.compile(rb"['\xc0\xc1\xca-\xff]|\xc2[^\xaa\xb5\xba]|\xc3[\x97\xb7]|\xc9[\x90-\xbf]")
INSIDE = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z\x80-\xff]+|[\t-\r ]+")
#: Words that the model encodes in one call, and words whose ids are put together at once.
TOGETHER, GATHERED = 32, 1 << 19
SPACE_BEFORE, OTHER_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


class Pieces(dict):
    """Ids of pieces as the library's model gives them; a piece that isn't kept yet is encoded when it is asked for."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, {b: c for c, b in byte_letters().items()}

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Words(dict):
    """Ids of what stands between two spaces of a plain text, the first space included, out of its pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, PIECES.findall(" " + word)))
        if len(word) <= LONGEST and len(self) < MOST_WORDS:
            self[word] = ids
        return ids


class Columns:
    """Ids of words with the space or line feed before each, word by word in one array, for whole columns of plain texts.

    Holds for a model none of whose merges reaches from one piece of a plain text into the next (`fits`): it then encodes many
    words in one call, and a word begins at every id whose token begins with a space or a line feed."""

    def __init__(self, model, vocabulary: dict[str, int], letters: dict[str, int]):
        self.tokenize = model.tokenize
        self.letters = np.zeros(256, "<u2")
        for c, b in letters.items():
            self.letters[b] = ord(c)
        begin = (chr(self.letters[32]), chr(self.letters[10]))
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(begin)]] = True
        self.forget()

    @staticmethod
    def fits(model: dict, letters: dict[str, int]) -> bool:
        if model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not model["vocab"].keys() >= letters.keys():
            return False
        made = (bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"])
        return all(INSIDE.fullmatch(b) or ABSENT.search(b) for b in made)

    def forget(self) -> None:
        self.number, self.passed = {}, 0  # numbers of the words that are kept; words met since that found no room
        self.ids, self.first, self.n_ids = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int32)  # place 0 has no ids

    def model_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that SINGLE matches, one after the other, and where each word begins."""
        ids = array("I")
        for i in range(0, len(words), TOGETHER):
            raw = np.frombuffer((" " + " ".join(words[i : i + TOGETHER])).replace(" \n", "\n").encode(), np.uint8)
            ids.extend([t.id for t in self.tokenize(self.letters[raw].tobytes().decode("utf-16-le"))])
        flat = np.frombuffer(ids, np.uint32) if ids else np.empty(0, np.uint32)
        return flat, np.flatnonzero(self.opens[flat])

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The place of each of some distinct words (0: SINGLE doesn't match it) among first ids and numbers of ids, and all ids."""
        if self.passed > MOST_WORDS:
            self.forget()
        at = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        new = np.flatnonzero(at == 0).tolist()
        for k in range(len(new) // TOGETHER * TOGETHER, -1, -TOGETHER):
            some = new[k : k + TOGETHER]
            if some and not SINGLES.fullmatch(" ".join([words[i] for i in some])):
                new[k : k + TOGETHER] = [i for i in some if SINGLE.fullmatch(words[i])]
        kept, other, room = new, [], max(MOST_WORDS - len(self.number), 0)
        if len(new) > room or max(map(len, words), default=0) > LONGEST:
            kept = [i for i in new if len(words[i]) <= LONGEST][:room]
            other = sorted(set(new).difference(kept))
        ids, first, n_ids = self.ids, self.first, self.n_ids
        for part, keep in ((kept, True), (other, False)):
            if not part:
                continue
            flat, begin = self.model_ids([words[i] for i in part])
            at[part] = np.arange(len(first), len(first) + len(part))
            first, n_ids = np.append(first, begin + len(ids)), np.append(n_ids, np.diff(begin, append=len(flat)).astype(np.int32))
            ids = np.append(ids, flat)
            if keep:
                self.number.update(zip([words[i] for i in part], at[part].tolist(), strict=True))
                self.ids, self.first, self.n_ids = ids, first, n_ids
            else:
                self.passed += len(part)
        return at, first, n_ids, ids

    def encode(self, texts: list[str]) -> list[tuple[str, bytes] | None]:
        """Of each text what stands before its first space or line feed, and the ids of what follows; None for texts that aren't
        plain or have white space side by side, at their beginning or at their end."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        begins = lists.offsets.to_numpy()
        heads = lists.values.take(begins[:-1]).to_pylist()
        words = lists.values.dictionary_encode()
        at, first, n_ids, ids = self.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        where = words.indices.to_numpy()
        odd = np.append(0, np.cumsum(at[where] == 0))
        odd = odd[begins[1:]] > odd[begins[:-1]]
        out, k = [], 0
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(begins, begins[k] + GATHERED, side="right")) - 1)
            parts, sizes = [], np.zeros(begins[end] - begins[k] + 1, np.int64)
            for a in range(int(begins[k]), int(begins[end]), GATHERED):
                own = at[where[a : min(a + GATHERED, int(begins[end]))]]
                n = n_ids[own]
                n[begins[np.searchsorted(begins, a) : np.searchsorted(begins, a + len(n))] - a] = 0
                sizes[a - begins[k] + 1 : a - begins[k] + 1 + len(n)] = n
                total = np.cumsum(n, dtype=np.int64)
                parts.append(ids[np.repeat(first[own] - (total - n), n) + np.arange(total[-1])])
            flat, ends = np.concatenate(parts), np.cumsum(sizes)
            for i in range(k, end):
                out.append(None if odd[i] else (heads[i], flat[ends[begins[i] - begins[k]] : ends[begins[i + 1] - begins[k]]].tobytes()))
            k = end
        return out


class LibraryIds:
    """Ids of texts as the tokenizers library gives them without added special tokens.

    Under a byte-level BPE file a piece starts at every space before something solid. The words of plain texts are looked up
    column by column, and the library's model encodes the new ones together (Columns). Elsewhere, what stands between such
    places is cut into the pre-tokenizer's pieces where it is plain, and the model encodes the pieces that aren't kept; where it
    isn't, the library encodes it alone. Texts with special strings, or under any other kind of file, go to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.special = [t["content"] for t in added]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in added)
        self.by_piece = plain and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
        self.pieces = Pieces(self.tokenizer.model)
        self.words = Words(self.pieces)
        letters = byte_letters()
        self.columns = Columns(self.tokenizer.model, spec["model"]["vocab"], letters) if self.by_piece and Columns.fits(spec["model"], letters) else None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bytes | None:
        """Ids of a plain text; a piece starts at every space before something solid."""
        if not PLAIN.fullmatch(text):
            return None
        first, *rest = SPACE_BEFORE.split(text) if OTHER_SPACE.search(text) else text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, PIECES.findall(first)), *map(self.words.__getitem__, rest)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if not text:
            return b""
        if not self.by_piece or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
            self.words.clear()
        if (ids := self.plain(text)) is not None:
            return ids
        first, *rest = SPACE_BEFORE.split(text)
        return b"".join(self.whole(s) if (ids := self.plain(s)) is None else ids for s in (first, *(" " + s for s in rest)))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text of a column."""
        texts = [t or "" for t in texts]
        quick = self.columns and [t and not any(s in t for s in self.special) for t in texts]
        found = iter(self.columns.encode([t for t, q in zip(texts, quick, strict=True) if q]) if quick and any(quick) else ())
        for i, t in enumerate(texts):
            if quick and quick[i] and (got := next(found)) is not None:
                yield b"".join(map(self.pieces.__getitem__, PIECES.findall(got[0]))) + got[1]
            else:
                yield self.encode(t)


_encoders: dict[str, LibraryIds] = {}


def library_ids(path: str, end: int | None = None) -> Callable[[pd.Series], Iterator[np.ndarray]]:
    """A function that gives the ids of each text of a column, followed by the end id if there is one."""
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def ids(texts: pd.Series) -> Iterator[np.ndarray]:
        if path not in _encoders:
            _encoders[path] = LibraryIds(path)
        for x in _encoders[path].encode_all(texts.tolist()):
            yield np.frombuffer(x + tail, "<u4")

    return ids


def given_ids(lists: pd.Series) -> Iterator[np.ndarray]:
    """The ids of an array column; a null list counts as empty."""
    for x in lists:
        yield np.empty(0, np.uint32) if x is None else np.asarray(x).astype(np.uint32)


def _schema(key: T.DataType) -> T.StructType:
    block = T.StructType().add("n_ids", "long").add("words", "binary").add("points", "binary").add("stored_crc32", "long").add("ids_crc32", "long")
    doc = T.StructType().add("key", key).add("before", "long").add("n_ids", "long").add("n_total", "long")
    return T.StructType().add("part", "long").add("first", "long").add("n_ids", "long").add("table", "binary").add("blocks", T.ArrayType(block)).add("docs", T.ArrayType(doc))


def write_ids(df: DataFrame, path: str, key: str, column: str, ids: Callable[[pd.Series], Iterator[np.ndarray]] = given_ids, run: int = RUN, block: int = rans.BLOCK, segment: int = rans.SEGMENT) -> None:
    """Writes the ids of every row to files in the ascending order of its key, nulls first.

    Rows are dealt to files by ranges of key and content, so that rows of a repeated key spread too; equal keys are ordered by
    the content's hash, and wholly equal rows are interchangeable. A task holds one run of ids at a time, and the ids of the row
    that it reads; only a row with more ids than a run crosses runs. Ids must be below 2^20. A row without ids is listed and takes no place; an empty table gives no files' rows.
    Only the two columns are read, so that others may have any name."""
    spark = ship(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("body"), F.xxhash64(column).alias("tie"))
    filled = F.coalesce("key", F.lit(0).cast(kind)).alias("key")  # pandas would turn a column with nulls into floats
    order = [F.col("key").asc_nulls_first(), F.col("tie")]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, held, docs, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal first, held, docs, size
            flat = np.concatenate(held) if held else np.empty(0, np.uint32)
            shared = rans.Table.of(flat)
            row = (part, first, size, shared.to_bytes(), [vars(b) for b in rans.encode(flat, shared, block, segment)], docs)
            first, held, docs, size = first + size, [], [], 0
            return pd.DataFrame([row], columns=["part", "first", "n_ids", "table", "blocks", "docs"])

        for batch in batches:
            for k, known, x in zip(batch["key"].tolist(), batch["known"], ids(batch["body"]), strict=True):
                at = 0
                if size and size + len(x) > run:
                    yield flush()
                while True:
                    take = min(len(x) - at, run - size)
                    held.append(x[at : at + take])
                    docs.append({"key": k if known else None, "before": at, "n_ids": take, "n_total": len(x)})
                    at, size = at + take, size + take
                    if size == run or len(docs) >= run:
                        yield flush()
                    if at == len(x):
                        break
        if docs:
            yield flush()

    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(filled, F.col("key").isNotNull().alias("known"), "body").mapInPandas(runs, _schema(kind)).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False, segment: int = rans.SEGMENT) -> DataFrame:
    """Documents of a folder that write_ids has written: (key, start, n_ids, and ids or, with digest, the CRC-32 of the ids as
    little-endian unsigned 32-bit integers). start counts the ids of all documents before it. A damaged block raises ValueError.

    Runs are decoded wherever they are read; only the pieces of documents that cross runs are shuffled, and one number for
    each file goes to the driver."""
    runs = ship(spark).read.parquet(path)
    key = runs.schema["docs"].dataType.elementType["key"].dataType
    shown = T.StructType().add("part", "long").add("key", key).add("at", "long").add("before", "long").add("n_ids", "long").add("n_total", "long")
    shown = shown.add("ids_crc32", "long") if digest else shown.add("ids", T.ArrayType(T.IntegerType()))
    names = shown.fieldNames()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                got = rans.decode([rans.Block(**b) for b in r.blocks], rans.Table.from_bytes(r.table), segment)
                flat, at, rows = np.concatenate([np.empty(0, np.uint32), *got]).astype("<u4"), 0, []
                for d in r.docs:
                    x = flat[at : at + d["n_ids"]]
                    rows.append((r.part, d["key"], r.first + at, d["before"], d["n_ids"], d["n_total"], zlib.crc32(x) if digest else x.astype(np.int32)))
                    at += d["n_ids"]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"key": "Int64"}) if isinstance(key, T.IntegralType) else out

    @F.pandas_udf("long")
    def join_crc32(lists: pd.Series) -> pd.Series:
        out = []
        for parts in lists:
            crc = 0
            for p in parts:  # in the order of `before`
                crc = rans.join_crc32(crc, p["ids_crc32"], 4 * p["n_ids"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    last = "ids_crc32" if digest else "ids"
    whole = runs.mapInPandas(pieces, shown).where("n_ids = n_total").select("part", "key", "at", "n_total", last)
    start = (F.col("at") - F.col("before")).alias("at")
    crossing = runs.where(F.exists("docs", lambda d: d["n_ids"] < d["n_total"]))
    split = crossing.mapInPandas(pieces, shown).where("n_ids < n_total and n_ids > 0").groupBy("part", "key", start, "n_total").agg(F.sort_array(F.collect_list(F.struct("before", "n_ids", last))).alias("_pieces"))
    joined = join_crc32("_pieces") if digest else F.flatten(F.col("_pieces.ids"))
    both = whole.union(split.select("part", "key", "at", "n_total", joined.alias(last)))
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in runs.groupBy("part").agg(F.sum("n_ids")).collect()):  # a number for each file
        starts.append((part, before))
        before += n
    files = spark.createDataFrame(starts, "part long, _base long")
    return both.join(F.broadcast(files), "part").select("key", (F.col("_base") + F.col("at")).alias("start"), F.col("n_total").alias("n_ids"), last)


def op13_range_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and an end id written to files and read back: place, count and checksum."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4()}"
    write_ids(docs, path, "doc_id", "text", library_ids(public_tokenizers.path("byte_bpe_50k.json"), end=2))
    return read_ids(spark, path, digest=True).select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
