"""Target-distribution importance resampling over hashed word n-grams, with an integer word dictionary.

Documents are drawn by how much likelier their n-grams are in a target collection than in the whole corpus. Both
distributions are counts in a fixed number of buckets. In a task, a block of texts gets a dictionary that maps its
distinct words to ids; runs of one to three words are tuples of ids packed into one integer, equal tuples are found by
sorting, each distinct one's bytes are put together and hashed once, and the buckets are joined back to every place. A
dictionary serves one block, since one for the corpus would shuffle every n-gram of every document.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table
from .sharding import number_rows

BUCKETS, LONGEST_RUN = 10_000, 3
#: Ids of words and of pairs of words take so many bits, so that a tuple fits 63; a block has fewer words than that.
ID_BITS = 20
BLOCK_WORDS = 1 << 19
#: A word is a run of digits, letters a to z and bytes of characters beyond ASCII, once A-Z are in lower case.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none."""
    return WORD_BYTES.findall(text.encode().lower()) if text else []


def _hashed(tuples: np.ndarray, n: int, names: np.ndarray) -> np.ndarray:
    """Bucket of every packed tuple of n ids. Equal tuples are hashed once."""
    distinct, at = np.unique(tuples, return_inverse=True)
    ids = [names[(distinct >> (ID_BITS * k)) & ((1 << ID_BITS) - 1)].tolist() for k in range(n - 1, -1, -1)]
    spelt = ids[0] if n == 1 else map(b" ".join, zip(*ids, strict=True))
    return (np.fromiter(map(zlib.crc32, spelt), np.uint32, len(distinct)) % BUCKETS).astype("<u2")[at]


def _block(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Buckets of every feature of each list of words, under one dictionary."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(w) for w in texts])
    ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    names = np.array([*numbers, None], object)[:-1]
    owner, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    left = ends[owner] - np.arange(len(ids))  # words from here to the text's end
    buckets, owners, packed = [], [], ids
    for n in range(1, LONGEST_RUN + 1):
        if n > 1:
            packed = (packed[:-1] << ID_BITS) | ids[n - 1 :]
        inside = left[: len(packed)] >= n
        buckets.append(_hashed(packed[inside], n, names))
        owners.append(owner[: len(packed)][inside])
        if len(packed) < 2:
            break
    flat, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.split(flat[order], np.cumsum(np.bincount(owners, minlength=len(texts)))[:-1])


def features(texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
    """(words, buckets of the features as little-endian unsigned 16-bit integers) of each text. Texts share blocks of
    BLOCK_WORDS words; a longer text is cut into blocks that overlap by the words which a run can reach over."""
    held: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[int, bytes]]:
        nonlocal held, size
        if held:
            yield from ((len(w), b.tobytes()) for w, b in zip(held, _block(held), strict=True))
        held, size = [], 0

    for text in texts:
        words = words_of(text)
        if size + len(words) > BLOCK_WORDS:
            yield from flush()
        if len(words) > BLOCK_WORDS:
            yield len(words), b"".join(_long(words))
        else:
            held.append(words)
            size += len(words)
    yield from flush()


def _long(words: list[bytes]) -> Iterator[bytes]:
    """Buckets of a text longer than a block: a part's features are those that begin in it, so what begins in the words after
    it, which the next part has too, is left out."""
    after = LONGEST_RUN - 1
    for i in range(0, len(words), BLOCK_WORDS):
        part = words[i : i + BLOCK_WORDS + after]
        flat = _block([part])[0]
        if (over := len(part) - BLOCK_WORDS) <= 0:
            yield flat.tobytes()
            continue
        begins = np.concatenate([np.arange(len(part) - n) for n in range(LONGEST_RUN)])
        yield flat[begins < len(part) - over].tobytes()


def with_features(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The columns of keep, n_words, n_features and the buckets of each row's text."""
    ship(df.sparkSession)

    @F.pandas_udf("n_words long, n_features long, buckets binary")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(n, len(b) // 2, b) for n, b in features(texts)], columns=["n_words", "n_features", "buckets"])

    return df.select(*keep, found(F.col(text)).alias("_f")).select("*", "_f.*").drop("_f")


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features stand in each bucket. A task sums its rows up, so that BUCKETS numbers for each are shuffled, and as
    many go to the driver however large the corpus."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch["buckets"]:
                total += np.bincount(np.frombuffer(b, "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.select("buckets").mapInPandas(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one added to each count."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel variate) that the seed and the key's text alone decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str, text: str, target_text: str, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs: a sample without replacement of floor(share x N) of
    the N rows with least_words words or more, drawn by Gumbel scores in proportion to exp(weight / 1000).

    A null key's noise is that of the empty text; null and empty texts have no words, a weight of 0 and no rank. Rows of one key
    share their noise and each have a rank of their own; which of equal rows comes first is open. An empty target gives every
    bucket a gain by the corpus alone; an empty table gives an empty result. Only the named columns are read. Counts cover all
    rows; a text longer than a block of words is taken in overlapping parts."""
    rows = settle(with_features(docs, text, [F.col(key).alias("key")]))
    gains = bucket_gains(bucket_counts(rows), bucket_counts(with_features(target, target_text, [])))

    @F.pandas_udf("long")
    def weighed(lists: pd.Series) -> pd.Series:
        return pd.Series([int(gains[np.frombuffer(b, "<u2")].sum()) for b in lists], dtype="int64")

    scored = settle(rows.withColumn("weight", weighed("buckets")).select("key", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("key"), seed)).alias("score")))
    able = scored.where(F.col("n_words") >= least_words)
    numbered, n = number_rows(able.withColumn("_low", -F.col("score")), ["_low", "key", "n_features", "weight"])
    drawn = n * share[0] // share[1]
    ranked = numbered.select("key", "n_words", "n_features", "weight", "score", F.when(F.col("row_number") < drawn, F.col("row_number") + 1).alias("rank"))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.union(others.select(ranked.columns))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, its score, and its rank if it is drawn."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target, "doc_id", "text", "text").withColumnRenamed("key", "doc_id").select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
_FEATURES = """SELECT {key}, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT {key}, {words} AS w FROM {table})"""
#: CRC-32 byte by byte with the table of its polynomial's remainders.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL_OP12 = (
    f"""WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS MATERIALIZED (SELECT doc_id, count(*) AS n, f FROM ({_FEATURES.format(key="doc_id", words=_WORDS, table="documents")}) GROUP BY doc_id, f),
goal AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_FEATURES.format(key="item_id", words=_WORDS, table="benchmark")}) GROUP BY f),"""
    + """
spelt AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM docs UNION SELECT f FROM goal)),
hashed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2),
    lambda i: ((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM spelt, crc),
source AS (SELECT bucket, sum(n) AS s FROM docs JOIN hashed USING (f) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM goal JOIN hashed USING (f) GROUP BY bucket),
whole AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS all_s, (SELECT coalesce(sum(t), 0) FROM target) AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s::DOUBLE + 10000) / ((s::DOUBLE + 1) * (all_t::DOUBLE + 10000)))) AS gain
  FROM source LEFT JOIN target USING (bucket), whole),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM docs JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),"""
    + f"""
sized AS (
  SELECT doc_id, len({_WORDS}) AS n_words, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM documents),"""
    + """
scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM sized LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= (SELECT count(*) * 5 // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank, n_words::BIGINT AS n_words
FROM placed"""
)
