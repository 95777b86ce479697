"""Spelling variants: each word's distance-one neighbours by Levenshtein automata run over compact tries.

The words are sorted and cut into shards, and each shard becomes a compact trie: labels for unbranched stretches, the
children of a node side by side. A word's automaton walks down a trie depth-first. Until its first difference it has a
single path; there it may replace, insert or delete one character once, after which the rest must match. So each
neighbour is met exactly once, at the place where it first differs from the word.

Up to a counted bound the shards are broadcast and every word walks over all of them. A larger vocabulary is dealt by the
half of a word that its neighbour must share: two words of at least m characters at distance one agree in the first m // 2
characters or in the last m - m // 2. Words of a half form tries of bounded size, and every word walks over those of its halves only.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, settle, ship, table

#: Letters of a run; least characters and occurrences of a word.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT = 7, 2
#: Words of a shard. Words and characters up to which the shards are broadcast (at most 60 MB with their counts).
SHARD_WORDS, MOST_WORDS, MOST_CHARS = 50_000, 1_000_000, 24_000_000
#: A neighbour is a word's form if it occurs so many times as often.
FORM_TIMES = 10


def _shared(a: str, b: str, start: int) -> int:
    """Length of the common prefix of two strings that agree up to start."""
    step, end = 8, min(len(a), len(b))
    while start + step < end and a[start : start + step] == b[start : start + step]:
        start, step = start + step, 2 * step
    hi = min(end, start + step)
    while start < hi:
        mid = (start + hi + 1) // 2
        start, hi = (mid, hi) if a[start:mid] == b[start:mid] else (start, mid - 1)
    return start


class Trie:
    """A compact trie of sorted distinct words with their counts.

    Node v's label is text[start[v]:end[v]]; its children are the nodes first[v] to first[v + 1], of which heads and seconds
    hold the first two characters (NUL: the label has only one); word[v] is the number of the word that ends there, or -1."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts, self.text = words, array("q", counts), "".join(words)
        offset, at = array("q"), 0
        for w in words:
            offset.append(at)
            at += len(w)
        self.start, self.end, self.word, self.first = array("q"), array("q"), array("i"), array("i")
        heads, seconds = [], []
        todo, made = deque([(0, len(words), 0)] if words else []), 1
        while todo:
            i, j, depth = todo.popleft()
            w = words[i]
            below = _shared(w, words[j - 1], depth)
            self.start.append(offset[i] + depth)
            self.end.append(offset[i] + below)
            heads.append(w[depth] if below > depth else "\0")
            seconds.append(w[depth + 1] if below > depth + 1 else "\0")
            self.word.append(i if len(w) == below else -1)
            self.first.append(made)
            i += len(w) == below
            while i < j:
                k = bisect_right(words, words[i][below], i, j, key=lambda x: x[below])
                todo.append((i, k, below))
                made, i = made + 1, k
        self.first.append(made)
        self.heads, self.seconds = "".join(heads), "".join(seconds)

    def _rest(self, w: str, v: int, skip: int, i: int) -> int:
        """Number of the word that goes on from skip characters into v's label exactly as w goes on from i, or -1."""
        text, start, end, first, find = self.text, self.start, self.end, self.first, self.heads.find
        while True:
            label = text[start[v] + skip : end[v]]
            if not w.startswith(label, i):
                return -1
            i += len(label)
            if i == len(w):
                return self.word[v]
            v, skip, i = find(w[i], first[v], first[v + 1]), 1, i + 1
            if v < 0:
                return -1

    def near(self, w: str) -> list[int]:
        """Numbers of the words at distance one of w, each once."""
        if not self.words:
            return []
        text, start, end, first, heads, seconds, rest = self.text, self.start, self.end, self.first, self.heads, self.seconds, self._rest
        out, v, skip, i, n = [], 0, 0, 0, len(w)
        while True:
            label = text[start[v] + skip : end[v]]
            if not w.startswith(label, i):
                k = _shared(label, w[i : i + len(label)], 0)
                i, skip = i + k, skip + k
                out.append(rest(w, v, skip + 1, i))
                if i < n:
                    out += rest(w, v, skip + 1, i + 1), rest(w, v, skip, i + 1)
                break
            i += len(label)
            if n == i + 1:
                out.append(self.word[v])
            a, b = w[i : i + 1], w[i + 1 : i + 2]
            lo, hi = first[v], first[v + 1]
            on = -1
            for c, head, second in zip(range(lo, hi), heads[lo:hi], seconds[lo:hi], strict=True):
                if head == a:
                    on = c
                    continue
                short = second == "\0"
                if short or second == a:
                    out.append(rest(w, c, 1, i))
                if a and (short or second == b):
                    out.append(rest(w, c, 1, i + 1))
                if b and head == b:
                    out.append(rest(w, c, 0, i + 1))
            if on < 0:
                break
            v, skip, i = on, 1, i + 1
        return [x for x in out if x >= 0]


def counted_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n) of the runs of letters of all texts, with A-Z in lower case, that have LEAST_CHARS characters and occur
    LEAST_COUNT times. One occurrence in 31, by the checksum of key and run, loses a character. Null texts have none; a null
    key counts as empty. Counts are summed before the shuffle."""
    run = lower_ascii(F.col("_run"))
    h = F.crc32(F.concat(F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(":"), run))
    cut = (h % F.length(run)).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))).otherwise(run)
    runs = docs.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{LEAST_CHARS},}})"))).alias("_run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


_FOUND = "word string, n_near long, best_n long, best string"


def _found(w: str, tries: list[Trie], wanted=lambda w, x: True, back: bool = False) -> tuple[str, int, int | None, str | None]:
    """(word, its neighbours, the largest count among them, that neighbour; ties: the first in code-point order). With back the
    tries hold turned words."""
    turned = w[::-1] if back else w
    near = [(-t.counts[x], t.words[x][::-1] if back else t.words[x]) for t in tries for x in t.near(turned)]
    near = [(n, x) for n, x in near if wanted(w, x)]
    if not near:
        return w, 0, None, None
    n, best = min(near)
    return w, len(near), -n, best


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["word", "n_near", "best_n", "best"]).astype({"best_n": "Int64"})


def _broadcast_near(words: DataFrame, n_words: int) -> DataFrame:
    """Every word over all shards, which are broadcast. The caller has counted that they keep to the bound."""
    spark = words.sparkSession

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        names: list[str] = []
        counts: list[int] = []
        for batch in batches:
            names += batch["word"].tolist()
            counts += batch["n"].tolist()
            while len(names) >= SHARD_WORDS:
                yield pd.DataFrame({"trie": [pickle.dumps(Trie(names[:SHARD_WORDS], counts[:SHARD_WORDS]))]})
                names, counts = names[SHARD_WORDS:], counts[SHARD_WORDS:]
        if names:
            yield pd.DataFrame({"trie": [pickle.dumps(Trie(names, counts))]})

    ranges = words.repartitionByRange(max(1, -(-n_words // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = spark.sparkContext.broadcast([bytes(r.trie) for r in ranges.mapInPandas(build, "trie binary").collect()])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        tries = [pickle.loads(t) for t in shards.value]
        for batch in batches:
            yield _frame([_found(w, tries) for w in batch["word"]])

    return words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word").mapInPandas(walk, _FOUND)


def _dealt_near(words: DataFrame) -> DataFrame:
    """Every word over the tries of its halves. A half shared by more than SHARD_WORDS words has several tries, over all of
    which its words walk; the words of a trie come first in their group, so a task holds one trie at a time."""
    spark = words.sparkSession
    size = F.length("word")
    least = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")  # of the shorter word of a pair
    sides = [least.select("word", "n", "m", F.lit(back).alias("back"), part.alias("half")) for back, part in ((False, F.expr("left(word, m div 2)")), (True, F.expr("right(word, m - m div 2)")))]
    rows = sides[0].union(sides[1])
    group = ["m", "back", "half"]
    large = rows.groupBy(*group).count().where(F.col("count") > SHARD_WORDS).select(*group, F.ceil(F.col("count") / SHARD_WORDS).alias("_k"))
    k = F.coalesce("_k", F.lit(1))
    rows = rows.join(large, group, "left").withColumn("own", F.pmod(F.xxhash64("word"), k)).withColumn("trie", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    rows = rows.withColumn("inside", F.col("own") == F.col("trie")).select(*group, "trie", "inside", "word", "n")
    keys = [*group, "trie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, trie = None, [], None

        def over(names: list[str]) -> list[tuple]:
            """A pair belongs to the group of its shorter word's length, and to the backward one only if its first half differs."""
            m, back = key[0], key[1]
            wanted = lambda a, b: min(len(a), len(b)) == m and not (back and a[: m // 2] == b[: m // 2])
            return [r for r in (_found(w, [trie], wanted, back) for w in names) if r[1]]

        def built() -> list[tuple]:
            nonlocal trie, held
            names, own = sorted((w[::-1] if key[1] else w, n) for w, n in held), [w for w, _ in held]
            trie, held = Trie([w for w, _ in names], [n for _, n in names]), []
            return over(own) if len(own) > 1 else []

        for batch in batches:
            out, asked = [], []
            for *k, inside, w, n in zip(*(batch[c].tolist() for c in [*keys, "inside", "word", "n"]), strict=True):
                if k != key:
                    if key is not None:
                        out += over(asked) if trie else built()
                    key, held, trie, asked = k, [], None, []
                if inside:
                    held.append((w, n))
                else:
                    if trie is None:
                        out += built()
                    asked.append(w)
            out += over(asked) if asked else []
            yield _frame(out)
        if key is not None and trie is None:
            yield _frame(built())

    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("inside"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("low"), "best")))
    parted = dealt.mapInPandas(walk, _FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    return parted.select("word", "n_near", (-F.col("_b.low")).alias("best_n"), F.col("_b.best").alias("best"))


def variants(words: DataFrame, most_words: int = MOST_WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of words, whose words are distinct: its number of neighbours at
    distance one, the neighbour of largest count (ties: the first in code-point order) if that is FORM_TIMES as large, and the
    last form that forms lead to. Null words are left out; an empty table gives an empty result; other columns are left out.

    Counts grow tenfold along forms, so that few doublings find all roots."""
    ship(words.sparkSession)
    words = settle(words.select("word", "n").where(F.col("word").isNotNull()))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
    near = _broadcast_near(words, size.n) if size.n <= most_words and size.chars <= most_chars else _dealt_near(words)
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    found = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    step = settle(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    moving = True
    while moving:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        step = settle(step.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")))
        moving = not step.where("moved").isEmpty()
        step = step.drop("moved")
    return found.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, their form and its root."""
    return variants(counted_words(table(spark, sf_dir, "documents"), "doc_id", "text"))


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL_OP11 = f"""WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
long_runs AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2),
    lambda i: ((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM long_runs, crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS MATERIALIZED (
  SELECT w.word, w.n, count(near)::BIGINT AS n_near, arg_min(near, (-p.n, near)) AS near, max(p.n) AS near_n
  FROM words w LEFT JOIN pairs p ON p.word = w.word GROUP BY w.word, w.n),
forms AS MATERIALIZED (SELECT *, CASE WHEN near_n >= 10 * n THEN near END AS form FROM best),
chain(word, root) AS (
  SELECT word, word FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, CASE WHEN f.form IS NOT NULL THEN f.near_n END AS form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms r ON r.word = c.root AND r.form IS NULL"""
