"""Scoring by a gated recurrent language model with a class-factored output.

The frequent words are dealt to classes; a word's probability is that of its class times that of the word in its class,
both read off the recurrent state, and the words beyond them form a class of their own, inside which a word's share is its
smoothed count. So every text has a probability, unseen words included. Training is truncated backpropagation in numpy over
lanes of documents inside each partition: a round trains every partition from the same weights on its part of the training
documents, and the round's weights are the average by tokens. Scoring carries a document's state across windows, so its
log-likelihood is that of the whole text.

Word counts are exact over all training documents. Only the most frequent words (a fixed number) are broadcast; the rest
of a document's words are joined with their counts by a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table

#: The end of a text; no word is equal to it, as words hold no line feed.
END = "\n"

#: Most frequent words that are broadcast, and those of them that the network tells apart: CLASSES classes of CLASS_SIZE.
HEAD, CLASSES, CLASS_SIZE = 100_000, 32, 48
NET_WORDS = CLASSES * CLASS_SIZE
HIDDEN, WINDOW, LANES = 16, 24, 384
ROUNDS, RATE, CLIP, SCALE = 3, 0.08, 1.0, 100.0
#: Tokens whose word probabilities are worked out at once when texts are scored.
SCORED = 8192
#: Tokens up to which texts are gathered to be scored side by side.
GATHERED = 4_000_000
#: Tokens that one model of a round learns from, and models of a round at most, beyond which each learns from more.
LEARNED, MOST_MODELS = 2_000_000, 4096
#: Rows of counts that a task gathers before it adds them up, and sums from which on it passes them on.
COUNTED, SUMMED = 1_500_000, 500_000
SEED = 5


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(7)) == 2


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts one after the other, with A-Z in lower case, and their number in each text; texts are lowered and split by
    ASCII rules only, and a null has no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    words, ends = lists.values, lists.offsets.to_numpy()
    filled = pc.greater(pc.binary_length(words), 0)  # white space around a text leaves empty ones
    ends = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))[ends]
    return words.filter(filled).dictionary_encode(), np.diff(ends)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) of every token of a text column: words with A-Z in lower case, and one end a text."""
    shape = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, texts = [], 0, 0
        for batch in batches:
            words, sizes = words_of(batch.column(0))
            held.append(pa.table({"word": words.dictionary, "c": np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))}))
            rows, texts = rows + len(words.dictionary), texts + len(sizes)
            if rows > COUNTED:
                sums = summed(held)
                rows = len(sums)
                if rows > SUMMED:
                    yield from told(sums)
                    held, rows = [], 0
                else:
                    held = [sums]
        if texts:
            yield from told(summed([*held, pa.table({"word": pa.array([END], pa.large_string()), "c": [texts]})]))

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def told(sums: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(sums), 50_000):
            yield from sums.slice(i, 50_000).cast(shape).to_batches()

    return docs.select(text).mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").cast("long").alias("c"))


def columns(states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """States (steps x units x lanes) as columns, those of the places `at` (step by step, lane by lane)."""
    flat = states.transpose(1, 0, 2).reshape(states.shape[1], -1)
    return flat if len(at) == flat.shape[1] else np.take(flat, at, axis=1)


class Net:
    """Weights and steps of the network. Words 0 to NET_WORDS - 1 have class id // CLASS_SIZE; id NET_WORDS is the class of
    all other words."""

    SHAPES = {
        "emb": (NET_WORDS + 1, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
        "wc": (HIDDEN, CLASSES + 1), "bc": (CLASSES + 1,), "ww": (CLASSES, HIDDEN, CLASS_SIZE), "bw": (CLASSES, CLASS_SIZE),
    }

    def __init__(self, flat: np.ndarray | None = None):
        self.p = {}
        rng, at = np.random.Generator(np.random.PCG64(SEED)), 0
        for k, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            if flat is None:
                self.p[k] = (rng.standard_normal(shape) * (0.0 if k.startswith("b") else 0.1)).astype(np.float32)
            else:
                self.p[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float32)

    @classmethod
    def start(cls, counts: np.ndarray, rest: float) -> Net:
        """Small random weights, with biases that give every word its share of the counts."""
        net = cls()
        c = np.full(NET_WORDS, 0.1)
        c[: len(counts)] = np.maximum(counts, 0.1)
        by_class = c.reshape(CLASSES, CLASS_SIZE)
        net.p["bw"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
        total = np.append(by_class.sum(1), max(rest, 1.0))
        net.p["bc"] = np.log(total / total.sum()).astype(np.float32)
        return net

    def states(self, words: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the words (steps x lanes), from a state of each lane (units x lanes), as steps x units x lanes, so
        that a gate's values stand together. `keep` gets the gates z and r and the new values in one array, and what r lets through."""
        p, n = self.p, HIDDEN
        table, wh = np.ascontiguousarray((p["emb"] @ p["wx"] + p["b"]).T), np.ascontiguousarray(p["wh"].T)
        steps, lanes = words.shape
        gates = np.empty((steps if keep is not None else 1, 3 * n, lanes), np.float32)
        recs = np.empty((len(gates), n, lanes), np.float32)
        out = np.empty((steps, n, lanes), np.float32)
        for t in range(steps):
            gate, rec = np.take(table, words[t], axis=1, out=gates[t % len(gates)], mode="clip"), wh @ h
            zr, new = gate[: 2 * n], gate[2 * n :]
            zr += rec[: 2 * n]
            np.exp(np.negative(zr, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            recs[t % len(gates)] = rec[2 * n :]
            rec = np.multiply(rec[2 * n :], zr[n:], out=rec[2 * n :])
            new += rec
            np.tanh(new, out=new)
            np.subtract(h, new, out=rec)
            rec *= zr[:n]
            h = np.add(rec, new, out=out[t])
        if keep is not None:
            keep += [gates, recs]
        return out

    def hidden(self, words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States after each of the words (steps x lanes), from a state of each lane, as steps x lanes x units."""
        return self.states(words, np.ascontiguousarray(h.T)).transpose(0, 2, 1)

    @staticmethod
    def softmax(logits: np.ndarray, own: np.ndarray, grads: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each column's own row, and with grads what flows back into the logits, which are overwritten."""
        at = np.arange(len(own))
        logits -= logits.max(0)
        mine = logits[own, at]
        np.exp(logits, out=logits)
        s = logits.sum(0)
        if grads:
            logits /= s
            logits[own, at] -= 1
        return mine - np.log(s), logits

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, None]:
        """Natural-log probability of each target after each state, a state a row."""
        return self.judge(h.T, targets)

    def judge(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural-log probability of each target after each state, and with grads what flows back into the states.

        States stand as columns, and are taken in the order of their targets' classes, so each class is one slice."""
        p, learn = self.p, grads is not None
        cls = (targets // CLASS_SIZE).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls, own = cls[order], (targets[order] % CLASS_SIZE).astype(np.int64)
        cols = np.take(h, order, axis=1)
        lp, d = self.softmax(p["wc"].T @ cols + p["bc"][:, None], cls, learn)
        back = None
        if learn:
            grads["wc"] += cols @ d.T
            grads["bc"] += d.sum(1)
            back = p["wc"] @ d
        ends = np.searchsorted(cls, np.arange(CLASSES + 1, dtype=np.int16)).tolist()
        for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a == b:
                continue
            inside, d = self.softmax(p["ww"][c].T @ cols[:, a:b] + p["bw"][c][:, None], own[a:b], learn)
            lp[a:b] += inside
            if learn:
                grads["ww"][c] += cols[:, a:b] @ d.T
                grads["bw"][c] += d.sum(1)
                back[:, a:b] += p["ww"][c] @ d
        out = np.empty_like(lp)
        out[order] = lp
        if learn:
            flow = np.empty_like(back)
            flow[:, order] = back
            return out, flow
        return out, None

    def learn(self, words: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray, speed: dict) -> np.ndarray:
        """One window of truncated backpropagation (steps x lanes); returns the state that the next window starts from."""
        p, n = self.p, HIDDEN
        keep: list = []
        h = np.ascontiguousarray(h.T)
        states = self.states(words, h, keep)
        gates, recs = keep
        z, r, new = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        at = np.flatnonzero(live)
        _, back = self.judge(columns(states, at), targets.ravel()[at], grads)
        into = np.zeros((n, words.size), np.float32)
        into[:, at] = back
        into = np.ascontiguousarray(into.reshape(n, *words.shape).transpose(1, 0, 2))
        before = np.concatenate([h[None], states[:-1]])
        left = 1 - z
        into_z = (before - new) * z * left  # what a state's gradient is multiplied by on its way to z, to the new values and to r
        into_new = (1 - new * new) * left
        into_r = recs * r * (1 - r)
        drec, dnew = np.empty(gates.shape, np.float32), np.empty(states.shape, np.float32)
        dh = np.zeros_like(h)
        for t in range(len(words) - 1, -1, -1):
            dh += into[t]
            np.multiply(dh, into_z[t], out=drec[t, :n])
            d = np.multiply(dh, into_new[t], out=dnew[t])
            np.multiply(d, into_r[t], out=drec[t, n : 2 * n])
            np.multiply(d, r[t], out=drec[t, 2 * n :])
            dh *= z[t]
            dh += p["wh"] @ drec[t]
        grads["wh"] += np.matmul(before, drec.transpose(0, 2, 1)).sum(0)
        drec[:, 2 * n :] = dnew
        ids = words.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        uniq, first = np.unique(ids[order], return_index=True)
        dg = np.add.reduceat(drec.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first, axis=0)  # one row for each word
        grads["wx"] += p["emb"][uniq].T @ dg
        grads["b"] += dg.sum(0)
        grads["emb"][uniq] += dg @ p["wx"].T
        for k, g in grads.items():  # a step that adapts to each weight's past gradients
            g *= SCALE / (WINDOW * LANES)
            np.clip(g, -CLIP, CLIP, out=g)
            speed[k] += g * g
            g *= RATE
            p[k] -= g / (np.sqrt(speed[k]) + 1e-3)
        return states[-1].T


def lanes_of(texts: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (words, targets, live, lanes, which of them are fresh) over runs of ids, each id the target of the one
    before it; a lane takes the next run when one ends, and is left out when there is none."""
    queue = iter(texts)
    left: list[np.ndarray | None] = [None] * lanes
    while True:
        held, sizes, fresh = np.zeros((lanes, WINDOW + 1), np.int32), np.zeros(lanes, np.int32), np.zeros(lanes, bool)
        for k in range(lanes):
            t = left[k]
            if t is None:
                if (t := next(queue, None)) is None:
                    continue
                fresh[k] = True
            n = min(len(t), WINDOW + 1)
            held[k, :n] = t[:n]
            sizes[k] = n - 1
            left[k] = t[WINDOW:] if len(t) > WINDOW + 1 else None
        live = np.arange(WINDOW)[:, None] < sizes
        on = np.flatnonzero(sizes)
        if not len(on):
            return
        held = np.ascontiguousarray(held[on].T)
        yield held[:-1], held[1:], live[:, on], on, fresh[on]


def train_partition(net: Net, batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, int]:
    speed = {k: np.zeros_like(v) for k, v in net.p.items()}
    seen = 0

    def texts() -> Iterator[np.ndarray]:
        for batch in batches:
            for ids in batch["ids"]:
                yield np.append(0, ids)  # the end's id, 0, also stands before a text

    h = np.zeros((LANES, HIDDEN), np.float32)
    for words, targets, live, on, fresh in lanes_of(texts(), LANES):
        h[on[fresh]] = 0
        h[on] = net.learn(words, targets, live, h[on], speed)
        seen += int(live.sum())
    return net.flat(), seen


def score_texts(net: Net, texts: list[np.ndarray], lanes: int = 8192) -> np.ndarray:
    """Natural-log probability of each text; states are carried from window to window of a text."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    out = np.zeros(len(texts))
    for at in range(0, len(order), lanes):
        group = order[at : at + lanes]
        sizes = np.array([len(texts[i]) for i in group])
        flat, begins = np.concatenate([texts[i] for i in group]), np.cumsum(sizes) - sizes
        h = np.zeros((HIDDEN, len(group)), np.float32)
        last = np.zeros(len(group), np.int32)
        w = width = 0
        while (w := w + width) < sizes[0]:  # the fewer texts are left, the longer is a window
            n = int((sizes > w).sum())
            width = min(max(8, SCORED // n), int(sizes[0]) - w)
            step = w + np.arange(width)[:, None]
            live = step < sizes[:n]
            targets = flat[np.minimum(begins[:n] + step, len(flat) - 1)] * live
            words = np.empty_like(targets)
            words[0], words[1:] = last[:n], targets[:-1]
            last[:n] = targets[-1]
            states = net.states(words, h[:, :n])
            h[:, :n] = states[-1]
            at = np.flatnonzero(live)
            lp, _ = net.judge(columns(states, at), targets.ravel()[at])
            out[group[:n]] += np.bincount(at % n, weights=lp, minlength=n)
    return out


def train(encoded: DataFrame, counts: np.ndarray, rest: float, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after the rounds. Each document trains in one round, with its state carried through all of it; the weights of a
    round's models are averaged in Spark, by chunks. Round, model and order follow from a document's hash and the number of
    training tokens, not from how the table is laid out."""
    weights = Net.start(counts, rest).flat()
    models = min(MOST_MODELS, max(1, -(-tokens // (rounds * LEARNED))))
    for k in range(rounds):
        start = weights

        def trained(batches: Iterator[pd.DataFrame], start: np.ndarray = start) -> Iterator[pd.DataFrame]:
            flat, seen = train_partition(Net(start), batches)
            if seen:
                parts = np.array_split(flat.astype(np.float64) * seen, 16)
                yield pd.DataFrame({"part": range(16), "n": seen, "w": [list(p) for p in parts]})

        share = encoded.where(~F.col("held")).where(F.pmod(F.xxhash64("deal", F.lit(SEED)), F.lit(rounds)) == k)
        dealt = share.select("deal", "ids").repartition(models, "deal").sortWithinPartitions("deal", "ids")
        sums = dealt.select("ids").mapInPandas(trained, "part int, n long, w array<double>").select("part", "n", F.posexplode("w").alias("i", "x"))
        rows = sums.groupBy("part", "i").agg((F.sum("x") / F.sum("n")).alias("w")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("w")).orderBy("part").collect()
        if rows:
            weights = np.array([x.w for r in rows for x in r.w], np.float32)
    return weights


def frequent_words(counts: DataFrame, most: int = HEAD - 1) -> list:
    """Rows (word, c) of all words from a count on, at most `most` of them; a histogram of counts, whose size is fixed, tells from
    which. Words of equal count stay together, so the choice doesn't hang on the layout."""
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor((F.log2("c") - 10) * 64)).cast("long")
    words = counts.where(F.col("word") != END).withColumn("level", level)
    least, left = None, most
    for r in sorted(words.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        if r.n > left:
            break
        least, left = r.level, left - r.n
    return words.where(F.col("level") >= least).select("word", "c").collect() if least is not None else []


_numbered: dict[str, dict[str, int]] = {}


def _numbers(broadcast: str, words: list[str]) -> dict[str, int]:
    """Number of each broadcast word; one table is kept in a worker."""
    if broadcast not in _numbered:
        _numbered.clear()
        _numbered[broadcast] = {w: i for i, w in enumerate(words)}
    return _numbered[broadcast]


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text is an empty one: its only token is the end. Rows whose key's checksum says so are held out of training (a
    null key counts as the empty string); without training rows nothing is learned and the smoothed shares of all words are
    equal. Repeated rows are scored, and trained on, as often as they occur; other columns are left out; an empty table gives
    an empty result."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("held"))
    counts = settle(count_words(rows.where(~F.col("held")), "text"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    smooth = float(total + distinct + 1)
    top = sorted(frequent_words(counts), key=lambda r: (-r.c, r.word))
    end = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = [END, *(r.word for r in top)]
    head = np.array([end, *(r.c for r in top)], np.int64)
    ranked, own = spark.sparkContext.broadcast((words, head)), str(uuid.uuid4())

    @F.arrow_udf("ids array<int>, tail array<string>, base double, known long, beyond double")
    def encode(texts: pa.Array) -> pa.Array:
        words, head = ranked.value
        coded, sizes = words_of(texts)
        distinct, word = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at = np.fromiter(map(_numbers(own, words).get, distinct, repeat(-1)), np.int64, len(distinct))
        n, text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        summed = lambda values: np.bincount(text, weights=np.where(at < 0, 0, values)[word], minlength=n)
        base = summed(np.log10((head[at] + 1) / smooth)) + np.log10((head[0] + 1) / smooth)
        known = summed(head[at] > 0).astype(np.int64) + int(head[0] > 0)
        beyond = summed(np.where(at >= NET_WORDS, np.log10(head[at] + 1.0), 0))
        ids = np.zeros(len(word) + n, np.int32)  # the end, 0, after each text
        ids[np.arange(len(word)) + text] = np.where(at < 0, NET_WORDS, np.minimum(at, NET_WORDS))[word]
        far = at[word] < 0
        upto = lambda k: pa.array(np.append(0, np.cumsum(k)), pa.int32())
        tail = pa.ListArray.from_arrays(upto(np.bincount(text[far], minlength=n)), coded.dictionary.take(word[far]).cast(pa.string()))
        columns = [pa.ListArray.from_arrays(upto(sizes + 1), ids), tail, base, known, beyond]
        return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["ids", "tail", "base", "known", "beyond"])

    key_type = dict(rows.dtypes)["key"]
    named = rows.select(F.col("key").cast("string").alias("key"), "held", F.xxhash64("key", "text").alias("deal"), encode("text").alias("_e"))
    encoded = settle(named.select("key", "held", "deal", "_e.*").withColumn("row", F.monotonically_increasing_id()))
    rest_counts = float(total - head[:NET_WORDS].sum())
    weights = spark.sparkContext.broadcast(train(encoded, head[:NET_WORDS].astype(float), rest_counts, int(total)))
    # The words beyond the network share their class by count plus one; unseen ones together have the share of one more word.
    rest_mass = rest_counts + max(0, distinct - min(len(head), NET_WORDS)) + 1

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Net(weights.value)

        def told(held: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            texts = list(part["ids"])
            far = np.array([int((t == NET_WORDS).sum()) for t in texts])
            lp = score_texts(net, texts) / np.log(10) + part["beyond"].to_numpy() - far * np.log10(rest_mass)
            return pd.DataFrame({"row": part["row"], "key": part["key"], "held": part["held"], "n": [len(t) for t in texts], "base": part["base"], "known": part["known"], "lp": lp})

        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += sum(map(len, batch["ids"]))
            if n >= GATHERED:
                yield told(waiting)
                waiting, n = [], 0
        if n:
            yield told(waiting)

    scored = encoded.drop("tail", "deal").mapInPandas(score, "row long, key string, held boolean, n long, base double, known long, lp double")
    found = encoded.select("row", F.explode("tail").alias("word")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("_plus"), F.count("*").alias("_f"), F.count_if(F.col("c") > 0).alias("_known"))
    plus, n_tail = F.coalesce("_plus", F.lit(0.0)), F.coalesce("_f", F.lit(0))
    return scored.join(tail, "row", "left").select(
        F.col("key").cast(key_type).alias(key),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + plus - n_tail * F.log10(F.lit(smooth))).alias("base_score"),
        (F.col("lp") + plus).alias("score"),
    )


def op10_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and its score by the gated recurrent model."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
