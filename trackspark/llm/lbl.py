"""Operator 6: log-bilinear language model trained in numpy by noise-contrastive estimation.

Token counts cover the whole training part and are kept as a table. A token's probability is that of its class after two words, times its
share of the class after the word before. The most frequent words are classes of their own; all others share classes by their
ending, of which there are more the more distinct tokens there are. A class is predicted by the dot product of its vector with the
sum of a vector for each context word (by its class and place), plus a bias; a token in its class by its smoothed count, weighted
with the dot product of its vector and one of the word before. Training documents are dealt to shards by a hash of key and text, so many that a shard
has SHARD_TOKENS tokens or so: the shards, and so the model, depend on the documents alone, not on partitions or tasks. Every shard is trained on from the same start, and the parameters are averaged by tokens; that in some rounds, each on
its part of the documents. As the score of a class is a sum of one part for each
context word, the normaliser of every pair of context words is one entry of a product of two matrices, and so are the classes' own normalisers
a table of classes by classes: scores are exact, normalised log-probabilities and cost some look-ups a token.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GROUP_CHARS, release, resident, row_groups, small_batches, stored

#: Words that are classes of their own, and the most classes that others share (one for each 32 distinct tokens below that).
SINGLES, SHARED = 768, 768
#: Lengths of the vectors of classes and of tokens within their class, context words.
WIDTH, INNER, CONTEXT = 24, 8, 2
#: Noise words that a minibatch of classes shares, its size, that of a minibatch within classes (a noise word each), the Adagrad step and its first square.
NOISE, BATCH, OWN_BATCH, STEP, FIRST = 64, 2048, 4096, 0.07, 1e-6
#: Rounds of training and averaging; a document belongs to one. Tokens of a shard, about; the number of shards grows with the corpus.
ROUNDS, SHARD_TOKENS = 3, 1_000_000
#: Numbers of a trained model that are one row on their way to the average.
PIECE = 1 << 15
#: Characters that a token counts for when texts are grouped.
CHARS_A_TOKEN = 6
#: Slots of the table that noise words within classes are drawn from.
SLOTS = 1 << 20
#: Most words with a vector of their own, whose counts are sent to the tasks; the counts of others are joined by a shuffle.
HEAD = 1 << 17
#: Steps of the histogram of counts for each doubling.
FINE = 16
#: Distinct tokens that a counting task holds before it hands them on.
HELD = 300_000
ALPHA = 0.1
#: The token at a text's end, which also stands for the words before its start. No word is empty.
END = ""
LN10 = float(np.log(10))


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end token. Null counts as empty."""
    return [*(text or "").encode().lower().split(), END.encode()]


def held_out(key: str, parts: int = 10, part: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, c of all texts, the end token included; summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        ends = 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for a, b in row_groups(batch.column(0)):
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    if t:
                        found.update(t.encode().lower().split())
                ends += b - a
                if len(found) > HELD:
                    yield give()
                    found.clear()
        if ends:
            found[END.encode()] = ends
            yield give()

    return docs.select(text).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def least_count(counts: DataFrame, most: int = HEAD) -> int:
    """The least count that at most ``most`` tokens reach, by a histogram of counts with FINE steps for each doubling."""
    step = F.floor(F.log2("c") * FINE).cast("int")
    rows = sorted(((r["step"], r["n"], r["low"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()), reverse=True)
    total, least = 0, np.iinfo(np.int64).max
    for _, n, low in rows:
        total += n
        if total > most:
            break
        least = low
    return int(least)


def shared_number(token: bytes, shared: int) -> int:
    """Number of a token's shared class: a hash of its last three bytes, so endings are what its members share."""
    return zlib.crc32(token[-3:]) % shared


class Vocabulary(dict):
    """Frequent token, in UTF-8 -> its number, in order of counts; classes, noise and shares of all tokens.

    ``rows`` has the frequent tokens and their counts; ``tail`` the occurrences and distinct tokens of each shared class that are in no row.
    """

    def __init__(self, rows: list[tuple[str, int]], total: int, distinct: int, tail: dict[int, tuple[int, int]] | None = None, singles: int = SINGLES, shared: int = SHARED):
        super().__init__()
        rows = sorted({END: 0, **dict(rows)}.items(), key=lambda x: (x[0] != END, -x[1], x[0]))
        self.total, self.distinct = total, distinct
        self.singles = min(singles, len(rows))
        self.shared = shared_classes(distinct, shared)
        self.classes = self.singles + self.shared
        for i, (t, _) in enumerate(rows):
            self[t.encode()] = i
        self.counts = np.array([c for _, c in rows], np.float64)
        self.class_of = np.array([i if i < self.singles else self.shared_class(t.encode()) for i, (t, _) in enumerate(rows)], np.int64)
        more, members = np.zeros(self.classes), np.bincount(self.class_of, minlength=self.classes).astype(np.float64)
        for k, (n, d) in (tail or {}).items():
            more[self.singles + k] += n
            members[self.singles + k] += d
        own = np.bincount(self.class_of, self.counts, self.classes) + more
        self.noise = ((own + ALPHA) / (own + ALPHA).sum()).astype(np.float32)
        # In a shared class, one more share stands for the tokens never met.
        self.class_norm = own + ALPHA * (members + (np.arange(self.classes) >= self.singles))
        self.share = (self.counts + ALPHA) / self.class_norm[self.class_of]

    def shared_class(self, token: bytes) -> int:
        return self.singles + shared_number(token, self.shared)

    def numbers(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of many texts: their numbers (-1: none), their classes, and the places of the end tokens."""
        get = self.get
        word = np.fromiter((get(w, -1) for ws in lists for w in ws), np.int64)
        cls, sizes = self.class_of[word], np.array([len(ws) for ws in lists])
        rare = np.flatnonzero(word < 0)
        if len(rare):
            owner, first = np.repeat(np.arange(len(lists)), sizes)[rare], np.cumsum(sizes) - sizes
            cls[rare] = [self.shared_class(lists[i][t]) for i, t in zip(owner.tolist(), (rare - first[owner]).tolist())]
        return word, cls, np.cumsum(sizes) - 1


def shared_classes(distinct: int, most: int = SHARED) -> int:
    return max(1, min(most, distinct // 32))


def start(v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters that every task begins with: small vectors, log-frequency biases.

    T, b: vectors and biases of the classes; Q: vectors of context classes, a set for each place; U, V: vectors of the class before, and of tokens in their class.
    """
    rng = np.random.default_rng(7)
    small = lambda rows, width: rng.normal(0, 0.1, (rows, width)).astype(np.float32)
    return {"Q": small(CONTEXT * v.classes, WIDTH), "T": small(v.classes, WIDTH), "U": small(v.classes, INNER), "V": np.zeros((len(v.counts), INNER), np.float32), "b": np.log(v.noise)}


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable" if at.dtype == np.int16 else None)
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first].astype(np.int64), np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps on one task's tokens."""

    def __init__(self, v: Vocabulary, seed: int, begin: tuple[dict, dict] | None = None):
        p, squares = begin or (start(v), {})
        self.p = {k: x.copy() for k, x in p.items()}
        self.squares = {k: squares[k].copy() if squares else np.full(x.shape, FIRST, np.float32) for k, x in self.p.items()}
        self.v, self.shift = v, np.log(v.noise) + np.float32(np.log(NOISE))
        self.edges = np.cumsum(v.noise.astype(np.float64))
        self.rng = np.random.default_rng(seed)
        self.trained = 0
        # Noise within a shared class: its frequent tokens hold slots of one table by their shares; ``offset`` mends what rounding to slots changes.
        members = np.flatnonzero(v.class_of >= v.singles)
        members = members[np.argsort(v.class_of[members], kind="stable")]
        weight, cls = v.share[members] * v.noise[v.class_of[members]], v.class_of[members]
        slots = np.maximum(1, np.round(weight / max(weight.sum(), 1e-9) * SLOTS)).astype(np.int64)
        self.table = np.repeat(members, slots).astype(np.int32)
        self.slots = np.bincount(cls, slots, v.classes).astype(np.int64)
        self.first = np.cumsum(self.slots) - self.slots
        self.offset = np.zeros(len(v.counts), np.float32)
        self.offset[members] = np.log(v.share[members] * self.slots[cls] / slots)

    def update(self, name: str, at: np.ndarray, rows: np.ndarray) -> None:
        square = self.squares[name][at] + rows * rows
        self.squares[name][at] = square
        self.p[name][at] += STEP * rows / np.sqrt(square)

    def step(self, context: np.ndarray, cls: np.ndarray) -> None:
        """A minibatch of classes: context (m, CONTEXT), nearest first, and the classes that follow."""
        p, n = self.p, self.v.classes
        drawn = np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1]).clip(max=n - 1)
        near = [context[:, i] + i * n for i in range(CONTEXT)]
        h = sum(p["Q"][x] for x in near)
        aim, noise, bias = p["T"][cls], p["T"][drawn], p["b"] - self.shift
        up = 1 / (1 + np.exp((np.einsum("ij,ij->i", h, aim) + bias[cls]).clip(-30, 30)))
        down = -1 / (1 + np.exp(-(h @ noise.T + bias[drawn]).clip(-30, 30)))
        into = up[:, None] * aim + down @ noise
        self.update("T", *summed(drawn, down.T @ h))
        self.update("T", *summed(cls.astype(np.int16), up[:, None] * h))
        g = np.bincount(cls, up, n).astype(np.float32) + np.bincount(drawn, down.sum(axis=0), n).astype(np.float32)
        self.squares["b"] += g * g
        p["b"] += STEP * g / np.sqrt(self.squares["b"])
        for x in near:
            self.update("Q", *summed(x.astype(np.int16), into))
        self.trained += len(cls)

    def own_step(self, before: np.ndarray, word: np.ndarray, cls: np.ndarray) -> None:
        """A minibatch within classes: the class before, and tokens with a vector in a shared class."""
        p = self.p
        noise = self.table[self.first[cls] + (self.rng.random(len(word)) * self.slots[cls]).astype(np.int64)]
        u, v, other = p["U"][before], p["V"][word], p["V"][noise]
        up = (1 / (1 + np.exp((np.einsum("ij,ij->i", u, v) + self.offset[word]).clip(-30, 30))))[:, None]
        down = (-1 / (1 + np.exp(-(np.einsum("ij,ij->i", u, other) + self.offset[noise]).clip(-30, 30))))[:, None]
        into = up * v + down * other
        self.update("V", *summed(np.concatenate([word, noise]).astype(np.int32), np.concatenate([up * u, down * u])))
        self.update("U", *summed(before.astype(np.int16), into))

    def learn(self, lists: list[list[bytes]]) -> None:
        """One pass over the tokens of many texts, in random order."""
        word, cls, ends = self.v.numbers(lists)
        before = contexts(cls, ends)
        order = self.rng.permutation(len(cls))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            self.step(before[some], cls[some])
        order = order[(word[order] >= 0) & (cls[order] >= self.v.singles)]
        for i in range(0, len(order), OWN_BATCH):
            some = order[i : i + OWN_BATCH]
            self.own_step(before[some, 0], word[some], cls[some])


def contexts(classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, CONTEXT) classes of the words before each token; before a text's start stand end tokens. ends: places of the end tokens."""
    out = np.zeros((len(classes), CONTEXT), np.int64)
    first = np.concatenate([[0], ends[:-1] + 1])
    at = np.arange(len(classes)) - np.repeat(first, np.diff(np.append(first, len(classes))))
    for i in range(CONTEXT):
        out[i + 1 :, i] = classes[: len(classes) - i - 1]
        out[at <= i, i] = 0
    return out


def train(docs: DataFrame, vocabulary, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> dict[str, np.ndarray]:
    """Parameters after one pass over all tokens, in rounds: a round's shards begin with the average of the round before, and hold the documents whose hash names it.

    Rows equal in key and text go to one shard.
    """
    begin, shards = None, max(1, round(vocabulary.value.total / rounds / shard_tokens))
    dealt = docs.select(text, F.xxhash64(key, text).alias("_hash"))
    for k in range(rounds):
        part = dealt.where(F.pmod("_hash", F.lit(rounds)) == k).withColumn("_shard", F.pmod(F.xxhash64("_hash"), F.lit(shards)))
        sent = docs.sparkSession.sparkContext.broadcast((begin, k))
        begin = train_round(part.repartition(shards, "_shard").sortWithinPartitions("_shard", "_hash"), vocabulary, sent, text) or begin
        sent.unpersist()
        # The texts and models that this round shuffled are not needed again.
        release(docs.sparkSession)
    return begin[0] if begin else start(vocabulary.value)


def packed(trainer: Trainer) -> Iterator[pa.RecordBatch]:
    """The trainer's parameters and sums of squares in a row: piece, data (PIECE numbers at most), weight (the tokens learned). A batch a piece."""
    data = np.concatenate([x[k].ravel() for x in (trainer.p, trainer.squares) for k in sorted(x)]).astype("<f4", copy=False)
    for i in range(0, len(data), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([data[i : i + PIECE].tobytes()], pa.binary()), pa.array([trainer.trained], pa.int64())], names=["piece", "data", "weight"])


def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, data: the average of each piece, weighted by ``weight``. Long doubles, so that the order of the rows does not show in the result."""
    totals: dict = {}
    for batch in batches:
        for i, d, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            x = np.frombuffer(d.as_buffer(), "<f4") * np.longdouble(w)
            if i in totals:
                totals[i][0] += x
                totals[i][1] += w
            else:
                totals[i] = [x, w]
    for i, (total, weight) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["piece", "data"])


def train_round(docs: DataFrame, vocabulary, begin, text: str) -> tuple[dict, dict] | None:
    """Average, weighted by tokens, of the parameters and sums of squares that the shards reach in one pass over these documents, sorted by ``_shard`` in their partitions; none without a token.

    What a shard returns is as large as the model, whose size has a bound. It goes in pieces to tasks that hold sums only, whatever the number of shards, and one model comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = begin.value
        trainer, shard, held, size = None, None, [], 0
        # Texts are learned in groups of GROUP_CHARS that end with their shard, wherever the batches end.
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1).to_pylist()):
                if held and (k != shard or size > GROUP_CHARS):
                    trainer.learn(held)
                    held, size = [], 0
                if k != shard:
                    if trainer:
                        yield from packed(trainer)
                        trainer = None  # before the next one takes memory
                    trainer, shard = Trainer(vocabulary.value, k * ROUNDS + number, first), k
                held.append(tokens(t.as_py()))
                size += len(held[-1]) * CHARS_A_TOKEN
        if trainer:
            trainer.learn(held)
            yield from packed(trainer)

    parts = docs.select(text, "_shard").mapInArrow(run, "piece int, data binary, weight long")
    rows = parts.repartition("piece").mapInArrow(average, "piece int, data binary").toArrow().sort_by("piece")
    if not len(rows):
        return None
    mean = np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in rows["data"]])
    shapes, at, out = {k: x.shape for k, x in start(vocabulary.value).items()}, 0, ({}, {})
    for made in out:
        for k in sorted(shapes):
            n = int(np.prod(shapes[k]))
            made[k] = mean[at : at + n].reshape(shapes[k]).copy()
            at += n
    return out


class Tables:
    """Parts of the class scores by context position, and log-normalisers of all context pairs and of all shared classes after each class; natural logarithms."""

    def __init__(self, p: dict[str, np.ndarray], v: Vocabulary):
        n = v.classes
        self.one, self.two = (p["Q"][i * n : (i + 1) * n] @ p["T"].T for i in range(CONTEXT))
        self.b, self.u, self.v = p["b"], p["U"], p["V"]
        self.z = np.log(np.exp(self.one + self.b) @ np.exp(self.two).T)
        self.own = np.zeros((n, n), np.float32)
        order = np.argsort(v.class_of, kind="stable")
        bounds = np.searchsorted(v.class_of[order], np.arange(n + 1))
        for k in range(v.singles, n):
            some = order[bounds[k] : bounds[k + 1]]
            rest = max(0.0, 1 - v.share[some].sum())
            self.own[k] = np.log(np.exp(self.u @ self.v[some].T) @ v.share[some] + rest)
        self.singles, self.log_share, self.log_norm = v.singles, np.log(v.share), np.log(v.class_norm)

    def log10(self, before: np.ndarray, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Normalised log10-probability of each token after its context. For a token without a number, less log10 of its smoothed count, which the caller adds."""
        a, b = before[:, 0], before[:, 1]
        out = (self.one[a, cls] + self.two[b, cls] + self.b[cls] - self.z[a, b] - self.own[cls, a]).astype(np.float64)
        known = word >= 0
        out += np.where(known, self.log_share[word], -self.log_norm[cls])
        some = np.flatnonzero(known & (cls >= self.singles))
        out[some] += np.einsum("ij,ij->i", self.u[a[some]], self.v[word[some]])
        return out / LN10


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 10, part: int = 0) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learned from the documents whose crc32 of the key as text does not leave ``part`` on division by ``parts`` (null
    key: of the empty text). Null text counts as empty: its only token is the end. Repeated rows are rows of
    their own; other columns are not read. With no training document every word is unknown and shares one class.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    small_batches(spark)
    own = docs.select(key, text)
    training = own.where(~held_out(key, parts, part))
    counts = stored(count_tokens(training, text), "lbl-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least, shared = least_count(counts), shared_classes(distinct)
    # Spark's last three bytes of a token are those of ``shared_number``.
    number = F.crc32(F.substring(F.encode("token", "UTF-8"), -3, 3)) % shared
    tail = {r["k"]: (r["n"], r["d"]) for r in counts.where((F.col("c") < least) & (F.col("token") != END)).groupBy(number.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    head = [(r["token"], r["c"]) for r in counts.where((F.col("c") >= least) | (F.col("token") == END)).collect()]
    vocabulary = spark.sparkContext.broadcast(Vocabulary(head, total, distinct, tail))
    tables = spark.sparkContext.broadcast(Tables(train(training, vocabulary, key, text), vocabulary.value))
    name = uuid.uuid4().hex
    base_norm = float(np.log10(total + ALPHA * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = resident(name, lambda: (vocabulary.value, tables.value))
        logs = np.log10(words.counts + ALPHA)
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                lists = [tokens(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                word, cls, ends = words.numbers(lists)
                sizes = np.diff(ends, prepend=-1)
                first = ends - sizes + 1
                # Tokens whose count is not at hand are left to the join.
                known = word >= 0
                base = np.add.reduceat(np.where(known, logs[word], 0), first)
                score = np.add.reduceat(model.log10(contexts(cls, ends), word, cls), first)
                n_known = np.add.reduceat((known & (words.counts[word] > 0)).astype(np.int64), first)
                tail: list = [{} for _ in lists]
                at = np.flatnonzero(~known)
                owner = np.repeat(np.arange(len(lists)), sizes)[at]
                for i, t in zip(owner.tolist(), (at - first[owner]).tolist()):
                    found, w = tail[i], lists[i][t]
                    found[w] = found.get(w, 0) + 1
                names = pa.array([[w.decode() for w in x] for x in tail], pa.list_(pa.string()))
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score), names, pa.array([list(x.values()) for x in tail], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "n_known", "base", "score", "tail", "times"])

    made = own.mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, base double, score double, tail array<string>, times array<long>")
    rows = stored(made.withColumn("row", F.monotonically_increasing_id()), "lbl-scores")
    tails = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("token"), F.col("x.times").alias("n"))
    met = tails.join(counts.where(F.col("c") < least), "token", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(ALPHA))).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    joined = rows.drop("tail", "times").join(sums, "row", "left").withColumn("tail_log", F.coalesce("tail_log", F.lit(0.0)))
    return joined.select(
        key,
        held_out(key, parts, part).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_log") - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"),
        (F.col("score") + F.col("tail_log")).alias("score"),
    )
