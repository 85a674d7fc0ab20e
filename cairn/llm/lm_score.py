"""Operator 3: language-model scores by a weighted backoff automaton.

Tokens are lower-cased words and one end for each text. States are words (and the begin of a text): a text
is traversed once from left to right, and each token leads to its own state. An arc is a pair of
successive tokens of the training texts, pairs seen once included; a token without an arc takes the failure arc to the
empty context, weighted by m / (c(word) + m), and is found there among all words:

    P(token | word) = (c(word token) + m(word) P(token)) / (c(word) + m(word))
    P(word) = (max(c - D, 0) + D V S(word)) / N        P(end) = max(c - D, 0) / N

(smoothing by a Dirichlet prior, whose weight m grows slower than the word's count c; D is DISCOUNT; after words that aren't known, P(token) holds). S comes from n-grams of ORDER bytes over the
distinct training words (Witten-Bell smoothed, all kept; there are less than 2^24 + 2^17 of them, whatever the input). They become states (the
contexts) with arcs for the bytes seen after them and a failure arc, weighted by what is left, to the context
without its first byte. A word is spelt by one left-to-right traversal that carries its state and adds up
log-probabilities; all words of a run step together.

Tasks traverse their texts and deal the steps by their token, packed in chunks of texts; where all
steps to a token meet, arcs are counted and weighted and each text's share of the sums goes back to its chunk. So counts cover
all training texts, each step is sent once, and no table of arcs is kept. A context goes by 48 bits of its hash: two contexts of one token are
taken as one with a chance of 2^-48. `docs` must come in the same order when a task is run again, as a file scan does.

Null texts are empty: their one token is the end. A null training mark is false. Every row gives a
row, repeated rows too, each of which trains; other columns are ignored. Without training tokens
words and end are taken as equally likely and spelt with equal bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.shared import Stage, shuffle_parts, small_batches

DISCOUNT = 0.75
#: Weight of the empty context beside a context's own followers: MASS * count ** GROWTH tokens, where a context with
#: less than N / HOT tokens weighs like one that has them. So at most HOT words have a weight of their own; they are broadcast.
MASS, GROWTH, HOT = 2.0, 0.8, 100_000
#: Bytes of an n-gram.
ORDER = 3
#: Words that a task gathers before it deals them out, texts of them at most, and steps of a bucket.
DEALT, TEXTS, GATHERED = 800_000, 60_000, 1_000_000
#: Stands for both edges of a word; no word holds it.
EDGE = 32
END = np.uint64(0)
#: The context of a text's first token.
BEGIN = np.uint64(1)


class Automaton:
    """States are contexts of up to ORDER - 1 bytes; arc keys are state * 256 + byte."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """`grams`: bytes packed behind a leading 1 (so that lengths differ), with their counts."""
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.int64), counts[order].astype(np.float64)
        size = np.floor(np.log2(np.maximum(grams, 1))).astype(np.int64) // 8
        context, symbol = grams >> 8, grams & 255
        states = np.unique(np.append(context, 1))  # 1: the empty context
        at = lambda keys: np.minimum(np.searchsorted(states, keys), len(states) - 1)
        depth = np.floor(np.log2(states)).astype(np.int64) // 8
        self.fail = np.zeros(len(states), dtype=np.int64)
        total, kinds = np.bincount(at(context), counts, len(states)), np.bincount(at(context), minlength=len(states))
        shorter = (states & ((1 << (8 * np.maximum(depth - 1, 0))) - 1)) | (1 << (8 * np.maximum(depth - 1, 0)))
        for d in range(1, int(depth.max(initial=0)) + 1):
            here = np.flatnonzero(depth == d)
            key = shorter[here]
            spot = at(key)
            while True:  # the longest suffix that is a state
                gone = states[spot] != key
                if not gone.any():
                    break
                k = np.floor(np.log2(key[gone])).astype(np.int64) // 8 - 1
                key[gone] = (key[gone] & ((1 << (8 * k)) - 1)) | (1 << (8 * k))
                spot = at(key)
            self.fail[here] = spot
        left = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        self.back = np.log10(np.maximum(left, 1e-300))
        self.key = np.zeros(len(grams), dtype=np.int64)
        self.log = np.zeros(len(grams))
        self.to = np.zeros(len(grams), dtype=np.int64)
        probability = np.zeros(len(grams))
        self.key[:] = at(context) * 256 + symbol
        by_key = np.argsort(self.key)
        self.key, grams, counts, size, context, symbol = (x[by_key] for x in (self.key, grams, counts, size, context, symbol))
        owner = at(context)
        for d in range(1, int(size.max(initial=0)) + 1):
            here = np.flatnonzero(size == d)
            lower = np.full(len(here), 1 / 256) if d == 1 else self._linear(self.fail[owner[here]], symbol[here], probability, left)
            probability[here] = (counts[here] + kinds[owner[here]] * lower) / (total[owner[here]] + kinds[owner[here]])
        self.log = np.log10(np.maximum(probability, 1e-300))
        # after a byte: the longest suffix of context and byte that is a state
        key = grams.copy()
        long = size > ORDER - 1
        key[long] = (key[long] & ((1 << (8 * (ORDER - 1))) - 1)) | (1 << (8 * (ORDER - 1)))
        spot = at(key)
        while True:
            gone = states[spot] != key
            if not gone.any():
                break
            k = np.floor(np.log2(key[gone])).astype(np.int64) // 8 - 1
            key[gone] = (key[gone] & ((1 << (8 * k)) - 1)) | (1 << (8 * k))
            spot = at(key)
        self.to = spot
        self.root = int(at(np.array([1]))[0])
        begin = at(np.array([(1 << 8) | EDGE]))
        self.begin = int(begin[0]) if states[begin[0]] == ((1 << 8) | EDGE) else self.root

    def _linear(self, state: np.ndarray, symbol: np.ndarray, probability: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Probabilities from shorter contexts, whose arcs are ready."""
        out, scale = np.zeros(len(state)), np.ones(len(state))
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * 256 + symbol[todo]
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[spot] == key
            out[todo[hit]] = scale[todo[hit]] * probability[spot[hit]]
            miss = todo[~hit]
            scale[miss] *= left[state[miss]]
            ended = state[miss] == 0
            out[miss[ended]] = scale[miss[ended]] / 256
            todo = miss[~ended]
            state[todo] = self.fail[state[todo]]
        return out

    def spell(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 S of each word."""
        out = np.zeros(len(starts))
        longest_first = np.argsort(starts - ends, kind="stable")
        state = np.full(len(starts), self.begin, dtype=np.int64)
        length = (ends - starts)[longest_first]
        for t in range(int(length.max(initial=-1)) + 1):
            live = longest_first[: np.searchsorted(-length, -t, "right")]
            symbol = np.full(len(live), EDGE, dtype=np.int64)
            inside = ends[live] > starts[live] + t
            symbol[inside] = data[starts[live[inside]] + t]
            todo = np.arange(len(live))
            now, gain = state[live], np.zeros(len(live))
            while len(todo):
                key = now[todo] * 256 + symbol[todo]
                spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[spot] == key if len(self.key) else np.zeros(len(todo), dtype=bool)
                done = todo[hit]
                gain[done] += self.log[spot[hit]]
                now[done] = self.to[spot[hit]]
                todo = todo[~hit]
                gain[todo] += self.back[now[todo]]
                lost = now[todo] == self.root
                gain[todo[lost]] -= math.log10(256)
                todo = todo[~lost]
                now[todo] = self.fail[now[todo]]
            out[live] += gain
            state[live] = now
        return out


class Lists:
    """Words as one run of bytes with bounds."""

    @staticmethod
    def take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size)])
        return data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(tk.word_hashes(data, starts, ends), return_index=True, return_inverse=True)


def word_counts(docs: DataFrame, text: str, train: str, buckets: int, parts: int) -> DataFrame:
    """(bucket, hashes, counts, words, sizes): all training words, packed; the end has hash 0 and no bytes."""

    def deal(held: list) -> pa.RecordBatch:
        names, counts, data, size = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        begin = np.cumsum(size) - size
        order = np.argsort(bucket, kind="stable")
        data = Lists.take(data, begin[order], (begin + size)[order])
        names, counts, size, bucket = names[order], counts[order], size[order], bucket[order]
        kinds = np.unique(bucket)
        at = np.append(np.searchsorted(bucket, kinds), len(bucket))
        bytes_at = np.concatenate([[0], np.cumsum(size)])[at]
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds), tk.binary(names, at), tk.binary(counts.astype(np.int64), at), tk.binary(data, bytes_at), tk.binary(size.astype(np.int32), at)], names=["bucket", "hashes", "counts", "words", "sizes"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            texts = tk.filled(batch.column(0))
            if len(texts):
                held.append((np.array([END]), np.array([len(texts)]), np.zeros(0, np.uint8), np.array([0])))
            for a, b in tk.runs(texts):
                data, at = tk.chars(texts.slice(a, b - a))
                data = tk.LOWER[data]
                starts, ends, _ = tk.word_spans(data, at)
                names, one, back = distinct(data, starts, ends)
                held.append((names, np.bincount(back, minlength=len(names)), Lists.take(data, starts[one], ends[one]), ends[one] - starts[one]))
                n += len(names)
                if n >= DEALT:
                    yield deal(held)
                    held, n = [], 0
        if held:
            yield deal(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            size = tk.unpacked(batch.column(4), np.int32)[0].astype(np.int64)
            held.append((tk.unpacked(batch.column(1), np.uint64)[0], tk.unpacked(batch.column(2), np.int64)[0], tk.unpacked(batch.column(3), np.uint8)[0], size))
        if held:
            names, counts, data, size = (np.concatenate(x) for x in zip(*held, strict=True))
            begin = np.cumsum(size) - size
            names, one, back = np.unique(names, return_index=True, return_inverse=True)
            yield deal([(names, np.bincount(back, counts, len(names)).astype(np.int64), Lists.take(data, begin[one], (begin + size)[one]), size[one])])

    schema = "bucket int, hashes binary, counts binary, words binary, sizes binary"
    dealt = docs.where(F.col(train)).select(text).mapInArrow(tk.frugal(count), schema)
    return dealt.repartition(parts, "bucket").mapInArrow(tk.frugal(total), schema)


def byte_grams(words: DataFrame) -> DataFrame:
    """(gram, n): counts of packed byte n-grams over distinct words."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, size = tk.unpacked(batch.column(0), np.uint8)[0], tk.unpacked(batch.column(1), np.int32)[0].astype(np.int64)
            size = size[size > 0]
            if not len(size):
                continue
            # each word between two edges
            at = np.concatenate([[0], np.cumsum(size + 2)])
            line = np.full(at[-1], EDGE, dtype=np.int64)
            line[np.arange(len(data)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = data
            start = np.repeat(at[:-1], size + 2)
            place = np.arange(len(line))
            made = []
            for k in range(1, ORDER + 1):
                ok = np.flatnonzero((place - k + 1 >= start) & (place > start))
                gram = np.ones(len(ok), dtype=np.int64)
                for j in range(k - 1, -1, -1):
                    gram = (gram << 8) | line[ok - j]
                made.append(np.stack(np.unique(gram, return_counts=True), 1))
            for part in made:
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["gram", "n"])

    return words.select("words", "sizes").mapInArrow(tk.frugal(f), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def steps_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and text of each step of a traversal, ends included."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size + 1)
    token = np.full(len(doc), END, dtype=np.uint64)
    token[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = words
    context = np.concatenate([[BEGIN], token[:-1]]) if len(token) else token
    context[np.cumsum(size + 1) - (size + 1)] = BEGIN
    return context, token, doc


PACKET = ("words", "spelt", "arcs", "low", "high", "seen", "times", "texts", "model", "base", "known", "sizes")


def packet(chunk: int, bucket: np.ndarray, columns: dict[str, pa.Array], ids: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
    """Rows of one chunk: its steps to the tokens of some buckets, or sums of its texts, or (once) its texts' ids and sizes."""
    n = len(bucket)
    rest = [columns.get(c, pa.nulls(n, pa.binary())) for c in PACKET]
    held = pa.nulls(n, pa.list_(kind)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk, np.int64)), pa.array(bucket.astype(np.int32)), held, *rest], names=["chunk", "bucket", "ids", *PACKET])


def traversed(docs: DataFrame, buckets: int, speller, schema: str) -> DataFrame:
    """Packets of the steps of (doc_id, text, train)."""

    def dealt(chunk: int, held: list, ids: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        h, w, doc, train, names, data, size = [], [], [], [], [], [], []
        sizes, texts = [], 0
        for words, first, trains, own, letters, lengths in held:
            a, b, c = steps_of(words, first)
            h.append(a)
            w.append(b)
            doc.append(c + texts)
            train.append(trains)
            sizes.append(np.diff(first) + 1)
            texts += len(first) - 1
            names.append(own)
            data.append(letters)
            size.append(lengths)
        h, w, doc, train, names, data, size, sizes = map(np.concatenate, (h, w, doc, train, names, data, size, sizes))
        all_ids = pa.concat_arrays([x.cast(kind) for x in ids])
        yield packet(chunk, np.array([chunk % buckets]), {"sizes": tk.binary(sizes.astype(np.int32), np.array([0, len(sizes)]))}, all_ids, kind)
        # the distinct tokens of the chunk, in the order of their buckets, with their spellings
        begin = np.cumsum(size) - size
        kinds, one = np.unique(np.append(names, END), return_index=True)
        spelt = np.zeros(len(kinds), dtype=np.float32)
        is_word = np.flatnonzero(kinds != END)
        start = begin[one[is_word]]
        spelt[is_word] = speller.value.spell(data, start, start + size[one[is_word]])
        bucket = (kinds >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(kinds), dtype=np.int64)
        place[order] = np.arange(len(kinds))
        at = place[np.searchsorted(kinds, w)]
        kinds, spelt, bucket = kinds[order], spelt[order], bucket[order]
        short = h & np.uint64(0xFFFFFFFFFFFF)
        order = np.lexsort((short, at))  # stable: texts stay in order
        at, short, doc = at[order], short[order], doc[order]
        arc = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (short[1:] != short[:-1])]))
        times = np.diff(np.append(arc, len(at)))
        seen = np.add.reduceat(train[doc].astype(np.int64), arc)
        of_word = np.bincount(at[arc], minlength=len(kinds))
        filled, word_at = np.unique(bucket, return_index=True)
        word_at = np.append(word_at, len(kinds))
        arc_at = np.concatenate([[0], np.cumsum(of_word)])[word_at]
        step_at = np.append(arc, len(at))[arc_at]
        low, high = (short[arc] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (short[arc] >> np.uint64(32)).astype(np.uint16)
        yield packet(
            chunk,
            filled,
            {
                **{c: tk.binary(v, word_at) for c, v in (("words", kinds), ("spelt", spelt), ("arcs", of_word.astype(np.int32)))},
                **{c: tk.binary(v, arc_at) for c, v in (("low", low), ("high", high), ("seen", seen.astype(np.int32)), ("times", times.astype(np.int32)))},
                "texts": tk.binary(doc.astype(np.uint16), step_at),
            },
            None,
            kind,
        )

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk, held, ids, words, rows, kind = (context.partitionId() if context else 0) << 32, [], [], 0, 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = tk.filled(batch.column(1))
            for a, b in ((x, min(x + TEXTS, e)) for s, e in tk.runs(texts) for x in range(s, e, TEXTS)):
                if rows + b - a > TEXTS:
                    yield from dealt(chunk, held, ids, kind)
                    chunk, held, ids, words, rows = chunk + 1, [], [], 0, 0
                data, at = tk.chars(texts.slice(a, b - a))
                data = tk.LOWER[data]
                starts, ends, first = tk.word_spans(data, at)
                hashes = tk.word_hashes(data, starts, ends)
                own, one = np.unique(hashes, return_index=True)
                held.append((hashes, first, batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False), own, Lists.take(data, starts[one], ends[one]), (ends - starts)[one]))
                ids.append(batch.column(0).slice(a, b - a))
                words, rows = words + len(hashes) + b - a, rows + b - a
                if words >= DEALT:
                    yield from dealt(chunk, held, ids, kind)
                    chunk, held, ids, words, rows = chunk + 1, [], [], 0, 0
        if held:
            yield from dealt(chunk, held, ids, kind)

    return docs.select("doc_id", "text", "train").mapInArrow(tk.frugal(f), schema)


def masses(c, least: float, mass: float, growth: float):
    """m of contexts with count c."""
    return mass * np.maximum(c, least) ** growth


def weighed(packets: DataFrame, tokens: int, kinds: int, prior: tuple[float, float, float], hot, schema: str) -> DataFrame:
    """Counts and weighs the arcs to the tokens of a bucket: partial sums of each chunk's texts. The rows with ids pass through."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = [], None
        for batch in batches:
            kind = batch.schema.field(2).type.value_type
            is_head = batch.column(2).is_valid()
            yield batch.filter(is_head)
            for row in np.flatnonzero(~is_head.to_numpy(zero_copy_only=False)).tolist():
                one = batch.slice(row, 1)
                held.append((one.column(0)[0].as_py(), *(tk.unpacked(one.column(3 + i), t)[0] for i, t in enumerate((np.uint64, np.float32, np.int32, np.uint32, np.uint16, np.int32, np.int32, np.uint16)))))
        if not held:
            return
        words, spelt, arcs, low, high, seen = (np.concatenate([x[i] for x in held]) for i in range(1, 7))
        names, word = np.unique(words, return_inverse=True)
        of_arc = np.repeat(word, arcs)  # the token of each arc
        c = np.bincount(of_arc, seen, len(names))
        s = np.zeros(len(names))
        s[word] = spelt
        del words, spelt, word
        context = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        order = np.lexsort((context, of_arc))
        new = np.concatenate([[True], (of_arc[order][1:] != of_arc[order][:-1]) | (context[order][1:] != context[order][:-1])])
        total = np.add.reduceat(seen[order].astype(np.float64), np.flatnonzero(new))
        count = np.empty(len(order))
        count[order] = total[np.cumsum(new) - 1]
        del order, new, total, low, high
        end = names == END
        p = logs(c, s, end, tokens, kinds)
        own, own_mass = hot.value
        spot = np.minimum(np.searchsorted(own, context), len(own) - 1)
        mass = np.where(own[spot] == context, own_mass[spot], masses(0, *prior))
        value = np.log10(count + mass * 10.0 ** p[of_arc]) - np.where(end, 0.0, np.log10(c + masses(c, *prior)))[of_arc]
        simple = np.log10(c + 1.0)[of_arc]
        known = (c > 0)[of_arc]
        at = 0
        for chunk, *_, times, texts in held:
            mine = np.repeat(np.arange(at, at + len(times)), times)
            at += len(times)
            which, back = np.unique(texts, return_inverse=True)
            sums = [np.bincount(back, v[mine], len(which)) for v in (value, simple, known)]
            bound = np.array([0, len(which)])
            columns = {"texts": tk.binary(which, bound), "model": tk.binary(sums[0], bound), "base": tk.binary(sums[1], bound), "known": tk.binary(sums[2].astype(np.int32), bound)}
            yield packet(chunk, np.array([0]), columns, None, kind)

    return packets.mapInArrow(tk.frugal(f), schema)


def logs(c: np.ndarray, spelt: np.ndarray, end: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """log10 P of tokens with count c in the empty context; spelt: log10 S."""
    if not tokens:
        return np.where(end, 0.0, spelt) - math.log10(2)
    return np.log10(np.maximum(np.maximum(c - DISCOUNT, 0) + np.where(end, 0.0, DISCOUNT * kinds * 10.0**spelt), 1e-300)) - math.log10(tokens)


def scores(docs: DataFrame, *, train: str = "train", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, for every row."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    counts = Stage(word_counts(marked, "text", "train", 2 * parts, parts))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, at = tk.unpacked(batch.column(0), np.int64)
            names = tk.unpacked(batch.column(1), np.uint64)[0]
            yield pa.RecordBatch.from_arrays([pa.array(tk.sums(c, at)), pa.array(np.diff(at)), pa.array(tk.sums(np.where(names == END, c, 0), at))], names=["n", "v", "ends"])

    zero = F.lit(0)
    total = counts.df.select("counts", "hashes").mapInArrow(tk.frugal(sums), "n long, v long, ends long").agg(*(F.coalesce(F.sum(c), zero) for c in ("n", "v", "ends"))).first()
    tokens, kinds, ends = map(int, total)
    grams = byte_grams(counts.df).toPandas()  # less than 2^24 + 2^17 rows
    speller = spark.sparkContext.broadcast(Automaton(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)))
    del grams
    # contexts with a weight of their own: the begin, and words with N / HOT tokens or more, of which there are at most HOT

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, c = tk.unpacked(batch.column(0), np.uint64)[0], tk.unpacked(batch.column(1), np.int64)[0]
            some = (c >= prior[0]) & (names != END)
            yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), pa.array(c[some])], names=["x", "c"])

    prior = (max(tokens / HOT, 1.0), MASS, GROWTH)
    listed = counts.df.select("hashes", "counts").mapInArrow(tk.frugal(often), "x long, c long").toPandas()
    names = np.append(listed["x"].to_numpy(np.int64).view(np.uint64), BEGIN) & np.uint64(0xFFFFFFFFFFFF)
    weights = masses(np.append(listed["c"].to_numpy(np.int64), ends), *prior)
    order = np.argsort(names)
    hot = spark.sparkContext.broadcast((names[order], weights[order]))
    counts.drop()
    buckets = max(parts, -(-tokens // GATHERED))
    kind = marked.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, bucket int, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in PACKET)
    summed = weighed(traversed(marked, buckets, speller, schema).repartitionById(buckets, "bucket"), tokens, kinds, prior, hot, schema)
    base, begin = math.log10(tokens + kinds + 1), math.log10(ends + masses(ends, *prior))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's rows lie together, that with its ids first."""
        now, ids, n, found = None, None, None, None

        def out() -> pa.RecordBatch:
            size = pa.array(n.astype(np.int64))
            return pa.RecordBatch.from_arrays([ids, size, pa.array(found[2].astype(np.int64)), pa.array(found[1] - n * base), pa.array(found[0] - begin)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            chunks = batch.column(0).to_pylist()
            for row, chunk in enumerate(chunks):
                if chunk != now:
                    if now is not None:
                        yield out()
                    ids = batch.column(2).slice(row, 1).flatten()
                    n = tk.unpacked(batch.column(3 + PACKET.index("sizes")).slice(row, 1), np.int32)[0]
                    now, found = chunk, np.zeros((3, len(n)))
                    continue
                texts = tk.unpacked(batch.column(3 + PACKET.index("texts")).slice(row, 1), np.uint16)[0]
                for i, (c, t) in enumerate((("model", np.float64), ("base", np.float64), ("known", np.int32))):
                    found[i][texts] += tk.unpacked(batch.column(3 + PACKET.index(c)).slice(row, 1), t)[0]
        if now is not None:
            yield out()

    together = summed.repartition(buckets, "chunk").sortWithinPartitions("chunk", F.col("ids").isNull())
    rows = together.mapInArrow(tk.frugal(gathered), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
