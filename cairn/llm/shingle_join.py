"""Operator 5: join of texts by the Jaccard similarity of their word shingles, with several global token orders.

Texts with the same set are one *class*, named by a hash of the set and its size. Then

1. the first 3/8 or so of each class's shingles, in the order of their hashes, go to buckets, four bytes of a shingle and of its
   class; a class with fewer than n / 8 of them in other such prefixes links with nothing and leaves. The whole sets of the others
   are dealt; a bucket sees how many classes hold a shingle, and tells each class its shingles that others
   hold too. A class with fewer of these than the smallest possible overlap, ceil(t n), leaves too.
2. what stays is ordered, unshared shingles first, then rarest first, in several orders. Linked classes share
   one of the first n - ceil(t n) + 1 shingles in each order.
3. large groups would give all pairs. So classes are first compared with one class of equal least
   hash (a pivot, under several hashes, in some turns: the one whose shingles most others hold, so that
   a text stands for its copies), which links most of a group through few pairs.
   Links inside a partial group can't change the result. So after each turn step 1 is repeated with
   shingles that several partial groups hold, and in the end classes of different groups give pairs. Pairs must be given by all orders and pass the size and position
   filters; then their sets are compared. Long lists of a shingle are dealt in blocks to several tasks.
4. components of the links, over distributed edges.

Hashes have 64 bits; sets that differ are taken as equal with a chance near 2^-64 a pair.

Rows: one for each input row. Null or empty texts have no set and are their own component; a
null id never names a component (a group of null ids only has the component null). Repeated rows and
rows with the same id keep a row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.components import components
from cairn.llm.shared import Stage, bounded, shuffle_parts, without

#: Shingles gathered before they are dealt to buckets (some 20 MB of a Python worker), and those of a bucket (some 50 MB).
DEALT, GATHERED = 400_000, 1_000_000
#: Classes that are broadcast as 8 bytes each; more are joined by a shuffle.
BROADCAST_CLASSES = 2_000_000
#: Hashes under which classes meet a pivot in a turn, and turns.
PIVOTS, TURNS = 3, 1
#: Pairs made at once inside one shingle's list.
BLOCK = 1 << 19
#: Classes of a list that one task compares; longer lists are dealt in blocks of it, a task for each pair of blocks.
SPLIT = 1024


def overlap_of(n: np.ndarray | int, num: int, den: int):
    """Least overlap of a set of n with any set linked to it: ceil(n num / den)."""
    return -(-n * num // den)


def common(need):
    """Prefix tokens that a pair which must share `need` tokens must share in each order.

    Its l-th common token has at least need - l tokens of either set after it; so with prefixes that are longer by l - 1 this loses no pair.
    """
    return np.maximum(4, need // 8)


def class_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for each set."""
    return tk.mixed(tk.sums(tk.mixed(values ^ np.uint64(0xA0761D6478BD642F)), at) + np.diff(at).astype(np.uint64) * tk.STEP).view(np.int64)


def salt(i: int) -> np.uint64:
    return np.uint64(i * int(tk.STEP) % 2**64)


def classes(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, class); class is null without shingles."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = tk.filled(batch.column(1)), batch.column(0)
            for first, values, at in tk.shingle_sets(texts, width):
                n = np.diff(at)
                named = pa.array(class_ids(values, at), mask=n == 0)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n, pa.int64()), named], names=["doc_id", "n_shingles", "class"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(tk.frugal(f), f"doc_id {kind}, n_shingles long, class long")


def prefix_of(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of n: the length of the first prefixes, and how many of a prefix's tokens another prefix must hold.

    A linked pair misses at most n - ceil(t n) tokens on either side, so its first l common tokens lie in prefixes that are longer than that by l.
    """
    several = np.maximum(1, n // 8)
    return n - overlap_of(n, num, den) + several, several


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)


def sent(docs: DataFrame, text: str, width: int, buckets: int, num: int, den: int) -> DataFrame:
    """(bucket, tokens, prints): the first prefix of each text in the order of the hashes, four bytes of a token and of its class."""

    def deal(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, prints = map(np.concatenate, zip(*parts, strict=True))
        low, high = halves(tokens)
        bucket = (high % np.uint32(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kinds, first = np.unique(bucket[order], return_index=True)
        at = np.append(first, len(order))
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), tk.binary(low[order], at), tk.binary(prints[order], at)], names=["bucket", "tokens", "prints"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, values, at in tk.shingle_sets(batch.column(0), width):
                n = np.diff(at)
                some = n > 0
                p = np.zeros(len(n), dtype=np.int64)
                p[some] = prefix_of(n[some], num, den)[0]
                take = np.repeat(at[:-1], p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                parts.append((values[take], np.repeat(halves(class_ids(values, at).view(np.uint64))[0], p)))
                held += len(take)
                if held >= DEALT:
                    yield deal(parts)
                    parts, held = [], 0
        if held:
            yield deal(parts)

    return docs.select(F.col(text)).mapInArrow(tk.frugal(f), "bucket int, tokens binary, prints binary")


def met(dealt: DataFrame, buckets: int) -> DataFrame:
    """(print, hits): tokens of a class's first prefix that other prefixes hold too; exact copies count as others.

    Tokens and classes go by half of their hashes here: more may be found in common, never less.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tk.unpacked(batch.column(1), np.uint32)[0].astype(np.uint64) << np.uint64(32) | tk.unpacked(batch.column(2), np.uint32)[0] for batch in batches]
        if not held:
            return
        both = np.concatenate(held)
        del held
        both.sort()
        token, name = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        if not len(token):
            return
        same = np.concatenate([[False], token[1:] == token[:-1], [False]])
        new = np.concatenate([[True], both[1:] != both[:-1]])
        prints, hits = np.unique(name[(same[1:] | same[:-1]) & new], return_counts=True)
        dest = (prints % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(dest, kind="stable")
        kinds, first = np.unique(dest[order], return_index=True)
        at = np.append(first, len(order))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), tk.binary(prints[order].astype(np.uint32), at), tk.binary(hits[order].astype(np.int32), at)], names=["dest", "prints", "hits"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(tk.unpacked(batch.column(1), np.uint32)[0], tk.unpacked(batch.column(2), np.int32)[0]) for batch in batches]
        if held:
            names, hits = map(np.concatenate, zip(*held, strict=True))
            names, back = np.unique(names, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(np.bincount(back, hits, len(names)).astype(np.int64))], names=["print", "hits"])

    found = dealt.repartitionById(buckets, "bucket").mapInArrow(tk.frugal(f), "dest int, prints binary, hits binary")
    return found.repartitionById(buckets, "dest").mapInArrow(tk.frugal(total), "print long, hits long")


def sets_of(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(class, n, tokens) of every text with a set; tokens packed and sorted."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, at in tk.shingle_sets(batch.column(0), width):
                n = np.diff(at)
                some = np.flatnonzero(n)
                if len(some):
                    at = np.append(at[some], at[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(class_ids(values, at)), pa.array(n[some].astype(np.int32)), tk.binary(values, at)], names=["class", "n", "tokens"])

    return docs.select(F.col(text)).mapInArrow(tk.frugal(f), "class long, n int, tokens binary")


def plausible(docs: DataFrame, rows: DataFrame, text: str, width: int, parts: int, num: int, den: int) -> Stage:
    """(class, n, tokens) of the classes whose first prefix has enough tokens that other prefixes hold, one row each."""
    some = rows.where("class is not null")
    size = some.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(parts, -(-size * 3 // (8 * GATHERED)))
    hits = met(sent(docs, text, width, buckets, num, den), buckets)
    few = "n_shingles div 8"
    wanted = some.select("class", "n_shingles", F.col("class").bitwiseAND(0xFFFFFFFF).alias("print")).distinct()
    chosen = Stage(wanted.join(hits, "print").where(f"hits >= greatest(1, {few})").select("class"))
    keep = F.broadcast(chosen.df) if chosen.df.count() <= BROADCAST_CLASSES else chosen.df
    found = sets_of(docs, text, width).join(keep, "class").groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    out = Stage(found)
    chosen.drop()
    return out


DEALT_AS = "bucket int, classes binary, sizes binary, groups binary, counts binary, tokens binary"


def packets(ids: np.ndarray, sizes: np.ndarray, groups: np.ndarray | None, tokens: np.ndarray, owner: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Deals tokens, whose owners (places in `ids`) rise, to buckets: one row for each bucket. Without groups every class is its own."""
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")  # owners stay together inside a bucket
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(tokens)))
    held, where = owner[begin], bucket[begin]
    filled = np.unique(where)
    of_rows = np.append(np.searchsorted(where, filled), len(where))
    of_tokens = np.append(np.searchsorted(bucket, filled), len(tokens))
    named = tk.binary(groups[held], of_rows) if groups is not None else pa.nulls(len(filled), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(filled, pa.int32()), tk.binary(ids[held], of_rows), tk.binary(sizes[held].astype(np.int32), of_rows), named, tk.binary(counts.astype(np.int32), of_rows), tk.binary(tokens, of_tokens)],
        names=["bucket", "classes", "sizes", "groups", "counts", "tokens"],
    )


def dealt_again(sets: DataFrame, buckets: int) -> DataFrame:
    """For some classes of (class, n, tokens, group), their shingles of one bucket, packed. Null groups: every class is its own."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                tokens, at = tk.unpacked(part.column(2), np.uint64)
                if len(tokens):
                    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                    groups = part.column(3).to_numpy() if part.column(3).null_count == 0 else None
                    yield packets(part.column(0).to_numpy(), part.column(1).to_numpy(), groups, tokens, owner, buckets)

    return sets.select("class", "n", "tokens", "group").mapInArrow(tk.frugal(f), DEALT_AS)


def by_class(owner: np.ndarray, n: np.ndarray, token: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, ...]:
    """Classes, their sizes, the bounds of their tokens, and tokens and df in that order, tokens sorted."""
    order = np.lexsort((token, owner))
    owner, n, token, df = owner[order], n[order], token[order], df[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], n[first].astype(np.int32), np.append(first, len(owner)), token, df.astype(np.int32)


def shared_tokens(dealt_out: DataFrame, parts: int) -> DataFrame:
    """(dest, classes, sizes, counts, tokens, df): shingles that classes of two or more groups hold, packed for their classes' parts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, groups, counts, tokens = [], [], [], [], []
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids.append(tk.unpacked(one.column(1), np.int64)[0])
                ns.append(tk.unpacked(one.column(2), np.int32)[0])
                groups.append(tk.unpacked(one.column(3), np.int64)[0] if one.column(3).null_count == 0 else ids[-1])
                counts.append(tk.unpacked(one.column(4), np.int32)[0])
                tokens.append(tk.unpacked(one.column(5), np.uint64)[0])
        if not tokens:
            return
        token = np.concatenate(tokens)
        del tokens
        order = np.argsort(token)
        token = token[order]
        same = np.concatenate([[False], token[1:] == token[:-1], [False]])
        some = same[1:] | same[:-1]
        order, token = order[some], token[some]
        del same, some
        entry = np.searchsorted(np.cumsum(np.concatenate(counts)), order, "right")
        owner, n, group = np.concatenate(ids)[entry], np.concatenate(ns)[entry], np.concatenate(groups)[entry]
        order = np.lexsort((owner, token))
        token, owner, n, group = token[order], owner[order], n[order], group[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner, n, group = token[new], owner[new], n[new], group[new]
        if not len(token):
            return
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.diff(np.append(first, len(token)))
        several = np.repeat(np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first), df)
        df = np.repeat(df, df)
        names, sizes, at, token, df = by_class(owner[several], n[several], token[several], df[several])
        dest = (names % parts).astype(np.int32)
        order = np.argsort(dest, kind="stable")
        k = np.diff(at)
        take = np.repeat(at[:-1][order], k[order]) + np.arange(len(token)) - np.repeat(np.cumsum(k[order]) - k[order], k[order])
        names, sizes, k, dest, token, df = names[order], sizes[order], k[order], dest[order], token[take], df[take]
        to = np.unique(dest)
        rows = np.append(np.searchsorted(dest, to), len(dest))
        cells = np.concatenate([[0], np.cumsum(k)])[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(to, pa.int32()), *(tk.binary(x, rows) for x in (names, sizes, k.astype(np.int32))), tk.binary(token, cells), tk.binary(df, cells)], names=["dest", "classes", "sizes", "counts", "tokens", "df"]
        )

    return dealt_out.repartitionById(parts, "bucket").mapInArrow(tk.frugal(f), "dest int, classes binary, sizes binary, counts binary, tokens binary, df binary")


def likely(shared: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """One row for each class that shares enough shingles to link at all: (class, n, tokens, df), tokens sorted."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            k = tk.unpacked(batch.column(3), np.int32)[0]
            owner, n = tk.unpacked(batch.column(1), np.int64)[0], tk.unpacked(batch.column(2), np.int32)[0]
            for c, v in zip(cols, (np.repeat(owner, k), np.repeat(n, k), tk.unpacked(batch.column(4), np.uint64)[0], tk.unpacked(batch.column(5), np.int32)[0]), strict=True):
                c.append(v)
        if not cols[0]:
            return
        names, n, at, token, df = by_class(*map(np.concatenate, cols))
        enough = np.flatnonzero(np.diff(at) >= overlap_of(n.astype(np.int64), num, den))
        for lo in range(0, len(enough), 1000):
            rows = enough[lo : lo + 1000]
            k = np.diff(at)[rows]
            cells = np.concatenate([[0], np.cumsum(k)])
            take = np.repeat(at[rows], k) + np.arange(cells[-1]) - np.repeat(cells[:-1], k)
            yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(n[rows]), tk.binary(token[take], cells), tk.binary(df[take], cells)], names=["class", "n", "tokens", "df"])

    return shared.repartitionById(parts, "dest").mapInArrow(tk.frugal(f), "class long, n int, tokens binary, df binary")


def pivots(sets: DataFrame, ways: range) -> DataFrame:
    """(class, way, least, held): the least hash of each class under the hashes `ways`, and how many classes hold one of its shingles in the mean."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at = tk.unpacked(batch.column(1), np.uint64)
            ids = batch.column(0).to_numpy()
            held = tk.sums(tk.unpacked(batch.column(2), np.int32)[0].astype(np.int64), at) / batch.column(3).to_numpy()
            for way in ways:
                least = np.minimum.reduceat(tk.mixed(tokens + salt(way + 1)), at[:-1]) if len(ids) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), way, np.int32)), pa.array(least.view(np.int64)), pa.array(held)], names=["class", "way", "least", "held"])

    return sets.select("class", "tokens", "df", "n").mapInArrow(tk.frugal(f), "class long, way int, least long, held double")


def prefixes(sets: DataFrame, way: int, num: int, den: int) -> DataFrame:
    """(slot, side, class, n, at): the prefix of each class in order `way`; at: the place in the whole order.

    A slot is a token's list or, where it is long, a pair of its blocks; classes of different sides meet, or all of side 2.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at = tk.unpacked(batch.column(2), np.uint64)
            df = tk.unpacked(batch.column(3), np.int32)[0]
            ids, n, k = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), np.diff(at)
            row = np.repeat(np.arange(len(ids)), k)
            rare, tie = (df, tokens) if way == 0 else (np.floor(np.log2(df)), tk.mixed(tokens + salt(way + 1000)))
            order = np.lexsort((tie, rare, row))
            place = np.arange(len(tokens)) - np.repeat(at[:-1], k) + np.repeat(n - k, k)
            ahead = place < np.repeat(n - overlap_of(n, num, den) + common(n), k)
            picked = order[ahead]
            token, blocks = tokens[picked], -(-df[picked].astype(np.int64) // SPLIT)
            copy = np.repeat(np.arange(len(picked)), blocks)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = (tk.mixed(ids[row[picked]].view(np.uint64) ^ token) % blocks.astype(np.uint64)).astype(np.int64)[copy]
            low, high = np.minimum(own, other), np.maximum(own, other)
            slot = tk.mixed(token[copy] + low.astype(np.uint64) * tk.STEP + high.astype(np.uint64) * tk.BASE)
            side = np.where(low == high, 2, own == high).astype(np.int8)
            picked, place = picked[copy], place[ahead][copy]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.view(np.int64)), pa.array(side), pa.array(ids[row[picked]]), pa.array(n[row[picked]].astype(np.int32)), pa.array(place.astype(np.int32))], names=["slot", "side", "class", "n", "at"]
            )

    return sets.mapInArrow(tk.frugal(f), "slot long, side byte, class long, n int, at int")


def pairs_across(lists: DataFrame, way: int, parts: int, num: int, den: int) -> DataFrame:
    """(dest, way, a, b, na, nb): pairs a < b of different groups that share a listed token and pass the size and position
    filters, once for each such token, with their sizes, packed by the part of a."""

    def packed_pairs(left: np.ndarray, right: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        swap = ids[left] > ids[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        dest = (ids[left] % parts).astype(np.int32)
        order = np.argsort(dest, kind="stable")
        left, right = left[order], right[order]
        to, first = np.unique(dest[order], return_index=True)
        at = np.append(first, len(left))
        columns = [tk.binary(v, at) for v in (ids[left], ids[right], n[left].astype(np.int32), n[right].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), way, np.int32)), *columns], names=["dest", "way", "a", "b", "na", "nb"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not got:
            return
        slot, side, ids, n, at, group = map(np.concatenate, zip(*got, strict=True))
        if not len(slot):
            return
        order = np.lexsort((n, slot))
        slot, side, ids, n, at, group = slot[order], side[order], ids[order], n[order].astype(np.int64), at[order].astype(np.int64), group[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        listed = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slot))))
        # sizes rise inside a list: partners of row i are those after it with n <= n_i den / num
        reach = np.searchsorted(listed << 32 | n, listed << 32 | n * den // num, "right")
        count = reach - np.arange(len(n)) - 1
        count[(np.minimum.reduceat(group, first) == np.maximum.reduceat(group, first))[listed]] = 0
        held, size = [], 0
        for lo, hi in blocks(count):
            left = np.repeat(np.arange(lo, hi), count[lo:hi])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
            need = overlap_of(n[left] + n[right], num, num + den)
            ok = (group[left] != group[right]) & ((side[left] != side[right]) | (side[left] == 2)) & (common(need) + np.minimum(n[left] - 1 - at[left], n[right] - 1 - at[right]) >= need)
            held.append((left[ok], right[ok]))
            size += len(held[-1][0])
            if size > BLOCK:
                yield packed_pairs(*map(np.concatenate, zip(*held, strict=True)), ids, n)
                held, size = [], 0
        if size:
            yield packed_pairs(*map(np.concatenate, zip(*held, strict=True)), ids, n)

    return lists.select("slot", "side", "class", "n", "at", "group").repartition(parts, "slot").mapInArrow(tk.frugal(f), "dest int, way int, a binary, b binary, na binary, nb binary")


def agreed(given: DataFrame, orders: int, parts: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs that share enough prefix tokens in every order."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            (a, at), b = tk.unpacked(batch.column(2), np.int64), tk.unpacked(batch.column(3), np.int64)[0]
            na, nb = (tk.unpacked(batch.column(k), np.int32)[0].astype(np.int64) for k in (4, 5))
            need = overlap_of(na + nb, num, num + den)
            for c, v in zip(cols, (a, b, np.repeat(batch.column(1).to_numpy(), np.diff(at)), np.minimum(common(need), need)), strict=True):
                c.append(v)
        if not cols[0]:
            return
        a, b, way, least = map(np.concatenate, cols)
        order = np.lexsort((way, b, a))
        a, b, way, least = a[order], b[order], way[order], least[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (way[1:] != way[:-1])]) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        enough = first[np.diff(np.append(first, len(a))) >= least[first]]
        a, b = a[enough], b[enough]
        last = np.flatnonzero(np.concatenate([(a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])) if len(a) else np.zeros(0, np.int64)
        all_ways = last[np.diff(np.concatenate([[-1], last])) == orders]
        yield pa.RecordBatch.from_arrays([pa.array(a[all_ways]), pa.array(b[all_ways])], names=["a", "b"])

    return given.repartitionById(parts, "dest").mapInArrow(tk.frugal(f), "a long, b long")


def blocks(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges that make about BLOCK pairs each; a row makes fewer pairs than its list has rows."""
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, "right")) - 1)
        yield lo, hi
        lo = hi


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            (xs, ax), (ys, ay) = tk.unpacked(batch.column(4), np.uint64), tk.unpacked(batch.column(5), np.uint64)
            same = np.array([len(np.intersect1d(xs[ax[i] : ax[i + 1]], ys[ay[i] : ay[i + 1]], assume_unique=True)) for i in range(len(na))], dtype=np.int64)
            ok = pa.array(den * same >= num * (na + nb - same), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    near = lambda x, y: F.col(x) * num <= F.col(y) * den
    both = pairs.join(one, "a").join(two, "b").where(near("na", "nb") & near("nb", "na"))
    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(tk.frugal(f), "a long, b long")


def weeded(sets: Stage, group, parts: int, num: int, den: int) -> tuple[Stage, int, int]:
    """Of `sets`, what shares enough shingles with other groups: (class, n, tokens, df), their number, and parts for the next turn. Drops `sets`."""
    size = sets.df.agg(F.sum("n")).first()[0] or 0
    parts = max(parts, -(-size // GATHERED))
    fewer = Stage(likely(shared_tokens(dealt_again(group(sets.df), parts), parts), parts, num, den))
    sets.drop()
    return fewer, fewer.df.count(), parts


def links(docs: DataFrame, rows: DataFrame, *, text: str = "text", width: int = 5, num: int = 75, den: int = 100, orders: int = 3) -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links. `rows`: classes() of the same texts."""
    parts = shuffle_parts(docs.sparkSession)
    sets, size, parts = weeded(plausible(docs, rows, text, width, parts, num, den), lambda df: df.withColumn("group", F.lit(None).cast("long")), parts, num, den)
    found = Stage(sets.df.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0))
    grouped = lambda df: df.withColumn("group", F.col("class"))
    for turn in range(TURNS if size else 0):
        seen = Stage(grouped(pivots(sets.df, range(turn * PIVOTS, (turn + 1) * PIVOTS))))
        first = seen.df.groupBy("way", "least").agg(F.max(F.struct("held", "class", "group")).alias("p"))
        apart = seen.df.join(first, ["way", "least"]).where(F.col("group") != F.col("p.group"))
        new = linked(apart.select(F.col("class").alias("a"), F.col("p.class").alias("b")).distinct(), sets.df, num, den)
        more = Stage(found.df.unionByName(new))
        seen.drop()
        found.drop()
        found = more
        groups = components(found.df).select(F.col("node").alias("class"), F.col("label").alias("group"))
        grouped = lambda df, groups=groups: df.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
        # only links between groups matter now, and for them a class needs enough shingles that other groups hold
        sets, size, parts = weeded(sets, grouped, parts, num, den)
        if not size:
            break
    given = None
    for way in range(orders):
        rows = grouped(prefixes(sets.df, way, num, den))
        made = pairs_across(rows, way, parts, num, den)
        given = made if given is None else given.unionByName(made)
    far = Stage(linked(agreed(given, orders, parts, num, den), sets.df, num, den))
    sets.drop()
    return found.df.unionByName(far.df)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 75, den: int = 100, orders: int = 3) -> DataFrame:
    """doc_id, n_shingles, class, component_id for every row of `docs`."""
    rows = Stage(classes(docs, doc_id, text, width))
    labels = Stage(components(links(docs, rows.df, text=text, width=width, num=num, den=den, orders=orders)))
    named = rows.df.join(labels.df.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = named.select("doc_id", "n_shingles", "class", "label")
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    own: Column = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "label", "left").select("doc_id", "n_shingles", "class", own.alias("component_id"))


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`docs` with one row of each group of linked rows: that of the smallest id, a null id last, and of rows with one id that of the smallest
    hash. Rows that are repeated as a whole are one row. Rows without a set stay, all of them. The columns are those of `docs`."""
    row = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))  # maps have no hash
    key = F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), row.alias("row"))
    found = near_duplicates(docs.select(key.alias("__row"), F.col(text)), doc_id="__row", text=text, **how).where("class is not null")
    found = Stage(found.select("doc_id.id", "doc_id.row", (F.col("doc_id") == F.col("component_id")).alias("first")))
    gone = found.df.where("not first").select(F.col("id").alias("__id"), F.col("row").alias("__row"))
    several = Stage(found.df.where("first").groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).count().where("count > 1").drop("count"))
    same = docs[doc_id].eqNullSafe(F.col("__id")) & (row == F.col("__row"))
    others = without(docs, gone.unionByName(several.df), same)
    if not several.df.count():
        return others
    once = docs.join(bounded(several.df), same).dropDuplicates(["__id", "__row"]).drop("__id", "__row")
    return others.unionByName(once)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
edge AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (WITH RECURSIVE r(node, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.node, e.b FROM r JOIN (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge) e ON r.seen = e.a)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON node = doc_id
"""
