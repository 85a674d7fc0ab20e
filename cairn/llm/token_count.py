"""Operator 8: token counts by heap-and-linked-list byte-pair merging.

A text is cut where no piece can cross (before each run of spaces, at characters
that no longer piece holds, and, in long cuts, between characters that no piece holds side by side); each cut is merged by popping the best-ranked adjacent
pair from a heap over a linked list. The count is initial symbols minus merges, and a
character outside the vocabulary counts its UTF-8 bytes. No identifier is made.

Null texts count as empty: 0 bytes, 0 tokens. Every input row gives one output row,
repeated rows and null ids included; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.shared import small_batches

SPACE = "▁"
#: Cuts up to this length are remembered; a worker forgets all of them at CACHE_CUTS.
CACHE_CHARS, CACHE_CUTS = 40, 1_000_000


class PieceCounter:
    """Counts what a sentencepiece BPE model with byte fallback and identity normalisation makes of a text."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        longer = [p for p in self.rank if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("pieces that cross a space can't be counted cut by cut")
        alone = "".join(c for c in "\n\t" if not any(c in p for p in longer))
        self.cuts = re.compile(f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+").findall
        #: Characters that stand side by side in some piece: merges cross no other border.
        self.joins = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        cuts = self.cuts(SPACE + text.replace(" ", SPACE))
        known, total = self.known, 0
        for cut in cuts:
            n = known.get(cut)
            if n is None:
                n = self.remembered(cut) if len(cut) <= CACHE_CHARS else sum(map(self.counted, self.parts(cut)))
            total += n
        return total

    def counted(self, part: str) -> int:
        n = self.known.get(part)
        return n if n is not None else self.remembered(part) if len(part) <= CACHE_CHARS else self.merge(part)

    def remembered(self, cut: str) -> int:
        if len(self.known) >= CACHE_CUTS:
            self.known.clear()
        n = self.known[cut] = self.merge(cut)
        return n

    def parts(self, cut: str) -> Iterator[str]:
        """A long cut in parts that no merge crosses."""
        joins, start = self.joins, 0
        for i in range(1, len(cut)):
            if cut[i - 1 : i + 1] not in joins:
                yield cut[start:i]
                start = i
        yield cut[start:]

    def merge(self, cut: str) -> int:
        """Symbols left of one cut. The heap holds (rank, left position, the pair's text); stale entries are skipped."""
        rank, n = self.rank, len(cut)
        symbol = list(cut)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [(rank[pair], i, pair) for i in range(n - 1) if (pair := cut[i : i + 2]) in rank]
        heapify(heap)
        left = n
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if not symbol[i] or j >= n or symbol[i] + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = pair, ""
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := pair + symbol[k]) in rank:
                    heappush(heap, (rank[right], i, right))
            if (h := before[i]) >= 0 and (joined := symbol[h] + pair) in rank:
                heappush(heap, (rank[joined], h, joined))
        return left + sum(len(s.encode()) - 1 for s in symbol if len(s) == 1 and s not in rank)


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_bytes and n_tokens of `text`."""
    small_batches(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = counter(model_file)
        for batch in batches:
            tokens = pa.array([n(x) for x in batch.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__n", *keep)), tokens], names=["n_bytes", *keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    sized = narrow.withColumn("__n", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long"))
    return sized.mapInArrow(tk.frugal(count), f"n_bytes long, {fields}, n_tokens long").select(*keep, "n_bytes", "n_tokens")
