"""Operator 2: toxicity by a gap-weighted subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares strings by their subsequences of three letters, each weighted by DECAY to the
power of the stretch it takes, up to SPAN letters; so `idiot` and `id.xi-ot` stay near. A unit is a
word's letters, a window of WINDOW letters of a long word, or a run of single-letter words
(`i d i o t`). Labels are of whole texts: a text's score is a logistic curve over the margins of its
TOP worst words, as one plain insult is enough while milder ones must come together (multiple instances).

Training, on the driver, over a bounded sample of labelled rows (SAMPLE rows a class of at most SAMPLE_CHARS
characters, in the order of a hash): units much likelier in toxic texts start as positive, landmarks are
taken among them by their evidence and their distance from each other, the machine is fitted in the Nyström features, and each
round adds the worst units of clean texts as negatives and those like positives in missed toxic texts as positives.
The curve is fitted to margins that each half of the sample gets from a machine fitted to the other half. All whole texts are scored by the same
landmarks, whose subsequences are a table of bounded size.

Null texts count as empty and get the score of no unit at all. Without labels of both classes the score is
the share of toxic labels (0 without labels). Every row gives a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.shared import small_batches

#: Letters are told apart by so many codes: a to z have one each, others go by a hash.
LETTERS = 128
DECAY, SPAN, POWER = 0.6, 7, 3
WINDOW, STRIDE = 16, 8
LANDMARKS, ROUNDS, COST = 96, 4, 10.0
#: Words of a text that its score looks at, and the margin from which they differ from no word at all.
TOP, FLOOR = 5, -1.0
#: Weight of a toxic text beside a clean one in the curve: a missed insult is worse.
WEIGHT = 3.0
#: Likelihood ratio from which a unit counts as toxic at first, and how many of them at most start the training.
EVIDENCE, SEEDS = 20.0, 1500
#: Clean words likest to the positives that become landmarks too, so that the machine can tell them apart.
ALIKE = 32
#: Of so many of the first seeds, spellings with an inserted letter are positive too.
BENT = 30
#: Bound of the training sample: rows of a class, and characters of a row.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
#: Words whose margins a worker remembers.
CACHE_WORDS = 1_000_000
SEED = 11


@lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where subsequences of a string of n letters lie, and their weights."""
    found = [(a, b, c) for a in range(n) for c in range(a + 2, min(n, a + SPAN)) for b in range(a + 1, c)]
    a, b, c = np.array(found, dtype=np.int64).reshape(-1, 3).T
    return a, b, c, (DECAY ** (c - a + 1)).astype(np.float32)


def letter_codes(unit: str) -> np.ndarray:
    at = np.frombuffer(unit.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where((at >= 97) & (at <= 122), at - 96, 27 + ((at * 2654435761) >> 9) % (LETTERS - 27))


#: Words, as scoring cuts them too, and letters written more than twice, which count as two.
WORD, STRETCHED = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"(.)\1{2,}", re.S)


def units_of(word: str) -> list[str]:
    """A word's letters, or the windows of a long word."""
    letters = word if word.isalpha() else "".join(filter(str.isalpha, word))
    letters = STRETCHED.sub(r"\1\1", letters.lower())
    if len(letters) <= WINDOW + STRIDE // 2:
        return [letters]
    return [letters[i : i + WINDOW] for i in range(0, len(letters) - STRIDE, STRIDE)]


def features(units: list[str], by_length: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For units of one length at a time: their indices, subsequences (one row each), weights, and lengths of the feature vectors."""
    sizes = np.array([len(u) for u in units])
    for n in np.unique(sizes):
        if n < 3:
            continue
        a, b, c, weight = places(int(n))
        rows_of = np.flatnonzero(sizes == n)
        step = max(1, (1 << 16) // len(a))
        for lo in range(0, len(rows_of), step):
            rows = rows_of[lo : lo + step]
            x = letter_codes("".join(units[i] for i in rows)).reshape(len(rows), n)
            at = (x[:, a] * LETTERS + x[:, b]) * LETTERS + x[:, c]
            order = np.argsort(at, axis=1)
            sorted_at = np.take_along_axis(at, order, 1)
            new = np.ones(at.shape, dtype=bool)
            new[:, 1:] = sorted_at[:, 1:] != sorted_at[:, :-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(weight[order].ravel(), first)
            norm = np.sqrt(np.bincount(first // at.shape[1], total * total, minlength=len(rows)))
            yield rows, at, weight, norm


class Landmarks:
    """Unit feature vectors of strings, as rows of the subsequences that any of them holds."""

    def __init__(self, units: list[str]):
        self.count = len(units)
        cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, at, weight, norm in features(units):
            cells.append((at.ravel(), np.repeat(rows, at.shape[1]), (weight[None, :] / norm[:, None]).ravel()))
        at, mark, value = (np.concatenate(x) for x in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 3
        held, row = np.unique(at, return_inverse=True)
        self.table = np.zeros((len(held), self.count), dtype=np.float32)
        np.add.at(self.table, (row, mark), value)
        self.row = np.full(LETTERS**3, -1, dtype=np.int32)
        self.row[held] = np.arange(len(held))

    def kernel(self, units: list[str]) -> np.ndarray:
        """The normalised kernel of each unit with each landmark, raised to POWER (a product of kernels is one)."""
        out = np.zeros((len(units), self.count), dtype=np.float32)
        for rows, at, weight, norm in features(units):
            r, t = np.nonzero(self.row[at] >= 0)
            if not len(r):
                continue
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            got = np.add.reduceat(self.table[self.row[at[r, t]]] * weight[t][:, None], first, axis=0)
            out[rows[r[first]]] = (got / norm[r[first], None]) ** POWER
        return out


@dataclass
class Model:
    marks: Landmarks | None
    weights: np.ndarray | None
    bias: float
    curve: np.ndarray
    constant: float

    def margins(self, units: list[str]) -> np.ndarray:
        return np.full(len(units), self.bias) if self.marks is None else self.marks.kernel(units) @ self.weights + self.bias

    def scores(self, worst: np.ndarray) -> np.ndarray:
        """Scores of texts by the margins of their worst words, (texts, TOP), falling; FLOOR stands for no word."""
        if self.marks is None:
            return np.full(len(worst), self.constant)
        return 1 / (1 + np.exp(-np.clip(np.maximum(worst, FLOOR) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def worst_of(text: np.ndarray, margin: np.ndarray, texts: int) -> np.ndarray:
    """(texts, TOP): the largest margins of each text, falling, FLOOR where it has fewer above it."""
    some = np.flatnonzero(margin > FLOOR)
    order = some[np.lexsort((-margin[some], text[some]))]
    text, margin = text[order], margin[order]
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    rank = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    out = np.full((texts, TOP), FLOOR)
    kept = rank < TOP
    out[text[kept], rank[kept]] = margin[kept]
    return out


SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.*_-]+){2,}[^\W\d_](?!\S)")


def spelled(text: str) -> list[str]:
    """Runs of single letters, joined."""
    return [u for found in SPELLED.finditer(text) for u in units_of(found[0])]


def word_units(text: str) -> list[list[str]]:
    """The units of each distinct word, and each spelled-out one."""
    found = [[u for u in units_of(w) if len(u) >= 3] for w in sorted(set(WORD.findall(text.lower())))]
    return [u for u in found if u] + [[u] for u in sorted(set(spelled(text)))]


def text_units(text: str) -> set[str]:
    return {u for units in word_units(text) for u in units}


def worst_words(texts: list[str], model: Model) -> np.ndarray:
    bags = [word_units(t) for t in texts]
    every = sorted({u for bag in bags for units in bag for u in units})
    margin = dict(zip(every, model.margins(every).tolist(), strict=True))
    owner = np.array([i for i, bag in enumerate(bags) for _ in bag], dtype=np.int64)
    return worst_of(owner, np.array([max(margin[u] for u in units) for bag in bags for units in bag]), len(texts))


def hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20) -> np.ndarray:
    """Dual coordinate descent for a linear machine; the last feature is the bias."""
    rng = np.random.default_rng(SEED)
    w, alpha, size = np.zeros(x.shape[1]), np.zeros(len(y)), np.maximum((x * x).sum(1), 1e-9)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / size[i], 0.0), cost[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


def apart(units: list[str], worth: np.ndarray, count: int) -> list[str]:
    """Greedily, the unit of most worth times its distance from those taken before; ties by order."""
    alike = Landmarks(units).kernel(units)
    near = np.zeros(len(units))
    taken: list[int] = []
    for _ in range(min(count, len(units))):
        gain = worth * np.maximum(0, 1 - near)
        i = int(np.argmax(gain))
        if gain[i] <= 1e-3 * worth.max():
            break
        taken.append(i)
        near = np.maximum(near, alike[:, i])
    return [units[i] for i in taken]


def evidence(k: np.ndarray, pos: int, m: np.ndarray, neg: int) -> np.ndarray:
    """Likelihood ratio statistic of k of `pos` against m of `neg` texts, signed by which share is larger."""

    def part(hit, n, share):
        return hit * np.log(np.maximum(share, 1e-12)) + (n - hit) * np.log(np.maximum(1 - share, 1e-12))

    p, q, both = k / pos, m / neg, (k + m) / (pos + neg)
    return np.sign(p - q) * 2 * (part(k, pos, p) + part(m, neg, q) - part(k, pos, both) - part(m, neg, both))


def likelier(bags: list[list[str]], toxic: list[int]) -> dict[str, float]:
    """Units that significantly more toxic texts hold, or whose start of 4 or 5 letters they hold, and no clean text; with their evidence."""
    inside: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, label in zip(bags, toxic, strict=True):
        inside[label].update({f"{u[:n]}{'' if n == 0 else '*'}" if n else u for u in bag for n in (0, 4, 5) if n == 0 or len(u) > n})
    keys = sorted(inside[1])
    pos = sum(toxic)
    g = evidence(np.array([inside[1][k] for k in keys], float), pos, np.array([inside[0][k] for k in keys], float), len(toxic) - pos)
    strong = {k: v for k, v in zip(keys, g.tolist(), strict=True) if v > EVIDENCE}
    out = {}
    for u in sorted({u for bag, label in zip(bags, toxic, strict=True) if label for u in bag}):
        found = [strong[k] for k in (u, f"{u[:4]}*", f"{u[:5]}*") if k in strong and inside[0][k] * 20 <= inside[1][k]]
        if found and not inside[0][u]:
            out[u] = max(found)
    return out


def curve_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on worst margins, none of which speaks against toxicity; toxic texts count WEIGHT times. The last coefficient is the constant."""
    often = np.where(y == 1, WEIGHT, 1.0)
    x = np.concatenate([np.maximum(x, FLOOR), np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    active = np.ones(x.shape[1], dtype=bool)
    for _ in range(x.shape[1]):
        w[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, active] @ w[active], -30, 30)))
            slope = x[:, active].T @ (often * (y - p)) - 1e-2 * w[active]
            bend = (x[:, active] * (often * p * (1 - p))[:, None]).T @ x[:, active] + 1e-2 * np.eye(active.sum())
            step = np.linalg.solve(bend, slope)
            w[active] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        against = np.flatnonzero((w[:-1] < 0) & active[:-1])
        if not len(against):
            break
        active[against] = False
        w[against] = 0
    return w


def nystroem(units: list[str]) -> tuple[Landmarks, np.ndarray]:
    """Landmarks, and the root that turns kernels with them into features."""
    marks = Landmarks(units)
    values, vectors = np.linalg.eigh(marks.kernel(units).astype(np.float64))
    return marks, vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T


def constant(y: np.ndarray) -> Model:
    return Model(None, None, 0.0, np.zeros(TOP + 1), float(y.mean()) if len(y) else 0.0)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The machine of all texts, and the curve of margins across two halves."""
    y = np.array(toxic, dtype=np.int64)
    model = machine(texts, toxic)
    if model.marks is None:
        return model
    half = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    x = np.zeros((len(y), TOP))
    for here in (half, ~half):
        other = machine([t for t, h in zip(texts, here, strict=True) if not h], y[~here].tolist())
        x[here] = worst_words([t for t, h in zip(texts, here, strict=True) if h], model if other.marks is None else other)
    return Model(model.marks, model.weights, model.bias, curve_of(x, y), 0.0)


def machine(texts: list[str], toxic: list[int]) -> Model:
    """The fitted margins, yet without a curve."""
    y = np.array(toxic, dtype=np.int64)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return constant(y)
    bags = [sorted(text_units(t)) for t in texts]
    worth = likelier(bags, toxic)
    df: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, label in zip(bags, toxic, strict=True):
        df[label].update(bag)
    held = {u for bag, label in zip(bags, toxic, strict=True) if not label for u in bag}
    if not worth:  # too few labels for evidence: every unit that only toxic texts hold
        counts = Counter(u for bag, label in zip(bags, toxic, strict=True) if label for u in bag if u not in held)
        worth = {u: float(k) for u, k in counts.items() if k == max(counts.values(), default=0)}
    seeds = sorted(worth, key=lambda u: (-worth[u], u))[:SEEDS]
    if not seeds:
        return constant(y)
    rng = np.random.default_rng(SEED)
    clean = sorted(held)
    clean = [clean[i] for i in rng.permutation(len(clean))[:3000]] or [""]
    chosen = apart(seeds, np.array([worth[u] for u in seeds]), LANDMARKS * 3 // 4)
    chosen += apart(clean[:400], np.ones(len(clean[:400])), LANDMARKS - len(chosen))
    for u in seeds[:BENT]:
        for _ in range(2):
            i = int(rng.integers(1, len(u)))
            bent = u[:i] + chr(97 + int(rng.integers(26))) + u[i:]
            if bent not in held:
                df[1][bent] += df[1][u] // 10
                worth.setdefault(bent, 0.0)
    marks, root = nystroem(chosen)
    positives, negatives = dict.fromkeys([*seeds, *sorted(u for u in worth if not worth[u])]), dict.fromkeys(clean)
    negatives[""] = None  # half of the clean weight: what is like no landmark is clean
    df[0][""] = sum(df[0].values())
    every = sorted({u for bag in bags for u in bag})
    place = {u: i for i, u in enumerate(every)}
    model = constant(y)
    for turn in range(ROUNDS):
        units = [*positives, *(u for u in negatives if u not in positives)]
        goal = np.where(np.arange(len(units)) < len(positives), 1.0, -1.0)
        x = np.concatenate([marks.kernel(units) @ root, np.ones((len(units), 1))], 1)
        often = np.array([df[0 if g < 0 else 1][u] for u, g in zip(units, goal, strict=True)], dtype=float) + 1
        often /= np.where(goal > 0, often[goal > 0].sum(), often[goal < 0].sum())
        w = hinge(x, goal, COST * len(units) * often)
        model = Model(marks, (root @ w[:-1]).astype(np.float32), float(w[-1]), np.zeros(TOP + 1), 0.0)
        margin = model.margins(every)
        worst = [max(bag, key=lambda u: margin[place[u]], default=None) for bag in bags]
        if not turn:
            alike = sorted((u for u in held if margin[place[u]] > -0.5), key=lambda u: (-margin[place[u]] * (1 + df[0][u]), u))[:ALIKE]
            marks, root = nystroem([*chosen, *(u for u in alike if u not in chosen)])
        if turn < ROUNDS - 1:
            for u, label in zip(worst, toxic, strict=True):
                if u is None:
                    continue
                if label and 0 < margin[place[u]] < 1 and u not in held:
                    positives[u] = None
            for bag, label in zip(bags, toxic, strict=True):
                if not label:
                    negatives.update(dict.fromkeys(u for u in bag if margin[place[u]] > -0.5))
    return model


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Joins a sample of labels to their texts; rows without an id, a text or a 0/1 label aren't used."""
    usable = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(toxic).cast("int").alias("__toxic")).distinct()
    picked = [usable.where(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE) for label in (1, 0)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 SAMPLE rows of an id and a label
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(sample, "__id")
    rows = sorted((-r.toxic, r.text) for r in joined.where(F.length("text") <= SAMPLE_CHARS).select(F.col("__toxic").alias("toxic"), "text").collect())
    return fit([t for _, t in rows], [-label for label, _ in rows])


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with score: the toxicity of each whole text."""
    small_batches(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, value = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            texts = tk.filled(batch.column("__text"))
            worst = np.full((len(texts), TOP), FLOOR)
            for a, b in tk.runs(texts) if model.marks is not None else ():
                part = texts.slice(a, b - a)
                data, at = tk.chars(part)
                starts, ends, first = tk.word_spans(tk.LOWER[data], at)
                if not len(starts):
                    continue
                names, one, back = np.unique(tk.word_hashes(tk.LOWER[data], starts, ends), return_index=True, return_inverse=True)
                if len(known) > CACHE_WORDS:
                    known, value = np.zeros(0, np.uint64), np.zeros(0)
                spot = np.searchsorted(known, names)
                there = np.zeros(len(names), dtype=bool)
                inside = spot < len(known)
                there[inside] = known[spot[inside]] == names[inside]
                new = np.flatnonzero(~there)
                raw = data.tobytes()
                units, owner = [], []
                for k, i in enumerate(one[new].tolist()):
                    for u in units_of(raw[starts[i] : ends[i]].decode()):
                        units.append(u)
                        owner.append(k)
                most = np.full(len(new), -np.inf)
                np.maximum.at(most, np.array(owner, dtype=np.int64), model.margins(units))
                known, value = np.insert(known, spot[new], names[new]), np.insert(value, spot[new], most)
                each = value[np.searchsorted(known, names)]
                bad = np.flatnonzero(each[back] > FLOOR)  # a word of a text counts once
                pairs = np.unique((np.searchsorted(first, bad, "right") - 1) << 32 | back[bad])
                text, margin = pairs >> 32, each[pairs & 0xFFFFFFFF]
                spelt, owner = [], []  # any text may spell, as in training
                for d, t in enumerate(part.to_pylist()):
                    found = sorted(set(spelled(t)))
                    spelt += found
                    owner += [d] * len(found)
                if spelt:
                    text, margin = np.append(text, np.array(owner, dtype=np.int64)), np.append(margin, model.margins(spelt))
                worst[a:b] = worst_of(text, margin, b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.scores(worst), pa.float64())], names=[*keep, "score"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in narrow.schema if x.name != "__text")
    return narrow.mapInArrow(tk.frugal(f), f"{fields}, score double")
