"""Operator 7: URL rules by a cascade of Bloom filters. Built-in functions only.

A rule is a host and a path start (`example.com/en/`). It fits its host and all
subdomains where the path starts with the rule's; the longest fitting rule wins, of equal
ones that with the longer host.

The keys a URL could be listed under are its host's suffixes at dots, each with the path
cut to a length that some rule has. All such keys of the corpus are the universe. The
first filter holds the listed keys; the second the universe's keys that the first takes
wrongly; the third the listed keys that the second takes; and so on until none is
taken wrongly. A key of the universe is listed where the first filter that refuses it
is of an even level, so that membership is exact and needs no join. A second cascade
tells the blocking rules from the listed ones.

The rules are a list on the driver, with MAX_RULES as its bound; the filters grow with the
rules, and their false positives over the universe are held near the number of rules by
sizing the first filter with the universe's row count. Verdict without a rule: allow.

A null URL, or one without `://`, has an empty host and path, and no rule. Every row gives
one row; repeated rows and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import cut

MAX_RULES = 100_000
#: Verdict where no rule fits.
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @classmethod
    def read(cls, line: str) -> Rule:
        """`block example.com/en/`"""
        verdict, _, key = line.strip().partition(" ")
        host, slash, path = key.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule says allow or block: {line!r}")
        return cls(verdict, host, slash + path)


@dataclass(frozen=True)
class Bloom:
    """Bits as words of 32, tested by k positions that two halves of one 64-bit hash give."""

    seed: int
    bits: int
    k: int
    words: list[int]

    def has(self, key: Column) -> Column:
        words = F.array(*map(F.lit, self.words)) if len(self.words) < 4096 else F.from_json(F.lit(str(self.words)), "array<bigint>")
        tests = [F.getbit(F.get(words, (p / 32).cast("int")), (p % 32).cast("int")) == 1 for p in positions(key, self.seed, self.bits, self.k)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def positions(key: Column, seed: int, bits: int, k: int) -> list[Column]:
    h = F.xxhash64(F.lit(seed), key)
    low, high = F.pmod(h, F.lit(2**31)), F.pmod(F.shiftright(h, 32), F.lit(2**31))
    return [F.pmod(low + high * i, F.lit(bits)) for i in range(k)]


def build(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """A filter of the column `key`: its set words, at most `bits / 32` of them, come to the driver."""
    k = max(1, min(16, round(-math.log2(rate))))
    bits = max(32, 32 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 32))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), seed, bits, k))).alias("p"))
    words = at.groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("v"))
    out = [0] * (bits // 32)
    for r in words.collect():
        out[r.w] = r.v
    return Bloom(seed, bits, k, out)


def cascade(listed: DataFrame, others: DataFrame, n_listed: int, n_others: int, seed: int = 0) -> list[Bloom]:
    """Filters that part `listed` from `others`, exact over both; `others` must not hold listed keys."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    n_in = n_listed
    rate = min(0.5, max(1e-6, n_listed / max(1, n_others) / 2))
    while n_in:
        level = build(inside, n_in, rate, seed + len(levels))
        levels.append(level)
        taken = cut(outside.where(level.has(F.col("key"))).distinct())
        inside, outside, rate = taken, inside, 0.5
        n_in = taken.count()
        if len(levels) > 64:
            raise RuntimeError("the cascade doesn't end: a listed key is among the others")
    return levels


def member(levels: list[Bloom], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct keys, the longest first and of equal ones that with the longer host: structs of n, h, key."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths)) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(cuts, lambda c: c.isNotNull()), lambda c: F.struct(F.length(F.concat(h, c)).alias("n"), F.length(h).alias("h"), F.concat(h, c).alias("key")))))
    return F.when(host != "", F.sort_array(pairs, asc=False)).otherwise(F.filter(pairs, lambda _: F.lit(False)))


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The `keep` columns, host, path, rule, verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    verdicts: dict[str, str] = {}
    for r in rules:
        if verdicts.setdefault(r.key, r.verdict) != r.verdict:
            raise ValueError(f"{r.key} is both allowed and blocked")
    host, path = split_url(F.col(url))
    base = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not rules:
        return base.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    lengths = sorted({len(r.path) for r in rules})
    keyed = base.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    spark = pages.sparkSession
    frame = lambda keys: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))
    listed = frame(sorted(verdicts))
    universe = keyed.select(F.explode("keys.key").alias("key"))
    size = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    # the rule list has a fixed bound, so that this membership test is a constant set, not a join
    others = universe.where(~F.col("key").isin(sorted(verdicts))) if len(verdicts) <= 1000 else universe.join(listed, "key", "left_anti")
    known = cascade(listed, others, len(verdicts), size)
    blocked = [k for k, v in verdicts.items() if v == "block"]
    free = [k for k, v in verdicts.items() if v == "allow"]
    blocking = cascade(frame(blocked), frame(free), len(blocked), len(free), seed=1000)
    fits = F.filter("keys", lambda x: member(known, x["key"]))
    out = keyed.withColumn("rule", F.get(fits, F.lit(0))["key"])
    return out.select(*keep, "host", "path", "rule", F.when(F.col("rule").isNotNull() & member(blocking, F.col("rule")), "block").otherwise(DEFAULT).alias("verdict"))


#: Fixed by the query's contract.
RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")

SQL_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.key}')" for r in map(Rule.read, RULES))
ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath, rule) AS (VALUES {SQL_RULES}),
fit AS (SELECT page_id, r.* FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT page_id, arg_max(rule, (length(rule), length(rhost))) AS rule, arg_max(verdict, (length(rule), length(rhost))) AS verdict FROM fit GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""
