"""Quality rules: text statistics, and a decision list learned from labelled ones."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import fold, map_arrow, text_bytes

#: The characters that count as symbols, and white space.
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test besides: shares and means over the words of a text.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share", "pipe_share", "end_share", "short_share")


def _repeats(codes: np.ndarray, window: int = 5) -> int:
    """Words that lie in windows found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = (h ^ codes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of `keep`), the counts of BASE and the shares of FEATURES for every whole text, in one pass.

    Words are runs of anything but ASCII white space; null text has none, and all its figures are 0. Other columns
    are ignored; repeated rows give repeated rows.
    """
    names = keep or ["doc_id"]
    clash = {c.lower() for c in names} & {*BASE, *FEATURES}
    if clash:
        raise ValueError(f"columns named like statistics: {sorted(clash)}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    schema = f"{fields}, " + ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES if c not in BASE)

    def per_slice():
        # a word's 64-bit code: its number times an odd constant; numbers are kept for a bounded set of words
        numbers: dict[bytes, int] = {}
        upper, punct = bytes(range(65, 91)), b".,;:!?'\"()-"

        def apply(batch: pa.RecordBatch) -> dict:
            if len(numbers) > 300_000:
                numbers.clear()
            out: dict[str, list] = {c: [] for c in (*BASE, *(f for f in FEATURES if f not in BASE))}
            for text in text_bytes(batch):
                words = text.split()
                n = len(words)
                for w in (distinct := set(words)):
                    if w not in numbers:
                        numbers[w] = len(numbers) + 1
                codes = np.fromiter(map(numbers.__getitem__, words), np.uint64, n) * np.uint64(0xD6E8FEB86659FD93)
                size = len(text) - len(text.translate(None, bytes(range(128, 192))))  # continuation bytes
                chars = len(text) - size - sum(map(text.count, (bytes([c]) for c in SPACE)))
                symbols = len(text) - len(text.translate(None, SYMBOLS))
                dup, lines, repeat = _dup_lines(text), text.count(b"\n") + 1, _repeats(codes)
                per = 1.0 / max(1, n)
                share = 1.0 / max(1, chars)
                for k, v in (
                    ("n_words", n), ("word_chars", chars), ("n_symbols", symbols), ("n_dup_lines", dup), ("n_repeat_words", repeat),
                    ("mean_word", chars * per), ("symbol_share", symbols * share), ("dup_line_share", dup / lines), ("repeat_share", repeat * per),
                    ("distinct_share", len(distinct) * per), ("upper_share", (len(text) - len(text.translate(None, upper))) * share), ("digit_share", (len(text) - len(text.translate(None, b"0123456789"))) * share),
                    ("punct_share", (len(text) - len(text.translate(None, punct))) * share), ("pipe_share", text.count(b"|") * share), ("end_share", (text.count(b". ") + text.count(b".\n") + text.count(b"!")) * per), ("short_share", sum(len(w) < 3 for w in words) * per),
                ):
                    out[k].append(v)
            return {c: batch.column(c) for c in names} | out

        return apply

    return map_arrow(docs.select(*(names if "text" in names else [*names, "text"])), per_slice, schema, "text")


@dataclass
class Rule:
    """A conjunction of (feature, ">=" or "<=", threshold); what it covers is rejected."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, sign, at in self.tests:
            v = x[:, FEATURES.index(name)]
            hit &= v >= at if sign == ">=" else v <= at
        return hit

    def condition(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & (F.col(name) >= F.lit(at) if sign == ">=" else F.col(name) <= F.lit(at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.tests)


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Add the test of the greatest information gain until nothing good is covered or nothing is gained."""
    rule, live = Rule(), np.ones(len(x), bool)
    for _ in range(most):
        p, n = int(bad[live].sum()), int((~bad[live]).sum())
        if n == 0 or p == 0:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for f in range(x.shape[1]):
            v, y = x[live, f], bad[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            below_p = np.cumsum(y)[cuts]
            below = cuts + 1
            middle = (v[cuts] + v[cuts + 1]) / 2
            for sign, pos, total in (("<=", below_p, below), (">=", p - below_p, p + n - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / total) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (FEATURES[f], sign, float(middle[k])))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        live = rule.covers(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop final tests as long as (bad - good) / covered doesn't fall on rows that didn't grow the rule."""

    def worth(r: Rule) -> float:
        hit = r.covers(x)
        return (2.0 * bad[hit].sum() - hit.sum()) / max(1, hit.sum()) if r.tests else -1.0

    options = [Rule(rule.tests[:k]) for k in range(len(rule.tests), 0, -1)]
    return max(options, key=worth) if options else rule


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.95, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on one third, keep while the rule is precise on both; drop what it covers."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    while len(x) >= 12 and bad.any() and len(rules) < most_rules:
        part = rng.random(len(x)) < 2 / 3
        rule = _prune(_grow(x[part], bad[part], most_tests), x[~part], bad[~part])
        hit = rule.covers(x) if rule.tests else np.zeros(len(x), bool)
        if hit.sum() < 3 or bad[hit].mean() < precision:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, folds: int = 5) -> list[Rule]:
    """Learn from at most most_rows labelled rows, the first by a hash of doc_id; rows with crc32(doc_id) mod folds = 0 stay out.

    No labels, or labels of one class, give an empty list: nothing is rejected. Of labels that contradict each other
    the lowest counts. What is learnt doesn't depend on how the rows are dealt.
    """
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "_quality"]).toPandas().sort_values(["doc_id", *FEATURES])
    return learn(rows[list(FEATURES)].to_numpy(float), rows["_quality"].to_numpy() == 0) if len(rows) else []


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false for what the first matching rule rejects, else true."""
    out = None
    for rule in rules:
        out = (F.when if out is None else out.when)(rule.condition(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """doc_id, the BASE counts, base_failed, kept and the number of the rule that rejects (0: none) for every document.

    Null texts have no words and fail; repeated rows come out repeatedly; a null doc_id stays null; an empty table
    gives an empty one. A very long text is counted whole by one task.
    """
    rules = fit(docs, labels, most_rows)
    number = None
    for i, rule in enumerate(rules):
        number = (F.when if number is None else number.when)(rule.condition(), F.lit(i + 1))
    number = F.lit(0) if number is None else number.otherwise(F.lit(0))
    return statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), number.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """The documents that neither fail the base rules nor match a learned one, with all their columns; text passes through once.

    Null and empty texts have fewer than ten words and go; repeated rows stay or go together; columns may have any names.
    """
    # the columns of documents may be named like statistics: n_words and the like are renamed on the way
    renamed = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rules = fit(docs, labels, most_rows)
    carried = docs.select(*[F.col(c).alias(renamed.get(c, c)) for c in docs.columns])
    good = statistics(carried, carried.columns).where(~base_failed() & verdict(rules))
    return good.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])
