"""The corpus operators against brute force, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import chat, context_tree, frames, lexicon, packing, quality_model, rule_list, sharding, shingle_join, weighted_print
from recordloom.llm.common import tokenizer_path, word_codes
from recordloom.llm.components import connected
from recordloom.llm.encoders import WordEncoder

SCHEMA = "doc_id bigint, text string, n bigint, length bigint, sid bigint, row bigint, _b int"


def corpus(seed=3, size=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(80)]
    texts = []
    for i in range(size):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(texts[-1])  # a copy
        elif kind == 2 and texts[-1]:
            w = texts[-1].split()
            w[rng.randrange(len(w)) :][:1] = ["new"]
            texts.append(" ".join(w))
        elif kind == 5:
            texts.append(rng.choice([None, "", " \n\t ", "one", "A  b\n c  ", "<|endoftext|> x", "I'll  </s>[INST] \\ ok [/INST]"]))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(3, 90))) + rng.choice(["", ".", "\n", " !!"]))
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, 3, 4, 5) for i, t in corpus()]
    return spark.createDataFrame([*rows, (None, "null key", 1, 2, 3, 4, 5), rows[0], rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _check_bins(rows, bins):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= bins.tokens and len(items) <= bins.documents and sum(n * n for _, n in items) <= bins.attention
    return len(by)


@pytest.mark.parametrize("rule", packing.RULES)
def test_packing(docs, empty, rule):
    """Every piece of every document by the tokenizers library, under all three capacities, by both rules."""
    bins = packing.Bin(tokens=64, documents=5, attention=3000)
    rows = packing.pack(packing.pieces(docs, capacity=48), (bins,), (rule,)).collect()
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id if r.doc_id is not None else -1, k // 48, k, len(ids[k : k + 48]), zlib.crc32(np.array(ids[k : k + 48], "<u4").tobytes())) for k in range(0, len(ids), 48)]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    _check_bins(rows, bins)
    assert packing.pack_documents(empty).count() == 0


def test_words_of_letters_need_no_separators(monkeypatch):
    """Words of A to Z alone are parted by the tokens that end them; ids are those of each text by itself."""
    encoder, read = WordEncoder("word_bpe_49k.json"), []
    plain = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: (read.append(text), plain(text))[1])
    texts = ["", " Some words, somewords.\t", "it's I'll x1 y2z \u00e9t\u00e9 | a|b", "<|endoftext|> Some", "thingering ofthing\x0bnotion " * 3, "b" * 300]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert any("thingering" in t for t in read) and not any("|" in t for t in read if "thingering" in t)


def test_best_fit_serves_bins_one_by_one():
    """Runs of equal bins give what serving every piece alone gives, by either rule."""
    rng = random.Random(8)
    bins = packing.Bin(40, 6, 900)
    for rule, weights in packing.RULES:
        lengths = sorted((rng.randint(1, 30) for _ in range(300)), reverse=True)
        rooms = []
        for n in lengths:
            need = (n, 1, n * n)
            fits = [r for r in rooms if all(a >= b for a, b in zip(r, need, strict=True))]
            if not fits:
                rooms.append([bins.tokens - n, bins.documents - 1, bins.attention - n * n])
                continue
            cap = (bins.tokens, bins.documents, bins.attention)
            if rule == packing.NORM:
                best = min(fits, key=lambda r: sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, r, need, cap, strict=True)))
            else:
                best = max(fits, key=lambda r: sum(w * a / c * b / c for w, a, b, c in zip(weights, r, need, cap, strict=True)))
            best[:] = [a - b for a, b in zip(best, need, strict=True)]
        plan = packing.best_fit({n: lengths.count(n) for n in set(lengths)}, bins, weights, rule)
        assert packing.bins_of(plan) <= len(rooms) + 1 and plan[:, 2].sum() == 300
    assert len(packing.best_fit({5: 100_000}, bins, rule=packing.DOT)) < 20


def test_tight_capacities_cost_no_sequence():
    histogram = {1: 5000, 3: 4000, 700: 30, 2048: 3}
    bins, plan = packing.best_plan(histogram)
    assert packing.bins_of(plan) == min(packing.bins_of(packing.best_fit(histogram, b)) for b in packing.BINS)
    wide = packing.best_plan({900: 10, 5: 100})
    assert wide[0].documents == 256


def test_encoding(docs, empty):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = lexicon.encode_documents(docs, lexicon_words=20).collect()
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert lexicon.encode_documents(empty).count() == 0


def test_words_met_again_are_not_merged_again(monkeypatch):
    """Words of the lexicon are taken from it once, others that come again soon are merged once; odd texts are split as ever."""
    merges = lexicon.Merges("byte_bpe_50k.json")
    lasting = {f" lasting{c}".encode(): merges.encode(f" lasting{c}") for c in "abcde"}
    encoder = lexicon.Encoder(merges, lexicon.Transducer.compile(lasting), cache_words=60)
    learnt, plain = Counter(), lexicon.Encoder._learn
    monkeypatch.setattr(lexicon.Encoder, "_learn", lambda self, words: (learnt.update(words), plain(self, words))[1])
    often = [f"often{c}" for c in "vwxyz"]
    odd = ["", " x  y ", "a\u00a0b c\x1c d", "<|endoftext|> lastinga oftenv.", "vw\n\nq oftenv\noften?! l'\u00e9t\u00e9 \u0661\u0662 x"]
    texts = [" ".join(["so", *often, *(w.decode().strip() for w in lasting), *(f"once{chr(97 + i // 26)}{chr(97 + i % 26)}{c}." for c in "klmnop")]) for i in range(60)]
    texts[7:7], texts[50:50] = odd, odd
    for at in range(0, len(texts), 2):
        for text, (ids, raw) in zip(texts[at : at + 2], encoder.batch([t.encode() for t in texts[at : at + 2]]), strict=True):
            assert [int(i) for i in ids.split(",") if i] == merges.encode(text) and raw == text.encode()
    assert {learnt[w.encode()] for w in often} | {learnt[w.strip()] for w in lasting} == {1}


def test_sharding(docs, empty):
    """Shards by the hash's definition; sizes and checksums of the texts; slots without gaps; growth takes rows into the new shard alone."""
    weights = [1.0, 2.0, 0.0]

    def shard(doc_id, weights):
        key = xxhash.xxh64_intdigest("null" if doc_id is None else str(doc_id), 42)
        us = [((xxhash.xxh64_intdigest(struct.pack("<i", k), key) >> 11) + 0.5) / 2**53 for k in range(len(weights))]
        return min((-math.log(u) / w, k) for k, (u, w) in enumerate(zip(us, weights, strict=True)) if w)[1]

    rows = sharding.shard_documents(docs, weights).collect()
    want = []
    for d in docs.collect():
        data = (d.text or "").encode()
        want.append((d.doc_id or -1, len(data) + 1, zlib.crc32(data), shard(d.doc_id, weights), shard(d.doc_id, [*weights, 1.0])))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == sorted(want)
    for k in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(r.grown_shard in (r.shard, 3) and r.law == "key" for r in rows)
    assert sharding.shard_documents(empty, [1.0] * 4).count() == 0


def test_sharding_keeps_to_the_weights(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    shares = Counter(r.shard for r in sharding.shard_documents(many, [1.0, 3.0, 2.0]).collect())
    assert all(abs(shares[k] / 6000 - w / 6) < 0.03 for k, w in enumerate((1, 3, 2)))


def test_fingerprints(docs, empty):
    """Edited texts, lengths and likenesses by hand; equal texts have equal fingerprints."""
    rows = weighted_print.fingerprints(docs).collect()
    assert len(rows) == docs.count()
    distinct = dict(corpus())
    order = sorted(distinct)
    by = {r.doc_id: r for r in rows}

    def like(a, b):
        return sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (len(a) / 8)

    for i, doc in enumerate(order):
        r, text = by[doc], distinct[doc] or ""
        # rows[0] stands three times: the next document of its last copy is the second, of the others itself
        follows = [distinct[order[(i + 1) % len(order)]] or "", text] if doc == order[0] else [distinct[order[(i + 1) % len(order)]] or ""]
        half = len(text) // 2
        assert r.n_chars == len(text)
        assert r.edited_sha256 in {hashlib.sha256((text[: len(text) - half] + f[:half]).encode()).hexdigest() for f in follows} or i == len(order) - 1
        assert abs(r.near_edited - like(r.fingerprint, r.edited_fingerprint)) < 1e-12
        if 0 < i < len(order) - 1:
            assert abs(r.near_next - like(r.fingerprint, by[order[i + 1]].fingerprint)) < 1e-12
    same = {}
    for i, t in corpus():
        same.setdefault(t or "", set()).add(by[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert weighted_print.fingerprints(empty).count() == 0


def test_texts_are_split_once(spark, docs):
    """The regular expression stands once in the plan, not in every place that names the words."""
    plan = weighted_print.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bsplit\([^,]*_text", plan)) == 1


def test_collision_rate(spark):
    """The share of equal samples against the generalised Jaccard similarity."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    pairs = []
    for k in range(40):
        a = rng.sample(words, 200)
        pairs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:100] + rng.sample(words, 100)))]
    rows = sorted(weighted_print.fingerprints(spark.createDataFrame(pairs, "doc_id bigint, text string"), 64).collect(), key=lambda r: r.doc_id)

    def terms(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    gap = [rows[2 * k].near_next - len(terms(pairs[2 * k][1]) & terms(pairs[2 * k + 1][1])) / len(terms(pairs[2 * k][1]) | terms(pairs[2 * k + 1][1])) for k in range(40)]
    assert abs(np.mean(gap)) < 0.03


class PlainTree:
    """Context-tree weighting over counts in dictionaries, by the definition: a symbol's probability is the quotient of two P_w."""

    def __init__(self):
        self.counts, self.below, self.weighted = {}, {}, {}

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def add(self, path, bit):
        """path: (node, context) from the empty context to the longest."""
        for up, at in zip([None, *path], path):
            self.counts.setdefault(at, [0, 0])[bit] += 1
            if up is not None:
                self.below.setdefault(up, set()).add(at)

    def mixed(self, at):
        if at not in self.weighted:
            own = self.kt(*self.counts[at])
            self.weighted[at] = np.logaddexp(own, sum(self.mixed(x) for x in self.below[at])) - math.log(2) if at in self.below else own
        return self.weighted[at]

    def one(self, path):
        """Probability of a one behind the longest context of path."""
        inner = 0.0  # by how much the log of P_w of the longer contexts grows
        for i in reversed(range(len(path))):
            at = path[i]
            a, b = self.counts.get(at, (0, 0))
            if at not in self.below and i + 1 < len(path) or at not in self.counts:
                inner = math.log(0.5) if at not in self.counts else self.kt(a, b + 1) - self.kt(a, b)
                continue
            grown = self.kt(a, b + 1)
            if at in self.below:
                grown = np.logaddexp(grown, sum(self.mixed(x) for x in self.below[at]) + inner) - math.log(2)
            inner = grown - self.mixed(at)
        return math.exp(inner)


def _paths(word, c):
    """For each byte of a word behind class c with its blank its eight (bit, path)."""
    data = bytes([context_tree.CLASS_BYTE + c]) + b" " + (word + b" " if word else context_tree.END)
    for i in range(2, len(data)):
        node = 1
        for shift in range(7, -1, -1):
            bit = data[i] >> shift & 1
            yield bit, [(node, data[i - d : i]) for d in range(min(i, context_tree.DEPTH) + 1)]
            node = 2 * node + bit


@pytest.mark.parametrize("head", [200_000, 3])
def test_context_tree(docs, head, monkeypatch):
    """Counts and base scores by plain counting; scores by a plain tree of every context; none depend on the partitioning."""
    monkeypatch.setattr(context_tree, "FREQUENT", 20)
    rows = [(d.doc_id, (d.text or "").encode().lower().split()) for d in docs.collect()]
    learnt = [w for i, w in rows if i is None or i % 2 == 0]
    counts = Counter(x for w in learnt for x in [*w, b""])
    often = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:20]
    number, follow = {w: i for i, w in enumerate(often)}, np.zeros((20, 20))
    for w in learnt:
        for x, y in zip(w, w[1:]):
            if x in number and y in number:
                follow[number[x], number[y]] += 1
    classes = context_tree.form_classes(often, follow)

    def places(w):
        now = context_tree.CLASSES
        for x in [*w, b""]:
            yield x, now
            now = classes.get(x, now)

    tree = PlainTree()
    for w in learnt:
        for x, c in places(w):
            for bit, path in _paths(x, c):
                tree.add(path, bit)
    total, distinct, known = sum(counts.values()), len(counts), {}

    def word(x, c):
        if (x, c) not in known:
            known[x, c] = sum(math.log10(p if bit else 1 - p) for bit, p in ((bit, tree.one(path)) for bit, path in _paths(x, c)))
        return known[x, c]

    want = sorted((-1 if i is None else i, len(w) + 1, sum(counts[x] > 0 for x in [*w, b""]), sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in [*w, b""]), sum(word(x, c) for x, c in places(w))) for i, w in rows)
    train = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    for parts in (1, 7):
        got = context_tree.score(docs.repartition(parts), train, head).collect()
        assert {r.train_tokens for r in got} == {total}
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-7)


def test_word_codes_are_plain_splits():
    texts = ["", None, " ", " A b", "b\x0b\x0cC \n", "\x1cx\x85 \u00a0É", "b" * 300 + "\t\tb", "a"]
    codes, sizes, words = word_codes(pa.record_batch({"text": pa.array(texts)}))
    got = iter([words[c].as_py() for c in codes.tolist()])
    assert [[next(got) for _ in range(n)] for n in sizes.tolist()] == [[*(t or "").encode().lower().split(), b""] for t in texts]
    assert next(got, None) is None


def test_common_words_forget_none_that_is_common(monkeypatch):
    """Words at the very limit, in one part or in all, are candidates however chunks are cut."""
    rng = random.Random(5)
    words = ["edge"] * 40 + ["late"] * 40 + [f"w{rng.randrange(3000)}" for _ in range(39 * 100 + 20)]
    head, tail = words[:40] + words[80:], words[40:80]
    rng.shuffle(head)
    texts = [" ".join(head[i : i + 50]) for i in range(0, len(head), 50)] + [" ".join(tail)]
    run = _per_slice(monkeypatch, lambda docs: context_tree.common_words(docs, 100, 300))
    for text in texts:
        run(pa.record_batch({"text": [text]}))
    (found,) = run.finish()
    often = {w.encode() for w, n in Counter(words).items() if n * 100 >= len(words)}
    assert {b"edge", b"late"} <= often <= set(found["word"].to_pylist()) and len(found["word"]) <= 8 / 7 * 100


def _per_slice(monkeypatch, call):
    """The function from slices to columns that a pass of the context tree hands to map_arrow."""
    held = []

    def catch(df, per_slice, *_, **__):
        held.append(per_slice())
        raise StopIteration

    monkeypatch.setattr(context_tree, "map_arrow", catch)
    with pytest.raises(StopIteration):
        call(SimpleNamespace(select=lambda *_: None))
    return held[0]


def test_counting_words_costs_a_few_splits(monkeypatch):
    """Rare words cost no Python object each: with many of them the pass took five times as long as splitting the texts."""
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 10**9}x" for _ in range(400)) for _ in range(512)]
    batch = pa.record_batch({"text": texts, "train": [True] * 512})
    raw = [t.encode() for t in texts]
    split, count = [], []
    for _ in range(3):
        at = time.process_time()
        for _ in range(4):
            assert [t.lower().split() for t in raw]
        split.append(time.process_time() - at)
        run = _per_slice(monkeypatch, lambda docs: context_tree.class_counts(docs, {b"w1x": 0}))
        at = time.process_time()
        for _ in range(4):
            run(batch)
        rows = [pa.record_batch([pa.array(x[c]) for c in ("word", "class", "n")], ["word", "class", "n"]) for x in run.finish()]
        count.append(time.process_time() - at)
        assert sum(r.column("n").to_numpy().sum() for r in rows) == 4 * 512 * 401
    assert min(count) < 3.4 * min(split)


def test_context_tree_of_nothing(docs, empty):
    assert context_tree.score_documents(empty).count() == 0
    untrained = context_tree.score(docs.where("doc_id < 12"), F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in untrained} == {(0, 0)} and all(abs(r.base_score) < 1e-9 for r in untrained)


def test_rules_and_classifier(spark, empty):
    rows = [(i, ("good words make a fine and plain text number " + str(i)) if i % 3 else "junk### junk### $$$ %%% &&& junk### !!! *** ### ###", 1) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    kept = {r.doc_id for r in rule_list.keep_good(docs, labels).collect()}
    assert all((i in kept) == (i % 3 > 0) for i in held if i % 3 == 0 or i in kept)
    scores = {r.doc_id: r.predicted for r in quality_model.classify(docs, labels).collect()}
    assert np.mean([scores[i] == (i % 3 > 0) for i in held]) > 0.95
    nothing = labels.where("false")
    assert quality_model.classify(docs, nothing).count() == 300 and rule_list.judge(empty, labels).count() == 0
    assert rule_list.keep_good(docs, nothing).columns == docs.columns


def plain_counts(text):
    """The base counts of quality rules, by the words of their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rule_counts(spark, docs):
    rng = random.Random(21)
    more = ["a b c d e f\n" * 4, "x\n\n x\nx\n \t\nx", "one two three four five six seven eight nine ten # $ & <b> | *", "é " * 9 + "ü%", " ".join(rng.choices(["p", "q"], k=60)), "tail\x0bof\x0cit\r\nand\x1cno blank"]
    frame = spark.createDataFrame([(900 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(900, 1), (901, 0), (901, 1), (None, 0), (902, None)], "doc_id bigint, quality int")
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rule_list.judge(frame, labels).collect())
    want = []
    for d in frame.collect():
        c = plain_counts(d.text)
        want.append((d.doc_id or -1, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want)
    kept = rule_list.keep_good(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(not w[-1] for w in want)


def test_classifier_scores_by_hand(spark, docs):
    """Scores by each text's bag of buckets; nulls, repeated rows, missing ids and contradicting labels."""
    frame = docs.select("doc_id", "text")
    labels = spark.createDataFrame([*[(i, i // 3 % 2) for i in range(0, 180, 3)], (0, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    shape = quality_model.Shape(buckets=512)
    model = quality_model.fit(frame, labels, shape=shape)
    features = quality_model.Features(shape)
    want = {}
    for d in frame.collect():
        ids, share = features.bag((d.text or "").encode())
        want[d.doc_id] = 1 / (1 + math.exp(-(float(share.astype(float) @ model.scalar[ids].astype(float)) + model.bias)))
    rows = quality_model.classify(frame, labels, shape=shape).collect()
    assert len(rows) == frame.count() and all(abs(r.score - want[r.doc_id]) < 1e-5 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.doc_id for r in rows if r.held_out} == {i for i in want if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    again = quality_model.fit(frame.repartition(5), labels, shape=shape)
    assert np.array_equal(again.scalar, model.scalar) and again.bias == model.bias


def test_gradient_by_differences():
    """A step's direction against the differences of the cross entropy, weight by weight."""
    rng = np.random.default_rng(2)
    vectors, out, bias = rng.normal(size=(12, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    ids, share, label, rate = np.array([3, 5, 9]), np.array([0.5, 0.25, 0.25]), 1, 1e-3

    def loss(v, o, b):
        z = o @ (share @ v[ids]) + b
        return math.log(np.exp(z).sum()) - z[label]

    after = [x.copy() for x in (vectors, out, bias)]
    quality_model.descend(*after, ids, share, label, rate)
    for k, scale in ((0, 4 * 2), (1, 1), (2, 0.1)):
        for at in np.ndindex(after[k].shape):
            moved = [x.copy() for x in (vectors, out, bias)]
            moved[k][at] += 1e-6
            slope = (loss(*moved) - loss(vectors, out, bias)) / 1e-6
            assert abs((vectors, out, bias)[k][at] - after[k][at] - rate * scale * slope) < 1e-7


def test_classifier_reads_words_without_blanks_to_the_end(spark):
    """Texts of one long word with a common beginning: only what stands behind it tells them apart."""
    rng = random.Random(4)
    head = "".join(rng.choices("天地玄黃宇宙洪荒", k=60))
    rows = [(i, head + "".join(rng.choices("甲乙丙丁" if i % 3 else "子丑寅卯", k=400))) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = {r.doc_id: r.predicted for r in quality_model.classify(docs, labels).collect()}
    assert np.mean([scores[i] == (i % 3 > 0) for i in held]) > 0.95


def test_long_words_have_the_n_grams_of_short_ones(monkeypatch):
    import xxhash

    data = bytes(random.Random(6).choices(range(256), k=300))
    for n in range(1, 16):
        want = [xxhash.xxh32_intdigest(data[i : i + n]) for i in range(len(data) - n + 1)]
        assert quality_model.window_hashes(np.frombuffer(data, np.uint8), n).tolist() == want
    text = b"short words and " + b"ab" * 20 + b"longer " * 3
    whole = quality_model.Features(quality_model.Shape()).bag(text)
    monkeypatch.setattr(quality_model, "LONG", 4)
    monkeypatch.setattr(quality_model, "CHUNK", 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, quality_model.Features(quality_model.Shape()).bag(text), strict=True))


def _scorer(monkeypatch, model):
    """The function from slices to columns with which a model scores texts."""
    held = []
    monkeypatch.setattr(quality_model, "map_arrow", lambda df, per_slice, *_: held.append(per_slice()))
    quality_model.score(SimpleNamespace(select=lambda *_: SimpleNamespace(schema=[])), model, ["text"])
    return held[0]


@pytest.mark.parametrize("chunk", [5, 40, 1 << 18])
def test_scores_of_a_slice_are_those_of_each_text(monkeypatch, chunk):
    """However words are cut into chunks, a text's score is that of its bag, and its neighbours don't move it."""
    rng = random.Random(8)
    texts = ["", None, " ", "a", " É  a\tA ", "b\x0b\x0cab \n", "\x1cx\x85 \u00a0É", "long" * 30 + " a", *(t for _, t in corpus(9, 40)), *(" ".join(rng.choices("abcdefgh", k=50)) for _ in range(4))]
    shape = quality_model.Shape(buckets=700)
    model = quality_model.Model(shape, np.random.default_rng(3).normal(size=700).astype(np.float32), 0.2)
    bags = [quality_model.Features(shape).bag((t or "").encode()) for t in texts]
    monkeypatch.setattr(quality_model, "CHUNK", chunk)
    run = _scorer(monkeypatch, model)
    got = run(pa.record_batch({"text": pa.array(texts)}))["score"]
    want = [1 / (1 + math.exp(-(float(share.astype(float) @ model.scalar[ids].astype(float)) + model.bias))) for ids, share in bags]
    assert np.abs(got - want).max() < 1e-6
    assert [float(run(pa.record_batch({"text": pa.array([t], pa.string())}))["score"][0]) for t in texts] == got.tolist()


def test_scoring_rare_words_costs_a_few_splits(monkeypatch):
    """N-grams of words met for the first time are hashed as arrays, not one by one."""
    rng = random.Random(7)
    raw = [[" ".join(f"w{int(rng.paretovariate(0.4)) % 10**9}x" for _ in range(400)) for _ in range(256)] for _ in range(6)]
    batches, model = [pa.record_batch({"text": t}) for t in raw], quality_model.Model(quality_model.Shape(), np.ones(1 << 16, np.float32), 0.0)
    split, count = [], []
    for _ in range(3):
        at = time.process_time()
        for texts in raw:
            assert [t.encode().split() for t in texts]
        split.append(time.process_time() - at)
        run = _scorer(monkeypatch, model)
        at = time.process_time()
        for batch in batches:
            run(batch)
        count.append(time.process_time() - at)
    assert min(count) < 8 * min(split), (min(count), min(split))


def test_token_files(docs, empty, tmp_path):
    """Tokens and checksums by the tokenizers library, in order of doc_id, those without one first."""
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d in docs.collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 1]
        want.append((-1 if d.doc_id is None else d.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = frames.token_files(docs).orderBy("start").collect()
    assert rows[0].doc_id is None and [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows] == sorted(want)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert frames.token_files(empty).count() == 0
    path = str(tmp_path / "x.zst")
    with open(path, "wb") as f:
        w = frames.FrameWriter(f, 4)
        for i in (None, *range(9)):
            w.add(i, np.arange(i or 0, dtype="<u4").tobytes())
        w.close()
    where, name = frames.open_folder(path)
    with where.open_input_file(name) as h:
        reader = frames.FrameReader(h)
        assert np.frombuffer(reader.find(7), "<u4").tolist() == list(range(7)) and reader.find(99) is None
        assert [d for d, _ in reader.read()] == [None, *range(9)]
    # any zstandard reader sees the frames as one stream
    assert zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read() == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(9))
    data = bytearray(open(path, "rb").read())
    data[9] ^= 255
    open(path, "wb").write(data)
    with where.open_input_file(name) as h, pytest.raises(Exception):  # noqa: B017
        list(frames.FrameReader(h).read())


def test_many_frames_and_files(spark):
    """Files by size, frames by tokens: nothing is lost or changes place."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("words and "), F.col("id").cast("string")).alias("text")).orderBy(F.desc("id"))
    folder = frames.shared_folder(spark)
    files = frames.write_tokens(docs, folder, frame_tokens=16, file_bytes=256)
    rows = frames.read_tokens(spark, files).orderBy("start").collect()
    assert len(files) > 4 and [r.doc_id for r in rows] == list(range(300))


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("sizes", [(131_072, 4096, 2_000_000), (4, 3, 60)])
def test_shingle_join(spark, empty, sizes):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = corpus(9, 40)
    for k in range(30):  # near copies of one text, some of which link through others only
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(base[: 7 + k])) for k in range(12)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.components(docs, sizes[0], 2, sizes[1], sizes[2]).collect()}
    assert got == brute(rows)
    if sizes[0] == 4:
        assert shingle_join.components(empty).count() == 0


def test_shingle_join_keeps_links_of_repeated_and_missing_ids(spark):
    """Rows of one doc_id with two texts, and a row without doc_id, pass links on."""
    rng = random.Random(12)
    a, b, c = (rng.sample([f"w{k}" for k in range(300)], 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, [*a, "x"]), (9, [*b, "y"]), (None, c), (20, c[:52]), (30, [*c, *"defghijk"]), (40, a), (40, a)]
    docs = spark.createDataFrame([(i, " ".join(w), 1, 2) for i, w in rows], "doc_id bigint, text string, sid int, _row int")
    got = sorted((r.doc_id or 0, r.component_id) for r in shingle_join.components(docs).collect())
    assert got == [(0, 20), (5, 5), (5, 5), (7, 5), (9, 5), (20, 20), (30, 20), (40, 5), (40, 5)]
    kept = shingle_join.keep_one(docs)
    # two different texts under one doc_id are two groups' firsts
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, " ".join(a)), (5, " ".join(b)), (20, " ".join(c[:52]))])
    again = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three"), (None, "three"), (2, ""), (3, None), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in shingle_join.keep_one(again).collect()) == [(0, ""), (0, "three"), (1, "one two"), (2, ""), (3, "")]


def test_large_groups_lose_no_link(spark):
    """A chain of near copies, whose ends share nothing with the first, in groups of many blocks."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(150)] + [(500 + k, " ".join(words[:50] + [f"x{k}"])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.components(docs, 8, 2, 5, 200).collect()}
    assert got == brute(rows)


def test_chance_repeats_are_not_indexed(spark):
    """Texts that share a third of their shingles with others, but link with none, leave hardly an index entry."""
    rng = random.Random(8)
    phrases = [[f"p{k}w{i}" for i in range(25)] for k in range(40)]
    rows = [(d, " ".join(w for j in range(4) for w in [*rng.choice(phrases), *(f"d{d}u{j}w{i}" for i in range(45))])) for d in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    repeated = shingle_join.shingle_counts(docs).where("c > 1")
    order = shingle_join.order_of(repeated, np.zeros(0, np.uint32))
    assert order.single and shingle_join.postings(docs, order, 2).count() < 0.01 * 120 * 70
    # a bitmap too small for all marks leaves unmarked shingles in the index, and the links as they are
    full = shingle_join.order_of(repeated, np.zeros(0, np.uint32), 1 << 8)
    assert not full.single and shingle_join.postings(docs, full, 2).count() > 120 * 60
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.components(docs, 8, 2).collect()} == brute(rows)


def test_small_sets_do_not_blur_large_ones():
    """Unrelated sets of a list whose sizes rise step by step aren't chained; sets that link are, across widths too."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, int(60 * 1.2**k), np.uint64)) for k in range(24)]
    large = [np.unique(rng.integers(0, 1 << 63, 3000, np.uint64)) for _ in range(20)]
    apart = [(k, len(s), shingle_join.bitmap(s)) for k, s in enumerate([*sets, *large])]
    assert not list(shingle_join.may_link(apart))
    copies = [s[: len(s) * 4 // 5] for s in sets]
    rows = apart + [(100 + k, len(s), shingle_join.bitmap(s)) for k, s in enumerate(copies)]
    assert len({r[2].__len__() for r in rows}) > 4
    assert sorted(tuple(sorted(e)) for e in shingle_join.may_link(rows)) == [(k, 100 + k) for k in range(24)]


def test_components_are_never_left_unfinished(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {tuple(r) for r in connected(path).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError):
        connected(path, 1)


def test_chat(spark):
    rng = random.Random(2)
    rows = []
    for c in range(6):
        for t in range(rng.randint(1, 40)):
            rows.append((c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], rng.choice([None, "", "hi " * rng.randint(1, 60), "</s>[INST] \\ ] ok [/INST] <s>"])))
    turns = spark.createDataFrame([*rows, (None, 0, None, "x")], "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_conversations(turns, budget=chat.Budget(100, 20, 2))
    out = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in range(6):
        mine = [(r, x or "") for k, _, r, x in rows if k == c]
        loss = "".join(x for r, x in mine if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert all(w.tokens <= 100 or w.n_turns == 1 for w in windows.collect())
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0


def test_chat_windows(spark):
    """Windows chosen turn by turn: the system turn, a limited history out of the mask, then as many new turns as fit."""
    rng = random.Random(5)
    budget = chat.Budget(80, 30, 3)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(c, k, "system" if k == 0 and c else ("user", "assistant")[k % 2], "word " * rng.randint(0, 30)) for c in range(4) for k in range(25)]
    turns = spark.createDataFrame([(*r, "x") for r in [*rows, rows[3]]], "conv_id bigint, turn bigint, role string, text string, tokens string")
    got = {}
    for w in chat.format_conversations(turns, budget=budget).orderBy("conv_id", "window").collect():
        got.setdefault(w.conv_id, []).append((chat.parse(w.formatted), w.n_repeated, w.n_turns, w.tokens))
    for c in range(4):
        mine = sorted(x for x in [*rows, rows[3]] if x[0] == c)
        size = [len(t.encode(x[3], add_special_tokens=False).ids) + 4 for x in mine]
        system, want, at, history = (0 if c else None), [], 0, []
        while at < len(mine):
            used = sum(size[i] for i in history)
            new = [at]
            while at + len(new) < len(mine) and used + sum(size[i] for i in new) + size[at + len(new)] <= budget.tokens:
                new.append(at + len(new))
            want.append(([(mine[i][2], mine[i][3]) for i in [*history, *new]], len(history), len(new), used + sum(size[i] for i in new)))
            tail = [i for i in [*history, *new] if i != system][-budget.history_turns :]
            while tail and sum(size[i] for i in tail) > budget.history_tokens:
                tail.pop(0)
            history, at = ([system] if system is not None else []) + tail, at + len(new)
        assert got[c] == want
    whole = {r.conv_id: r.formatted_chars for r in chat.read_back(chat.format_conversations(turns, budget=budget)).collect()}
    assert all(whole[c] > 0 for c in range(4))


def test_very_long_texts(spark):
    """One text of 60,000 words and one word of 200,000 characters, beside short ones, through every operator."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(900)]
    long = " ".join(rng.choices(words, k=60_000))
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, "y" * 200_000), (4, long + " tail")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id bigint, quality int")
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids] for i, x in docs.collect()}
    packed = packing.pack_documents(docs).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in ids} == {i: len(x) + 1 for i, x in ids.items()}
    assert _check_bins(packed, packing.Bin()) <= 1 + -(-sum(len(x) + 1 for x in ids.values()) // 2048)
    b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in lexicon.encode_documents(docs, lexicon_words=50).collect()} == {i: len(b.encode(x, add_special_tokens=False).ids) for i, x in docs.collect()}
    assert {r.doc_id: r.size for r in sharding.shard_documents(docs, [1.0] * 3).collect()} == {i: len(x) + 1 for i, x in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in frames.token_files(docs).collect()} == {i: len(x) + 1 for i, x in ids.items()}
    assert {r.doc_id: r.component_id for r in shingle_join.components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    prints = {r.doc_id: r for r in weighted_print.fingerprints(docs).collect()}
    assert prints[1].n_chars == len(long) and prints[1].near_edited > 0.3
    assert {r.doc_id: (r.n_words, r.word_chars) for r in rule_list.judge(docs, labels).collect()} == {i: (len(x.split()), sum(map(len, x.split()))) for i, x in docs.collect()}
    assert all(0 <= r.score <= 1 for r in quality_model.classify(docs, labels).collect())
    scored = {r.doc_id: r for r in context_tree.score(docs, F.lit(True)).collect()}
    assert scored[1].n_tokens == 60_001 and scored[3].n_tokens == 2 and all(math.isfinite(r.score) and r.score < 0 for r in scored.values())
    turns = docs.select(F.lit(1).cast("bigint").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    (talk,) = chat.format_and_read(turns).collect()
    assert talk.loss_chars == sum(len(x) for _, x in docs.collect())
