"""Suffix tree language model against a dictionary implementation of the same tree."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import suffix_tree_lm as S
from logsift.llm.common import prepare


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Brute:
    """The tree with tuples as contexts, scored position by position."""

    def __init__(self, texts, order):
        self.order = order
        seqs = [tokens_of(t) for t in texts]
        self.words = Counter(w for s in seqs for w in s[1:])
        self.total = sum(self.words.values())
        after = defaultdict(Counter)
        for s in seqs:
            for i in range(1, len(s)):
                for k in range(1, min(order, i) + 1):
                    after[tuple(s[i - k:i])][s[i]] += 1
        self.nodes = {}
        for k in range(1, order + 1):
            for c, symbols in after.items():
                n = sum(symbols.values())
                seen = {a: m for a, m in symbols.items() if m >= S.KEEP}
                # a longer context is one of the n-grams kept a level before
                if len(c) != k or n < S.MIN_COUNT or not seen or (
                        k > 1 and (c[:-1] not in self.nodes or c[-1] not in self.nodes[c[:-1]][0])):
                    continue
                self.nodes[c] = (seen, n, (n - sum(seen.values()) + S.DISCOUNT * len(seen)) / n)
        self.kept = set()
        for c, (seen, n, spread) in self.nodes.items():
            gain = sum(m * (math.log10(self.at(c, a)) - math.log10(self.below(c, a))) for a, m in seen.items())
            gain += (n - sum(seen.values())) * math.log10(spread)
            if gain > 0.5 * (len(seen) + 1) * math.log10(n):
                self.kept |= {c[i:] for i in range(len(c))}

    def root(self, a):
        return (self.words[a] + 0.5) / (self.total + 0.5 * (len(self.words) + 1))

    def below(self, c, a):
        return self.at(c[1:], a) if len(c) > 1 else self.root(a)

    def at(self, c, a):
        seen, n, spread = self.nodes[c]
        return (max(seen.get(a, 0) - S.DISCOUNT, 0) / n) + spread * self.below(c, a)

    def state(self, history):
        return next((c for k in range(min(self.order, len(history)), 0, -1)
                     if (c := tuple(history[-k:])) in self.kept), None)

    def score(self, text):
        s, out = tokens_of(text), 0.0
        for i in range(1, len(s)):
            c = self.state(s[:i])
            out += math.log10(self.at(c, s[i]) if c else self.root(s[i]))
        return out


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Ünd", "THE", "the"]
    follow = {w: rng.sample(vocab, 4) for w in vocab}
    rows = []
    for i in range(n):
        w, out = rng.choice(vocab), []
        for _ in range(rng.randint(0, 80)):
            out.append(w)
            w = rng.choice(follow.get(w, vocab)) if rng.random() < 0.8 else rng.choice(vocab + [f"rare{rng.random()}"])
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(out)))
    rows += [(500 + i, " ".join(rng.choice(["x a b c", "y a b d"]) for _ in range(9))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "w1 w2 w3"), (3, rows[3][1]), (3, rows[3][1]),
             (1003, "the " * 9000), (1004, "x" * 300_000 + " w1 w2"), (1005, "nothing known here " * 3)]
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    prepare(spark)
    rows = corpus()
    monkeypatch.setattr(S, "FREQUENT", 40)      # most keys take the join
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted(S.score_corpus(df, order).collect(), key=str)
    brute = Brute([t for d, t in rows if not is_held(d)], order)
    assert any(len(c) == order for c in brute.kept)
    want = []
    for d, t in rows:
        s = tokens_of(t)[1:]
        want.append((d, is_held(d), len(s), sum(brute.words[w] > 0 for w in s), brute.total,
                     sum(math.log10(brute.root(w)) for w in s), brute.score(t)))
    want.sort(key=str)
    key = lambda r: (str(r[0]), r[2], round(r[6], 5))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)
    assert len(got) == len(want)


def test_every_node_sums_to_one():
    brute = Brute([t for d, t in corpus() if not is_held(d)], 2)
    unknown = brute.root("never seen")
    for c in list(brute.kept)[:50]:
        assert sum(brute.at(c, a) for a in brute.words) + brute.nodes[c][2] * (
            brute.nodes[c[1:]][2] if len(c) > 1 else 1) * unknown == pytest.approx(1)


def test_frequent_keys_only_save_work(spark, monkeypatch):
    prepare(spark)
    df = spark.createDataFrame(corpus(5, 40), "doc_id long, text string")
    monkeypatch.setattr(S, "CHUNK", 100)
    few = sorted(S.score_corpus(df).collect(), key=str)
    monkeypatch.setattr(S, "FREQUENT", 0)
    monkeypatch.setattr(S, "RANGE", 64)
    none = sorted(S.score_corpus(df).collect(), key=str)
    assert [r[:5] for r in map(tuple, few)] == [r[:5] for r in map(tuple, none)]
    assert [r.score for r in few] == pytest.approx([r.score for r in none], rel=1e-9)


def test_word_keys_do_not_depend_on_their_place():
    texts = ["ab cd", None, "", "  ab\tcd ab\n", "AB", "é ab", "y" * 600_000 + " ab " + "z " * 300_000]
    keys, sizes = S.token_keys(pa.array(texts))
    assert list(sizes) == [len(tokens_of(t)) for t in texts]
    names = [w for t in texts for w in tokens_of(t)]
    seen = {}
    for w, k in zip(names, keys.tolist()):
        assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)
    sliced = pa.array(["zz", *texts, "q"]).slice(1, len(texts))
    assert np.array_equal(S.token_keys(sliced)[0], keys)


def test_empty_table_and_no_training_rows(spark):
    prepare(spark)
    assert S.score_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(50) if is_held(i))
    rows = S.score_corpus(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == \
        [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
