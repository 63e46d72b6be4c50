"""Tables and shuffles of a step are gone before the next one needs the disk."""
import os
import random

import numpy as np

from logsift.llm import common, line_dedup
from logsift.llm import sentencepiece_lattice as sp


def gone(made, *names):
    return not any(os.path.exists(at.removeprefix("file:")) for n, at in made if n.startswith(names))


def recorded(monkeypatch, module):
    made = []

    def staged(df, name):
        out = common.stage(df, name)
        made.append((name, out.staged_at))
        return out

    monkeypatch.setattr(module, "stage", staged)
    return made


def test_line_pairs_apart_are_dissimilar():
    rng = random.Random(5)

    def line(n):
        return "".join(rng.choice("abcdeést0 ") for _ in range(n))

    norms, pairs = [], []
    for _ in range(150):
        x = line(rng.randint(40, 300))
        y = list(x)
        for _ in range(int(rng.random() * .4 * len(x))):
            i = rng.randrange(len(y) + 1)
            y[i:i + rng.choice([0, 1])] = rng.choice(["", "a", "xy"])
        pairs.append((len(norms), len(norms) + 1))
        norms += [x, "".join(y)[int(rng.random() * .1 * len(x)):]]
    far = [(len(norms) + k, len(norms) + k + 1) for k in range(0, 100, 2)]
    norms += [line(500) for _ in range(100)]
    a, b = np.array(pairs + far).T
    flagged = line_dedup.apart(norms, a, b) | line_dedup.apart(norms, b, a)
    for x, y, f in zip(a, b, flagged):
        assert not (f and line_dedup.similar(norms[x], norms[y]))
    assert flagged[len(pairs):].mean() > .9


def test_line_texts_are_shuffled_in_parts(spark, monkeypatch):
    made = recorded(monkeypatch, line_dedup)
    monkeypatch.setattr(line_dedup, "PART", 1)
    base = " ".join(f"palabra{i % 7}x{i}" for i in range(40))
    common.prepare(spark)
    rows = [(k, f"{base} fin{chr(97 + k)}") for k in range(6)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.n_removed for r in out.collect()) == [0, 1, 1, 1, 1, 1]
    names = [n for n, _ in made]
    # near copies share most of their bands: one part per key, not all texts at once
    assert names.count("links-grams") > 3
    assert gone(made, "norms", "near", "shared")


def test_sentencepiece_word_tables_are_removed_before_documents_are_joined(spark, monkeypatch):
    made = recorded(monkeypatch, sp)
    monkeypatch.setattr(sp, "FREQUENT", 2)
    common.prepare(spark)
    rows = [(1, "one two three, one two"), (2, None), (3, "four  five\nsix"), (3, "four  five\nsix")]
    out = sp.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [n for n, _ in made] == ["words", "word_ids", "rare"]
    assert gone(made, "words", "word_ids")
    texts = {r.doc_id: r.text for r in sp.decode(out).collect()}
    assert texts == {1: rows[0][1], 2: "", 3: rows[2][1]}
