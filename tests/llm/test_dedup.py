"""Line, document and substring dedup against brute force."""
import random

import pytest
import xxhash

from logsift.llm import line_dedup as L
from logsift.llm import simhash as S
from logsift.llm import substring_dedup as X
from logsift.llm.common import connected_components, prepare

SCHEMA = "doc_id long, text string, row string, fp long, component_id long"


def corpus(seed=1, n=60):
    """Documents with shared passages, copies, odd texts and repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(14, 60))] for _ in range(4)]
    docs = [(100 + i, None) for i in range(2)] + [(102, ""), (103, " \n\t "), (104, "one"), (105, "a b c " * 40)]
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            p = passages[i % 4]
            w[len(w) // 2:len(w) // 2] = p[rng.randint(0, 3):len(p) - rng.randint(0, 3)]
        docs.append((200 + i, "\n".join(" ".join(w[k:k + 20]) for k in range(0, len(w), 20))))
    for i in range(0, n, 7):
        t = docs[6 + i][1].split(" ")
        t[rng.randrange(len(t))] = "changed"
        docs.append((400 + i, " ".join(t)))
        docs.append((500 + i, docs[6 + i][1]))
    docs.append((600, " ".join(rng.choice(vocab) for _ in range(20000))))
    docs.append(docs[10])
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in corpus()], SCHEMA).repartition(3)


def brute_substrings(docs):
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def test_substring_dedup_equals_brute_force(docs):
    out = X.substring_dedup(docs).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, out)) == brute_substrings(corpus())


def test_substring_dedup_empty_and_null_ids(spark):
    prepare(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert X.substring_dedup(none).count() == 0
    t = " ".join(map(str, range(20)))
    two = spark.createDataFrame([(None, t), (5, t)], "doc_id long, text string")
    assert [r["n_removed"] for r in X.substring_dedup(two).collect()] == [0, 0]


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(docs):
    fp = {d: brute_fingerprint(t) for d, t in corpus()}
    group = {x: x for x in fp.values()}
    for _ in range(len(group)):
        for a in group:
            group[a] = min(group[b] for b in group if (a ^ b).bit_count() <= 2)
    least = {}
    for d, x in fp.items():
        least[group[x]] = min(least.get(group[x], d), d)
    out = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in S.simhash_groups(docs).collect()}
    assert out == {d: (x, least[group[x]]) for d, x in fp.items()}


def test_covering_masks_cover_every_pair_within_the_radius():
    masks = [m % 2**64 for m in S.covering_masks()]
    assert len(masks) == 7
    assert all(any(not (1 << i | 1 << j) & m for m in masks) for i in range(64) for j in range(64))


def test_links_join_exactly_the_fingerprints_within_two_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = set(base)
    for b in base:      # a crowd of variants, so that buckets are large
        fps |= {b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(80)}
    sign = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    got = {frozenset((r["u"] % 2**64, r["v"] % 2**64)) for r in S.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, got))

    def parts(pairs):
        up = {x: x for x in fps}
        for a, b in pairs:
            ra, rb = a, b
            while up[ra] != ra:
                ra = up[ra]
            while up[rb] != rb:
                rb = up[rb]
            up[ra] = rb
        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        return {frozenset(y for y in fps if root(y) == r) for r in map(root, fps)}

    every = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert parts(map(tuple, got)) == parts(every)


def test_keep_one_keeps_columns_and_one_per_group(docs):
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    groups = {r["component_id"] for r in S.simhash_groups(docs).collect()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(groups)


def test_keep_one_keeps_unrelated_texts_of_one_id(spark):
    prepare(spark)
    t, u = (" ".join(f"{c}{i}" for i in range(50)) for c in "tu")
    rows = [(1, t), (5, t), (5, u), (None, t), (None, t), (None, "only without an id, once or twice"),
            (None, "only without an id, once or twice"), (7, None), (8, "")]
    df = spark.createDataFrame([(d, x, "clash") for d, x in rows], "doc_id long, text string, text_key string")
    out = [(r["doc_id"], r["text"]) for r in S.keep_one(df.repartition(3)).collect()]
    assert sorted(out, key=str) == sorted([(1, t), (5, u), rows[5], (7, None)], key=str)
    assert S.keep_one(df.limit(0)).collect() == []


def test_connected_components_long_chain(spark):
    prepare(spark)
    rng = random.Random(2)
    names = rng.sample(range(1000), 200)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(2000, 2001), (2002, 2002)], "u long, v long")
    out = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert out == {**{n: min(names) for n in names}, 2000: 2000, 2001: 2000}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert L.edit_distance(a, b) == plain_distance(a, b)


def test_line_dedup_exact_and_fuzzy(spark):
    prepare(spark)
    line = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 4
    near = line.replace("lazy", "lazi", 1)
    rows = [(2, f"{line}\nalone in the second one\n\nok"), (1, "Alone  in the SECOND one!\nok"), (3, near),
            (4, None), (5, ""), (5, ""), (None, "page 12 of the book"), (6, "page 7 of the book")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, line int")
    out = [(r["row"]["doc_id"], r["n_removed"], r["kept_text"]) for r in L.line_dedup(df).collect()]
    got = dict((d, (n, t)) for d, n, t in out)
    assert len(out) == len(rows)
    assert got[1] == (0, rows[1][1])
    assert got[2] == (1, f"{line}\n\nok")
    assert got[3] == (1, "")
    assert got[4] == (0, None) and got[5] == (0, "")
    assert got[None][0] == 0 and got[6] == (1, "")      # digits are normalised, a null id sorts first
    assert L.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_chunks_give_the_same_groups(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(5)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(chr(97 + i % 26)) for i in range(40)]
    texts = []
    for i in range(40):
        w = list(base)
        w[i % 40] = "zz" + chr(97 + i % 26)
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted((r["row"]["doc_id"], r["n_removed"]) for r in L.line_dedup(df).collect())
    monkeypatch.setattr(L, "CHUNK", 3)
    assert sorted((r["row"]["doc_id"], r["n_removed"]) for r in L.line_dedup(df).collect()) == whole
    assert sum(n for _, n in whole) > 30


def test_a_near_pair_is_a_candidate_in_its_first_shared_block_only():
    import numpy as np
    import pyarrow as pa

    line = [f"w{i}" for i in range(40)]
    words = line + ["other"] + line[1:] + [f"v{i}" for i in range(40)]
    s, m = L._sketches(words, np.array([40, 40, 40]))
    for other, expected in ((1, True), (2, False)):
        shared, found = [], []
        for k in range(2 * L.HALF):
            block = s[:, k // L.HALF] >> np.uint64(L.BLOCK_BITS * (k % L.HALF)) & np.uint64((1 << L.BLOCK_BITS) - 1)
            if expected and block[0] != block[other]:
                continue
            two = [0, other]
            t = pa.table({"key": pa.array([k << L.BLOCK_BITS] * 2), "s1": s[two, 0].view(np.int64),
                          "s2": s[two, 1].view(np.int64), "m": m[two].view(np.int64), "chars": pa.array([150, 150])})
            shared.append(k)
            if L._Sketched(t).candidates(np.array([0]), np.array([1]))[0]:
                found.append(k)
        assert shared and found == (shared[:1] if expected else [])


def test_overlap_of_distinct_words_is_asked_for_before_the_edit_distance():
    assert L.similar("a b c d e f g h one", "a b c d e f g h two")
    assert not L.similar(" ".join(["the"] * 50 + ["of"]), " ".join(["and"] * 50 + ["to"]))


def _variants(length, typos, n, seed):
    """Pairs of random lines of about ``length`` characters and the same with
    ``typos`` characters replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        line = ""
        while len(line) < length:
            line += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) + " "
        line = line.strip()
        other = list(line)
        for at in rng.sample([i for i, c in enumerate(line) if c != " "], typos):
            other[at] = rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != other[at]])
        out.append((line, "".join(other)))
    return out


def test_lines_with_typos_share_a_band_at_every_length():
    import numpy as np

    for length, typos, recall in ((12, 1, 0.85), (25, 1, 0.98), (60, 1, 0.99), (60, 2, 0.9), (120, 2, 0.99), (250, 3, 0.99)):
        pairs = _variants(length, typos, 300, length)
        values, m = L.bands([x for pair in pairs for x in pair])
        found = 0
        for i in range(0, len(values), 2):
            a, b = values[i], values[i + 1]
            k = min(len(a), len(b))
            near = L._differing(m[i:i + 1] ^ m[i + 1:i + 2])[0] <= L._Banded.near
            found += bool(near and np.any(a[:k] == b[:k]))
        assert found >= recall * len(pairs), (length, typos, found)


def test_line_dedup_finds_typos_in_ordinary_lines(spark):
    prepare(spark)
    pairs = _variants(60, 1, 100, 7)
    df = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)],
                               "doc_id long, text string")
    out = {r["row"]["doc_id"]: r["n_removed"] for r in L.line_dedup(df).collect()}
    assert sum(out[2 * i + 1] for i in range(100)) >= 98
    assert not any(out[2 * i] for i in range(100))


def test_line_dedup_short_and_unspaced_lines(spark):
    prepare(spark)
    rows = [(1, "All rights reserved by Acme Corporation"), (2, "All rights reserved by Acme Corporatian"),
            (3, "and ornd"), (4, "And, ornd!"), (5, "版权所有翻印必究本网站内容"), (6, "版权所有翻印必究本网站内容"),
            (7, "版权所有翻印必究本网站内客"), (8, "-----"), (9, "-----"), (10, "12 34 56"), (11, "12 34 57"), (12, "12 34 56")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["row"]["doc_id"]: r["n_removed"] for r in L.line_dedup(df).collect()}
    assert [d for d, n in out.items() if n] and {d for d, n in out.items() if n} == {2, 4, 6, 7, 9, 12}
