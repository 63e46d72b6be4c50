"""Tokens, packing, chat format, toxicity, fertility, neighbours, revisits."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from logsift.llm import ann, chat_format, fertility, packing, tokens, toxicity, warc
from logsift.llm import sentencepiece_lattice as sp
from logsift.llm.common import prepare

ODD = ["", " ", "a", "  two  blanks ", "tab\there\n\nline\r\n x", "don't we'll", "<|endoftext|>mid<|endoftext|>", "\x1c a\x1d",
       "é😀 ünï　wide nb  thin", "x" * 300, "1234 5 67,8.9", "áb", "▁ under ▁▁x", "word " * 500]


def test_token_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.id_bytes()
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 1.\n\té'<| ") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_histogram_uses_every_length_once():
    rng = random.Random(2)
    hist = Counter(rng.randint(1, 64) for _ in range(2000)) + Counter({64: 500})
    used = Counter()
    for pattern, n in packing.pack_histogram(hist, 64):
        assert sum(pattern) <= 64
        for x in pattern:
            used[x] += n
    assert used == hist
    assert sum(n for _, n in packing.pack_histogram(hist, 64)) * 64 < 1.02 * sum(k * v for k, v in hist.items())


def test_packing_places_every_id_once(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 2)    # many salts
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, None), (50, "long text " * 3000)]
    out = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")).collect()
    encode = tokens.id_bytes()
    have = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = Counter()
    for d, t in rows:
        ids = encode(t or "") + b"\x01\0\0\0"
        for s in range(0, len(ids) // 4, 2048):
            part = ids[4 * s:4 * s + 8192]
            want[d, s, len(part) // 4, zlib.crc32(part)] += 1
    assert have == want
    at = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat_round_trip(spark):
    prepare(spark)
    texts = ["plain", "</s>[INST] ok [/INST]", "<s~> </s~~> ~", "", None, "a</s", "[/INST]</s>", "<s>1user[INST]x[/INST]</s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)]
    rows += [(2, 0, "we[INST]ird", "x\ny", "x"), (2, 0, None, "z", "x"), (3, 1, "assistant", "only", "x"), (3, 1, "assistant", "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert [t["text"] for t in out[1]["turns"]] == [t or "" for t in texts]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "z"), ("we[INST]ird", "x\ny")]
    assert len(out[3]["turns"]) == 2
    for r in out.values():      # the spans hold the assistant texts, as rendered
        f, back = r["formatted"], []
        for s in r["loss_spans"]:
            cut = f[s["start"]:s["end"]]
            back.append(re.sub(r"(</?s|\[/?INST)~(~*)([>\]])", r"\1\2\3", cut) if s["escaped"] else cut)
        want = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert back == want
        assert f.count("<s>") == f.count("</s>") == f.count("[INST]") == f.count("[/INST]") == len(r["turns"])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(400):
        ids = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        w = rng.random(len(ids)) + 0.1
        vectors.append((ids, w / np.linalg.norm(w)))
    dense = np.zeros((400, 30))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    index = toxicity.BlockMaxIndex(vectors, 30)
    for ids, w in vectors[:60]:
        q = np.zeros(30)
        q[ids] = w
        want = np.sort(np.round(dense @ q, 12))[::-1][:15]
        got = [s for s, _ in index.search(ids, w, 15)]
        assert np.allclose(got, want[:len(got)]) and (len(got) == 15 or want[len(got)] <= 1e-12)


def test_toxicity_held_out(spark):
    prepare(spark)
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        if bad := i % 6 == 0:
            w[rng.randrange(60)] = rng.choice(["scum", "scummy!", "vileness", "Vile,"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "w1 " * 5000 + "scum", "x"), (1, docs[1][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    y = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    out = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(d, y).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((out[i] >= 0.3) == (i % 6 == 0) for i in held)
    assert out[1000] == out[1001] < 0.3 and out[1002] >= 0.3
    assert {r["score"] for r in toxicity.score(d, y.limit(0)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), y).count() == 0
    assert toxicity.drop_toxic(d, y).columns == d.columns


def test_whole_index_equals_brute_force():
    rng = random.Random(8)
    names = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(400)], k=rng.randint(1, 80))) for _ in range(150)]
    texts += [None, "", " ".join(texts[3].split()[:-2] + ["new"]), texts[5] + " new other"]
    index = toxicity.WholeIndex(texts[:140] + texts[150:152])
    for t in texts[100:]:
        ids, w, norm = index._weights(toxicity.words(t))
        want = []
        for e, (other, x) in enumerate(index.vectors):
            y = dict(zip(other.tolist(), x.tolist()))
            c = sum(v / norm * y.get(i, 0.0) for i, v in zip(ids.tolist(), w.tolist()))
            if c >= toxicity.NEAR:
                want.append(round(c, 4))
        got = [round(s, 4) for s, _ in index.search(toxicity.words(t), 200)]
        assert np.allclose(got, sorted(want, reverse=True), atol=2e-4)


def test_a_copy_of_a_toxic_example_without_a_common_term_is_toxic(spark):
    prepare(spark)
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60))) for i in range(400)]
    labels = [(i, int(i < 8)) for i in range(400)]
    picked = next(i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2)
    copy = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2)
    d = spark.createDataFrame(docs + [(copy, docs[picked][1])], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["row"]["doc_id"]: (r["score"], r["evidence"]) for r in toxicity.score(d, y).collect()}
    assert out[copy][0] >= toxicity.THRESHOLD and out[copy][1][0] == picked
    assert all(out[i][0] < toxicity.THRESHOLD for i in range(8, 400))


def test_fertility_base_measures(spark):
    prepare(spark)
    rng = random.Random(5)
    texts = [None, "", "a b c a b c", "x # y\nx # y\n \nx # y", "very " * 4000] + [
        " ".join(rng.choice(["alpha", "beta|", "gamma\n", "délta"]) for _ in range(rng.randint(40, 400))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, scaled int")
    out = {r["doc_id"]: r for r in fertility.fertility(df).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        tri = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert fertility.fertility(df.limit(0)).count() == 0


def test_fertility_band_of_a_small_language_has_no_switch(spark):
    prepare(spark)
    rng = random.Random(10)
    latin = ["the", "house", "water", "under", "light", "people", "garden", "morning", "letter", "and", "river", "stone"]
    greek = ["και", "σπίτι", "νερό", "κάτω", "φως", "άνθρωποι", "κήπος", "πρωί", "γράμμα", "ποτάμι", "πέτρα", "δρόμος"]
    text = lambda names: " ".join("".join(rng.sample(names, 2)) if rng.random() < 0.3 else rng.choice(names)
                                  for _ in range(rng.randint(80, 200)))
    docs = [(i, text(latin), "en") for i in range(300)] + [(1000 + i, text(greek), "el") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["kept"] for r in fertility.fertility(df).collect()}
    assert all(out[1000 + i] for i in range(20))
    assert sum(out[i] for i in range(300)) >= 295

    # one document more at any size moves the band by little
    def median(n):
        m = spark.createDataFrame([("a", "LATIN", float(i % 2)) for i in range(1000)] + [("b", "LATIN", 5.0)] * n,
                                  "lang string, script string, x double")
        row = fertility._with_bands(m, m, ["x"]).where("lang = 'b'").first()
        return row["q_x"][1]

    assert abs(median(100) - median(99)) < 0.1 and median(99) < median(100)


def test_sentencepiece_ids_equal_the_library(spark):
    import sentencepiece

    prepare(spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    texts = [t for t in ODD if "\x1c" not in t] + ["the,quick.brown (fox) " * 3, "a" * 100 + " " + "ab" * 70,
                                                 "x" + " " * 37 + "the y" + " " * 16 + "\n" + " " * 15 + "z"] + [
        "".join(rng.choice("abcdetn  .,\né日") for _ in range(50)) for _ in range(15)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, ODD[1])], "doc_id long, text string")
    out = sp.encode(df)
    got = [(r["doc_id"], r["ids"]) for r in out.collect()]
    want = [(i, lib.encode(t or "")) for i, t in enumerate(texts)] + [(0, lib.encode(ODD[1]))]
    assert sorted(got) == sorted(want)
    back = Counter((r["doc_id"], r["text"]) for r in sp.decode(out).collect())
    # a literal meta symbol comes back as a blank, as from the library
    assert back == Counter([(i, (t or "").replace(sp.META, " ")) for i, t in enumerate(texts)] + [(0, ODD[1])])


def test_viterbi_fold_is_the_best_path(spark):
    prepare(spark)
    pieces = {"a": (0, -3.0), "b": (1, -3.0), "ab": (2, -4.0), "ba": (3, -3.5), "aba": (4, -9.0), "bb": (5, -5.5)}
    p = spark.createDataFrame([(k, i, s) for k, (i, s) in pieces.items()], "piece string, id int, score double")
    words = ["".join(x) for x in ("ab", "aba", "abba", "babab", "a")]
    e = sp.lattice(spark.createDataFrame([(w,) for w in words], "word string"), p, 3, 0)
    e = e.withColumn("best", sp.fold_viterbi(F.col("word"), F.col("edges")))
    e = e.withColumn("ends", sp.viterbi_ends(F.col("best")))
    got = {r["word"]: r["ids"] for r in e.select("word", sp._path_ids(F.col("edges"), F.col("ends")).alias("ids")).collect()}

    def best(w):
        return 0.0 if not w else max(pieces[w[:k]][1] + best(w[k:]) for k in range(1, 4) if k <= len(w) and w[:k] in pieces)

    score = {i: s for i, s in pieces.values()}
    text = {i: k for k, (i, _) in pieces.items()}
    for w in words:
        assert "".join(text[i] for i in got[w]) == w
        assert abs(sum(score[i] for i in got[w]) - best(w)) < 1e-9


def test_neighbours_recall_and_exact_scores(spark):
    prepare(spark)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(1, 16)), 500, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0])]
    rows.append(rows[3])
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = x.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 2000, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(2000), -np.round(s, 12)))[:5].tolist()
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in found)
        hits += len(set(want) & {v for _, v, _ in found})
        total += 5
    assert hits / total >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_score_does_not_depend_on_the_rows_own_label(spark):
    prepare(spark)
    rng = random.Random(4)
    bad = ["scum", "vile"]
    docs = [(i, " ".join(rng.choice(["red", "tree", "walk", "stone", "river"] + (bad * 3 if i % 3 == 0 else [])) for _ in range(25)))
            for i in range(120)]
    train = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    lone = train[7]
    docs = [(i, "only here stands this text of its own") if i == lone else (i, t) for i, t in docs]
    d = spark.createDataFrame(docs + [docs[lone]], "doc_id long, text string")
    found = []
    for own in (0, 1):
        y = spark.createDataFrame([(i, own if i == lone else int(i % 3 == 0)) for i in train], "doc_id long, toxic int")
        out = [r for r in toxicity.score(d, y).collect() if r["row"]["doc_id"] == lone]
        assert all(lone not in r["evidence"] for r in out) and len(out) == 2
        found.append(out[0]["score"])
    # the label still counts in the rate of all rows, not as the row's neighbour
    assert abs(found[0] - found[1]) < 0.05


def test_revisits(spark):
    prepare(spark)
    h = {"etag": "e", "server": "s", "date": "1"}
    rows = [(1, "response", "HTTP://A.com:80/x/?ref=q#f", 10, "e1", None, "d1", h),
            (2, "response", "http://a.com/x", 50, "e2", None, "d2", h),
            (3, "revisit", "http://a.com/x", 40000, "e2", None, None, {"date": "9", "server": "no"}),
            (4, "revisit", "http://a.com/x", 20, "e1", None, None, {}),
            (5, "revisit", "http://a.com/x", 60, "e1", None, None, {"date": "7"}),
            (6, "revisit", "http://a.com/x", 5, "e1", None, None, {}),
            (7, "revisit", "http://a.com/x", 70, None, 50, None, {}),
            (8, "revisit", None, 70, None, None, None, {}), (9, "revisit", "http://a.com/x", None, "e1", None, None, {})]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, etag string, "
                                     "last_modified long, digest string, headers map<string,string>")
    out = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert {k: (r["status"], r["refers_to"]) for k, r in out.items()} == {
        3: ("resolved", 2), 4: ("resolved", 1), 5: ("mismatch", 2), 6: ("orphan", None), 7: ("resolved", 2),
        8: ("orphan", None), 9: ("orphan", None)}
    assert out[3]["headers"] == {"etag": "e", "server": "s", "date": "9"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_revisit_validators(spark):
    prepare(spark)
    u = "http://b.com/x"
    full = [(1, "response", u, 1000, '"q"', 400, "d", {"ETag": '"q"', "Date": "1", "X-A": "k"}),
            (2, "response", u + "2", 1000, None, 400, "d2", None), (3, "response", u + "3", 1000, '"q"', None, "d3", {})]
    asked = [(10, u, 2000, None, 400, "resolved"), (11, u, 2000, None, 399, "mismatch"), (12, u, 2000, 'W/"q"', 300, "resolved"),
             (13, u, 2000, '"other"', 400, "mismatch"), (14, u, 2000, None, None, "resolved"), (15, u, 2000, "", 400, "resolved"),
             (16, u, 2000, '""', 300, "mismatch"), (17, u + "2", 2000, '"q"', 400, "resolved"),
             (18, u + "2", 2000, '"q"', 300, "mismatch"), (19, u + "3", 2000, None, 100, "resolved"),
             (20, u, 999, '"q"', 400, "orphan"), (21, u, 1000, '"q"', None, "resolved"), (21, u, 1000, '"q"', None, "resolved")]
    rows = full + [(i, "revisit", url, t, tag, lm, None, {"DATE": "9", "Etag": tag or "none"}) for i, url, t, tag, lm, _ in asked]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, etag string, "
                                     "last_modified long, digest string, headers map<string,string>")
    out = warc.resolve(df.withColumn("bucket", warc.F.lit("clash"))).collect()
    assert sorted((r["record_id"], r["status"]) for r in out) == sorted((a[0], a[5]) for a in asked)
    head = next(r["headers"] for r in out if r["record_id"] == 12)
    assert head == {"etag": 'W/"q"', "date": "9", "x-a": "k"}


def test_revisits_of_lost_records_do_not_meet(spark):
    prepare(spark)
    rows = [(i, "revisit", None, None, None, None, None, None) for i in range(50)] + [(99, "response", None, 1, None, None, "d", {})]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, etag string, "
                                     "last_modified long, digest string, headers map<string,string>")
    assert sorted(r["record_id"] for r in warc.resolve(df).collect() if r["status"] == "orphan") == list(range(50))


def test_pipeline_stages(spark, tmp_dir):
    import corpus_pipeline as C

    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    docs = [(i, text(80), "en", "s", 0) for i in range(60)]
    docs += [(100, docs[0][1] + " end", "en", "s", 0), (101, text(30) + " " + docs[1][1][:200] + " " + text(30), "en", "s", 0),
             (102, None, "en", None, None), (103, "", None, "s", 0), (104, text(20) + " scum scum", "en", "s", 0)]
    labels = [(i, 0, 0) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    out = C.run(spark, tmp_dir)
    length = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
    assert all(length.get(i, 0) > 80 for i in range(60))
    assert length.get(100, 1) == 1      # its one line is a variant of an earlier one
    frame = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    for name, fn in C.STAGES[:-1]:
        assert fn(spark, frame, tmp_dir).columns == frame.columns, name
        assert fn(spark, frame.limit(0), tmp_dir).count() == 0, name
