"""SentencePiece encoding and decoding over a relational lattice.

1. *Words.*  A text gets the dummy prefix, blanks become the meta symbol, and
   it is cut where no piece of the vocabulary can reach across: before a meta
   symbol, around newlines, and before those marks that follow a letter in no
   piece.  Word counts are pre-aggregated per task, then summed.
2. *Lattice.*  Each distinct word is exploded into its substrings of at most
   the longest piece's length, joined with the piece table on equality (the
   table is the vocabulary, so its broadcast is bounded), and the edges are
   grouped by word.  A character without a piece becomes its byte pieces.
3. *Fold.*  ``aggregate`` folds the edges into the segmentation.  For a unigram
   vocabulary that is Viterbi (largest sum of scores).  The public vocabulary
   is a BPE one, for which Viterbi gives other ids than the library: there each
   step of the fold takes the next edge, best score first (leftmost on ties),
   and merges it if its ends are boundaries and its inside holds exactly one;
   boundaries are the bits of one long.  One pass over the edges gives what
   repeated best-first merging gives, unless a merge enables one with a better
   score; a piece for which that happens in its own merges is found from the
   vocabulary.  Words with such a piece (a run of 16 blanks) and words over
   ``MASK`` characters, whose boundaries exceed a long, take the merges in a
   small Python helper.
4. *Documents.*  The ids of the ``FREQUENT`` most frequent words are broadcast
   (a fixed bound); the other occurrences are joined with the word table and
   go back to their document, which travels as packed ids, not as text.

Decoding joins the pieces' bytes and undoes the meta symbol and the prefix; as in
the library, a literal meta symbol of the text comes back as a blank.

Edge cases: null and empty texts have no ids; control pieces in a text are
ordinary characters; repeated rows are encoded each; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import cached_property
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, stage, table

META = "▁"
MASK = 60
FREQUENT = 400_000
MARKS = ".,;:!?)*#$%&"
HELD = 200_000              # words a task counts before it hands them on
HOLE = 0xFFFFFFFF

_MODELS: dict = {}


class Pieces:
    """The vocabulary: normal pieces with id and score, byte pieces, kind."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not special[i]}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        self.text = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.text[i] = p.replace(META, " ").encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        inner = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        marks = [m for m in MARKS if not any(x[1] == m and x[0].isalpha() for x in inner)]
        if any(x[1] == META and x[0] != META or "\n" in x for x in inner):
            raise ValueError("pieces reach across words")
        # a newline, or a run of meta symbols and what follows it; after a letter a mark starts anew
        cut = "".join(map(re.escape, marks))
        plain, mark = f"[^{META}\n{cut}]++", f"|(?<![^\\W\\d_])[{cut}]" if cut else ""
        self.word = re.compile(f"\n|{META}*+[^{META}\n](?:{plain}{mark})*+|{META}++")

    @cached_property
    def late(self) -> list[str]:
        """Pieces whose own merges don't come in the order of their scores."""
        out = []
        for p in self.pieces:
            trace: list = []
            merge_word(p, self, trace)
            if trace != sorted(trace):
                out.append(p)
        return out

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.word.findall(META + text.replace(" ", META))

    def char_ids(self, c: str) -> list[int]:
        return [self.pieces[c][0]] if c in self.pieces else [self.byte[b] for b in c.encode()]

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


def model(path: str | None = None) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def merge_word(word: str, vocab: Pieces, trace: list | None = None) -> list[int]:
    """BPE ids of one word by a heap of neighbouring pairs; ``trace`` takes
    (cost, start, end) of every merge."""
    n = len(word)
    part, nxt, prev = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list = []

    def push(i):
        j = nxt[i]
        if j < n and (hit := vocab.pieces.get(part[i] + part[j])):
            heapq.heappush(heap, (-hit[1], i, part[i], part[j], j))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b, j = heapq.heappop(heap)
        if part[i] == a and nxt[i] == j and part[j] == b:
            part[i], part[j] = a + b, ""
            if trace is not None:
                trace.append((-vocab.pieces[a + b][1], i, i + len(a + b)))
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
    return [x for p in part if p for x in ([vocab.pieces[p][0]] if p in vocab.pieces else vocab.char_ids(p))]


def _counted(path):
    def run(it):
        vocab, held = model(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in it:
            for text in b.column(0).to_pylist():
                held.update(vocab.words(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()
    return run


def _merged(path):
    def run(it):
        for b in it:
            ids = [merge_word(w, model(path)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])
    return run


def lattice(words: DataFrame, pieces: DataFrame, longest: int, byte_base: int) -> DataFrame:
    """``words`` (word) -> word, edges: all (i, j, ids, score) of pieces and of
    single characters, best score first, leftmost first."""
    n = F.length("word")
    span = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.struct(
            i.alias("at"), k.alias("k"), F.col("word").substr(i, k).alias("piece")))))
    sub = words.select("word", F.explode(span).alias("s")).select("word", "s.*")
    hit = sub.join(F.broadcast(pieces), "piece", "left").where("id is not null or k = 1")
    spelled = F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda x: F.lit(byte_base) + F.conv(
        F.hex(F.encode("piece", "UTF-8")).substr(x * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled)
    rows = hit.select("word", "k", (-F.coalesce("score", F.lit(-1e30))).alias("cost"), (F.col("at") - 1).alias("i"),
                      (F.col("at") + F.col("k") - 1).alias("j"), ids.alias("ids"))
    inside, ends = F.expr("shiftleft(1L, j) - shiftleft(1L, i + 1)"), F.expr("shiftleft(1L, i) + shiftleft(1L, j)")
    return rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(
        "cost", "i", "j", inside.alias("inside"), ends.alias("ends"), "ids"))).alias("edges"))


def _path_ids(edges: Column, ends: Column) -> Column:
    """Ids of the edges between consecutive boundaries."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda t: F.get(F.filter(
        edges, lambda e: (e["i"] == F.get(ends, t - 1)) & (e["j"] == F.get(ends, t))), F.lit(0))["ids"]))


def fold_bpe(word: Column, edges: Column) -> Column:
    """Boundaries, as bits of a long, once every edge has been tried, best score
    first.  One pass is enough where no merge enables a better one
    (``Pieces.late`` has the others)."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(word) + 1) - F.lit(1)
    return F.aggregate(edges, whole, lambda mask, e: F.when(
        (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inside"])) == 1),
        mask.bitwiseAND(F.bitwise_not(e["inside"]))).otherwise(mask))


def _bpe_ids(edges: Column, mask: Column) -> Column:
    """Ids of the edges between consecutive boundaries."""
    path = F.filter(edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"])
                    & (mask.bitwiseAND(e["inside"]) == 0))
    return F.flatten(F.transform(F.array_sort(F.transform(
        path, lambda e: F.struct(e["i"].alias("i"), e["ids"].alias("ids")))), lambda e: e["ids"]))


def fold_viterbi(word: Column, edges: Column) -> Column:
    """Boundaries of the path with the largest sum of scores (for unigram
    vocabularies); equal sums keep the edge listed first."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("back")))

    def step(best, j):
        into = F.filter(edges, lambda e: e["j"] == j)
        ways = F.transform(into, lambda e: F.struct(
            (F.get(best, e["i"])["cost"] + e["cost"]).alias("cost"), e["i"].alias("back")))
        return F.concat(best, F.array(F.array_min(ways)))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)


def viterbi_ends(best: Column) -> Column:
    """Walk the back pointers of ``fold_viterbi`` into ascending boundaries."""
    last = F.size(best) - 1
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), F.array(last), lambda ends, _: F.when(
        F.get(ends, F.lit(0)) > 0, F.concat(F.array(F.get(best, F.get(ends, F.lit(0)))["back"]), ends)).otherwise(ends))
    return walked


def word_ids(words: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``words`` (word, distinct) -> word, ids."""
    vocab = model(path)
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in vocab.pieces.items()],
                                   "piece string, id int, score double")
    base = min(vocab.byte.values()) if vocab.byte else 0
    # dealt by word before the explode, so that the far larger edges stay where they are
    words = words.repartition(4 * spark.sparkContext.defaultParallelism, "word")
    if kind != "bpe":
        edges = lattice(words, pieces, vocab.longest, base)
        # the boundaries are used several times below, so they stay a column
        edges = edges.withColumn("best", fold_viterbi(F.col("word"), F.col("edges")))
        edges = edges.withColumn("ends", viterbi_ends(F.col("best")))
        return edges.select("word", _path_ids(F.col("edges"), F.col("ends")).alias("ids"))
    folded = F.length("word") <= MASK
    if vocab.late:
        folded &= ~F.col("word").rlike("|".join(map(re.escape, vocab.late)))
    edges = lattice(words.where(folded), pieces, vocab.longest, base)
    edges = edges.withColumn("mask", fold_bpe(F.col("word"), F.col("edges")))
    out = edges.select("word", _bpe_ids(F.col("edges"), F.col("mask")).alias("ids"))
    rest = words.where(~folded).select("word").mapInArrow(_merged(path), "word string, ids array<int>")
    return out.union(rest)


def _rare(path, frequent):
    def run(it):
        vocab, known = model(path), frequent.value
        for b in it:
            rows = [(d, r, i, w) for d, r, t in zip(*(b.column(c).to_pylist() for c in range(3)))
                    for i, w in enumerate(vocab.words(t)) if w not in known]
            cols = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["did", "rid", "at", "word"])
    return run


def _packed(path, frequent):
    hole = np.array([HOLE], "<u4").tobytes()

    def run(it):
        vocab, known = model(path), frequent.value
        for b in it:
            out = [b"".join(map(known.get, vocab.words(t), repeat(hole))) for t in b.column(2).to_pylist()]
            small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in out]   # ids are below 2**16 - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(3), b.column(0), b.column(1), pa.array(small, pa.binary())], names=["doc_id", "did", "rid", "packed"])
    return run


def _filled(it):
    for b in it:
        out = []
        for raw, at, ids in zip(*(b.column(c) for c in (1, 2, 3))):
            x = np.frombuffer(raw.as_py() or b"", "<u2").astype(np.int32)
            holes = np.flatnonzero(x == 0xFFFF)
            if len(holes):
                order = dict(zip(at.as_py(), ids.as_py()))
                parts, last = [], 0
                for h, k in zip(holes.tolist(), sorted(order)):
                    parts += [x[last:h], np.array(order[k], np.int32)]
                    last = h + 1
                x = np.concatenate([*parts, x[last:]])
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids."""
    spark = docs.sparkSession
    if len(model(path).text) >= 0xFFFF:
        raise ValueError("packed ids hold vocabularies below 65,535 pieces")
    words = stage(docs.select("text").mapInArrow(_counted(path), "word string, n long")
                  .groupBy("word").agg(F.sum("n").alias("n")), "words")
    ids = stage(word_ids(words.select("word"), path), "word_ids")
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")
    # at most FREQUENT words
    known = {w: np.asarray(i, "<u4").tobytes() for w, i in _pairs(ids.join(top, "word"))}
    known = spark.sparkContext.broadcast(known)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"),
                      F.xxhash64("text").alias("rid"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    rare = (src.mapInArrow(_rare(path, known), "did long, rid long, at int, word string")
            .join(ids, "word").groupBy("did", "rid")
            .agg(F.collect_list("at").alias("at"), F.collect_list("ids").alias("ids")))
    rare = stage(rare, "rare")
    # the packed documents go through the last shuffle: nothing else is left on disk by then
    discard(words)
    discard(ids)
    release(spark)
    packed = src.mapInArrow(_packed(path, known), "doc_id long, did long, rid long, packed binary")
    return (packed.join(rare, ["did", "rid"], "left").select("doc_id", "packed", "at", "ids")
            .mapInArrow(_filled, "doc_id long, ids array<int>"))


def _pairs(df: DataFrame):
    t = df.select("word", "ids").toArrow()
    for b in t.to_batches():
        yield from zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) -> doc_id, text."""
    def run(it):
        vocab = model(path)
        for b in it:
            text = [vocab.decode(x.tolist()) if len(x) else "" for x in b.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark, sf_dir):
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
