"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max
inverted index, distance-weighted votes.

Terms are lower-cased words without outer punctuation and their prefixes of 4
and 5 characters.  Fitting uses a bounded sample of the labelled training rows
(at most ``PER_CLASS`` of each class, those of least hash): terms that
``MIN_DF`` distinct toxic texts have (copies of one text are one) and whose chi-square against the label reaches ``MIN_CHI2``, nine in ten rows with it toxic,
form the vocabulary (at most ``MAX_TERMS``), and the sample's vectors over it form the index, which is
therefore bounded and broadcast.  Their document frequencies count all documents.
Every example of the sample is also searched by the cosine over all its words
(document frequencies of the sample), from ``NEAR`` on.

Search is exact: blocks of examples are visited by falling upper bound (the
largest weight of each term in the block) until the bound is below the k-th
best cosine; over all words the rare ones bound the cosine and the examples
that can reach ``NEAR`` are compared whole.  The score is the similarity-weighted
share of toxic neighbours (fourth power of the similarity over all words, where
half of a text's weight in common says little),
classes weighted back to their share among all labelled rows and shrunk
towards the rate among examples without any vocabulary term; a document
without a neighbour gets that rate.  A row's own example is none of its
neighbours.  ``evidence`` lists its nearest examples.

Edge cases: null and empty texts have no term and get the base rate; null or
repeated labels are dropped or merged (toxic if any row says so); without
labels every score is 0; repeated rows are scored each; other columns pass
through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

PER_CLASS = 4000
MAX_TERMS = 2000
MIN_CHI2 = 30.0
MIN_DF = 4                 # distinct toxic texts with a term
MIN_SHARE = 0.9            # toxic share among the labelled rows with a term, at least
K = 15
BLOCK = 64
SHRINK = 0.5
THRESHOLD = 0.3
NEAR = 0.5                 # cosine over all words from which an example votes
LEFT = 0.4                 # norm of the frequent words that only the examples in reach are compared by
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
MAX_CACHED = 300_000
GROUP = 1 << 17             # tokens of the texts that are looked up together


def terms_of(word: str) -> tuple[str, ...]:
    w = word.strip(EDGE)
    if not w:
        return ()
    out = ["w:" + w[:40]]
    if len(w) >= 4:
        out.append("4:" + w[:4])
    if len(w) >= 5:
        out.append("5:" + w[:5])
    return tuple(out)


class _Lookup(dict):
    """word -> ids of its vocabulary terms; a bounded table per worker."""

    def __init__(self, vocab):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word):
        v = tuple(self.vocab[t] for t in terms_of(word) if t in self.vocab)
        if len(self) < MAX_CACHED:
            self[word] = v
        return v

    def counts(self, text: str | None) -> Counter:
        return Counter(i for ids in map(self.__getitem__, (text or "").lower().split()) if ids for i in ids)


def _vector(counts: Counter, idf: np.ndarray):
    ids = np.array(sorted(counts), np.int64)
    w = np.array([1 + math.log(counts[i]) for i in ids.tolist()]) * idf[ids]
    return ids, w / np.sqrt((w * w).sum())


class BlockMaxIndex:
    """Postings by term over examples in blocks, with each block's largest
    weight per term."""

    def __init__(self, vectors, n_terms):
        # examples with the same leading term share blocks, so bounds are tight
        self.order = sorted(range(len(vectors)), key=lambda e: (
            int(vectors[e][0][vectors[e][1].argmax()]), e))
        n_blocks = -(-len(vectors) // BLOCK)
        self.top = np.zeros((n_terms, n_blocks))
        lists = [[] for _ in range(n_terms)]
        for slot, e in enumerate(self.order):
            for t, w in zip(vectors[e][0].tolist(), vectors[e][1].tolist()):
                lists[t].append((slot, w))
                self.top[t, slot // BLOCK] = max(self.top[t, slot // BLOCK], w)
        self.slots = [np.array([s for s, _ in x], np.int64) for x in lists]
        self.weights = [np.array([w for _, w in x]) for x in lists]
        self.bounds = [np.searchsorted(s, np.arange(n_blocks + 1) * BLOCK) for s in self.slots]

    def search(self, ids, w, k):
        """The k examples of largest cosine above zero: [(cosine, example)]."""
        upper = w @ self.top[ids]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-upper, kind="stable").tolist():
            if upper[b] <= 0 or len(best) == k and upper[b] < -best[-1][0] - 1e-9:
                break
            acc = np.zeros(BLOCK)
            for t, x in zip(ids.tolist(), w.tolist()):
                lo, hi = self.bounds[t][b], self.bounds[t][b + 1]
                acc[self.slots[t][lo:hi] - b * BLOCK] += x * self.weights[t][lo:hi]
            hit = np.flatnonzero(acc > 0)
            best = sorted(best + [(-round(float(acc[i]), 12), self.order[b * BLOCK + i]) for i in hit])[:k]
        return [(-s, e) for s, e in best]


def words(text: str | None) -> Counter:
    return Counter(w for x in (text or "").lower().split() if (w := x.strip(EDGE)))


class WholeIndex:
    """All examples by TF-IDF over all their words, for cosines from ``NEAR``."""

    def __init__(self, texts: list[str | None]):
        # as arrays at once: the words of all texts as dictionaries take much memory
        at, rows = {}, []
        for t in texts:
            c = words(t)
            rows.append((np.fromiter((at.setdefault(w, len(at)) for w in c), np.int32, len(c)),
                         np.fromiter(c.values(), np.int32, len(c))))
        n, names = len(texts), list(at)
        df = np.bincount(np.concatenate([ids for ids, _ in rows]), minlength=len(at))
        # rare words first
        order = sorted(range(len(names)), key=lambda i: (df[i], names[i]))
        self.vocab = {names[i]: k for k, i in enumerate(order)}
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.idf = np.log((n + 1) / (df[order].astype(float) + 1)) + 1
        self.unseen = math.log(n + 1) + 1
        self.vectors = []
        for ids, c in rows:
            ids = rank[ids]
            by = np.argsort(ids)
            ids, w, norm = self.weights_by_id(ids[by], c[by].astype(float), np.zeros(0))
            self.vectors.append((ids.astype(np.int32), (w / norm).astype(np.float32)))
        ids = np.concatenate([v[0] for v in self.vectors])
        order = np.argsort(ids, kind="stable")
        self.slots = np.repeat(np.arange(n, dtype=np.int32), [len(v[0]) for v in self.vectors])[order]
        self.weights = np.concatenate([v[1] for v in self.vectors])[order]
        self.starts = np.searchsorted(ids[order], np.arange(len(df) + 1))

    def _weights(self, counts: Counter):
        """(ids in order, weights, norm with the words that no example has)"""
        return self.weights_of({self.vocab[w]: n for w, n in counts.items() if w in self.vocab},
                               [n for w, n in counts.items() if w not in self.vocab])

    def weights_of(self, known: dict[int, int], other: list[int]):
        """The same from counts by word id and those of the words that no example has."""
        ids = np.fromiter(known, np.int64, len(known))
        order = np.argsort(ids)
        return self.weights_by_id(ids[order], np.fromiter(known.values(), float, len(known))[order], np.array(other, float))

    def weights_by_id(self, ids: np.ndarray, n: np.ndarray, other: np.ndarray):
        """The same from ids in order with their counts."""
        w = (1 + np.log(n)) * self.idf[ids]
        rest = ((1 + np.log(other)) ** 2).sum() * self.unseen ** 2
        return ids, w, math.sqrt((w * w).sum() + rest) or 1.0

    def search(self, counts: Counter, k: int) -> list[tuple[float, int]]:
        """The k examples of largest cosine, at least ``NEAR``: [(cosine, example)]."""
        return self.nearest(*self._weights(counts), k)

    def nearest(self, ids, w, norm, k: int) -> list[tuple[float, int]]:
        w = w / norm
        if (w * w).sum() < NEAR * NEAR - 1e-6:
            return []
        # the words after the first m have at most LEFT, so the first ones bound the cosine
        left = np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0.0))
        m = int(np.argmax(left <= LEFT))
        lo, hi = self.starts[ids[:m]], self.starts[ids[:m] + 1]
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        part = np.bincount(self.slots[at], np.repeat(w[:m], size) * self.weights[at], len(self.vectors))
        out = []
        for e in np.flatnonzero(part + left[m] >= NEAR - 1e-6).tolist():
            other, x = self.vectors[e]
            where = np.minimum(np.searchsorted(other, ids), len(other) - 1)
            s = float((w * x[where] * (other[where] == ids)).sum())
            if s >= NEAR - 1e-6:
                out.append((-round(s, 6), e))
        return [(-s, e) for s, e in sorted(out)[:k]]


class Model:
    """Vocabulary, idf, indexes and class weights; bounded by the sample."""

    def __init__(self, vocab, idf, examples, base, weight, whole=()):
        """``whole``: (doc_id, toxic, text) of every example of the sample."""
        self.whole_ids = [e[0] for e in whole]
        self.whole_toxic = [e[1] for e in whole]
        self.whole = WholeIndex([e[2] for e in whole]) if any(words(e[2]) for e in whole) else None
        self.vocab, self.idf, self.base, self.weight = vocab, idf, base, weight
        self.doc_ids = [e[0] for e in examples]
        self.toxic = [e[1] for e in examples]
        self.index = BlockMaxIndex([e[2] for e in examples], len(vocab)) if examples else None

        self.rows_of = Counter(self.whole_ids)

    def score(self, counts, text=None, own=None, found=None):
        """``own``: the row's id, whose examples have no vote, so that no label is
        an input of its own score; ``found``: the words of ``text`` as
        ``weights_by_id`` takes them, where they are known."""
        k = K + self.rows_of.get(own, 0)
        near = self.index.search(*_vector(counts, self.idf), k) if counts and self.index else []
        votes = [(s, s, self.toxic[e], self.doc_ids[e]) for s, e in near if own is None or self.doc_ids[e] != own][:K]
        if self.whole and text:
            near = self.whole.nearest(*self.whole.weights_by_id(*found), k) if found else self.whole.search(words(text), k)
            votes += [(s ** 4, s, self.whole_toxic[e], self.whole_ids[e]) for s, e in near
                      if own is None or self.whole_ids[e] != own][:K]
        total, toxic = SHRINK, SHRINK * self.base
        for v, _, y, _ in votes:
            total += v * self.weight[y]
            toxic += v * self.weight[y] * y
        votes.sort(key=lambda x: -x[1])
        return toxic / total, list(dict.fromkeys(x[3] for x in votes))[:3]


def _term_rows(it):
    for b in it:
        df = Counter()
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            df.update({(t, y) for w in set((text or "").lower().split()) for t in terms_of(w)})
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in df], pa.string()), pa.array([y for _, y in df], pa.int64()),
             pa.array(list(df.values()), pa.int64())], names=["term", "y", "n"])


def _df_rows(vocab):
    def run(it):
        lookup, df, n = _Lookup(vocab), Counter(), 0
        for b in it:
            for text in b.column(0).to_pylist():
                df.update(set(lookup.counts(text)))
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())],
                                         names=["id", "n"])
    return run


def _count_rows(vocab):
    def run(it):
        lookup = _Lookup(vocab)
        for b in it:
            c = [lookup.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(x) for x in c], pa.list_(pa.int64())),
                 pa.array([list(x.values()) for x in c], pa.list_(pa.int64()))], names=["doc_id", "y", "ids", "tf"])
    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("y"))
         .where("doc_id is not null and y in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2")
         .groupBy("doc_id").agg(F.max("y").alias("y")))
    totals = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}     # two rows
    picked = [y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    # at most 2 * PER_CLASS ids, so the broadcast is bounded
    sample = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .join(F.broadcast(picked[0].union(picked[1])), "doc_id"), "examples")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n1 or not n0:
        return Model({}, np.zeros(0), [], float(bool(n1)), {0: 1.0, 1: 1.0})
    # copies of a text are one
    texts = sample.groupBy("text").agg(F.max("y").alias("y"))
    distinct = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    d0, d1 = distinct.get(0, 0), distinct.get(1, 0)
    df = (texts.mapInArrow(_term_rows, "term string, y long, n long")
          .groupBy("term").agg(F.sum(F.expr("n * y")).alias("a"), F.sum(F.expr("n * (1 - y)")).alias("b"))
          .where(F.col("a") >= MIN_DF))
    a, b = F.col("a"), F.col("b")
    # a term of all texts says nothing
    chi2 = (F.pow(a * d0 - b * d1, 2.0) * (d0 + d1)
            / F.nullif((a + b) * (d0 + d1 - a - b) * F.lit(d0).cast("double") * d1, F.lit(0.0)))
    weight = {c: totals[c] / n[c] for c in (0, 1)}
    share = a * weight[1] / (a * weight[1] + b * weight[0])
    chosen = (df.withColumn("chi2", chi2).where((F.col("chi2") >= MIN_CHI2) & (share >= MIN_SHARE))
              .orderBy(F.desc("chi2"), "term").limit(MAX_TERMS).select("term").collect())
    vocab = {r["term"]: i for i, r in enumerate(chosen)}
    seen = {r["id"]: r["n"] for r in docs.select("text").mapInArrow(_df_rows(vocab), "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect()}     # one row per term
    idf = np.array([math.log((seen.get(-1, 0) + 1) / (seen.get(i, 0) + 1)) + 1 for i in range(len(vocab))])
    rows = sample.select("doc_id", "y", "text").mapInArrow(
        _count_rows(vocab), "doc_id long, y long, ids array<long>, tf array<long>")
    empty = {r["y"]: r["count"] * weight[r["y"]]
             for r in rows.where(F.size("ids") == 0).groupBy("y").count().collect()}
    base = (empty.get(1, 0) + 0.5 * n1 / (n0 + n1)) / (sum(empty.values()) + 0.5)
    examples = [(r["doc_id"], r["y"], _vector(Counter(dict(zip(r["ids"], r["tf"]))), idf))
                for r in rows.where(F.size("ids") > 0).orderBy("doc_id").collect()]     # the bounded sample
    whole = [(r["doc_id"], r["y"], r["text"]) for r in sample.orderBy("doc_id", "text").collect()]
    return Model(vocab, idf, examples, base, weight, whole)


class _Words:
    """Per distinct token its word's id among the examples' words (words that no
    example has: from -2 down, no word: -1) and its lexicon terms; a table per
    worker, emptied when it holds ``MAX_CACHED`` tokens."""

    def __init__(self, model: Model):
        self.vocab = model.vocab
        self.words = model.whole.vocab if model.whole else {}
        self.clear()

    def clear(self):
        self.at, self.terms, self.other = {}, {}, {}
        self.word = np.zeros(1 << 12, np.int64)
        self.lexical = np.zeros(1 << 12, bool)

    def hold(self, texts: list[list[str]]) -> None:
        if len(self.at) > MAX_CACHED:
            self.clear()
        for token in set().union(*texts).difference(self.at):
            i = self.at[token] = len(self.at)
            if i == len(self.word):
                self.word = np.concatenate([self.word, np.zeros_like(self.word)])
                self.lexical = np.concatenate([self.lexical, np.zeros_like(self.lexical)])
            word = token.strip(EDGE)
            known = self.words.get(word) if word else -1
            self.word[i] = -2 - self.other.setdefault(word, len(self.other)) if known is None else known
            terms = [self.vocab[t] for t in terms_of(token) if t in self.vocab]
            self.lexical[i] = bool(terms)
            if terms:
                self.terms[i] = terms

    def of(self, tokens: list[str]):
        """Counts of lexicon terms, and (ids, counts, counts of the words that no
        example has)."""
        at = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
        ids, n = np.unique(self.word[at], return_counts=True)
        known = ids >= 0
        terms = Counter(t for i in at[self.lexical[at]].tolist() for t in self.terms[i])
        return terms, (ids[known], n[known].astype(float), n[ids < -1].astype(float))


def _groups(texts: list[str | None]):
    """The tokens of some texts at a time."""
    group, n = [], 0
    for text in texts:
        group.append((text or "").lower().split())
        n += len(group[-1])
        if n >= GROUP:
            yield group
            group, n = [], 0
    yield group


def _scored(shared):
    def run(it):
        model = shared.value
        lookup = _Words(model)
        for b in it:
            out, own, texts = [], b.column(2).to_pylist(), b.column(0).to_pylist()
            for group in _groups(texts):
                lookup.hold(group)
                for tokens in group:
                    terms, found = lookup.of(tokens)
                    out.append(model.score(terms, texts[len(out)], own[len(out)], found))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([s for s, _ in out], pa.float64()),
                 pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["row", "score", "evidence"])
    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, anything else) -> row (all input columns as a
    struct), score, evidence (doc_ids of the nearest examples)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("text", F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"row {kind}, score double, evidence array<long>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold."""
    return score(docs, labels).where(F.col("score") < THRESHOLD).select("row.*")


def op7_toxicity(spark, sf_dir):
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    doc = F.col("row.doc_id")
    return out.select(doc.alias("doc_id"), F.expr("crc32(cast(row.doc_id as string)) % 4 = 2").alias("held_out"),
                      "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
