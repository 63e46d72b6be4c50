"""Probabilistic suffix tree: a language model of variable-length contexts.

Tokens are lower-cased (A-Z) words and one end per text; a start mark stands
before the first word as context only.  The tree's root is the smoothed unigram
distribution.  A context of 1 to ``ORDER`` tokens that occurs ``MIN_COUNT`` times
is a node; it is retained if its next-symbol distribution diverges from that of
its longest proper suffix: the gain in log-likelihood over the suffix, summed
over its occurrences, must exceed the description length of its symbols, half a
log of its count each.  Suffixes of retained contexts are retained.  A node's
distribution is interpolated absolute discounting over symbols seen twice or
more after it, the rest of its mass spread like its suffix's distribution, so
each node sums to one.  A token is scored by the longest retained suffix of its
history.

How this becomes joins.  An n-gram's 64-bit key is made from the keys of its
first and of its last n - 1 tokens, so level k of the tree is a table of
(context key, suffix key, count), counted like level 1, with no strings.  The
score of a text is the sum over its n-grams of one value per key, 0 for keys
that are not in the table:

* a unigram w:  log P(w) at the root + log backoff(w) if w is a retained context,
* a longer n-gram (s, a):  log P(a | s) - log backoff(s) - log P(a | suffix of s)
  if s is retained and a kept in it, + log backoff(sa) if sa is a retained context,

since for every position the backoffs of all retained suffixes cancel up to the
longest one that kept the symbol.  So scoring is one equi-join of the n-grams of
a text with the value table.

Scale.  Every pass reads the texts and hashes words with array operations.
n-grams are counted within chunks of about ``CHUNK`` tokens, then by key range in
ranges that grow in number with the tokens; the range of an n-gram holds one
entry a chunk however frequent it is.  Contexts, symbols and values all grow
with the corpus: nothing is capped.  Two things of fixed size are broadcast, both
only savings: the values of the most frequent keys (``FREQUENT``), so that hot
keys are not shuffled, and bit sets of ``BITS`` bits that leave out n-grams which
no table holds (a false positive is looked up and found absent).

Edge cases: null and empty texts are one end token; a row with a null ``doc_id``
is trained on; repeated rows are texts of their own; other columns are not read;
without training rows every token has probability one at the root; an empty
table gives no rows.  Keys are 64-bit hashes: two of the words of a corpus get
the same one with a chance of about (distinct words)^2 / 2^60.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, release, splitmix, stage, table

ORDER = 2               # tokens of the longest context
MIN_COUNT = 8           # occurrences of a context
DISCOUNT = 0.75
KEEP = 2                # occurrences of a symbol after a context to be kept in it
CHUNK = 1 << 20         # tokens counted or looked up together
RANGE = 1 << 21         # tokens a key range
FREQUENT = 1 << 20      # values that are broadcast, at most
SLOT_BITS = 22
BITS = 1 << 26          # of a bit set
SLICE = 1 << 18         # bytes hashed together
BATCH = "8m"            # bytes of an Arrow batch: rows hold whole texts or packed arrays
MIN_RANGES = 32
BLOCK_BITS = 15         # bits of a bit set's block, as a power of two

_U = np.uint64
_BYTE = np.array([splitmix(7000 + (b + 32 if 65 <= b <= 90 else b)) for b in range(256)], _U)   # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = splitmix(71) | 1
START, END = _U(splitmix(72)), _U(splitmix(73))
_LEFT, _RIGHT, _SEED = (_U(splitmix(s) | 1) for s in (74, 75, 76))


# ------------------------------------------------------------ texts as keys --
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


class _Hasher:
    """Words of UTF-8 bytes as 64-bit keys: differences of one running sum of
    byte codes times powers of an odd number, shifted back by inverse powers."""

    up = down = None

    def __init__(self):
        if _Hasher.up is None:
            _Hasher.up, _Hasher.down = _powers(_R, SLICE + 1), _powers(pow(_R, -1, 1 << 64), SLICE + 1)

    def _slice(self, b: np.ndarray, first: np.ndarray):
        space = _SPACE[b]
        begins = ~space
        begins[1:] &= space[:-1] | first[1:]
        ends = ~space
        ends[:-1] &= space[1:] | first[1:]
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        n = len(b)
        if n > SLICE:           # one word longer than a slice
            up, down = _powers(_R, n + 1), _powers(pow(_R, -1, 1 << 64), n + 1)
        else:
            up, down = self.up, self.down
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[b] * up[:n], out=total[1:])
        return mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(_U)), lo

    def words(self, b: np.ndarray, starts: np.ndarray):
        """(keys, byte offsets) of the words of texts that begin at ``starts``."""
        first = np.zeros(len(b) + 1, bool)
        first[starts] = True
        keys, at, lo = [], [], 0
        while lo < len(b):
            hi = min(lo + SLICE, len(b))
            if hi < len(b):     # cut before a space or the start of a text
                cuts = np.flatnonzero(_SPACE[b[lo + 1:hi + 1]] | first[lo + 1:hi + 1])
                while not len(cuts) and hi < len(b):
                    hi = min(2 * hi - lo, len(b))
                    cuts = np.flatnonzero(_SPACE[b[lo + 1:hi]] | first[lo + 1:hi])
                hi = lo + 1 + int(cuts[-1]) if len(cuts) else len(b)
            k, offsets = self._slice(b[lo:hi], first[lo:hi])
            keys.append(k)
            at.append(offsets + lo)
            lo = hi
        return (np.concatenate(keys), np.concatenate(at)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def token_keys(texts: pa.Array):
    """Keys of start, words and end of every text in one array, and the number
    of them for each text (a null text: empty)."""
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    words, at = _Hasher().words(b, offsets[:-1])
    text = np.searchsorted(offsets[1:], at, side="right")
    sizes = np.bincount(text, minlength=len(texts)) + 2
    ends = np.cumsum(sizes)
    keys = np.empty(int(ends[-1]) if len(ends) else 0, _U)
    keys[ends - sizes], keys[ends - 1] = START, END
    keys[np.arange(len(words)) + 2 * text + 1] = words
    return keys, sizes


def join_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of the n-grams whose first and last n - 1 tokens have these keys."""
    return mix64(left * _LEFT + right * _RIGHT + _SEED)


def windows(tokens: np.ndarray, sizes: np.ndarray, order: int):
    """For n = 1 .. order + 1: keys of the n-grams at each position, and which
    positions start one that lies in one text (for n = 1: no start mark)."""
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(tokens))      # tokens to the end of the text
    keys, out = tokens, [(tokens, tokens != START)]
    for n in range(2, order + 2):
        keys = join_keys(keys[:-1], keys[1:]) if len(keys) > 1 else keys[:0]
        out.append((keys, room[:len(keys)] >= n))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _chunks(batches, weight: int = CHUNK):
    """Arrow batches (columns: .., text) as (batches, tokens, sizes) of about
    ``weight`` tokens."""
    held, tokens, sizes, n = [], [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        k, s = token_keys(b.column(b.num_columns - 1))
        held.append(b.select(list(range(b.num_columns - 1))))
        tokens.append(k)
        sizes.append(s)
        n += len(k)
        if n >= weight:
            yield held, np.concatenate(tokens), np.concatenate(sizes)
            held, tokens, sizes, n = [], [], [], 0
    if held:
        yield held, np.concatenate(tokens), np.concatenate(sizes)


# ------------------------------------------------------------- bit sets --
class BitSet:
    """A set of keys as ``BITS`` bits, two for a key: no key of it is missed, a
    few others pass."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(keys: DataFrame, key: str) -> BitSet:
        """From a column of keys: blocks of bits are made where their keys meet,
        so that ``BITS`` / 8 bytes reach the driver whatever the number of keys."""
        def blocks(batches):
            made = {}
            for b in batches:
                bit = np.unique(b.column(0).to_numpy())
                block = bit >> BLOCK_BITS
                for lo, hi in _runs(block):
                    bits = made.setdefault(int(block[lo]), np.zeros(1 << BLOCK_BITS, bool))
                    bits[bit[lo:hi] & ((1 << BLOCK_BITS) - 1)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(made), pa.int64()), pa.array(
                    [np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())],
                names=["block", "bits"])

        bit = F.explode(F.array(F.col(key).bitwiseAND(F.lit(BITS - 1)),
                                F.shiftright(F.col(key), 32).bitwiseAND(F.lit(BITS - 1))))
        dealt = (keys.select(bit.alias("bit")).repartition(MIN_RANGES, F.shiftright("bit", BLOCK_BITS)))
        words = np.zeros((BITS >> BLOCK_BITS, 1 << (BLOCK_BITS - 6)), _U)
        rows = dealt.mapInArrow(blocks, "block long, bits binary").toArrow()
        for block, bits in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
            words[block] = np.frombuffer(bits, _U)
        return BitSet(words.ravel())

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for bit in (keys & _U(BITS - 1), (keys >> _U(32)) & _U(BITS - 1)):
            found &= (self.words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) != 0
        return found


# ------------------------------------------------------------- counting --
def _token_counts(batches):
    for _, tokens, _ in _chunks(batches):
        keys, counts = np.unique(tokens[tokens != START], return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(counts)], names=["key", "n"])


def _pairs(level: int, ranges: int, wanted):
    """Chunk-wise counts of the (context, suffix) pairs of level ``level``: one
    row for each chunk and key range, with packed arrays."""
    def run(batches):
        has = wanted.value.has if wanted else None
        for _, tokens, sizes in _chunks(batches):
            grams = windows(tokens, sizes, level)
            context, inside = grams[level - 1][0], grams[level][1]
            if len(inside) and has:
                inside = inside & has(context[:len(inside)])
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            key = grams[level][0][at]
            order = np.argsort(key)
            key, at = key[order], at[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(key))).astype(np.uint32)
            if counts.max() > 255:      # a larger count is several entries
                times = (counts + 254) // 255
                last = np.cumsum(times) - 1
                first, rest = np.repeat(first, times), counts - 255 * (times - 1)
                counts = np.full(len(first), 255, np.uint32)
                counts[last] = rest
            key, at = key[first], at[first]
            place = _range_of(key, ranges)
            for lo, hi in _runs(place):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(place[lo])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (
                        context[at[lo:hi]], context[at[lo:hi] + 1], counts[lo:hi].astype(np.uint8))]],
                    names=["place", "context", "suffix", "n"])
    return run


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> _U(40)) * _U(ranges) >> _U(24)).astype(np.int32)


def _runs(values: np.ndarray):
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else [0]
    return zip(edges[:-1], edges[1:])


def _merged(batches):
    """Sums the packed counts of a key range; the rows come sorted by range."""
    def total(rows):
        context, suffix = (np.concatenate([np.frombuffer(r[i], _U) for r in rows]) for i in (1, 2))
        n = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
        rows.clear()
        key = join_keys(context, suffix)
        order = np.argsort(key).astype(np.uint32)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n[order], first, dtype=np.int64)
        kept = n >= KEEP
        at = order[first[kept]]
        return pa.RecordBatch.from_arrays(
            [_signed(key[first[kept]]), _signed(context[at]), _signed(suffix[at]), pa.array(n[kept])],
            names=["key", "context", "suffix", "n"])

    held, place = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and place != row[0]:
                yield total(held)
            place = row[0]
            held.append(row)
    if held:
        yield total(held)


def _count_pairs(texts: DataFrame, level: int, ranges: int, wanted) -> DataFrame:
    """(key, context, suffix, n) of the n-grams of ``level`` + 1 tokens that
    occur ``KEEP`` times or more."""
    packed = texts.mapInArrow(_pairs(level, ranges, wanted), "place int, context binary, suffix binary, n binary")
    return stage(packed.repartition(ranges, "place").sortWithinPartitions("place")
                 .mapInArrow(_merged, "key long, context long, suffix long, n long"), f"pairs{level}")


# -------------------------------------------------------------- the tree --
def _level(pairs: DataFrame, contexts: DataFrame, parents: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One level of the tree from its counts, ``contexts`` (context, total) and
    ``parents`` (suffix, below: log10 P of the symbol at the parent node):

    nodes (context, total, kept, symbols, backoff: log10 of the mass that is
    spread like the parent's distribution) and
    symbols (key, context, suffix, n, p: log10 P at the node, more: p - backoff -
    below)."""
    sums = pairs.groupBy("context").agg(F.sum("n").alias("kept"), F.count("*").alias("symbols"))
    spread = (F.col("total") - F.col("kept") + DISCOUNT * F.col("symbols")) / F.col("total")
    nodes = stage(contexts.where(F.col("total") >= MIN_COUNT).join(sums, "context")
                  .withColumn("backoff", F.log10(spread)), f"nodes{k}")
    p = F.log10((F.col("n") - DISCOUNT) / F.col("total") + F.pow(F.lit(10.0), F.col("backoff") + F.col("below")))
    rows = (pairs.join(nodes.select("context", "total", "backoff"), "context").join(parents, "suffix")
            .withColumn("p", p))
    return nodes, stage(rows.select("key", "context", "suffix", "n", "p",
                                    (F.col("p") - F.col("backoff") - F.col("below")).alias("more")), f"symbols{k}")


def _retained(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Contexts of a level whose gain over the parent exceeds their cost."""
    more = symbols.groupBy("context").agg(F.sum(F.col("n") * F.col("more")).alias("more"))
    gain = F.col("more") + F.col("total") * F.col("backoff")
    cost = 0.5 * (F.col("symbols") + 1) * F.log10(F.col("total").cast("double"))
    return nodes.join(more, "context").where(gain > cost).select("context", "backoff")


class Tree:
    """values: (key, value, base, known, n), a row for each n-gram with a value;
    numbers of training tokens and of distinct ones; the value of the start mark."""

    def __init__(self, values, tokens, distinct, start):
        self.values, self.tokens, self.distinct, self.start = values, tokens, distinct, start

    @property
    def unknown(self) -> float:
        return math.log10(0.5 / (self.tokens + 0.5 * (self.distinct + 1)))


def learn(texts: DataFrame, order: int = ORDER) -> Tree:
    """The suffix tree of a column of texts."""
    counted = stage(texts.mapInArrow(_token_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    size = counted.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"),
                       F.max(F.when(F.col("key") == _long(END), F.col("n"))).alias("texts")).first()
    tokens, distinct, n_texts = size["tokens"] or 0, size["distinct"], size["texts"] or 0
    words = counted.withColumn("root", F.log10((F.col("n") + 0.5) / F.lit(tokens + 0.5 * (distinct + 1))))
    ranges = max(MIN_RANGES, -(-tokens // RANGE))
    # contexts of one token: words (each has one follower) and the start mark
    contexts = words.where(F.col("key") != _long(END)).select(F.col("key").alias("context"), F.col("n").alias("total"))
    contexts = contexts.union(texts.sparkSession.createDataFrame([(_long(START), n_texts)], "context long, total long"))
    parents = words.select(F.col("key").alias("suffix"), F.col("root").alias("below"))
    sc = texts.sparkSession.sparkContext
    levels = []
    for k in range(1, order + 1):
        wanted = sc.broadcast(BitSet.of(contexts.where(F.col("total") >= MIN_COUNT), "context"))
        release(texts.sparkSession)
        pairs = _count_pairs(texts, k, ranges, wanted)
        nodes, symbols = _level(pairs, contexts, parents, k)
        discard(pairs)
        levels.append((nodes, symbols))
        contexts = symbols.where(F.col("suffix") != _long(END)).select(F.col("key").alias("context"), F.col("n").alias("total"))
        parents = symbols.select(F.col("key").alias("suffix"), F.col("p").alias("below"))
    # from the longest contexts down, as suffixes of retained ones are retained
    kept, longer = [None] * order, None
    for k in range(order - 1, -1, -1):
        nodes, symbols = levels[k]
        own = _retained(nodes, symbols)
        if longer is not None:
            ends = symbols.join(longer.select(F.col("context").alias("key")), "key", "left_semi")
            also = ends.select(F.col("suffix").alias("context")).distinct()
            own = own.union(nodes.join(also, "context", "left_semi").select("context", "backoff")).distinct()
        kept[k] = longer = stage(own, f"kept{k + 1}")
    unknown = F.lit(math.log10(0.5 / (tokens + 0.5 * (distinct + 1))))

    def with_own(rows, k):      # ``own``: backoff of the n-gram as a retained context
        if k == order:
            return rows.withColumn("own", F.lit(None).cast("double"))
        return rows.join(kept[k].select(F.col("context").alias("key"), F.col("backoff").alias("own")), "key", "left")

    none = F.lit(0.0)
    values = with_own(words, 0).select(
        "key", (F.col("root") - unknown + F.coalesce("own", none)).alias("value"),
        (F.col("root") - unknown).alias("base"), F.lit(1).alias("known"), "n")
    for k, (_, symbols) in enumerate(levels):
        inner = symbols.join(kept[k].select("context", F.lit(True).alias("inner")), "context", "left")
        values = values.union(with_own(inner, k + 1).where("inner or own is not null").select(
            "key", (F.when(F.col("inner"), F.col("more")).otherwise(none) + F.coalesce("own", none)).alias("value"),
            none.alias("base"), F.lit(0).alias("known"), "n"))
    values = stage(values, "values")
    start = kept[0].where(F.col("context") == _long(START)).select("backoff").first()
    for used in [counted, *kept, *[t for level in levels for t in level]]:
        discard(used)
    return Tree(values, tokens, distinct, start["backoff"] if start else 0.0)


def _long(x) -> int:
    return int(x) - (1 << 64) if int(x) >> 63 else int(x)


# --------------------------------------------------------------- scoring --
class _Frequent:
    """Values of frequent keys in a table of ``1 << SLOT_BITS`` slots; a key whose
    slot is taken by a more frequent one is left to the join."""

    def __init__(self, key, value, base, known):
        slot = self._slot(key)          # the rows come with the most frequent first
        _, first = np.unique(slot, return_index=True)
        self.key = np.zeros(1 << SLOT_BITS, _U)
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.key[slot[first]], self.at[slot[first]] = key[first], first
        self.value, self.base, self.known = value, base, known

    @staticmethod
    def _slot(key):
        return (key >> _U(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys):
        """(found, row of each found key)."""
        slot = self._slot(keys)
        found = self.key[slot] == keys
        return found, self.at[slot[found]]


_TABLES: dict = {}


def _frequent(rows):
    """The broadcast rows as a table, made once a worker."""
    if rows.get("id") not in _TABLES:
        _TABLES.clear()
        _TABLES[rows["id"]] = _Frequent(*rows["columns"])
    return _TABLES[rows["id"]]


def _frequent_rows(values: DataFrame) -> dict:
    """At most ``FREQUENT`` rows, those of the largest counts: whole classes of
    the counts' logarithms, chosen from their histogram."""
    cls = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    hist = sorted(((r["c"], r["count"]) for r in values.groupBy(cls.alias("c")).count().collect()), reverse=True)
    total, least = 0, None
    for c, n in hist:
        total += n
        if total > FREQUENT:
            break
        least = c
    if least is None:
        rows = values.limit(0).toArrow()
    else:
        rows = values.where(cls >= least).toArrow()
    order = np.argsort(-rows.column("n").to_numpy(), kind="stable")
    key = rows.column("key").to_numpy().view(_U)[order]
    cols = [rows.column(c).to_numpy()[order] for c in ("value", "base", "known")]
    return {"id": splitmix(len(key)) ^ int(np.bitwise_xor.reduce(key, initial=_U(0))),
            "columns": (key, cols[0], cols[1], cols[2].astype(np.int8))}


_ROWS = "place int, chunk long, kind int, keys binary, texts binary, data binary, held binary"
_NAMES = ["place", "chunk", "kind", "keys", "texts", "data", "held"]
MODEL, LOOKUP, TEXTS, FOUND = 0, 1, 2, 3


def _row(place, chunk, kind, keys=None, texts=None, data=None, held=None):
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int32()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()),
         *[pa.array([x], pa.binary()) for x in (keys, texts, data, held)]], names=_NAMES)


def _model_rows(ranges: int):
    """The value table packed by key range."""
    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy().view(_U)
            order = np.argsort(key)
            key = key[order]
            value, base, known = (b.column(i).to_numpy()[order] for i in (1, 2, 3))
            place = _range_of(key, ranges)
            for lo, hi in _runs(place):
                yield _row(int(place[lo]), 0, MODEL, key[lo:hi].tobytes(), known[lo:hi].astype(np.int8).tobytes(),
                           np.stack([value[lo:hi], base[lo:hi]]).tobytes())
    return run


def _asked(order: int, ranges: int, shared):
    """Per chunk: a row with the texts' sums over frequent keys, and for each key
    range a row with the other keys that a table may hold."""
    def run(batches):
        rows, bits = shared.value
        table_ = _frequent(rows)
        task = TaskContext.get().partitionId() << 24
        for i, (held, tokens, sizes) in enumerate(_chunks(batches, CHUNK // 2)):     # beside the table of values
            m = len(sizes)
            text = np.repeat(np.arange(m, dtype=np.int32), sizes)
            sums = np.zeros((3, m))
            keys, owner = [], []
            for n, (gram, inside) in enumerate(windows(tokens, sizes, order)):
                at = np.flatnonzero(inside)
                gram, own = gram[at], text[at]
                found, row = table_.find(gram)
                mine = own[found]
                sums[0] += np.bincount(mine, table_.value[row], m)
                if not n:
                    sums[1] += np.bincount(mine, table_.base[row], m)
                    sums[2] += np.bincount(mine, table_.known[row], m)
                gram, own = gram[~found], own[~found]
                maybe = bits.has(gram)
                keys.append(gram[maybe])
                owner.append(own[maybe])
            key, owner = np.concatenate(keys), np.concatenate(owner)
            sort = np.argsort(key)
            key, owner = key[sort], owner[sort]
            chunk = task + i
            ids = pa.concat_tables([pa.Table.from_batches([b]) for b in held]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_table(ids)
            yield _row(-1 - chunk % ranges, chunk, TEXTS, sizes.astype(np.int64).tobytes(), None, sums.tobytes(),
                       sink.getvalue().to_pybytes())
            owner = owner.astype(_owner_type(m))
            place = _range_of(key, ranges)
            for lo, hi in _runs(place):
                yield _row(int(place[lo]), chunk, LOOKUP, key[lo:hi].tobytes(), owner[lo:hi].tobytes(),
                           np.int64(m).tobytes())
    return run


def _owner_type(texts: int):
    return np.uint16 if texts <= 1 << 16 else np.uint32


def _answered(batches):
    """Looks the asked keys up, range by range (the rows come sorted by range,
    the table's first); a found row holds the texts' sums of one chunk."""
    place, packed, key, value, base, known = None, [], None, None, None, None
    for b in batches:
        for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)))):
            if row[2] == TEXTS:
                yield b.slice(i, 1)
                continue
            if row[0] != place:
                place, packed, key = row[0], [], None
            if row[2] == MODEL:
                packed.append(row)
                continue
            if key is None:
                key = np.concatenate([np.frombuffer(r[3], _U) for r in packed] or [np.zeros(0, _U)])
                sort = np.argsort(key)
                both = [np.frombuffer(r[5]).reshape(2, -1) for r in packed] or [np.zeros((2, 0))]
                value, base = np.concatenate(both, axis=1)[:, sort]
                known = np.concatenate([np.frombuffer(r[4], np.int8) for r in packed] or [np.zeros(0, np.int8)])[sort]
                key, packed = key[sort], []
            if not len(key):
                continue
            m = int(np.frombuffer(row[5], np.int64)[0])
            asked, owner = np.frombuffer(row[3], _U), np.frombuffer(row[4], _owner_type(m))
            at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            found = key[at] == asked
            at, owner = at[found], owner[found]
            if len(at):
                sums = np.stack([np.bincount(owner, x[at], m) for x in (value, base, known)])
                yield _row(0, row[1], FOUND, data=sums.tobytes())


def _summed(batches):
    """Adds the sums of a chunk (the rows come sorted by chunk, its texts first)."""
    def done(row, sums):
        ids = pa.ipc.open_stream(row[6]).read_all().combine_chunks()
        sizes = np.frombuffer(row[3], np.int64) - 1     # words and the end
        cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in ids.columns]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(sizes), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])],
            names=[*ids.schema.names, "n_tokens", "n_known", "base", "score"])

    held, sums = None, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[2] == TEXTS:
                if held is not None:
                    yield done(held, sums)
                held, sums = row, np.frombuffer(row[5]).reshape(3, -1).copy()
            else:
                sums += np.frombuffer(row[5]).reshape(3, -1)
    if held is not None:
        yield done(held, sums)


def score(docs: DataFrame, tree: Tree, order: int = ORDER) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known,
    base_score, score."""
    spark = docs.sparkSession
    n = tree.values.count()
    ranges = max(MIN_RANGES, -(-tree.tokens // RANGE), -(-n // RANGE))
    shared = spark.sparkContext.broadcast((_frequent_rows(tree.values), BitSet.of(tree.values, "key")))
    release(spark)
    asked = docs.select("doc_id", "held_out", "text").mapInArrow(_asked(order, ranges, shared), _ROWS)
    model = tree.values.select("key", "value", "base", "known").mapInArrow(_model_rows(ranges), _ROWS)
    found = (asked.union(model).repartition(ranges, "place").sortWithinPartitions("place", "kind")
             .mapInArrow(_answered, _ROWS))
    sums = (found.repartition(ranges, "chunk").sortWithinPartitions("chunk", "kind")
            .mapInArrow(_summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"))
    root = F.lit(tree.unknown) * F.col("n_tokens")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", (F.col("base") + root).alias("base_score"),
                       (F.col("score") + root + F.lit(tree.start)).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from (a null id: learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the rows of ``docs`` (doc_id, text) that are not held out and
    scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probabilities)."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    tree = learn(rows.where(~F.col("held_out")).select("text"), order)
    return score(rows, tree, order).select("doc_id", "held_out", "n_tokens", "n_known",
                                           F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_suffix_tree_lm(spark, sf_dir):
    return score_corpus(table(spark, sf_dir, "documents"))
