"""Quality rules from tokeniser fertility.

Public vocabularies measure each document's words: characters per token and
token entropy with the byte-level BPE, byte-fallback share with the piece BPE.
Each language has a rejection band per measure, from the quartiles of all its
documents that pass the base rules, drawn towards the quartiles of its script
with the weight of ``PRIOR`` documents, so that no number of documents switches
to another band.  A document's script is that of most of its words.  Characters per token vary with
the inverse square root of the length, so a document is rejected only if its
distance from the median is beyond ``SHIFT`` interquartile ranges and, times
the root of its tokens, beyond ``SPREAD`` ranges of that product.  Entropy is
rejected below, byte fallback above ``SPREAD`` ranges from the quartile.

A word's tokens do not depend on its neighbours, so they are kept in a bounded
table per worker, and a document is measured by array operations over its words'
places in it.  Edge cases: null and empty texts have no words and fail the
base rules; a null language is one language; repeated rows are judged each;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import odd_constants, rolling, stage, table
from .tokens import byte_bpe

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
SPREAD, SHIFT = 5.0, 2.0
PRIOR = 100
MAX_WORDS, MAX_TOKENS = 400_000, 4_000_000      # of a worker's table
GROUP = 1 << 17         # words of the texts that are looked up together
# floors: smallest width taken for a measure's interquartile range
FLOOR = {"chars_per_token": 0.02, "token_entropy": 0.02, "fallback_share": 0.02}
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
_C = odd_constants(21, 3)

SCHEMA = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_tokens long, chars_per_token double, token_entropy double, fallback_share double, script string")


def script_of(word: str) -> str:
    """Script of the first letter, as the first word of its Unicode name."""
    return next((unicodedata.name(c, "").split(" ")[0] for c in word if c.isalpha()), "")


class WordTable:
    """Per distinct word what the measures need, in arrays: hash, characters,
    script, numbers of pieces and of byte pieces, and its tokens.  A table per
    worker, emptied between two documents when it holds ``MAX_WORDS`` words or
    ``MAX_TOKENS`` tokens."""

    def __init__(self, bpe_path=None, piece_path=None):
        import sentencepiece

        self.bpe = byte_bpe(bpe_path)
        self.pieces = sentencepiece.SentencePieceProcessor(
            model_file=piece_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.scripts: list[str] = [""]
        self.script_id = {"": 0}
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.columns = np.zeros((6, 1 << 12), np.int64)     # hash, chars, script, pieces, byte pieces, tokens
        self.first = np.zeros(1 << 12, np.int64)            # of its tokens in ``tokens``
        self.tokens, self.used = np.zeros(1 << 14, np.uint32), 0

    def _room(self, words: int, tokens: int):
        while len(self.at) + words > len(self.first):
            self.columns = np.concatenate([self.columns, np.zeros_like(self.columns)], axis=1)
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.used + tokens > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])

    def _add(self, words: list[bytes]):
        texts = [w.decode() for w in words]
        ids = [self.bpe.encode_ordinary(" " + t) for t in texts]
        pieces = self.pieces.encode(texts, num_threads=1)
        n, sizes = len(words), np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        self._room(n, total)
        lo, hi = len(self.at), len(self.at) + n
        c = self.columns[:, lo:hi]
        c[0] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n).view(np.int64)
        c[1] = np.fromiter(map(len, texts), np.int64, n)
        for i, t in enumerate(texts):
            script = script_of(t)
            if script not in self.script_id:
                self.script_id[script] = len(self.scripts)
                self.scripts.append(script)
            c[2, i] = self.script_id[script]
        c[3] = np.fromiter(map(len, pieces), np.int64, n)
        flat = self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, int(c[3].sum()))]
        c[4] = np.add.reduceat(np.append(flat, False), np.cumsum(c[3]) - c[3], dtype=np.int64) * (c[3] > 0)
        c[5] = sizes
        self.first[lo:hi] = self.used + np.cumsum(sizes) - sizes
        self.tokens[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total
        self.at.update(zip(words, range(lo, hi)))

    def hold(self, texts: list[list[bytes]]) -> None:
        """Add the words of some texts that are new, in one call of the tokenisers."""
        if len(self.at) > MAX_WORDS or self.used > MAX_TOKENS:
            self.clear()
        new = list(set().union(*texts).difference(self.at))
        if new:
            self._add(new)

    def tokens_of(self, at: np.ndarray) -> np.ndarray:
        size = self.columns[5][at]
        ends = np.cumsum(size)
        return self.tokens[np.arange(ends[-1]) + np.repeat(self.first[at] - (ends - size), size)]


_TABLES: dict = {}


def repeat_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    w = rolling(h, _C)
    sorted_ = np.sort(w)
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if not len(twice):
        return 0
    again = twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[j:j + len(w)] |= again
    return int(covered.sum())


def _groups(texts: list[str | None]):
    """(text, words) of some texts at a time, about ``GROUP`` words."""
    group, n = [], 0
    for text in texts:
        words = (text or "").encode().split()
        group.append((text or "", words))
        n += len(words)
        if n >= GROUP:
            yield group
            group, n = [], 0
    yield group


def measures(texts: list[str | None], table_: WordTable) -> list[tuple]:
    out = []
    for group in _groups(texts):
        table_.hold([words for _, words in group])
        out += [_measures(text, words, table_) for text, words in group]
    return out


def _measures(text: str, words: list[bytes], table_: WordTable) -> tuple:
    symbols = sum(map(text.count, SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0, 0, None, None, None, None
    at = np.fromiter(map(table_.at.__getitem__, words), np.int64, len(words))
    h, chars, script, pieces, byte_pieces, _ = table_.columns
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _LINE_WORD.search(line):
            seen.add(line)
    n_script = np.bincount(script[at], minlength=1)
    script = max(((n, table_.scripts[i]) for i, n in enumerate(n_script.tolist()) if n and i), default=(0, ""))[1]
    tokens = np.sort(table_.tokens_of(at))
    n = len(tokens)
    p = np.diff(np.append(np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])), n)) / n
    entropy = float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0
    word_chars = int(chars[at].sum())
    return (len(words), word_chars, symbols, dup, repeat_words(h[at].view(np.uint64)),
            n, word_chars / n, entropy, int(byte_pieces[at].sum()) / int(pieces[at].sum()), script)


def _rows(bpe_path, piece_path):
    def run(it):
        key = (bpe_path, piece_path)
        if key not in _TABLES:
            _TABLES[key] = WordTable(*key)
        for b in it:
            cols = list(zip(*measures(b.column(2).to_pylist(), _TABLES[key]))) or [[]] * 10
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)
    return run


def fertility(docs: DataFrame, bpe_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang) -> doc_id, the measures, base_failed, kept."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    m = src.mapInArrow(_rows(bpe_path, piece_path), SCHEMA).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    m = stage(m, "measures")
    names = list(FLOOR)
    good = m.where("not base_failed")
    m = _with_bands(m, good, names).withColumn("scaled", (
        F.col("chars_per_token") - F.col("q_chars_per_token")[1]) * F.sqrt("n_tokens"))
    m = _with_bands(m, m.where("not base_failed"), ["scaled"])

    def width(c):
        return F.greatest(F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0], F.lit(FLOOR.get(c, 0.2)))

    far = F.abs(F.col("chars_per_token") - F.col("q_chars_per_token")[1]) > SHIFT * width("chars_per_token")
    bad = (far & (F.abs("scaled") > SPREAD * width("scaled"))
           | (F.col("token_entropy") < F.col("q_token_entropy")[0] - SPREAD * width("token_entropy"))
           | (F.col("fallback_share") > F.col("q_fallback_share")[2] + SPREAD * width("fallback_share")))
    return m.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).drop(
        "script", "scaled", "q_scaled", *[f"q_{c}" for c in names])


def _with_bands(m: DataFrame, good: DataFrame, names: list[str]) -> DataFrame:
    """``m`` with ``q_<name>``: quartiles of its language and script, drawn
    towards those of the script."""
    # exact over a fixed grid: the same in every run, and as many counts as the grid has points
    quartiles = [F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{c}") for c in names]
    own = good.groupBy("lang", "script").agg(F.count("*").alias("b_n"), *quartiles).select(
        F.col("lang").alias("b_lang"), F.col("script").alias("b_script"), "b_n", *[F.col(f"q_{c}").alias(f"b_{c}") for c in names])
    whole = good.groupBy("script").agg(*quartiles).withColumnRenamed("script", "s_script")      # a row per script
    n = F.col("b_n")
    q = [F.coalesce(F.zip_with(f"b_{c}", f"q_{c}", lambda x, y: (n * x + PRIOR * y) / (n + PRIOR)), f"q_{c}").alias(f"q_{c}")
         for c in names]
    joined = (m.join(F.broadcast(whole), F.col("script").eqNullSafe(F.col("s_script")), "left")
              .join(own, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("script").eqNullSafe(F.col("b_script")), "left"))
    return joined.select(*m.columns, *q)


def op2_quality_fertility(spark, sf_dir):
    return fertility(table(spark, sf_dir, "documents")).drop("lang")
