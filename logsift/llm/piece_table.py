"""Fill-in-middle transformation over piece tables.

A document is never rewritten.  It is a list of descriptors (buffer, start,
length) over two immutable buffers, the document's own bytes and the sentinels:

* *Cutting* at two byte positions splits descriptors (prefix, middle, suffix).
* An *arrangement* permutes the cut pieces and puts sentinel descriptors
  between them; hashes and texts stream over the descriptors.
* *Restoring* makes the output the text buffer, cuts it at its sentinels, drops
  those, and applies the inverse permutation.

Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points; cuts fall on token
boundaries, found on the UTF-8 bytes (a token starts at a byte that continues
no code point and no run of letters).  Cuts and form of a document come from
the sha256 of ``1:`` and its decimal id, so they do not depend on the
partitioning; the work is one narrow pass, documents never leave their task.

Edge cases: null and empty texts are plain (n = 0); a text that holds a
sentinel is plain; a null ``doc_id`` is drawn like the empty text ``1:``;
repeated rows give equal rows; other columns are not read, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TEXT, MARKS = 0, 1
SENTINELS = b"<P><S><M>"
MARK = 3                                # bytes of a sentinel
PREFIX, MIDDLE, SUFFIX = 0, 1, 2        # the cut pieces, in document order
# form -> pieces in output order; each is led by its sentinel where given
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
LEAD = {PREFIX: 0, SUFFIX: MARK, MIDDLE: 2 * MARK}     # offsets into SENTINELS
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


class PieceTable:
    """Descriptors (buffer, start, length) over a text and the sentinels."""

    def __init__(self, text: bytes, pieces: list[tuple[int, int, int]] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *positions: int) -> list[list[tuple[int, int, int]]]:
        """The runs of descriptors between ascending byte positions; a
        descriptor across a position is split, no byte is copied."""
        runs, run, at, todo = [], [], 0, list(positions)
        for buffer, start, length in self.pieces:
            while todo and todo[0] - at < length:
                head = todo.pop(0) - at
                run.append((buffer, start, head))
                runs.append(run)
                run, start, length, at = [], start + head, length - head, at + head
            run.append((buffer, start, length))
            at += length
        return runs + [run] + [[] for _ in todo]

    def with_pieces(self, pieces) -> PieceTable:
        out = object.__new__(PieceTable)
        out.buffers, out.pieces = self.buffers, [p for p in pieces if p[2]]
        return out

    def stream(self):
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.stream():
            digest.update(piece)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def token_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the tokens start."""
    b = np.frombuffer(text, np.uint8)
    letter = _LETTER[b]
    starts = (b & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def draws(doc_id) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def arrange(doc: PieceTable, cuts: tuple[int, int], form: str) -> PieceTable:
    """The document's pieces in the order of ``form``, led by their sentinels."""
    runs = doc.cut(*cuts)
    return doc.with_pieces([p for k in ORDERS[form] for p in [(MARKS, LEAD[k], MARK), *runs[k]]])


def restore(output: bytes, form: str) -> PieceTable:
    """The document as descriptors over its output: sentinels are found (each
    occurs once and starts with a byte that it does not repeat, so the first
    find is the one that was put there), dropped, and the pieces permuted back."""
    out = PieceTable(output)
    if form == "plain":
        return out
    order = ORDERS[form]
    marks = [output.find(SENTINELS[LEAD[k]:LEAD[k] + MARK]) for k in order]
    bounds = [x for at in marks for x in (at, at + MARK)]
    runs = out.cut(*bounds)[2::2]           # what follows each sentinel
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return out.with_pieces([p for i in inverse for p in runs[i]])


def transform_text(doc_id, text: str | None):
    """(n, form, output as a piece table, code points of prefix and middle)."""
    raw = (text or "").encode()
    doc = PieceTable(raw)
    starts = token_starts(raw)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not raw or any(SENTINELS[i:i + MARK] in raw for i in LEAD.values()) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", doc.with_pieces(doc.pieces), None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    cuts = tuple(int(starts[k]) if k < n else len(raw) for k in (lo, hi))
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    b = np.frombuffer(raw, np.uint8)
    points = [int(np.count_nonzero((b[x:y] & 0xC0) != 0x80)) for x, y in ((0, cuts[0]), cuts)]
    return n, form, arrange(doc, cuts, form), *points


_PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                  ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                  ("pieces", pa.list_(_PIECE)), ("output", pa.string()), ("output_sha256", pa.string())])
OUT = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
       "pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string")


def _transform(batches):
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, form, out, prefix, middle = transform_text(doc_id, text)
            rows.append({"doc_id": doc_id, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle,
                         "pieces": [dict(zip(("buffer", "start", "length"), p)) for p in out.pieces],
                         "output": out.bytes().decode(), "output_sha256": out.sha256()})
        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def transform(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n (tokens), form, prefix_chars,
    middle_chars, pieces (descriptors of the output over the text, buffer 0, and
    the sentinels, buffer 1), output (text), output_sha256."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_transform, OUT)


def _restore(batches):
    for b in batches:
        output, form = b.schema.get_field_index("output"), b.schema.get_field_index("form")
        tables = [restore((o or "").encode(), f) for o, f in
                  zip(b.column(output).to_pylist(), b.column(form).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([t.bytes().decode() for t in tables], pa.string()),
             pa.array([t.sha256() for t in tables], pa.string())],
            names=[*b.schema.names, "restored", "restored_sha256"])


def restore_rows(rows: DataFrame) -> DataFrame:
    """Adds restored (the source text) and restored_sha256 to rows with
    ``output`` and ``form``, from these two alone."""
    schema = rows.select("*", F.lit("").alias("restored"), F.lit("").alias("restored_sha256")).schema
    return rows.mapInArrow(_restore, schema)


def op13_fill_in_middle(spark, sf_dir):
    out = transform(table(spark, sf_dir, "documents")).drop("pieces")
    return restore_rows(out).drop("output", "restored")


# the cut pieces as lists of tokens; the hex digits of the digest as numbers
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
k AS (SELECT doc_id, text, t, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a,
  CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
    OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(t[1:least(a, b)], '') AS prefix, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle,
  array_to_string(t[greatest(a, b) + 1:n], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
