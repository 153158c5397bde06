"""Fill-in-the-middle transformation of documents, cut at line ends.

A text's units are its lines, each with its line end.  Two hashed numbers of
a document choose the units after which its prefix and its middle end; the
parts are written in psm or spm order behind sentinels.

The cuts are found on UTF-8 bytes viewed as 64-bit words (SWAR).  One
arithmetic expression marks the bytes of a word that end a unit, a second
those that continue a code point; ``bitwise_count`` per word and a running
sum make an index over a whole batch.  The k-th unit end is then a binary
search in the running sum and a select inside one word, and the code points
of a part are its bytes less the continuation bytes ranked inside it.  No
text is walked character by character, and no row leaves its partition: the
transformation is one pass without a shuffle.

Defined results: null and empty texts are plain, with 0 lines; so is a text
that holds one of the sentinels, as it could not be taken apart again; a null
id is hashed as an empty string; repeated rows give equal rows; a text of any
length is handled whole, in slices of about ``SLICE`` bytes of a batch;
columns that are added replace columns of the same name, others pass through;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# FIXED VALUES of the digest contract
SEED = "7"
SENTINELS = ("<P>", "<S>", "<M>")       # prefix, suffix, middle
PERCENT, SPM_PERCENT = 100, 50

SLICE = 8 << 20             # bytes of text that are indexed together
LOW_SEVEN = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH_BIT = np.uint64(0x8080808080808080)
LINE_ENDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)

ADDED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


# ---- marks in words ----------------------------------------------------------

def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, with at least one spare byte."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8").astype(np.uint64, copy=False)


def line_end_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed, exactly: the sum of
    the low seven bits stays inside its byte."""
    x = words ^ LINE_ENDS
    return ~(((x & LOW_SEVEN) + LOW_SEVEN) | x | LOW_SEVEN)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx."""
    return words & ~(words << ONE) & HIGH_BIT


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before byte ``at``."""
        word = at >> 3
        below = (ONE << ((at & 7) << 3).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The place of the marked byte with ``nth`` marked ones before it."""
        word = np.searchsorted(self.before, nth, side="right") - 1
        left, mark = nth - self.before[word], self.marks[word]
        for step in range(1, 8):                # at most eight marks a word
            mark = np.where(left >= step, mark & (mark - ONE), mark)
        lowest = mark & (~mark + ONE)
        return word * 8 + (np.bitwise_count(lowest - ONE) >> 3)


def cut_points(data: np.ndarray, start: np.ndarray, end: np.ndarray,
               first: np.ndarray, second: np.ndarray):
    """Of texts ``data[start:end]``: their numbers of lines, the bytes where
    prefix and middle end, and the code points of both.  ``first`` and
    ``second`` are the hashed numbers, taken modulo lines + 1."""
    words = words_of(data)
    ends, rest = Marks(line_end_marks(words)), Marks(continuation_marks(words))
    base = ends.rank(start)
    closed = ends.rank(end) - base
    open_line = (end > start) & (data[np.maximum(end - 1, 0)] != 10) if len(data) else np.zeros(len(start), bool)
    n = closed + open_line
    one, two = first % (n + 1), second % (n + 1)

    def place(units):
        at = np.where(units == 0, start, end)           # an open last line ends with the text
        inner = (units > 0) & (units <= closed)
        at[inner] = ends.select(base[inner] + units[inner] - 1) + 1
        return at

    prefix, middle = place(np.minimum(one, two)), place(np.maximum(one, two))
    at_start, at_prefix, at_middle = (x - rest.rank(x) for x in (start, prefix, middle))
    return n, prefix, middle, at_prefix - at_start, at_middle - at_prefix


# ---- batches -----------------------------------------------------------------

def _slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high
        low = high


def _transformed(texts: pa.Array, h: np.ndarray, percent: int, spm_percent: int, sentinels: tuple[bytes, ...]):
    """Columns of ``ADDED`` for one slice of texts; h: four numbers a row."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = data[offsets[0]:offsets[-1]]
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    n, prefix, middle, prefix_chars, middle_chars = cut_points(data, start, end, h[0], h[1])
    whole, p, s, m = data.tobytes(), *sentinels
    chosen, spm = h[2] % 100 < percent, h[3] % 100 < spm_percent
    forms, output = [], []
    for i, (a, b, c, d) in enumerate(zip(start.tolist(), prefix.tolist(), middle.tolist(), end.tolist())):
        text = whole[a:d]
        if a == d or not chosen[i] or p in text or s in text or m in text:
            forms.append("plain")
            output.append(text)
        elif spm[i]:
            forms.append("spm")
            output.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
        else:
            forms.append("psm")
            output.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
    plain = np.array([f == "plain" for f in forms], bool)
    return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64(), mask=plain),
            pa.array(middle_chars, pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED,
                   percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with n (lines), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output."""
    if len(set(sentinels)) != 3 or not all(s and s[0] not in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, and none may begin inside another")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    h = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])
    kept = [c for c in docs.columns if c not in ADDED.names]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), body.alias("body"), h.alias("h"))
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").cast(pa.large_string())
            numbers = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            for low, high in _slices(offsets, SLICE):
                made = _transformed(texts.slice(low, high - low), numbers[:, low:high], percent, spm_percent, marks)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), *made], ["row", *ADDED.names])

    schema = T.StructType([packed.schema["row"], *ADDED.fields])
    done = packed.mapInArrow(run, schema)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *ADDED.names)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, rebuilt from output and form alone.  Behind the order
    that the form names, each sentinel is found at its first place: none
    stands in a part, and none can begin inside another."""
    p, s, m = sentinels
    after = lambda c, x: F.substring_index(c, x, -1)        # noqa: E731
    before = lambda c, x: F.substring_index(c, x, 1)        # noqa: E731
    prefix = F.when(form == "psm", before(after(output, p), s)).otherwise(before(after(output, p), m))
    suffix = F.when(form == "psm", before(after(output, s), m)).otherwise(before(after(output, s), p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(output, m), suffix))
