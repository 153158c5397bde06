"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

A pre-token is cut wherever no piece of the vocabulary spans two neighbouring
bytes: merges never cross such a place, so a text's tokens are the sum over
its pre-tokens.  Lengths come from two tiers, both beside the map task:

1. a hash table of the frequent pre-tokens, broadcast once.  It holds their
   bytes themselves (up to ``KEY_BYTES``), so a hit is exact, and it has at
   most ``TABLE`` entries at any size of the corpus;
2. for a miss the library itself, behind a cache that the Python worker keeps
   from task to task, bounded in bytes.

What is frequent is counted over all documents: each task keeps a bounded
summary of its own pre-tokens and hands on the ``TASK_TOP`` commonest, which
are added up.  That table only saves time - counts do not depend on it - and
pre-tokens themselves are never shuffled.  The model travels with the job.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of
special tokens inside a text are ordinary text, as the library has it by
default; a text of any length is counted whole, in strips cut between
pre-tokens; repeated rows give equal rows; null keys pass through; columns
that are added replace columns of the same name; an empty table gives an
empty table.  A model that normalises characters, adds no blank in front or
joins over line ends is refused, as its pre-tokens could not be cut this way.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MODEL_NAME = "piece_bpe_32k.model"
LIMIT = 4096                # tokens; more is over the limit
TABLE = 1 << 16             # frequent pre-tokens in the broadcast table
TASK_TOP = 1 << 13          # pre-tokens a task reports
SUMMARY = 1 << 17           # pre-tokens a task holds while counting
KEY_BYTES = 16              # of a pre-token in the table
STRIP = 4 << 20             # bytes of text split together
CACHE_BYTES = 24 << 20      # of a worker's cache
CACHED_UNIT = 128           # longer pre-tokens are not cached
BLANK = "▁"

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))     # odd multipliers of the hash
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


# ---- the model ---------------------------------------------------------------

def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_NAME)


class Lengths:
    """The library's token counts of single pre-tokens."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.front = len(self.model.encode("\n"))
        self.cache: dict[bytes, int] = {}
        self.held = 0

    def of(self, units: list[bytes]) -> list[int]:
        """Counted behind a line end, which no piece spans, so that the
        blank the library puts in front of a text stays apart."""
        coded = self.model.encode(["\n" + u.decode("utf-8") for u in units], num_threads=1)
        return [len(ids) - self.front for ids in coded]

    def cached(self, units: list[bytes]) -> list[int]:
        cache = self.cache
        new = list({u for u in units if u not in cache})
        fresh = dict(zip(new, self.of(new)))
        out = [fresh[u] if u in fresh else cache[u] for u in units]
        keep = {u: n for u, n in fresh.items() if len(u) <= CACHED_UNIT}
        size = sum(map(len, keep)) + 120 * len(keep)
        if self.held + size > CACHE_BYTES:
            cache.clear()
            self.held = 0
        if size <= CACHE_BYTES:
            cache.update(keep)
            self.held += size
        return out


def worker_lengths(proto: bytes, digest: str) -> Lengths:
    """One per Python worker and model, kept from task to task."""
    home = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    kept = home.__dict__.setdefault("lengths", {})
    if digest not in kept:
        kept.clear()
        kept[digest] = Lengths(proto)
    return kept[digest]


def spans_of(proto: bytes) -> np.ndarray:
    """For every pair of bytes (first * 256 + second) whether they must stay
    together: inside a character, or inside some piece.  Refuses models whose
    pre-tokens are not independent."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=proto)
    together = np.zeros((256, 256), bool)
    together[:, 0x80:0xC0] = True
    last = lambda c: (0x20, c.encode()[-1]) if c == BLANK else (c.encode()[-1],)        # noqa: E731
    first = lambda c: (0x20, c.encode()[0]) if c == BLANK else (c.encode()[0],)         # noqa: E731
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        piece = m.id_to_piece(i)
        for a, b in zip(piece, piece[1:]):
            for x in last(a):
                for y in first(b):
                    together[x, y] = True
    if together[10].any() and together[10, np.r_[0:0x80, 0xC0:256]].any() or together[:, 10].any():
        raise ValueError("pieces of this model go over line ends")
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    if m.normalize(every) != BLANK + every.replace(" ", BLANK) or m.normalize("  a  b  ") != BLANK * 3 + "a" + BLANK * 2 + "b" + BLANK * 2:
        raise ValueError("this model changes characters, or adds no blank in front")
    return together.reshape(-1)


# ---- pre-tokens of a strip ---------------------------------------------------

def unit_starts(data: np.ndarray, together: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    cut = np.ones(len(data), bool)
    np.logical_not(together[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]], out=cut[1:])
    cut[text_starts] = True
    return np.flatnonzero(cut)


def unit_keys(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first sixteen bytes of each pre-token as two words; ``padded`` has
    sixteen spare bytes."""
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    low = at[starts] & MASKS[np.minimum(sizes, 8)]
    high = at[starts + 8] & MASKS[np.clip(sizes - 8, 0, 8)]
    return low, high


def key_hash(low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = low * MIX[0] ^ ((high ^ sizes.astype(np.uint64)) * MIX[1])
    h ^= h >> np.uint64(32)
    return h * MIX[0]


class Table:
    """Open addressing over (two words, size) -> tokens; exact on a hit."""

    def __init__(self, units: list[bytes], tokens: list[int]):
        self.bits = max(4, (2 * max(1, len(units)) - 1).bit_length())
        slots = 1 << self.bits
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.tokens = np.full(slots, 255, np.uint8), np.zeros(slots, np.uint8)
        self.reach = 1
        for unit, n in zip(units, tokens):
            low, high = (int.from_bytes(unit[i:i + 8], "little") for i in (0, 8))
            h = key_hash(*(np.array([x], np.uint64) for x in (low, high)), np.array([len(unit)]))
            at, steps = int(self._slot(h)[0]), 1
            while self.size[at] != 255:
                at, steps = (at + 1) & (slots - 1), steps + 1
            self.low[at], self.high[at], self.size[at], self.tokens[at] = low, high, len(unit), n
            self.reach = max(self.reach, steps)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each key, -1 where the table does not hold it."""
        out = np.full(len(low), -1, np.int64)
        slot = self._slot(key_hash(low, high, sizes))
        left = np.flatnonzero(sizes <= KEY_BYTES)
        for step in range(self.reach):
            at = (slot[left] + step) & ((1 << self.bits) - 1)
            hit = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.size[at] == sizes[left])
            out[left[hit]] = self.tokens[at[hit]]
            left = left[~hit & (self.size[at] != 255)]
            if not len(left):
                break
        return out


def strips(texts: pa.Array, together: np.ndarray, most: int | None = None) -> Iterator[tuple]:
    """(padded bytes, unit starts, unit sizes, rows, first unit of each row)
    over texts that each have a blank put in front.  Short texts share a
    strip; a long one is cut between pre-tokens into several."""
    most = most or STRIP
    fronted = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(fronted.buffers()[1], np.int64)[fronted.offset:fronted.offset + len(fronted) + 1] if len(fronted) else np.zeros(1, np.int64)
    data = np.frombuffer(fronted.buffers()[2], np.uint8) if len(fronted) else np.zeros(0, np.uint8)

    def strip(low, high, text_starts):
        padded = np.zeros(high - low + KEY_BYTES, np.uint8)
        padded[:high - low] = data[low:high]
        starts = unit_starts(padded[:high - low], together, text_starts)
        return padded, starts, np.diff(starts, append=high - low)

    row, n = 0, len(fronted)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[last])
        if high - low <= most or last > row + 1:
            starts = offsets[row:last] - low
            padded, units, sizes = strip(low, high, starts)
            yield padded, units, sizes, np.arange(row, last), np.searchsorted(units, starts)
        else:                               # one long text
            step = most
            while low < high:
                end = min(high, low + step)
                padded, units, sizes = strip(low, end, np.zeros(1, np.int64))
                if end < high:              # its last pre-token may go on
                    if len(units) == 1:
                        step *= 2
                        continue
                    end, units, sizes, step = low + int(units[-1]), units[:-1], sizes[:-1], most
                yield padded, units, sizes, np.array([row]), np.zeros(1, np.int64)
                low = end
        row = last


# ---- the job -----------------------------------------------------------------

def frequent_units(texts: DataFrame, together: np.ndarray) -> list[bytes]:
    """At most ``TABLE`` of the commonest short pre-tokens of column ``body``
    over all rows.  Each task counts in a summary of bounded size; what falls
    out of it was rare there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for padded, starts, sizes, _, _ in strips(batch.column("body"), together):
                short = sizes <= KEY_BYTES
                starts, sizes = starts[short], sizes[short]
                _, first, counts = np.unique(key_hash(*unit_keys(padded, starts, sizes), sizes), return_index=True, return_counts=True)
                whole = padded.tobytes()
                for a, s, c in zip(starts[first].tolist(), sizes[first].tolist(), counts.tolist()):
                    unit = whole[a:a + s]
                    seen[unit] = seen.get(unit, 0) + c
                if len(seen) > SUMMARY:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1])[:SUMMARY // 2])
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TASK_TOP]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["unit", "seen"])

    tops = texts.mapInArrow(run, "unit binary, seen bigint")
    best = tops.groupBy("unit").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "unit").limit(TABLE)
    return [bytes(r["unit"]) for r in best.select("unit").collect()]        # at most TABLE rows of KEY_BYTES


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark: SparkSession = docs.sparkSession
    with open(model or default_model(), "rb") as f:
        proto = f.read()
    together, digest = spans_of(proto), hashlib.sha256(proto).hexdigest()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    units = frequent_units(docs.select(body.alias("body")), together)
    tokens = Lengths(proto).of(units)
    fits = [(u, n) for u, n in zip(units, tokens) if n <= 255]
    shared = spark.sparkContext.broadcast((proto, digest, together, Table([u for u, _ in fits], [n for _, n in fits])))

    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    kept = [c for c in docs.columns if c not in (*added.names, "over_limit")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, digest, together, table = shared.value
        lengths = worker_lengths(proto, digest)
        for batch in batches:
            texts = batch.column("body")
            totals = np.zeros(len(texts), np.int64)
            for padded, starts, sizes, rows, first in strips(texts, together):
                n = table.look_up(*unit_keys(padded, starts, sizes), sizes)
                missed = np.flatnonzero(n < 0)
                if len(missed):
                    whole = padded.tobytes()
                    n[missed] = lengths.cached([whole[a:a + s] for a, s in zip(starts[missed].tolist(), sizes[missed].tolist())])
                totals[rows] += np.add.reduceat(n, first)
            size = pc.binary_length(texts).cast(pa.int64())
            totals[size.to_numpy(zero_copy_only=False) == 0] = 0        # no blank in front of nothing
            yield pa.RecordBatch.from_arrays([batch.column("row"), size, pa.array(totals)], ["row", *added.names])

    done = packed.mapInArrow(run, T.StructType([packed.schema["row"], *added.fields]))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *added.names, (F.col("n_tokens") > limit).alias("over_limit"))
