"""Removal of repeated long byte strings by a depth-limited radix sort.

Suffixes are ordered only through ``depth`` bytes, most significant digits
first, and groups that are single drop out after each pass; the groups that
are left at full depth are exactly the repeated windows.

Windows are not all carried through the passes.  Every window of ``depth``
bytes has one anchor: of the ``ANCHOR``-byte strings inside it, the one with
the least hash (the first, if several).  Equal windows have equal anchors at
the same place, and windows that follow each other mostly share theirs, so
one record stands for a run of windows.

  pass 1  the digit is the anchor string; anchors that occur once in the
          whole corpus leave (sharded counts);
  pass 2  records of the other anchors - the run's bytes - are sorted by
          anchor, document and place, and inside a group the digit is the
          rest of the window: a window seen before in this order is a repeat.
          An anchor with over ``HOT`` records takes its last digits at once:
          each of its windows is a record of its own under the hash of the
          whole window, so the group is dealt over all tasks and no task
          holds more of a group than its different windows.

Repeated windows become byte intervals, which are merged per document.

Defined results: null text is empty; texts below ``depth`` bytes are kept;
a null id sorts after all others and comes back null; rows that share an id
are ordered by a hash of their text, and rows that agree in id and text are
one document that comes back as often as it is there; removal may cut a
character in two, hashes and counts are of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import LAST_ID, stored
from tidemark.llm.ngram_jaccard import BASE, INVERSE, mixed

DEPTH = 100
ANCHOR = 32
HOT = 1 << 19
BROADCAST_KEYS = 4_000_000
STRIP = 1 << 20                 # bytes hashed at once; at most 2 ** PLACE_BITS
PLACE_BITS = 22


class Roller:
    """Hashes of all strings of one length in a buffer."""

    def __init__(self):
        self.letters = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(data):
            n, one = max(len(data), STRIP + STRIP // 2), np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(n, BASE, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(n, INVERSE, np.uint64)]))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.power[:len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start, length: int) -> np.ndarray:
        return mixed((sums[start + length] - sums[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by minima of blocks from both ends."""
    n = len(x) - width + 1
    full = np.concatenate([x, np.full(-len(x) % width, x.max(initial=0), x.dtype)]).reshape(-1, width)
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(full, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def pieces(column: pa.Array, depth: int):
    """Buffers of bounded size as lists of (row, place in its text, bytes);
    a long text comes in pieces that overlap by depth - 1 bytes."""
    held, size = [], 0
    for row, t in enumerate(column.to_pylist()):
        data = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - depth + 1), STRIP):
            part = data[at:at + STRIP + depth - 1]
            if len(part) < depth:
                continue
            if size + len(part) > STRIP + STRIP // 4 and held:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield held


def anchored(parts, roller: Roller, depth: int, anchor: int):
    """The runs of windows of a buffer that share an anchor: buffer, owner
    part, first window, number of windows, anchor's place and key."""
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    sums = roller.sums(data)
    grams = roller.at(sums, np.arange(len(data) - anchor + 1), anchor)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), depth - anchor + 1)
    owner = np.repeat(np.arange(len(parts)), sizes - depth + 1)
    window = np.arange(len(owner)) + (owner * (depth - 1))          # windows inside one part
    chosen = (low[window] & mask).astype("i8")
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
    many = np.diff(np.r_[first, len(window)])
    return data, owner[first], window[first], many, chosen[first], grams[chosen[first]], begin


def _row_hash(text) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def anchor_counts(docs: DataFrame, depth: int, anchor: int) -> DataFrame:
    """``(key, n)`` of the anchors of more than one window run."""

    def count(batches):
        roller, held, size = Roller(), [], 0

        def flush():
            k, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(k[i:i + (1 << 17)].view("i8")),
                                                  pa.array(n[i:i + (1 << 17)].astype("i8"))], ["key", "n"])

        for b in batches:
            for parts in pieces(b.column("text"), depth):
                held.append(anchored(parts, roller, depth, anchor)[5])
                size += len(held[-1])
                if size > 1 << 22:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")).where("n > 1")


RECORD = "key long, id long, row long, start long, lead int, body binary"


def _keep(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys


def window_records(docs: DataFrame, repeated: DataFrame, depth: int, anchor: int, hot: int, broadcast_keys: int) -> DataFrame:
    """One record per window run of a repeated anchor: its anchor's key, the
    document, the first window's start, how far before the anchor that is, and
    the run's bytes; for an anchor with over ``hot`` records one record per
    window, under the window's hash and without bytes."""
    keys = None
    if repeated.count() <= broadcast_keys:
        got = repeated.toArrow()
        wanted, often = got.column("key").to_numpy().view("u8"), got.column("n").to_numpy() > hot
        keys = docs.sparkSession.sparkContext.broadcast((np.sort(wanted), np.sort(wanted[often])))
        source = docs.select("id", "text")
    else:
        # too many keys to send around: each document is joined with its own
        def own(batches):
            roller = Roller()
            for b in batches:
                ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
                for parts in pieces(b.column("text"), depth):
                    _, owner, *_, key, _ = anchored(parts, roller, depth, anchor)
                    rows = [parts[o][0] for o in owner.tolist()]
                    hashes = {r: _row_hash(texts[r]) for r in set(rows)}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view("i8")), pa.array([ids[r] for r in rows], pa.int64()),
                         pa.array([hashes[r] for r in rows], pa.int64())], ["key", "id", "row"])

        lists = (docs.select("id", "text").mapInArrow(own, "key long, id long, row long")
                 .join(repeated, "key").groupBy("id", "row").agg(
                     F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("n") > hot, F.col("key"))).alias("often")))
        source = with_row(docs.select("id", "text")).join(lists, ["id", "row"]).select("id", "text", "keys", "often")

    def single(parts, ids, texts, who, key, place):
        rows = np.array([p[0] for p in parts])[who]
        hashes = {r: _row_hash(texts[r]) for r in set(rows.tolist())}
        place = place + np.array([p[1] for p in parts])[who]
        for i in range(0, len(key), 1 << 15):
            part = slice(i, i + (1 << 15))
            here = rows[part].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[part].view("i8")), pa.array([ids[r] for r in here], pa.int64()),
                 pa.array([hashes[r] for r in here], pa.int64()), pa.array(place[part].astype("i8")),
                 pa.array(np.zeros(len(here), "i4")), pa.array([b""] * len(here), pa.binary())],
                ["key", "id", "row", "start", "lead", "body"])

    def records(batches):
        roller = Roller()
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            lists = None if keys is not None else (b.column("keys"), b.column("often"))
            for parts in pieces(b.column("text"), depth):
                data, owner, start, many, place, key, begin = anchored(parts, roller, depth, anchor)
                if lists is None:
                    keep, often = _keep(key, keys.value[0]), _keep(key, keys.value[1])
                else:
                    keep, often = np.zeros(len(key), bool), np.zeros(len(key), bool)
                    for o in range(len(parts)):
                        here = owner == o
                        for got, column in ((keep, lists[0]), (often, lists[1])):
                            got[here] = _keep(key[here], np.sort(column[parts[o][0]].values.to_numpy().view("u8")))
                if often.any():         # their windows one by one
                    n = many[often]
                    one = np.repeat(start[often] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    who = np.repeat(owner[often], n)
                    yield from single(parts, ids, texts, who, roller.at(roller.sums(data), one, depth), one - begin[who])
                keep &= ~often
                owner, start, many, place, key = (x[keep] for x in (owner, start, many, place, key))
                if not len(key):
                    continue
                hashes = {r: _row_hash(texts[r]) for r in {parts[o][0] for o in np.unique(owner)}}
                size = many + depth - 1
                ends = np.cumsum(size)
                where = np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)
                body = pa.Array.from_buffers(pa.binary(), len(size), [
                    None, pa.py_buffer(np.r_[0, ends].astype("i4")), pa.py_buffer(data[where])])
                row_of = np.array([p[0] for p in parts])[owner]
                from_text = np.array([p[1] for p in parts])[owner] + start - begin[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view("i8")), pa.array([ids[r] for r in row_of.tolist()], pa.int64()),
                     pa.array([hashes[r] for r in row_of.tolist()], pa.int64()), pa.array(from_text.astype("i8")),
                     pa.array((place - start).astype("i4")), body], ["key", "id", "row", "start", "lead", "body"])

    return source.mapInArrow(records, RECORD)


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, the hash that tells rows of one id apart."""

    @F.arrow_udf("long")
    def row(text: pa.Array) -> pa.Array:
        return pa.array([_row_hash(t) for t in text.to_pylist()], pa.int64())

    return docs.withColumn("row", row("text"))


def _windows(bodies: list[bytes], roller: Roller, depth: int):
    """Hashes of all windows of the records, and their record; a record
    without bytes is one window, told by its key alone."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(x) for x in bodies])
    many = np.maximum(size - depth + 1, 1)
    record = np.repeat(np.arange(len(bodies)), many)
    place = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(size) - size, many)
    h, real = np.zeros(len(record), np.uint64), (size > 0)[record]
    h[real] = roller.at(roller.sums(data), place[real], depth)
    return h, record, many


def repeats(records: DataFrame, depth: int) -> DataFrame:
    """``(id, row, start, length)`` of runs of repeated windows, from records
    sorted by key, id, row and start."""

    def scan(batches):
        roller, key_before, seen, before = Roller(), None, np.zeros(0, np.uint64), None

        def chunk(key, ids, row, start, bodies):
            nonlocal key_before, seen, before
            # rows that agree in id and text are one document
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1])
            fresh[0] = before != (key[0], ids[0], row[0], start[0])
            before = (key[-1], ids[-1], row[-1], start[-1])
            if not fresh.all():
                bodies = [x for x, f in zip(bodies, fresh.tolist()) if f]
                key, ids, row, start = key[fresh], ids[fresh], row[fresh], start[fresh]
            if not len(key):
                return
            h, record, many = _windows(bodies, roller, depth)
            h = mixed(h ^ key.view("u8")[record])
            if key[0] != key_before:
                seen = np.zeros(0, np.uint64)
            value, first, at = np.unique(h, return_index=True, return_inverse=True)
            repeat = first[at] != np.arange(len(h))
            if len(seen):               # the first group goes on from the last chunk
                head = int(np.searchsorted(record, np.argmax(key != key[0]))) if (key != key[0]).any() else len(h)
                repeat[:head] |= _keep(h[:head], seen)
            tail = h[key[record] == key[-1]]
            seen = np.unique(np.concatenate([seen, tail]) if key[0] == key[-1] else tail)
            key_before = key[-1]
            opens = np.flatnonzero(repeat & np.r_[True, ~repeat[:-1] | (record[1:] != record[:-1])])
            closes = np.flatnonzero(repeat & np.r_[~repeat[1:] | (record[1:] != record[:-1]), True])
            r, base = record[opens], (np.cumsum(many) - many)
            if len(r):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r]), pa.array(row[r]), pa.array(start[r] + opens - base[r]),
                     pa.array((closes - opens + depth).astype("i8"))], ["id", "row", "start", "length"])

        for b in batches:
            for i in range(0, b.num_rows, 1 << 14):
                part = b.slice(i, 1 << 14)
                yield from chunk(*(part.column(c).to_numpy() for c in ("key", "id", "row", "start")),
                                 part.column("body").to_pylist())

    return records.mapInArrow(scan, "id long, row long, start long, length long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, depth: int = DEPTH,
                   anchor: int = ANCHOR, hot: int = HOT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)`` of every row."""
    spark = docs.sparkSession
    anchor = min(anchor, depth)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = stored(anchor_counts(base, depth, anchor), "suffix-keys")
    records = window_records(base, repeated, depth, anchor, hot, broadcast_keys)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = records.repartition(width, "key").sortWithinPartitions("key", "id", "row", "start")
    lists = repeats(ordered, depth).groupBy("id", "row").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    full = with_row(base).join(lists, ["id", "row"], "left").select("id", "text", "spans")

    def cut(batches):
        for b in batches:
            ids, texts, spans = b.column("id"), b.column("text"), b.column("spans")
            n_bytes, removed, runs, kept = [], [], [], []
            for i in range(b.num_rows):
                data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                n_bytes.append(len(data))
                if not spans[i].is_valid:
                    removed.append(0)
                    runs.append(0)
                    kept.append(data)
                    continue
                v = spans[i].values
                start, length = v.field("start").to_numpy(), v.field("length").to_numpy()
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start + length)[order])
                opens = np.r_[True, start[1:] > end[:-1]]
                first, last = start[opens], end[np.r_[np.flatnonzero(opens)[1:] - 1, len(end) - 1]]
                removed.append(int((last - first).sum()))
                runs.append(len(first))
                kept.append(b"".join(data[i:j] for i, j in zip(np.r_[0, last].tolist(), np.r_[first, len(data)].tolist())))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = full.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))
