"""SentencePiece encoding and decoding, with the N best segmentations.

A text's lattice has an edge for every vocabulary piece that stands in it;
a segmentation is a path, its score the sum of the pieces' scores.  Forward
Viterbi gives every node the score of its best prefix.  Searching backwards
from the end, that score is the exact cost to come, so A-star pops complete
paths in order of score: the first N are the N best.

No piece spans a blank followed by a word's end, nor a character that is in
no longer piece; there the lattice falls into units that share only a node.
Units repeat, so each is solved once per worker and kept in a bounded cache:
Viterbi forwards and backwards for many units at once, which also gives the
loss of a unit's second-best path.  The N best paths of the text differ from
the best one in at most N - 1 units, those of least loss, so only these are
searched, and their alternatives are merged by a heap.

Rules of the model kind used: a blank is U+2581, one is put before the text,
nothing else is normalised; a character without a piece is spelled in byte
pieces at the price of the worst score less 10.  Decoding joins pieces and
bytes, turns U+2581 into blanks and takes the first blank off.

Defined results: null or empty text has no pieces, the score 0 and one
(empty) segmentation; of paths with equal scores that with the longer last
piece is the best, and the order of later ones is by place and pieces; a text
that itself holds U+2581 decodes to a blank there; invalid byte sequences
decode to U+FFFD; added columns replace columns of the same name.
"""

from __future__ import annotations

import heapq
import re
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.kn_quality import hash_table, look_up

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
CACHE_UNITS = 200_000       # of a worker, kept from task to task
BEST_UNITS = 15_000         # units whose N best paths are kept
SOLVE_CHARS = 80_000       # characters of units solved together
STRIP = 1 << 18             # characters encoded at once
LONG_UNIT = 48              # longer units are solved one by one
SPACE = "▁"
UNKNOWN = 10.0              # below the worst score
BASE = np.uint64(0x100000001B3)


class Vocabulary:
    """Pieces, scores and the tables the lattice needs."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.n = pieces, len(pieces)
        self.score = np.array(scores, "f8")
        plain = [i for i, k in enumerate(kinds) if k == "plain" and pieces[i]]
        self.ids = {pieces[i]: i for i in reversed(plain)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = kinds.index("unknown") if "unknown" in kinds else 0
        usual = self.score[plain][self.score[plain] > -1e8]
        self.unknown = float(usual.min() if len(usual) else 0.0) - UNKNOWN
        self.longest = max(map(len, self.ids), default=1)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece goes on after a blank; units can't be cut there")
        self.inner = np.zeros(0x110000, bool)           # characters of longer pieces
        self.inner[[ord(c) for p in self.ids if len(p) > 1 for c in p]] = True
        self.inner[ord(SPACE)] = False
        # pieces by number, and -1 for what only begins one
        stems = {p[:i] for p in self.ids for i in range(1, len(p))}
        self.goes_on = np.zeros(self.n, bool)
        self.goes_on[[k for p, k in self.ids.items() if p in stems]] = True
        known = {**dict.fromkeys(sorted(stems), -1), **self.ids}
        keys = np.array([self._key(p) for p in known], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.table = hash_table(keys, np.array(list(known.values()), "f4"))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return (h ^ (len(piece) << 58)) & 0xFFFFFFFFFFFFFFFF

    def cut(self, code: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Starts of the units of texts laid end to end: blanks and the inner
        characters after them, inner characters, or one other character."""
        blank, inner = code == ord(SPACE), self.inner[code]
        begins = ~inner & ~blank
        begins[1:] |= np.where(blank[1:], ~blank[:-1], begins[:-1])
        begins[0] = True
        begins[texts[texts < len(code)]] = True
        return np.flatnonzero(begins)

    def spell(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown_id) for b in char.encode("utf-8", "surrogatepass")]


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: ("unknown" if m.is_unknown(i) else "byte" if m.is_byte(i)
                      else "control" if m.is_control(i) or m.is_unused(i) else "plain")
    n = m.get_piece_size()
    return Vocabulary([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)],
                      [kind(i) for i in range(n)])


# ---- one unit --------------------------------------------------------------

def edges(unit: str, v: Vocabulary) -> list[list[tuple[int, int, float]]]:
    """For every start, its edges: (end, piece id or -1 to spell, score)."""
    out, get = [], v.ids.get
    for i in range(len(unit)):
        here = []
        for j in range(i + 1, min(len(unit), i + v.longest) + 1):
            k = get(unit[i:j])
            if k is not None:
                here.append((j, k, v.score[k]))
        if not here or here[0][0] != i + 1:
            here.append((i + 1, -1, v.unknown))
        out.append(here)
    return out


def n_best_of_unit(unit: str, v: Vocabulary, n: int) -> list[tuple[float, list[int]]]:
    """The n best paths of a unit as (score, piece ids), best first."""
    size, out = len(unit), edges(unit, v)
    forward = [0.0] + [-np.inf] * size
    into: list[list] = [[] for _ in range(size + 1)]
    for i, here in enumerate(out):
        for j, k, s in here:
            into[j].append((i, k, s))
            forward[j] = max(forward[j], forward[i] + s)
    found, tick = [], 0
    # (-(best prefix + suffix), order of finding, node, suffix score, suffix)
    heap = [(-forward[size], 0, size, 0.0, None)]
    while heap and len(found) < n:
        _, _, at, suffix, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path is not None:
                (k, char), path = path
                ids += v.spell(char) if k < 0 else [k]
            found.append((suffix, ids))
            continue
        for i, k, s in into[at]:
            tick += 1
            heapq.heappush(heap, (-(forward[i] + s + suffix), tick, i, s + suffix, ((k, unit[i:at]), path)))
    return found


def solve_one(unit: str, v: Vocabulary):
    """Best path, its score and the loss of the second best."""
    size, out = len(unit), edges(unit, v)
    f, back = [0.0] + [-np.inf] * size, [None] * (size + 1)
    for i, here in enumerate(out):
        for j, k, s in here:
            if f[i] + s > f[j]:
                f[j], back[j] = f[i] + s, (i, k)
    b = [-np.inf] * size + [0.0]
    for i in range(size - 1, -1, -1):
        b[i] = max(s + b[j] for j, _, s in out[i])
    at, ids, on = size, [], {}
    while at:
        i, k = back[at]
        ids.append(v.spell(unit[i:at])[::-1] if k < 0 else [k])
        on[i], at = at, i
    second = max((f[i] + s + b[j] for i, here in enumerate(out) for j, _, s in here if on.get(i) != j), default=-np.inf)
    return [k for part in ids for k in part][::-1], f[size], f[size] - second


# ---- many units at once ----------------------------------------------------

def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin[i] .. begin[i] + size[i] - 1`` of all i, end to end."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def solve_units(units: list[str], v: Vocabulary):
    """``(ids of all units, counts, scores, losses)``."""
    flat, begin, counts, score, loss = solve_codes(_codes("".join(units)), np.array([len(u) for u in units], "i8"), v)
    return flat[_runs(begin, counts)], counts, score, loss


def solve_codes(code: np.ndarray, sizes: np.ndarray, v: Vocabulary):
    """``(ids, begins, counts, scores, losses)`` of units laid end to end."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")                               # longest first
    begin, counts = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")
    score, loss, parts, done = np.zeros(len(sizes)), np.zeros(len(sizes)), [], 0
    far = int((sizes > LONG_UNIT).sum())
    for at in order[:far].tolist():
        unit = code[start[at]:start[at] + sizes[at]].tobytes().decode("utf-32-le", "surrogatepass")
        got, score[at], loss[at] = solve_one(unit, v)
        begin[at], counts[at] = done, len(got)
        parts.append(np.array(got, "i4"))
        done += len(got)
    chars = np.cumsum(sizes[order])
    while far < len(order):
        upto = max(far + 1, int(np.searchsorted(chars, (chars[far - 1] if far else 0) + SOLVE_CHARS)))
        at = order[far:upto]
        got, counts[at], score[at], loss[at] = _solve_together(code[_runs(start[at], sizes[at])], sizes[at], v)
        begin[at] = done + np.cumsum(counts[at]) - counts[at]
        parts.append(got)
        done += len(got)
        far = upto
    return np.concatenate(parts) if parts else np.zeros(0, "i4"), begin, counts, score, loss


def _solve_together(chars: np.ndarray, sizes: np.ndarray, v: Vocabulary):
    """Viterbi both ways over units sorted by falling length, laid end to end:
    one table look-up per piece width, going on only where a longer piece
    begins alike, and one step per place in the units over the edges there."""
    n, total, longest = len(sizes), len(chars), int(sizes[0])
    code = chars.astype(np.uint64) + np.uint64(1)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(total) - start[owner]
    room = sizes[owner] - place                         # characters left in the unit
    first = start + np.arange(n)
    at, h = np.arange(total), np.zeros(total, np.uint64)
    edge, width = [], 1                                 # per width: places, pieces (-1: to spell), scores
    while len(at):
        h = h * BASE + code[at + (width - 1)]
        k, hit = look_up(v.table, h ^ (np.uint64(width) << np.uint64(58)))
        k = np.where(hit, k, -1).astype("i4")
        is_piece = k >= 0
        if width == 1:
            edge.append((at, k, np.where(is_piece, v.score[k], v.unknown)))
        else:
            edge.append((at[is_piece], k[is_piece], v.score[k[is_piece]]))
        more = np.flatnonzero(hit & (~is_piece | v.goes_on[k]) & (room[at] > width))
        at, h, width = at[more], h[more], width + 1
    wide = np.repeat(np.arange(1, len(edge) + 1), [len(e[0]) for e in edge])
    source, cost = np.concatenate([e[0] for e in edge]), np.concatenate([e[2] for e in edge])
    group = place[source] * (len(edge) + 1) + wide      # by place, then width
    order = np.argsort(group.astype("u2") if longest * (len(edge) + 1) + len(edge) < 1 << 16 else group, kind="stable")
    group = group[order]
    node, wide, cost = (source + owner[source])[order], wide[order], cost[order]
    bound = np.searchsorted(group, np.arange((longest + 1) * (len(edge) + 1) + 1)).tolist()
    f, b = np.full(total + n, -np.inf), np.full(total + n, -np.inf)
    f[first] = b[first + sizes] = 0
    last = np.zeros(total + n, "i4")
    for i in range(longest):
        e = slice(bound[i * (len(edge) + 1)], bound[(i + 1) * (len(edge) + 1)])
        to, new = node[e] + wide[e], f[node[e]] + cost[e]
        better = new > f[to]
        f[to[better]], last[to[better]] = new[better], wide[e][better]
    for g in range(len(bound) - 2, -1, -1):
        if bound[g] < bound[g + 1]:
            e = slice(bound[g], bound[g + 1])
            x = node[e]
            b[x] = np.maximum(b[x], cost[e] + b[x + wide[e]])
    on, at = np.zeros(total, "i4"), sizes.copy()
    live = np.arange(n)
    while len(live):
        step = last[first[live] + at[live]]
        at[live] -= step
        on[start[live] + at[live]] = step
        live = live[at[live] > 0]
    second, chosen = np.full(total, -np.inf), np.full(total, -2, "i4")
    for w, (at, k, s) in enumerate(edge, 1):
        used = on[at] == w
        chosen[at[used]] = k[used]
        at, s = at[~used], s[~used]
        x = at + owner[at]
        second[at] = np.maximum(second[at], f[x] + s + b[x + w])
    score = f[first + sizes]
    taken = chosen != -2
    flat, many = chosen[taken], taken.astype("i8")
    spelled = np.flatnonzero(chosen == -1)
    if len(spelled):
        kinds, kind = np.unique(chars[spelled], return_inverse=True)
        byte_ids = [np.array(v.spell(c), "i4") for c in kinds.tobytes().decode("utf-32-le", "surrogatepass")]
        many[spelled] = np.array([len(x) for x in byte_ids])[kind]
        flat = np.repeat(flat, many[taken])
        flat[flat == -1] = np.concatenate([byte_ids[j] for j in kind.tolist()])
    return flat, np.add.reduceat(many, start), score, score - np.maximum.reduceat(second, start)


def unit_hash(code: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of units laid end to end; ``place`` of each character in its unit."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    power = np.cumprod(np.full(int(size.max()), odd, np.uint64))
    x = code.astype(np.uint64)
    x += np.uint64(seed + 1)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= power[place]
    x = np.add.reduceat(x, start)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Encoder:
    """Encodes texts with a bounded cache of solved units.

    Units are runs of code points, found by a hash and then compared in full;
    two units with one hash make all hashes anew."""

    def __init__(self, v: Vocabulary, n: int, cache_units: int = CACHE_UNITS):
        self.v, self.n, self.cache_units, self.seed = v, n, cache_units, 0
        self.clear()

    def clear(self) -> None:
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, "i4")      # by hash
        self._fill(np.zeros(0, "<u4"), np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i8"), np.zeros(0), np.zeros(0))
        self.used = np.zeros(0, bool)
        self.best: dict[str, list] = {}

    def _fill(self, code, size, flat, count, score, loss) -> None:
        self.code, self.size, self.flat, self.count, self.score, self.loss = code, size, flat, count, score, loss

    def _drop(self, room: int) -> None:
        """Makes room: units not met since the last time go, or all."""
        keep = np.flatnonzero(self.used)
        if len(keep) > min(room, self.cache_units // 2):
            keep = keep[:0]
        begin, first = np.cumsum(self.size) - self.size, np.cumsum(self.count) - self.count
        new = np.full(len(self.size), -1, "i4")
        new[keep] = np.arange(len(keep))
        stay = new[self.row] >= 0
        self.key, self.row = self.key[stay], new[self.row[stay]]
        self._fill(self.code[_runs(begin[keep], self.size[keep])], self.size[keep],
                   self.flat[_runs(first[keep], self.count[keep])], self.count[keep], self.score[keep], self.loss[keep])
        self.used = np.zeros(len(keep), bool)

    def _learn(self, key, code, size, flat, count, score, loss) -> None:
        if len(key) + len(self.key) > self.cache_units:
            self._drop(self.cache_units - len(key))
            if len(key) + len(self.key) > self.cache_units:
                return
        base = len(self.size)
        at = np.searchsorted(self.key, key)
        self.key, self.row = np.insert(self.key, at, key), np.insert(self.row, at, base + np.arange(len(key), dtype="i4"))
        self._fill(*(np.concatenate(x) for x in zip((self.code, self.size, self.flat, self.count, self.score, self.loss),
                                                    (code, size, flat, count, score, loss))))
        self.used = np.concatenate([self.used, np.zeros(len(key), bool)])

    def encode(self, texts: list[str]):
        """Per text: piece ids and the N best, each (score, pieces, edits);
        an edit (at, gone, ids) replaces pieces of the best segmentation."""
        code = _codes("".join([SPACE + t for t in texts if t]))
        if not len(code):
            return [self._none() for _ in texts]
        code = np.where(code == 0x20, np.uint32(ord(SPACE)), code)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        start = self.v.cut(code, ends[:-1])
        size = np.diff(start, append=len(code))
        place = np.arange(len(code)) - np.repeat(start, size)
        while (solved := self._solve(code, place, start, size)) is None:
            self.seed += 1              # two units share a hash
            self.clear()
        unit, flat, begin, count, score, loss = solved
        first, out = 0, []
        count_at, score_at, loss_at = count[unit], score[unit], loss[unit]
        ids = flat[_runs(begin[unit], count_at)]
        after = np.cumsum(count_at)
        gone = 0
        for last in np.searchsorted(start, ends).tolist():
            if last == first:
                out.append(self._none())
                continue
            x = slice(first, last)
            upto = int(after[last - 1])
            out.append(self._one(ids[gone:upto], code, start[x], size[x], count_at[x], after[x] - gone, score_at[x], loss_at[x]))
            first, gone = last, upto
        return out

    def _none(self):
        return np.zeros(0, "i4"), [(0.0, 0, [])]

    def _solve(self, code, place, start, size):
        """Each unit's number among the different ones, and the solutions of
        those; None if two units share a hash."""
        key, kind, unit = np.unique(unit_hash(code, place, start, size, self.seed), return_index=True, return_inverse=True)
        if (size[kind][unit] != size).any() or (code[np.repeat(start[kind][unit], size) + place] != code).any():
            return None
        kinds_size = size[kind]
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        hit = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        old, new = np.flatnonzero(hit), np.flatnonzero(~hit)
        row = self.row[at[old]] if len(old) else np.zeros(0, "i4")
        if (self.size[row] != kinds_size[old]).any() or (
                self.code[_runs((np.cumsum(self.size) - self.size)[row], self.size[row])]
                != code[_runs(start[kind[old]], kinds_size[old])]).any():
            return None
        self.used[row] = True
        fresh_code = code[_runs(start[kind[new]], kinds_size[new])]
        fresh, fresh_begin, fresh_count, fresh_score, fresh_loss = solve_codes(fresh_code, kinds_size[new], self.v)
        begin, count = np.zeros(len(key), "i8"), np.zeros(len(key), "i8")
        score, loss = np.zeros(len(key)), np.zeros(len(key))
        count[old], score[old], loss[old] = self.count[row], self.score[row], self.loss[row]
        count[new], score[new], loss[new] = fresh_count, fresh_score, fresh_loss
        flat = self.flat[_runs((np.cumsum(self.count) - self.count)[row], self.count[row])]
        begin[old] = np.cumsum(count[old]) - count[old]
        begin[new] = len(flat) + fresh_begin
        flat = np.concatenate([flat, fresh])
        self._learn(key[new], fresh_code, kinds_size[new], fresh[_runs(fresh_begin, fresh_count)], fresh_count, fresh_score, fresh_loss)
        return unit, flat, begin, count, score, loss

    def _one(self, ids, code, start, size, count, ends, scores, loss):
        """One text: its pieces, units, and their solutions."""
        total = len(ids)
        score = float(scores.sum())
        # ties of loss go to the earlier unit
        few = min(self.n - 1, len(start))
        if few and few < len(start):
            bound = np.partition(loss, few - 1)[few - 1]
            few_at = np.concatenate([np.flatnonzero(loss < bound), np.flatnonzero(loss == bound)])[:few]
        else:
            few_at = np.arange(len(start))[:few]
        options = []
        for i in sorted(few_at.tolist()):
            if loss[i] < np.inf:
                w = code[start[i]:start[i] + size[i]].tobytes().decode("utf-32-le", "surrogatepass")
                if w not in self.best:
                    if len(self.best) >= BEST_UNITS:
                        self.best.clear()
                    self.best[w] = self._alternatives(w, ids[ends[i] - count[i]:ends[i]].tolist(), float(scores[i]))
                if self.best[w]:
                    options.append((int(ends[i] - count[i]), int(count[i]), self.best[w]))
        out, heap, seen = [], [(0.0, (0,) * len(options))], set()
        while heap and len(out) < self.n:
            lost, pick = heapq.heappop(heap)
            edits = [(o[0], o[1], o[2][p - 1][1]) for o, p in zip(options, pick) if p]
            out.append((score - lost, total + sum(len(e[2]) - e[1] for e in edits), edits))
            for x, p in enumerate(pick):
                if p < len(options[x][2]):
                    nxt = pick[:x] + (p + 1,) + pick[x + 1:]
                    if nxt not in seen:
                        seen.add(nxt)
                        step = options[x][2][p][0] - (options[x][2][p - 1][0] if p else 0.0)
                        heapq.heappush(heap, (lost + step, nxt))
        return ids, out

    def _alternatives(self, unit: str, best: list[int], score: float) -> list[tuple[float, list[int]]]:
        """Up to n - 1 other paths of a unit as (loss, ids)."""
        found = n_best_of_unit(unit, self.v, self.n + 1)
        return [(score - s, ids) for s, ids in found if ids != best][:self.n - 1]


def worker_encoder(token: str, v: Vocabulary, n: int) -> Encoder:
    """The encoder of one ``encode`` call in this Python worker, with what its
    earlier tasks there have solved."""
    home = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    kept = home.__dict__.setdefault("encoders", {})
    if token not in kept:
        kept.clear()
        kept[token] = Encoder(v, n)
    return kept[token]


NBEST = "array<struct<score:double,n_pieces:int,edits:array<struct<at:int,gone:int,ids:array<int>>>>>"
_EDIT = pa.struct([("at", pa.int32()), ("gone", pa.int32()), ("ids", pa.list_(pa.int32()))])
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("edits", pa.list_(_EDIT))]))


def encode(docs: DataFrame, text_col: str = "text", *, model_path: str = MODEL, n: int = N_BEST,
           vocabulary: Vocabulary | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``ids array<int>`` and
    ``nbest`` (score, pieces, and edits that make it out of ``ids``)."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("ids", "nbest")]
    v = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary(model_path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__sp_text")
    token = uuid.uuid4().hex

    def run(batches):
        encoder = worker_encoder(token, v.value, n)
        for b in batches:
            texts = b.column("__sp_text")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            first = 0
            while first < b.num_rows:
                after, held = first, 0
                while after < b.num_rows and (held < STRIP or after == first):
                    held += int(sizes[after])
                    after += 1
                done = encoder.encode(texts.slice(first, after - first).to_pylist())
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in done])]).astype("i4")),
                    pa.array(np.concatenate([x for x, _ in done]), pa.int32()))
                nbest = pa.array([[{"score": s, "n_pieces": p, "edits": [
                    {"at": a, "gone": g, "ids": e} for a, g, e in edits]} for s, p, edits in x] for _, x in done], _NBEST)
                part = b.slice(first, after - first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, nbest], [*keep, "ids", "nbest"])
                first = after

    kept = docs.select(*keep)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, text).mapInArrow(run, f"{ddl}{', ' if ddl else ''}ids array<int>, nbest {NBEST}")


def decode_ids(ids, v: Vocabulary) -> str:
    """The text a list of piece ids stands for."""
    out, run = [], bytearray()
    for k in ids:
        b = v.byte_of.get(k)
        if b is None:
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(v.pieces[k] if 0 <= k < v.n else "�")
        else:
            run.append(b)
    if run:
        out.append(run.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def decode(rows: DataFrame, ids_col: str = "ids", *, model_path: str = MODEL,
           vocabulary: Vocabulary | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids_col`` (null: null)."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary(model_path))

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        v = held.value
        if not hasattr(v, "as_bytes"):      # pieces as bytes, to be gathered at once
            plain = [bytes([v.byte_of[i]]) if i in v.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
            v.as_bytes, v.sizes = np.frombuffer(b"".join(plain), "u1"), np.array([len(p) for p in plain], "i8")
            v.starts = np.cumsum(v.sizes) - v.sizes
        out = []
        for i in range(len(column)):
            if not column[i].is_valid:
                out.append(None)
                continue
            ids = column[i].values.to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= v.n):
                out.append(decode_ids(ids.tolist(), v))
                continue
            parts = []
            for at in range(0, len(ids), 1 << 20):
                k = ids[at:at + (1 << 20)]
                size = v.sizes[k]
                ends = np.cumsum(size)
                where = np.arange(int(ends[-1])) + np.repeat(v.starts[k] - (ends - size), size)
                parts.append(v.as_bytes[where].tobytes())
            s = b"".join(parts).decode("utf-8", "replace")
            out.append(s[1:] if s[:1] == " " else s)
        return pa.array(out, pa.string())

    return rows.withColumn("decoded", text(F.col(ids_col)))
