"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a 100-byte string that covers it also starts earlier: in a
document of smaller doc_id (of rows that share it, the smaller text hash), or
earlier in the same one.  Strings are judged on the input and never cross texts.

1. Whole copies fold first: of equal texts only the one of least doc_id goes on;
   in every other each 100-byte string starts earlier, so nothing of it is left.
2. Every 100-byte window names one anchor inside it, the 24 bytes of least hash
   (the leftmost of equals), so equal windows have equal anchors at equal places.
   Neighbouring windows with one anchor make a run; its first and last window's
   hashes tell its bytes.  Runs meet by anchor.  Of equal runs (128 bits of hash)
   the first stands for all; runs whose anchor has no second, different run repeat
   nothing else.  The text under the remaining ones is cut out.
3. A task reads these in order of anchor and, in blocks of about ``BLOCK`` bytes,
   builds the suffix array (prefix doubling to a depth over 100) and the
   Burrows-Wheeler transform.  Breadth-first backward extension of intervals then
   sets the common prefixes of neighbouring suffixes by increasing value and stops
   at 100; neighbours it has not parted share 100 bytes.  All windows of such a
   class but the first go.  The runs of an anchor with more than ``WIDE`` different
   ones are cut by the anchor's place in the window, ``CUT`` places at a time, and
   dealt out by the bytes that all windows of a part have, so not the anchor but the
   passage around it is what meets in a task.
4. A document's removed stretches come together and its text is cut.

Texts move once, by document; every later step that needs them reads that exchange.

Null text is empty; texts under 100 bytes stay whole; repeated rows (same doc_id
and text) are one document and share its result; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import batch, bounded, slices

LEAST = 100
ANCHOR = 24
SPREAD = LEAST - ANCHOR + 1
BLOCK = 1 << 18
#: Different runs of an anchor that meet in one task, and places of an anchor in its window that stay together beyond that.
WIDE, CUT = 256, 7
#: Bytes hashed at once, and the bits that hold a place among them.
PART, PLACE = 1 << 18, 20
#: A null doc_id is ordered before all others.
NO_ID = -(1 << 63)

_RNG = np.random.default_rng(3)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(STEP), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``ANCHOR`` and of the ``LEAST`` bytes at each place, by doubling."""
    h = {1: BYTE_HASH[data]}
    for n in (1, 2, 4, 8, 16, 32):
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
    h24 = h[16][:-8] * _power(8) + h[8][16:]
    h96 = h[64][:-32] * _power(32) + h[32][64:]
    return _mixed(h24), _mixed(h96[:-4] * _power(4) + h[4][96:])


def runs(data: np.ndarray, inside: np.ndarray):
    """Anchor hash, hash of its bytes, first window and number of windows of each run.

    ``data`` may hold several texts; ``inside`` tells for each window whether it lies
    in one text.
    """
    grams, wholes = gram_hashes(data)
    low = np.uint64((1 << PLACE) - 1)
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the place breaks ties
    width = 1
    while width * 2 <= SPREAD:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - SPREAD + width], m[SPREAD - width :])
    new = np.r_[True, (m[1:] != m[:-1]) | ~inside[:-1]] | ~inside
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(m)])
    keep = inside[at]
    at, n = at[keep], n[keep]
    fold = _mixed(wholes[at] * STEP + wholes[at + n - 1] + n.astype(np.uint64))
    return grams[(m[at] & low).astype(np.int64)].view(np.int64), fold.view(np.int64), at, n


def all_runs(texts: list[bytes]):
    """``runs`` of texts of any length: (number of the text, anchor, fold, first window, windows), part by part.

    A run over a part's edge comes as two.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        lens = np.array([len(p) for _, _, p in held])
        begin = np.cumsum(lens) - lens
        inside = np.zeros(len(data) - LEAST + 1, bool)
        for a, n in zip(begin.tolist(), lens.tolist(), strict=True):
            inside[a : a + n - LEAST + 1] = True
        h, fold, at, n = runs(data, inside)
        piece = np.searchsorted(begin, at, "right") - 1
        owner, offset = (np.array([p[i] for p in held], np.int64) for i in (0, 1))
        return owner[piece], h, fold, at - begin[piece] + offset[piece], n

    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - LEAST + 1, 0), PART):
            p = t[a : a + PART + LEAST - 1]
            held.append((i, a, p))
            size += len(p)
            if size >= PART:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the first ``depth`` symbols (under 512 each) or more; equals in any order."""
    n = len(symbols)
    padded = np.r_[symbols.astype(np.int64), np.zeros(7, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | padded[j : j + n]
    order = np.argsort(key)
    new = np.diff(key[order], prepend=-1) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while h < depth:
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)  # slots of groups that are not told apart yet
        if not len(open_):
            break
        at = order[open_]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        group = rank[at]
        key = group * (n + 1) + nxt + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        begins = np.diff(key, prepend=-1) != 0
        new[open_] = begins
        rank[at] = np.maximum.accumulate(np.where(begins, open_, 0))
        h *= 2
    return order


def parted(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether suffix i (in order) shares fewer than ``least`` symbols with suffix i - 1.

    Intervals of suffixes with a common prefix are extended backward by one symbol,
    breadth first, so common prefixes are found by increasing value; an interval
    whose right end is parted already is not extended further.  Symbol 0 parts
    texts and is never part of a prefix.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    counts = np.bincount(symbols, minlength=int(symbols.max()) + 1)
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    ends = np.zeros(n + 1, bool)
    ends[[0, n]] = True
    ends[counts[0]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        size = hi - lo
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(begin - lo, size)
        owner = np.repeat(np.arange(len(lo)), size)
        keep = bwt[at] != 0
        target, owner = lf[at[keep]], owner[keep]
        by = np.argsort(target)
        target, owner = target[by], owner[by]
        if not len(target):
            break
        # an extended interval is a stretch of neighbours from one interval and with one symbol
        cut = np.r_[True, (np.diff(owner) != 0) | (np.diff(target) != 1) | (np.diff(symbols[order[target]]) != 0)]
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(target)] - 1
        right = target[last] + 1
        fresh = ~ends[right]
        ends[right[fresh]] = True
        lo, hi = target[first[fresh]], right[fresh]
        if not len(lo):
            break
    return ends[:n]


def repeats(contexts: list[bytes], least: int = LEAST) -> np.ndarray:
    """For every window of the contexts (in order): whether an equal one comes before."""
    symbols = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8).astype(np.int16) + 1
    sizes = np.fromiter((len(c) + 1 for c in contexts), np.int64, len(contexts))
    stops = np.cumsum(sizes) - 1
    symbols[stops] = 0
    order = suffix_array(symbols, least + 1)
    window = np.ones(len(symbols), bool)
    for k in range(least):
        window[stops - k] = False
    group = np.cumsum(parted(symbols, order, least))
    inside = window[order]
    at, group = order[inside], group[inside]
    first = np.full(int(group.max()) + 1 if len(group) else 0, len(symbols))
    np.minimum.at(first, group, at)
    again = np.zeros(len(symbols), bool)
    again[at] = at != first[group]
    return again[window]


_ANCHORS = pa.schema([("anchor", pa.int64()), ("fold", pa.int64()), ("id", pa.int64()), ("dk", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("gone", pa.bool_())])
ANCHORS = "anchor long, fold long, id long, dk long, start long, n int, gone boolean"


def _anchors(it):
    """Runs of the texts.  Of equal runs in a batch all but the first are decided here (gone); they go on under a
    scattered anchor, so that a run that is everywhere comes once from each batch."""
    for b in slices(it, 1 << 22):
        b = b.filter(pc.fill_null(b["is_first"], False))
        ids, dks = b["id"].to_numpy(), b["dk"].to_numpy()
        found = list(all_runs([t.encode() for t in b["text"].to_pylist()]))
        if not found:
            continue
        owner, h, fold, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
        i, dk = ids[owner], dks[owner]
        key = h * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) + fold
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        several = order[np.r_[False, same] | np.r_[same, False]]
        gone, keep = np.zeros(len(h), bool), np.ones(len(h), bool)
        if len(several):
            by = several[np.lexsort((at[several], dk[several], i[several], key[several]))]
            later = np.r_[False, key[by][1:] == key[by][:-1]]
            twin = later & np.r_[False, (i[by][1:] == i[by][:-1]) & (dk[by][1:] == dk[by][:-1]) & (at[by][1:] == at[by][:-1])]
            gone[by[later]] = True
            keep[by[twin]] = False
            h = np.where(gone, _mixed((i + at).view(np.uint64) * STEP).view(np.int64), h)
        yield batch(_ANCHORS, anchor=h[keep], fold=fold[keep], id=i[keep], dk=dk[keep], start=at[keep], n=n[keep].astype(np.int32), gone=gone[keep])


_MET = pa.schema([*((n, pa.int64()) for n in ("id", "dk", "anchor", "start")), ("n", pa.int32()), ("gone", pa.bool_()), ("wide", pa.bool_())])
MET = "id long, dk long, anchor long, start long, n int, gone boolean, wide boolean"


def _meet(it):
    """Of runs ordered by (anchor, fold, id, dk, start): those that equal an earlier one (gone), and the first of
    each fold where an anchor has several folds, with whether it has more than ``WIDE`` (wide).  Holds at most that
    many rows between batches."""
    last = None  # key of the last row
    held: list[pa.RecordBatch] = []  # firsts of the anchor that the last batch ended with, not passed on yet
    wide = False  # whether that anchor is known to be wide, and its firsts passed on

    def passed(parts: list[pa.RecordBatch]):
        n = sum(p.num_rows for p in parts)
        if n > 1:
            for p in parts:
                yield _marked(p, np.zeros(p.num_rows, bool), np.full(p.num_rows, n > WIDE))

    for b in it:
        decided = b["gone"].to_numpy(zero_copy_only=False)
        if decided.any():
            own = b.filter(pa.array(decided))
            yield _marked(own, np.ones(own.num_rows, bool), np.zeros(own.num_rows, bool))
            b = b.filter(pa.array(~decided))
        if not b.num_rows:
            continue
        a, f, i, dk, start = (b[x].to_numpy() for x in ("anchor", "fold", "id", "dk", "start"))
        new_a = np.r_[last is None or a[0] != last[0], a[1:] != a[:-1]]
        new_f = new_a | np.r_[last is None or f[0] != last[1], f[1:] != f[:-1]]
        same = (i[1:] == i[:-1]) & (dk[1:] == dk[:-1]) & (start[1:] == start[:-1])
        twin = ~new_f & np.r_[last is not None and (i[0], dk[0], start[0]) == last[2:], same]  # a repeated row
        gone = ~new_f & ~twin
        group = np.cumsum(new_a)  # 0: the anchor the batch before ended with
        before = new_f & (group == 0)
        if before.any():
            own = b.filter(pa.array(before))
            if wide:
                yield _marked(own, np.zeros(own.num_rows, bool), np.ones(own.num_rows, bool))
            else:
                held.append(own)
        if group[-1]:
            yield from passed(held)
            held, wide = [], False
            firsts = np.bincount(group[new_f], minlength=int(group[-1]) + 1)
            open_ = new_f & (group == group[-1])
            keep = (new_f & (group > 0) & ~open_ & (firsts[group] > 1)) | gone
            yield _marked(b, gone, ~gone & (firsts[group] > WIDE)).filter(pa.array(keep))
            held.append(b.filter(pa.array(open_)))
        elif gone.any():
            yield _marked(b, gone, np.zeros(len(a), bool)).filter(pa.array(gone))
        if sum(p.num_rows for p in held) > WIDE:
            yield from passed(held)
            held, wide = [], True
        last = (a[-1], f[-1], i[-1], dk[-1], start[-1])
    yield from passed(held)


def _marked(b: pa.RecordBatch, gone: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(b[x] for x in ("id", "dk", "anchor", "start", "n")), pa.array(gone), pa.array(wide)], schema=_MET)


_RUNS = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("dk", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("context", pa.binary())])
RUNS = "anchor long, id long, dk long, start long, n int, context binary"


def _cut(anchor: int, data: bytes, start: int, n: int):
    """A wide run's parts (key, first window, windows): the anchor's places of a part lie in one of the stretches of
    ``CUT``, and its key is a hash of the bytes that all windows of these places have around the anchor."""
    grams = np.frombuffer(data[start : start + n + LEAST - 1], np.uint8)
    at = start + int(np.flatnonzero(gram_hashes(grams)[0].view(np.int64)[n - 1 : SPREAD] == anchor)[0]) + n - 1  # a byte in all windows
    first = start
    while first < start + n:
        place = (at - first) // CUT * CUT  # places place .. place + CUT - 1; the window that begins at ``first`` has the greatest
        stop = min(start + n, at - place + 1)
        core = data[at - place : at - place - CUT + 1 + LEAST]
        yield int.from_bytes(hashlib.blake2b(core + anchor.to_bytes(8, "little", signed=True) + bytes([place]), digest_size=8).digest(), "little", signed=True), first, stop - first
        first = stop


def _contexts(it):
    for b in slices(it, 1 << 21):
        out = []
        for i, dk, text, found in zip(*(b[x].to_pylist() for x in ("id", "dk", "text", "found")), strict=True):
            data = text.encode() if found else b""
            for r in found or ():
                parts = _cut(r["anchor"], data, r["start"], r["n"]) if r["wide"] else ((r["anchor"], r["start"], r["n"]),)
                out += [(key, i, dk, start, n, data[start : start + n + LEAST - 1]) for key, start, n in parts]
            if len(out) > 20_000:
                yield batch(_RUNS, **dict(zip(_RUNS.names, zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield batch(_RUNS, **dict(zip(_RUNS.names, zip(*out, strict=True), strict=True)))


_GONE = pa.schema([("id", pa.int64()), ("dk", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
GONE = "id long, dk long, start long, n long"


def _decide(rows: list[tuple]) -> list[tuple]:
    """Stretches of windows to remove among (id, dk, start, n, context) rows."""
    rows = sorted(rows, key=lambda r: r[:3])
    again = repeats([r[4] for r in rows])
    out, base = [], 0
    for i, dk, start, n, _ in rows:
        mine = np.flatnonzero(again[base : base + n])
        base += n
        if len(mine):
            for part in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if mine[-1] - mine[0] + 1 != len(mine) else [mine]:
                out.append((i, dk, start + int(part[0]), len(part)))
    return out


def _decide_large(rows: list[tuple]) -> list[tuple]:
    """The same for one anchor's rows of any number.

    Windows whose hash no other window has repeat nothing; they leave, and equal rests
    of runs fold.  What is still more than a block holds is dealt out by window.
    """
    rows = sorted(rows, key=lambda r: r[:3])
    sizes = [r[3] for r in rows]
    hashes = np.concatenate([gram_hashes(np.frombuffer(r[4], np.uint8))[1] for r in rows])
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    out, left, base = [], {}, 0
    for (i, dk, start, _, c), n in zip(rows, sizes, strict=True):
        mine = np.flatnonzero(twice[base : base + n])
        base += n
        if not len(mine):
            continue
        for part in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if mine[-1] - mine[0] + 1 != len(mine) else [mine]:
            a, k = int(part[0]), len(part)
            text = c[a : a + k + LEAST - 1]
            if text in left:
                out.append((i, dk, start + a, k))
            else:
                left[text] = (i, dk, start + a, k, text)
    rest = list(left.values())
    if sum(len(r[4]) + 1 for r in rest) <= BLOCK:
        return out + (_decide(rest) if rest else [])
    parts = -(-sum(r[3] * (LEAST + 1) for r in rest) // BLOCK)
    dealt: list[list[tuple]] = [[] for _ in range(parts)]
    for i, dk, start, n, c in rest:
        for k in range(n):
            w = c[k : k + LEAST]
            dealt[hash(w) % parts].append((i, dk, start + k, 1, w))
    for own in dealt:
        out += _decide(own) if own else []
    return out


def _blocks(it):
    """Decides runs that come ordered by (anchor, id, dk, start), whole anchors at a time.  Of runs of equal bytes
    under an anchor only the first is held."""
    done: list[tuple] = []  # rows of whole anchors
    open_: list[tuple] = []  # rows of the anchor being read
    known: dict[bytes, tuple] = {}  # and their bytes, with where they come first
    size = mine = 0
    before = None
    out: list[tuple] = []

    def close():
        nonlocal done, size, mine, open_
        if mine > BLOCK:
            out.extend(_decide_large(open_))
        else:
            done += open_
            size += mine
        open_, mine = [], 0
        known.clear()
        if size > BLOCK:
            out.extend(_decide(done))
            done, size = [], 0

    for b in it:
        for anchor, i, dk, start, n, c in zip(*(b[x].to_pylist() for x in _RUNS.names), strict=True):
            if before != anchor:
                close()
                before = anchor
            if known.setdefault(c, (i, dk, start)) != (i, dk, start):
                out.append((i, dk, start, n))
                continue
            if open_ and open_[-1][:3] == (i, dk, start):
                continue  # a repeated row
            open_.append((i, dk, start, n, c))
            mine += len(c) + 1
        if out:
            yield batch(_GONE, **dict(zip(_GONE.names, zip(*out, strict=True), strict=True)))
            out.clear()
    close()
    if done:
        out.extend(_decide(done))
    if out:
        yield batch(_GONE, **dict(zip(_GONE.names, zip(*out, strict=True), strict=True)))


def stretches(found: list[dict]) -> list[tuple[int, int]]:
    """Removed byte stretches (start, end) of a text, apart and ascending, from its windows to remove."""
    if not found:
        return []
    a = np.fromiter((r["start"] for r in found), np.int64, len(found))
    z = a + np.fromiter((r["n"] for r in found), np.int64, len(found)) + LEAST - 1
    by = np.argsort(a, kind="stable")
    a, z = a[by], np.maximum.accumulate(z[by])
    cut = np.flatnonzero(a[1:] > z[:-1]) + 1
    return list(zip(a[np.r_[0, cut]].tolist(), z[np.r_[cut - 1, len(z) - 1]].tolist(), strict=True))


KEY = ["id", "dk"]


def _judged(docs: DataFrame, rest: Column) -> DataFrame:
    """id, dk (order key and text hash), text, rest, is_first, gone and gone2: every row with whether its text is the
    first of its equals, and the windows to remove as two lists.

    All steps take the same columns of the rows that were dealt by document, ``rest``
    too where they have no use for it, so that Spark finds one exchange for them all.
    """
    text = F.coalesce("text", F.lit(""))
    base = bounded(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("dk"), text.alias("text"), rest.alias("rest"))
    firsts = base.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min(F.struct(*KEY)).alias("k")).select("k.id", "k.dk", F.lit(True).alias("is_first"))
    rows = base.join(firsts, KEY, "left")
    anchors = rows.mapInArrow(_anchors, ANCHORS)
    met = anchors.repartition("anchor").sortWithinPartitions("anchor", "fold", "id", "dk", "start").mapInArrow(_meet, MET)
    by_doc = met.groupBy(*KEY).agg(
        F.collect_list(F.when(~F.col("gone"), F.struct("anchor", "start", "n", "wide"))).alias("found"),
        F.collect_list(F.when(F.col("gone"), F.struct("start", "n"))).alias("gone"),
    )
    judged = rows.join(by_doc, KEY, "left")
    more = judged.mapInArrow(_contexts, RUNS).repartition("anchor").sortWithinPartitions("anchor", "id", "dk", "start").mapInArrow(_blocks, GONE)
    more = more.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("gone2"))
    return judged.join(more, KEY, "left")


def _kept(data: bytes, first: bool | None, *found) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and stretches removed."""
    if not first:
        return (b"", len(data), 1) if len(data) >= LEAST else (data, 0, 0)
    spans = stretches([r for f in found if f for r in f])
    if not spans:
        return data, 0, 0
    left, at = [], 0
    for a, z in spans:
        left.append(data[at:a])
        at = z
    left.append(data[at:])
    return b"".join(left), sum(z - a for a, z in spans), len(spans)


LISTS = ("text", "is_first", "gone", "gone2")
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digest(docs: DataFrame) -> DataFrame:
    """Bytes, bytes removed, stretches removed and the hash of the rest, for every row."""

    def run(it):
        for b in slices(it):
            rows = []
            for doc, text, *how in zip(*(b[x].to_pylist() for x in ("rest", *LISTS)), strict=True):
                data = text.encode()
                left, removed, spans = _kept(data, *how)
                rows.append((doc["doc_id"], len(data), removed, spans, hashlib.sha256(left).hexdigest()))
            yield batch(_CUT, **dict(zip(_CUT.names, zip(*rows, strict=True), strict=True)))

    return _judged(docs, F.struct("doc_id")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated stretches removed; all columns and rows stay, a null text stays null, a
    character cut in two goes whole.  n_chars, where there is one, follows a text that was cut."""

    def run(it):
        for b in slices(it):
            left = [_kept(t.encode(), *how) for t, *how in zip(*(b[x].to_pylist() for x in LISTS), strict=True)]
            new, cut = pa.array([x.decode("utf-8", "ignore") for x, _, _ in left], pa.string()), pa.array([n > 0 for _, n, _ in left], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["rest"], new, cut], ["rest", "new", "cut"])

    others = F.struct(F.col("text").isNull().alias("none"), F.struct(*(c for c in docs.columns if c != "text")).alias("columns"))
    judged = _judged(docs, others)
    schema = StructType([judged.schema["rest"], StructField("new", StringType()), StructField("cut", BooleanType())])
    done = judged.mapInArrow(run, schema)
    out = {c: F.col("rest.columns")[c] for c in docs.columns if c != "text"} | {"text": F.when(~F.col("rest.none"), F.col("new"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("cut"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return done.select(*(out[c].alias(c) for c in docs.columns))
