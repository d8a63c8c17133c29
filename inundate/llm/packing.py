"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids.  A window is one sequence of 4,096 tokens;
in each, every queue earns its share of the window, takes the whole tokens it has
earned and carries the rest; tokens still free go around the ring, one each, to
the queues that are owed most (of queues owed alike, to the first by name).  The
shares are the queues' shares of all tokens, so all queues run out together and
every window holds the target mixture.

The same round-robin runs at every level of a tree of blocks, each of up to
``FAN`` blocks or windows: a block's allotment is whole tokens per queue, so
deficits are carried across windows and, through the blocks, across partitions,
and no task needs what another has packed.  The totals alone go to the tasks,
which work out the blocks on the way to their documents' windows.  Documents are
cut where a window's share ends.  The last window's tokens are parted into
sequences of powers of two, which need no padding.

The ``QUEUES`` sources of most tokens have a queue each.  All others, each of
less than a window's ``1 / QUEUES``, share one queue more, in which they are
interleaved by weighted fair queueing: a document's place is its start's share of
its source's tokens, so every stretch of that queue holds the small sources in
their proportions too.  The output names the true source throughout.

Queue order is (scan partition, row).  Token ids are kept once, two bytes each, in
a checkpoint; positions follow from a table of token counts by partition and
source.  Null text is empty (its one token is the end mark), null source is a
queue of its own (with the empty name), repeated rows are packed as often as they
occur, an empty table gives no pieces, other columns are left behind whatever
their names, and a very long text fills as many windows as it needs.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import OrderedDict
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .common import batch, slices, texts

WINDOW, END_ID = 4096, 2
END = np.array([END_ID], "<u2").tobytes()
QUEUES, FAN = 255, 512
#: Blocks whose plan a task keeps.
HELD = 12
#: Tokens of one of the stretches of the shared queue in which documents are put in order, and stretches counted together.
POOL_TOKENS, TOGETHER = 2_000_000, 4096
#: Rows of the table of counts by partition and queue up to which it is sent to all executors; a larger one is joined.
SENT_ROWS = 200_000
#: Words whose ids a worker keeps, the first it meets (most of the common ones are among them).
KEPT = 300_000
#: Bytes of a word beyond which the library spells it.
LONG = 64

#: Texts with any other character go to the library whole (as do those that may hold a special token).
PLAIN = r"\t\n\r\x20-\x7e\x{a1}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{12f}\x{131}-\x{17f}"
#: The tokenizer file's own pre-token pattern (a fixed value).
PRETOKEN = r"('s|'t|'re|'ve|'m|'ll|'d|[\pL]+|[\pN]|[^\s\pL\pN]+)"
#: A stop or comma that belongs to a longer run of marks.
RUN = r"[^\pL\pN\s][.,]\s"


class Merges:
    """Byte-pair merges of many words at a time, as the vocabulary file orders them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; others are moved up
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[names[b] + mark] for b in range(256)], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.none = len(pairs)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        every = np.repeat(self.inner, 256), np.tile(self.inner, 256)
        self.pairs = self._ranks(*every).astype(np.int32).reshape(256, 256)  # of two bytes inside a word

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        place = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[place] == key, self.rank[place], self.none)

    def spell(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``sizes`` bytes (one at least), and each word's number of ids.

        In each, the pair of least rank, leftmost of equals, is merged until none is left.
        """
        ends = np.cumsum(sizes)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.empty(len(sym), np.int32)
        rank[:-1] = self.pairs[data[:-1], data[1:]]
        before = ends[sizes > 1] - 2  # the last pair of each word
        rank[before] = self._ranks(sym[before], sym[before + 1])
        rank[ends - 1] = self.none
        first = ends - sizes
        done, n_ids = [], np.empty(len(sizes), np.int64)
        while len(sym):
            least = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(sym)), first)
            at = least & 0xFFFFFFFF
            on = least >> 32 < self.none
            length = np.diff(np.r_[first, len(sym)])
            if not on.all():  # whole words leave
                n_ids[word[first[~on]]] = length[~on]
                stay = np.repeat(on, length)
                done.append((word[~stay], sym[~stay]))
                at = at[on] - (first - np.r_[0, np.cumsum(length * on)[:-1]])[on]
                word, sym, rank, length = word[stay], sym[stay], rank[stay], length[on]
                if not len(sym):
                    break
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # each word before has lost one
            word, sym, rank = word[keep], sym[keep], rank[keep]
            length -= 1
            stops = np.cumsum(length)
            first = stops - length
            rank[at] = self.none
            right, left = at[at + 1 < stops], at[at > first]
            ranks = self._ranks(sym[np.r_[right, left - 1]], sym[np.r_[right + 1, left]])
            rank[right], rank[left - 1] = ranks[: len(right)], ranks[len(right) :]
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(word, kind="stable")], n_ids


class Tokens:
    """Ids of the vocabulary file, equal to the library's.

    Ids are two little-endian bytes each.  Texts are cut into words column-wise and
    each different word of a batch is looked up once; stops and commas are set apart
    first, so that a word is known whatever follows it.  Words that were not seen
    before are merged together.  Very long words, and texts with characters that the
    library would normalize, go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib, self.merges = Tokenizer.from_file(path), Merges(path)
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<u2"), np.zeros(0, np.int64)  # of the words that stay, in order

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u2")

    def _spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, of one digit or of marks alone, and each one's number of ids (of the empty word none)."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        short = (sizes > 0) & (sizes <= LONG)
        some, ids, n = words.filter(pa.array(short)), np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        if len(some):
            places = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
            data = np.frombuffer(some.buffers()[2], np.uint8)[places[0] : places[-1]]
            ids, n[short] = self.merges.spell(data, sizes[short])
        if (sizes <= LONG).all():
            return ids, n
        stops = np.cumsum(n)
        got = [self._whole(words[i].as_py()) if size > LONG else ids[a:z] for i, (size, a, z) in enumerate(zip(sizes.tolist(), (stops - n).tolist(), stops.tolist(), strict=True))]
        return np.concatenate(got), np.array(list(map(len, got)), np.int64)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not known, and each one's number of ids."""
        alone = pc.utf8_is_alpha(words)
        mixed = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(words.filter(pc.invert(alone)), PRETOKEN, r"\1 ")))
        parts = mixed.flatten().dictionary_encode()
        alone = alone.to_numpy(zero_copy_only=False)
        ids, n = self._spelled(pa.concat_arrays([words.filter(pa.array(alone)), parts.dictionary]))
        n_alone = int(alone.sum())
        # a word's parts by number: itself, or what it was cut into
        counts = np.ones(len(words), np.int64)
        counts[~alone] = np.diff(mixed.offsets.to_numpy())
        which = np.empty(int(counts.sum()), np.int64)
        of_alone = np.repeat(alone, counts)
        which[of_alone] = np.arange(n_alone)
        which[~of_alone] = parts.indices.to_numpy() + n_alone
        total = np.r_[0, np.cumsum(n[which])]
        return gathered(ids.astype("<u2"), n, which), np.diff(total[np.r_[0, np.cumsum(counts)]])

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number by word, and the place of each of ``words`` (all different) among these."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.ids, self.sizes, place
        ids, sizes = self._new(words.take(pa.array(new)))
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        place[new] = np.arange(len(self.sizes), len(sizes))
        if len(sizes) <= KEPT:
            self.known.update(zip([names[i] for i in new.tolist()], place[new].tolist(), strict=True))
            self.ids, self.sizes = ids, sizes
        return ids, sizes, place

    def _plain(self, column: pa.Array) -> list[bytes]:
        low = pc.binary_join_element_wise(pc.utf8_lower(column), "", " ")
        apart = low
        for mark in ".,":
            for after in " \n":
                apart = pc.replace_substring(apart, mark + after, f" {mark}{after}")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, RUN), low, apart))
        coded = split.flatten().dictionary_encode()
        ids, sizes, place = self._looked_up(coded.dictionary)
        which = place[coded.indices.to_numpy()]
        cuts = split.offsets.to_numpy()
        blob = gathered(ids, sizes, which).tobytes()
        stops = (2 * np.r_[0, np.cumsum(sizes[which])][cuts - cuts[0]]).tolist()
        return [blob[a:z] for a, z in zip(stops, stops[1:], strict=False)]

    def encode_batch(self, texts_) -> list[bytes]:
        column = texts_ if isinstance(texts_, pa.Array) else pa.array(texts_, pa.string())
        odd = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, f"[^{PLAIN}]")).to_numpy(zero_copy_only=False)
        plain = iter(self._plain(column.filter(pa.array(~odd))) if not odd.all() else ())
        return [self._whole(column[i].as_py()).tobytes() if x else next(plain) for i, x in enumerate(odd.tolist())]


def gathered(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The ids of the words numbered ``which``, one after another."""
    begin = np.cumsum(sizes) - sizes
    out = [ids[:0]]
    for a in range(0, len(which), step):
        w = which[a : a + step]
        n = sizes.take(w)
        stops = np.cumsum(n)
        at = np.repeat(begin.take(w) - stops + n, n)
        at += np.arange(len(at))
        out.append(ids.take(at))
    return np.concatenate(out)


@lru_cache(1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def round_robin(totals: np.ndarray, window: int) -> np.ndarray:
    """Cumulative tokens taken from each queue after each full window; shape (windows + 1, queues).

    ``totals`` are the queues' tokens; the last window may be short and takes the rest.
    """
    totals = np.asarray(totals, np.int64)
    left, whole = totals.copy(), int(totals.sum())
    share = totals * (window / max(whole, 1))
    owed = np.zeros(len(totals))
    taken = [np.zeros(len(totals), np.int64)]
    for _ in range(whole // window):
        owed += share
        take = np.clip(np.floor(owed + 1e-9).astype(np.int64), 0, left)
        free = window - int(take.sum())
        while free > 0:  # once around the ring, the queues owed most first
            ring = np.argsort(take - owed, kind="stable")
            ring = ring[left[ring] > take[ring]][:free]
            take[ring] += 1
            free -= len(ring)
        while free < 0:
            ring = np.argsort(owed - take, kind="stable")
            ring = ring[take[ring] > 0][:-free]
            take[ring] -= 1
            free += len(ring)
        owed -= take
        left -= take
        taken.append(taken[-1] + take)
    if left.any():
        taken.append(totals)
    return np.array(taken)


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Block:
    """Each queue's cumulative tokens by child (blocks or windows) and, of windows, where in each its tokens begin."""

    def __init__(self, cum: np.ndarray, first: int):
        self.cum, self.first = cum, first
        self.held: dict[int, tuple[list, list]] = {}

    def of(self, queue: int) -> tuple[list, list]:
        if queue not in self.held:
            before = np.diff(self.cum[:, :queue].sum(1))
            self.held[queue] = self.cum[:, queue].tolist(), before.tolist()
        return self.held[queue]


class Plan:
    """Where each token of each queue goes."""

    def __init__(self, totals: np.ndarray):
        self.totals = np.asarray(totals, np.int64)
        self.full, self.rest = divmod(int(self.totals.sum()), WINDOW)
        self.spans = [1]  # windows of a block's children, by level
        while self.spans[-1] * FAN < self.full + (self.rest > 0):
            self.spans.append(self.spans[-1] * FAN)
        self.held: OrderedDict[tuple[int, int], Block] = OrderedDict()

    def _block(self, level: int, first: int, start: np.ndarray, totals: np.ndarray) -> Block:
        if (level, first) not in self.held:
            if len(self.held) >= HELD:
                self.held.popitem(last=False)
            self.held[level, first] = Block(start + round_robin(totals, WINDOW * self.spans[level]), first)
        self.held.move_to_end((level, first))
        return self.held[level, first]

    def leaf(self, queue: int, at: int) -> Block:
        """The block of windows that holds token ``at`` of ``queue``."""
        level = len(self.spans) - 1
        block = self._block(level, 0, np.zeros_like(self.totals), self.totals)
        while level:
            child = bisect_right(block.of(queue)[0], at) - 1
            first, level = block.first + child * self.spans[level], level - 1
            block = self._block(level, first, block.cum[child], block.cum[child + 1] - block.cum[child])
        return block

    def pieces(self, queue: int, start: int, n: int):
        """(start in the document, length, sequence, offset) of the document at ``start`` of ``queue``."""
        at, end = start, start + n
        while at < end:
            block = self.leaf(queue, at)
            cum, before = block.of(queue)
            w = bisect_right(cum, at) - 1
            while at < end and w < len(before):
                stop = min(end, cum[w + 1])
                if stop > at:
                    offset, sequence = before[w] + at - cum[w], block.first + w
                    if sequence < self.full:
                        yield at - start, stop - at, sequence, offset
                    else:
                        yield from self._last(at - start, stop - at, offset)
                    at = stop
                w += 1

    def _last(self, place: int, n: int, offset: int):
        """A piece of the last, short window, in its sequences of powers of two."""
        for i, size in enumerate(powers(self.rest)):
            a, z = max(offset, 0), min(offset + n, size)
            if a < z:
                yield place + a - offset, z - a, self.full + i, a
            offset -= size


IDS = "doc_id long, queue string, part int, start long, n long, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids (two bytes each, little-endian) with its place among its scan partition's of its queue."""

    def run(it):
        part, taken, vocabulary = TaskContext.get().partitionId(), {}, tokens(path)
        for b in slices(it):
            rows = []
            for doc, ids, queue in zip(b["doc_id"].to_pylist(), vocabulary.encode_batch(b["text"]), b["queue"].to_pylist(), strict=True):
                ids, n = ids + END, len(ids) // 2 + 1
                rows.append((doc, queue, part, taken.get(queue, 0), n, ids))
                taken[queue] = taken.get(queue, 0) + n
            yield batch(_IDS, **dict(zip(_IDS.names, zip(*rows, strict=True), strict=True)))

    return docs.mapInArrow(run, IDS)


PLACED = ("doc_id", "queue", "part", "start", "before", "n", "ids")


def interleaved(ids: DataFrame, offsets: DataFrame, totals: DataFrame, tokens_: int) -> DataFrame:
    """The rows of the sources in ``totals`` as one queue, every source spread evenly over its length.

    A row's place is where its source's tokens have come to, as a share of them all.
    Rows are ordered inside stretches of equal length of the places, which hold about
    ``POOL_TOKENS`` each; the stretches' own starts are sums of sums.
    """
    stretches = max(1, -(-tokens_ // POOL_TOKENS))
    offset = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / F.lit(float(1 << 20))  # else all sources of one document were first
    place = (F.col("before") + F.col("start") + offset * F.col("n")) / F.col("total")
    spread = ids.join(offsets, ["part", "queue"]).join(totals, "queue").withColumn("place", place)
    spread = spread.withColumn("stretch", F.least(F.floor(F.col("place") * stretches), F.lit(stretches - 1)))
    sums = checkpointed(spread.groupBy("stretch").agg(F.sum("n").alias("n")).withColumn("together", F.floor(F.col("stretch") / TOGETHER)))
    inside = F.sum("n").over(Window.partitionBy("together").orderBy("stretch")) - F.col("n")
    base, at = [], 0
    for r in sums.groupBy("together").agg(F.sum("n").alias("n")).orderBy("together").collect():  # one row for 8 billion tokens
        base.append((r["together"], at))
        at += r["n"]
    known = ids.sparkSession.createDataFrame(base, "together long, base long")
    starts = sums.withColumn("inside", inside).join(F.broadcast(known), "together").select("stretch", (F.col("base") + F.col("inside")).alias("base"))
    order = Window.partitionBy("stretch").orderBy("place", "queue", "before", "start")
    rows = spread.withColumn("own", F.sum("n").over(order) - F.col("n")).join(starts, "stretch")
    return rows.select("doc_id", "queue", "part", F.col("own").alias("start"), F.col("base").alias("before"), "n", "ids")


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence."""
    ids = checkpointed(tokenize(texts(docs, F.coalesce("source", F.lit("")).alias("queue")), path))
    counts = checkpointed(ids.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("queue").agg(F.sum("n").alias("total"))
    large = {r.queue: r.total for r in totals.orderBy(F.desc("total"), "queue").limit(QUEUES).collect()}
    names = sorted(large)
    whole = [large[q] for q in names]
    pooled = (counts.agg(F.sum("n")).first()[0] or 0) - sum(whole)
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")
    offsets = counts.select("part", "queue", before.alias("before"))
    of_large = F.col("queue").isin(names)
    own = ids.where(of_large) if pooled else ids
    if counts.count() <= SENT_ROWS:
        known = {(r.part, r.queue): r.before for r in offsets.collect()}
        placed = own.withColumn("before", F.lit(None).cast("long"))
    else:
        known = {}
        placed = own.join(offsets, ["part", "queue"])
    placed = placed.select(*PLACED)
    if pooled:
        placed = placed.unionByName(interleaved(ids.where(~of_large), offsets, totals.where(~of_large), pooled).select(*PLACED))
        whole.append(pooled)
    sent = ids.sparkSession.sparkContext.broadcast((Plan(np.array(whole, np.int64)), {q: i for i, q in enumerate(names)}, known))

    def run(it):
        plan, number, known = sent.value
        shared = len(number)
        for b in slices(it, 1 << 20, "ids"):
            out = []
            for doc, queue, part, start, before, n, blob in zip(*(b[x].to_pylist() for x in PLACED), strict=True):
                ids = np.frombuffer(blob, "<u2").astype("<u4").tobytes()
                for s, length, sequence, offset in plan.pieces(number.get(queue, shared), start + (known[part, queue] if before is None else before), n):
                    out.append((doc, s, length, zlib.crc32(ids[4 * s : 4 * (s + length)]), n, sequence, offset, queue))
            if out:
                yield batch(_PIECES, **dict(zip(_PIECES.names, zip(*out, strict=True), strict=True)))

    return placed.mapInArrow(run, PIECES)
