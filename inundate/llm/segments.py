"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A text's lattice has every vocabulary piece that matches at every place; a piece's
weight is a Zipf law of its rank in the model file, and a character no piece spells
is spelled by byte pieces.  The probability of a segmentation is its weight's share
of all segmentations' (forward sums over the lattice).

Sampling is a best-first search over the tree of partial segmentations, in which
every node carries a perturbed log-probability: the root draws a Gumbel variate, a
node's best child inherits its value, and the other children draw theirs below it.
A node's value is thus the greatest of all complete segmentations under it, an
exact bound for A-star: the first goal reached is the best, the next comes from the
best open sibling on the paths walked so far, and so on.  ``k`` distinct samples
come out in order of their values, each with its inclusion probability (given the
value of the best segmentation not emitted).  A text with fewer segmentations gives
them all, the last ones with inclusion 1.

No piece spans the end of a word, so the lattice falls into words and a path is
walked through all words of a batch at a time, piece by piece; the lattices of a
batch's different words are built together.  All variates are hashes of the
row key (doc_id; a null one counts as -1, repeated rows draw alike) and the place,
so neither partitioning nor retries change a sample.

Decoding joins the pieces' bytes and turns the model's space mark back.  Null text
is empty and has one segmentation, without pieces; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices, texts

SAMPLES = 2
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
CHARS = 1 << 20
#: Nodes of lattices that a worker keeps (about 45 MB).
KEPT = 700_000


BASE, SPREAD, SLOTS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 20


class Pieces:
    """The model file's pieces, and the lattices of a batch's words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.bytes_of, self.byte_id, ids = [b""] * self.size, {}, {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece] = i
                self.bytes_of[i] = piece.encode()
        self.ids, self.longest = ids, max(map(len, ids))
        shown = [b.replace(MARK.encode(), b" ") for b in self.bytes_of]
        self.spelled_out = np.frombuffer(b"".join(shown), np.uint8)
        self.sizes = np.fromiter(map(len, shown), np.int32, self.size)
        self.places = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        first = min(ids.values())
        self.log_weight = np.zeros(self.size)
        own = np.array(list(ids.values()))
        self.log_weight[own] = -np.log(own - first + 10.0)
        self.log_weight -= np.log(np.exp(self.log_weight[own]).sum())
        self.fallback = self.log_weight[own].min() - 2.0
        # every piece's prefixes by hash, in buckets of the hash's top bits
        hashes = {}
        for piece, i in ids.items():
            h = 0
            for k, c in enumerate(piece):
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if k + 1 == len(piece):
                    hashes[h] = i
                else:
                    hashes.setdefault(h, -1)
        keys = np.fromiter(hashes, np.uint64, len(hashes))
        slot = self._slot(keys)
        by = np.argsort(slot, kind="stable")
        self.keys, self.piece = keys[by], np.fromiter(hashes.values(), np.int64, len(hashes))[by]
        self.start = np.searchsorted(slot[by], np.arange((1 << SLOTS) + 1)).astype(np.int32)
        self.single = np.full(1 + max(ord(x[0]) for x in ids) + 2, -1, np.int64)  # by code point plus 1; the last is for those beyond
        starts = np.array(sorted({ord(x[0]) for x in ids}), np.uint64) + np.uint64(1)
        self.single[starts.astype(np.int64)] = self._find(starts)
        self.unit: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.count, self.begin, self.to, self.id, self.phi = (np.zeros(0, k) for k in ("i4", "i4", "i4", "i4", "f8"))
        self.spelled: dict[str, int] = {}  # a character without a piece: a number from ``size`` on
        self.spelling: list[tuple[int, ...]] = []

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * SPREAD) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the prefixes, or -1."""
        slot = self._slot(h)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(h), -1)
        todo = np.flatnonzero(at < end)
        while len(todo):
            place = at[todo]
            hit = self.keys[place] == h[todo]
            out[todo[hit]] = place[hit]
            at[todo] += 1
            todo = todo[~hit & (place + 1 < end[todo])]
        return out

    def learn(self, units: list[str]) -> np.ndarray:
        """The first node of each word's lattice (words all different): a node for each place, edges with their share
        of all ways on from the node.

        The words met first stay, up to ``KEPT`` nodes, as most of the common ones are
        among them; the others' lattices last until the next call.
        """
        first = np.fromiter(map(self.unit.get, units, repeat(-1)), np.int32, len(units))
        missing = np.flatnonzero(first < 0)
        new = [units[i] for i in missing.tolist()]
        count, to, ids, phi = self._lattices(new)
        n, e, base, edge = len(count), len(to), self.nodes, self.edges
        self._reserve(base + n, edge + e)
        self.count[base : base + n] = count
        self.begin[base : base + n] = np.cumsum(count, dtype=np.int32) - count + edge
        self.to[edge : edge + e] = np.where(to >= 0, to + base, -1)
        self.id[edge : edge + e] = ids
        self.phi[edge : edge + e] = phi
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        first[missing] = np.cumsum(sizes) - sizes + base
        if base + n <= KEPT:
            self.unit.update(zip(new, first[missing].tolist(), strict=True))
            self.nodes, self.edges = base + n, edge + e
        return first

    def _reserve(self, nodes: int, edges: int) -> None:
        for names, size in ((("count", "begin"), nodes), (("to", "id", "phi"), edges)):
            for x in names:
                now = getattr(self, x)
                if len(now) < size:
                    larger = np.empty(size + size // 2, now.dtype)
                    larger[: len(now)] = now
                    setattr(self, x, larger)

    def _lattices(self, units: list[str]):
        """Edges of each node, and the edges: node within the batch (-1: the word's end), piece, log of its share."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(points)
        end_of = np.repeat(ends, sizes).astype(np.int32)
        at, h = np.arange(n, dtype=np.int32), points + np.uint64(1)
        points = h
        found, count = [], np.zeros(n, np.int32)
        alone = at
        for k in range(1, self.longest + 1):
            place = self.single[np.minimum(points, len(self.single) - 1).astype(np.int32)] if k == 1 else self._find(h)
            known = np.flatnonzero(place >= 0)
            at, place = at[known], place[known]
            piece = self.piece[place]
            got = np.flatnonzero(piece >= 0)
            src = at[got]
            found.append((src, k, piece[got], count[src]))
            count[src] += 1
            if k == 1:
                alone = np.flatnonzero(count == 0)
            on = np.flatnonzero(at + k < end_of[at])
            at, h = at[on], h[known[on]]
            if not len(at):
                break
            h = h * BASE + points[at + k]
        if len(alone):
            found.append((alone, 1, np.array([self._spell(text[i]) for i in alone.tolist()], np.int32), count[alone]))
            count[alone] += 1
        total = int(count.sum())
        begin = np.cumsum(count, dtype=np.int32) - count
        dst, ids = np.empty(total, np.int32), np.empty(total, np.int32)
        for src, k, piece, rank in found:
            slot = begin[src] + rank
            dst[slot] = src + k
            ids[slot] = piece
        weight = self.log_weight.take(ids, mode="clip")
        if len(alone):
            weight[begin[alone] + found[-1][3]] = [self.fallback * len(text[i].encode()) for i in alone.tolist()]
        # sums over all ways from each node to its word's end, from the ends back; the end's own is 0
        to = np.where(dst == np.repeat(end_of, count), np.int32(n), dst)
        beta = np.zeros(n + 1)
        left = end_of - np.arange(n, dtype=np.int32)
        nodes = np.argsort(left.astype(np.uint16) if n and left.max() < 65536 else left, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(left)[1:])] if n else np.zeros(1, np.int64)
        for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if a == z:
                continue
            group = nodes[a:z]
            c = count[group]
            first = np.cumsum(c, dtype=np.int32) - c
            e = np.arange(int(c.sum()), dtype=np.int32) + np.repeat(begin[group] - first, c)
            v = weight[e] + beta[to[e]]
            top = np.maximum.reduceat(v, first)
            own = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, c)), first))
            beta[group] = own
            weight[e] = v - np.repeat(own, c)
        return count, np.where(to == n, np.int32(-1), to), ids, weight

    def _spell(self, c: str) -> int:
        """The byte piece of a character of one byte; else a number that stands for its byte pieces."""
        data = c.encode()
        if len(data) == 1:
            return self.byte_id[data[0]]
        if c not in self.spelled:
            self.spelled[c] = self.size + len(self.spelling)
            self.spelling.append(tuple(self.byte_id[x] for x in data))
        return self.spelled[c]


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _uniform(key: np.ndarray) -> np.ndarray:
    """One number in (0, 1) for each 64-bit key (the SplitMix64 finisher)."""
    z = key + np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    u = z.astype(float)
    u += 0.5
    u *= 1 / (1 << 53)
    return u


def _gumbel(key: np.ndarray) -> np.ndarray:
    u = _uniform(key)
    for _ in range(2):
        np.negative(np.log(u, u), u)
    return u


def _below(top, best, own):
    """A variate ``own`` moved below ``top`` as ``best``, its siblings' greatest, is moved to ``top``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = top - own + np.log1p(-np.exp(np.minimum(own - best, 0)))
        return top - np.maximum(0, v) - np.log1p(np.exp(-np.abs(v)))


P1, P2, P3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


#: What a child's rank adds to its node's key; no node has more children than the longest piece has characters, and one.
with np.errstate(over="ignore"):
    RANKS = np.arange(256).astype(np.uint64) * P3


class Walk:
    """A path through words ``occ`` (ascending) from nodes ``node``, all at a time, and its best siblings."""

    def __init__(self, model: Pieces, occ, node, depth, doc, key, top, docs: int):
        self.occ, self.depth, self.edge = [], [], []
        rows = []  # of each step: document, greatest sibling, its word, depth, edge
        logp = np.zeros(docs)
        doc_of, key_of = doc, key
        while len(occ):
            n, begin = model.count[node], model.begin[node]
            starts = np.cumsum(n, dtype=np.int32) - n
            rank = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(starts, n)
            edge = rank + np.repeat(begin, n)
            k = key_of[occ] ^ (depth.astype(np.uint64) * P2)
            own = np.repeat(k, n)
            own += RANKS.take(rank, mode="clip")
            own = _gumbel(own)
            own += model.phi[edge]
            best = np.maximum.reduceat(own, starts)
            won = np.flatnonzero(own == np.repeat(best, n))
            if len(won) > len(starts):  # a tie of variates: the first wins
                row = np.repeat(np.arange(len(n)), n)[won]
                won = won[np.diff(row, prepend=-1) > 0]
            chosen = edge[won]
            d = doc_of[occ]
            logp += np.bincount(d, model.phi[chosen], docs)
            many = np.flatnonzero(n > 1)
            if len(many):
                rest = own.copy()
                rest[won] = -np.inf
                second = np.maximum.reduceat(rest, starts)[many]
                rows.append((d[many], _below(top[d[many]], best[many], second), occ[many], depth[many], node[many]))
            self.occ.append(occ)
            self.depth.append(depth)
            self.edge.append(chosen)
            node = model.to[chosen]
            on = node >= 0
            occ, node, depth = occ[on], node[on], depth[on] + 1
        self.logp = logp
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.occ, self.depth, self.edge = join(self.occ, np.int64), join(self.depth, np.int64), join(self.edge, np.int64)
        self.rows = [join([r[i] for r in rows], float if i == 1 else np.int64) for i in range(5)]


#: What keeps a text from being cut at single spaces and line ends.
UNEVEN = f"  |\n\n| \n|\n |{MARK}|^[ \n]|[ \n]$|^$"


def cut(column: pa.Array) -> pa.ListArray:
    """Each text's words that no piece reaches beyond, space marks with the word after them."""
    uneven = pc.match_substring_regex(column, UNEVEN)
    marked = pc.replace_substring(pc.replace_substring(column.filter(pc.invert(uneven)), " ", " " + MARK), "\n", " \n ")
    even = pc.split_pattern(pc.binary_join_element_wise(MARK, marked, ""), " ")
    odd = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in column.filter(uneven).to_pylist()]
    if not odd:
        return even
    order = np.argsort(uneven.to_numpy(zero_copy_only=False), kind="stable")
    both = pa.concat_arrays([even, pa.array(odd, even.type)])
    return both.take(pa.array(np.argsort(order)))


def sample_batch(model: Pieces, keys: list[int], texts_, k: int = SAMPLES):
    """For each text, its samples: (ids as two-byte numbers, log-probability, perturbed value, inclusion)."""
    split = cut(texts_ if isinstance(texts_, pa.Array) else pa.array(texts_, pa.string()))
    coded = split.flatten().dictionary_encode()
    docs = len(texts_)
    sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(docs), sizes)
    node0 = model.learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    place = np.arange(len(doc)) - first[doc] if len(doc) else np.zeros(0, np.int64)
    row_key = np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64) * P1
    top = _gumbel(row_key ^ P2)
    everything = np.arange(len(doc), dtype=np.int32)

    def word_keys(sample: int):
        with np.errstate(over="ignore"):
            return _mix(row_key[doc] + np.uint64(sample) * P2) ^ _mix(place.astype(np.uint64) * P3 + P1)

    def paths(walk):
        by = np.argsort(walk.occ, kind="stable")  # steps of a word come in order of depth
        return walk.occ[by], walk.depth[by], walk.edge[by]

    walk = Walk(model, everything, node0, np.zeros(len(doc), np.int32), doc, word_keys(0), top, docs)
    # of each sample: its path's words, depths and edges, where each document's begin, and values
    occ, depth, edge = paths(walk)
    found = [[] for _ in range(docs)]
    cuts = np.searchsorted(occ, np.r_[first, len(doc)])
    current = {d: (occ[cuts[d] : cuts[d + 1]], depth[cuts[d] : cuts[d + 1]], edge[cuts[d] : cuts[d + 1]]) for d in range(docs)}
    for d in range(docs):
        found[d].append([current[d][2], walk.logp[d], top[d]])
    # open siblings of each document: (value, sample whose path it leaves, word, depth, node, rank among its siblings)
    open_: list[list] = [[] for _ in range(docs)]
    paths_of = [{0: (*current[d], 0)} for d in range(docs)]

    def gather(walk, sample, values):
        d, value, occ_, depth_, node = walk.rows
        left = value.copy()
        for _ in range(k - sample):  # the best of each document, as many as can still be used
            if not len(d):
                return
            best = np.full(docs, -np.inf)
            np.maximum.at(best, d, left)
            hit = np.flatnonzero((left == best[d]) & np.isfinite(left))
            for i in hit.tolist():
                open_[d[i]].append((float(value[i]), sample, int(occ_[i]), int(depth_[i]), int(node[i]), 1, float(values[d[i]])))
            left[hit] = -np.inf

    keys_of = [word_keys(0)]
    gather(walk, 0, top)
    for sample in range(1, k):
        keys_of.append(word_keys(sample))
        more_occ, more_node, more_depth = [], [], []
        values = np.full(docs, -np.inf)
        prefix = {}
        for d in range(docs):
            if not open_[d]:
                continue
            best = max(open_[d])
            open_[d].remove(best)
            value, source, o, dep, node, rank, parent = best
            raw, moved = _siblings(model, keys_of[source][o], dep, node, parent)
            order = np.argsort(-raw, kind="stable")
            e = int(model.begin[node] + order[rank])
            if rank + 1 < len(order):
                open_[d].append((float(moved[order[rank + 1]]), source, o, dep, node, rank + 1, parent))
            p_occ, p_depth, p_edge, _ = paths_of[d][source]
            stop = int(np.searchsorted(p_occ, o)) + dep
            kept = tuple(np.concatenate((x[:stop], (y,))) for x, y in ((p_occ, o), (p_depth, dep), (p_edge, e)))
            prefix[d], values[d] = kept, value
            if model.to[e] >= 0:
                more_occ.append(np.array([o]))
                more_node.append(model.to[[e]])
                more_depth.append(np.array([dep + 1]))
            rest = everything[o + 1 : first[d] + sizes[d]]
            more_occ.append(rest)
            more_node.append(node0[rest])
            more_depth.append(np.zeros(len(rest), np.int32))
        if not prefix:
            break
        joined = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (more_occ, more_node, more_depth)]
        walk = Walk(model, *joined, doc, keys_of[sample], np.where(np.isfinite(values), values, 0), docs)
        occ, depth, edge = paths(walk)
        cuts = np.searchsorted(occ, np.r_[first, len(doc)])
        for d, (a, b, c) in prefix.items():
            s = slice(cuts[d], cuts[d + 1])
            whole = (np.concatenate((a, occ[s])), np.concatenate((b, depth[s])), np.concatenate((c, edge[s])), 0)
            paths_of[d][sample] = whole
            found[d].append([whole[2], float(model.phi[whole[2]].sum()), values[d]])
        gather(walk, sample, values)
    out = []
    for d in range(docs):
        limit = max(open_[d])[0] if open_[d] else -np.inf
        rows = []
        for e, logp, value in found[d]:
            ids = model.id[e]
            if len(ids) and ids.max() >= model.size:
                ids = np.array([y for x in ids.tolist() for y in ((x,) if x < model.size else model.spelling[x - model.size])])
            inclusion = 1.0 if limit == -np.inf else -float(np.expm1(-np.exp(min(logp - limit, 50.0))))
            rows.append((ids.astype("<u2").tobytes(), float(logp), float(value), inclusion))
        out.append(rows)
    return out


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(27))


def _siblings(model: Pieces, key, depth: int, node: int, top: float):
    """The variates of a node's children, as the walk drew them, and their perturbed values."""
    n, begin = int(model.count[node]), int(model.begin[node])
    with np.errstate(over="ignore"):
        k = np.full(n, key, np.uint64) ^ (np.uint64(depth) * P2)
        own = model.phi[begin : begin + n] + _gumbel(k + np.arange(n).astype(np.uint64) * P3)
    return own, _below(top, own.max(), own)


def decoded(model: Pieces, several: list[bytes]) -> list[bytes]:
    """The texts' bytes: the pieces' one after another, space marks as spaces, without the leading one."""
    i = np.frombuffer(b"".join(several), "<u2")
    out = []
    for a in range(0, len(i), 1 << 14):
        own = i[a : a + (1 << 14)]
        sizes = model.sizes[own]
        ends = np.cumsum(sizes)
        at = np.repeat(model.places[own] - (ends - sizes), sizes).astype(np.int64)
        at += np.arange(len(at))
        out.append(model.spelled_out.take(at).tobytes())
    whole = b"".join(out)
    stops = np.r_[0, np.cumsum(model.sizes[i], dtype=np.int64)][np.cumsum([0, *(len(x) // 2 for x in several)])].tolist()
    return [whole[a + 1 : z] for a, z in zip(stops, stops[1:], strict=False)]


def decode(model: Pieces, ids: bytes) -> str:
    return decoded(model, [ids])[0].decode("utf-8", "replace")


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.binary()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])
SEGMENTS = "doc_id long, sample int, ids binary, log_prob double, perturbed double, inclusion double"


def encode(docs: DataFrame, path: str, k: int = SAMPLES) -> DataFrame:
    """``k`` distinct segmentations of every document, best perturbed value first."""

    def run(it):
        model = pieces(path)
        for b in slices(it, CHARS):
            docs_ = b["doc_id"].to_pylist()
            got = sample_batch(model, [-1 if x is None else x for x in docs_], b["text"], k)
            rows = [(doc, i, *row) for doc, samples in zip(docs_, got, strict=True) for i, row in enumerate(samples)]
            yield batch(_SEGMENTS, **dict(zip(_SEGMENTS.names, zip(*rows, strict=True), strict=True)))

    return texts(docs).mapInArrow(run, SEGMENTS)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])


def digest(segments: DataFrame, path: str) -> DataFrame:
    """Piece counts, a checksum of the ids and the hash of the decoded text."""

    def run(it):
        model = pieces(path)
        for b in it:
            ids = b["ids"].to_pylist()
            same = {n: b[n] for n in ("doc_id", "sample", "log_prob", "perturbed", "inclusion")}
            yield batch(_DIGEST, **same, n_pieces=[len(x) // 2 for x in ids], ids_crc32=[zlib.crc32(x) for x in ids], decoded_sha256=[hashlib.sha256(x).hexdigest() for x in decoded(model, ids)])

    return segments.mapInArrow(run, "doc_id long, sample int, n_pieces long, ids_crc32 long, decoded_sha256 string, log_prob double, perturbed double, inclusion double")
