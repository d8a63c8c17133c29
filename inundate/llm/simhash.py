r"""SimHash near-duplicates with BK-trees.

Texts are lower-cased (A-Z), cut into words ``[^\x20\x09-\x0D]+`` and into four-word
shingles, repeats included (fewer words: one shingle of all; none: fingerprint 0).
A bit of the fingerprint is 1 if it is set in more than half the shingles' XXH64.

Links between fingerprints of ``RADIUS`` or fewer differing bits are found without
loss: the 64 bits are cut into 6 blocks, and fingerprints that differ in 4 bits
share at least 2 whole blocks, so every distinct fingerprint goes to 15 trees, one
for each pair of blocks and value.  A tree's children are keyed by their integer
Hamming distance to the parent, and a search follows only edges within the radius
of the distance just measured.  Trees of a shard are built and searched level by
level, all at once.  The fingerprints of a key with more than ``TREE`` of them are
dealt out again in the same way by the bits that they do not share yet, until no
tree is larger (or ``FEW`` bits are left, which bound it); so a hot key costs 15 rows
for each of its fingerprints, not a row for each pair of parts.  Sending every tree to
every executor would grow with the corpus.

Equal fingerprints are one node, whatever the number of copies.  From a shard only
a spanning forest of the links found leaves, at most one link for each row.

Null text is empty; empty texts share fingerprint 0; repeated rows give repeated
rows; a component without any doc_id has a null id; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import smallest_reachable
from ..sources.store import checkpointed
from .common import batch, slices, texts

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCKS = 6
TREE, FEW = 16_384, 14
SHARD_ROWS = 60_000
#: Of the pipeline's stage: members of a band compared in one task; those of a larger one meet in parts.
PART = 2048
#: Of the pipeline's stage: words of a shingle and the similarity of copies; bands of least hashes, and how many of the
#: ``BANDS * BAND`` two texts share that are compared (copies share about 46 and hardly ever fewer than 40).
WIDTH, ALIKE = 5, 0.8
BANDS, BAND, SHARED = 14, 4, 36
#: Members of a component judged in one task; of a larger one so many lead at a time.  Members of a task.
TOGETHER, LEAD_PARTS, JUDGED_ROWS = 2000, 16, 2000


def _hashes(data: bytes, width: int):
    """XXH64 of the shingles of ``width`` words, in parts; nothing of a text without words."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[width - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    h = xxhash.xxh64_intdigest
    for i in range(0, len(ends), 65536):
        yield np.array([h(joined[a:z], SEED) for a, z in zip(starts[i : i + 65536], ends[i : i + 65536], strict=True)], "<u8")


def _majority(parts: list[np.ndarray]) -> int:
    counts = np.zeros(64, np.int64)
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > sum(map(len, parts)), bitorder="little").view("<u8")[0])


def shingle_bits(data: bytes, width: int = SHINGLE) -> int:
    """The fingerprint over shingles of ``width`` words, unsigned."""
    return _majority(list(_hashes(data, width)))


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(it):
        for b in slices(it):
            bits = np.array([shingle_bits(t.encode()) for t in b["text"].to_pylist()], "<u8")
            yield batch(_PRINTS, doc_id=b["doc_id"], fp=bits.view("<i8"))

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """The shingles' least values under ``BANDS * BAND`` hash functions."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for part in parts:
        for i in range(0, len(part), 4096):
            least = np.minimum(least, (_FACTORS[0][:, None] * part[i : i + 4096] + _FACTORS[1][:, None]).min(1))
    return least


_SKETCHES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, the fingerprint fp, a byte of each least hash (sig) and the keys of the bands."""

    def run(it):
        for b in slices(it):
            fps, sigs, bands = [], [], []
            for t in b["text"].to_pylist():
                parts = list(_hashes(t.encode(), SHINGLE))
                least = least_hashes(parts)
                fps.append(_majority(parts))
                sigs.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
                bands.append([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND))])
            keys = np.array(bands, "<u8").reshape(-1, BANDS).view("<i8").tolist()
            yield batch(_SKETCHES, doc_id=b["doc_id"], text_hash=b["text_hash"], fp=np.array(fps, "<u8").view("<i8"), sig=sigs, bands=keys)

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long, sig binary, bands array<long>")


def shingle_set(data: bytes) -> bytes:
    """The different ``WIDTH``-word shingles' hashes, 32 bits each, ascending."""
    parts = [p >> np.uint64(32) for p in _hashes(data, WIDTH)]
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, "<u8")).astype("<u4").tobytes()


class Forest:
    """BK-trees over (tree, fingerprint) rows, distinct and all built together."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray):
        order = np.lexsort((fp, tree))
        self.tree, self.fp = tree[order], fp[order]
        self.order = order
        first = np.flatnonzero(np.diff(self.tree, prepend=self.tree[0] - 1 if len(tree) else 0)) if len(tree) else np.zeros(0, np.int64)
        self.names, self.roots = self.tree[first], first
        self.sizes = np.diff(np.r_[first, len(fp)])
        at = np.repeat(first, self.sizes)
        item = np.arange(len(fp))
        keep = item != at
        item, at = item[keep], at[keep]
        edges, child = [], []
        while len(item):
            d = np.bitwise_count(self.fp[item] ^ self.fp[at]).astype(np.int64)
            edge = at * 65 + d
            by = np.argsort(edge, kind="stable")
            item, edge = item[by], edge[by]
            new = np.flatnonzero(np.diff(edge, prepend=-1))
            edges.append(edge[new])
            child.append(item[new])
            at = np.repeat(item[new], np.diff(np.r_[new, len(edge)]))
            keep = item != at
            item, at = item[keep], at[keep]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(child) if child else np.zeros(0, np.int64)
        by = np.argsort(edge)
        self.edge, self.child = edge[by], child[by]

    def search(self, tree: np.ndarray, fp: np.ndarray, radius: int = RADIUS):
        """Blocks of (query, node) with ``radius`` or fewer differing bits."""
        place = np.searchsorted(self.names, tree)
        place = np.minimum(place, max(len(self.names) - 1, 0))
        known = np.flatnonzero(self.names[place] == tree) if len(self.names) else np.zeros(0, np.int64)
        known = known[np.argsort(self.sizes[place[known]], kind="stable")]
        load = np.cumsum(self.sizes[place[known]])
        begin = 0
        while begin < len(known):
            stop = max(begin + 1, int(np.searchsorted(load, (load[begin - 1] if begin else 0) + 2_000_000, "right")))
            q = known[begin:stop]
            node = self.roots[place[q]]
            begin = stop
            while len(q):
                d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
                n = hi - lo
                q = np.repeat(q, n)
                node = self.child[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by least member, in place."""

    def roots(x):
        x = parent[x]
        while not np.array_equal(up := parent[x], x):
            x = up
        return x

    while True:
        ra, rb = roots(a), roots(b)
        apart = ra != rb
        if not apart.any():
            return
        a, b = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shard(rows: pa.Table) -> pa.Table:
    key, fp = rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    tree = np.unique(key, return_inverse=True)[1].ravel()
    nodes, own = np.unique(fp, return_inverse=True)
    forest = Forest(tree, fp)
    mine = own[forest.order]
    parent = np.arange(len(nodes))
    for q, node in forest.search(tree, fp):
        unite(parent, own[q], mine[node])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.table([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[parent[moved]].view(np.int64))], schema=_LINKS)


def blocks(free: int) -> list[int]:
    """Masks of the keys: the free bits (a mask) cut into ``BLOCKS`` blocks, and every choice of as many as must be whole."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * i // BLOCKS for i in range(BLOCKS + 1)]
    parts = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, BLOCKS - RADIUS)]


EVERY, KEYS = (1 << 64) - 1, math.comb(BLOCKS, BLOCKS - RADIUS)
_KEYED = pa.schema([("key", pa.int64()), ("free", pa.int64()), ("fp", pa.int64())])
KEYED = "key long, free long, fp long"


def deal(it):
    """(key, free, fp) rows under the next keys: a hash of the key so far and the bits of a choice of blocks.

    Should two keys hash alike, their fingerprints share a tree, which loses nothing.
    """
    for b in it:
        key, free, fp = (b[n].to_numpy().view(np.uint64) for n in ("key", "free", "fp"))
        for mask in np.unique(free).tolist():
            own = free == mask
            for i, chosen in enumerate(blocks(mask)):
                z = (key[own] ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & EVERY)) * np.uint64(0xBF58476D1CE4E5B9) + (fp[own] & np.uint64(chosen))
                z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(29)
                rest = np.full(len(z), mask & ~chosen, np.uint64)
                yield batch(_KEYED, key=z.view(np.int64), free=rest.view(np.int64), fp=fp[own].view(np.int64))


def dealt(prints: DataFrame) -> tuple[DataFrame, int]:
    """(key, fp) of all trees, and the rows dealt; ``prints`` has a durable column fp, distinct."""
    whole, done, rows = prints.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"), "fp"), [], 0
    while True:
        keyed = whole.mapInArrow(deal, KEYED)
        sizes = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.bit_count("free")).alias("left")).where("n > 1"))
        hot = sizes.where((F.col("n") > TREE) & (F.col("left") > FEW)).select("key")
        rows += KEYS * whole.count()
        if not hot.limit(1).count():
            done.append(keyed)
            return reduce(DataFrame.unionByName, (k.select("key", "fp") for k in done)), rows
        hot = checkpointed(hot)
        done.append(keyed.join(hot, "key", "left_anti"))
        whole = checkpointed(keyed.join(hot, "key", "left_semi").select("key", "free", "fp"))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of a component; ``prints`` has a durable column fp, distinct."""
    keyed, rows = dealt(prints)
    shards = max(1, rows // SHARD_ROWS)
    return keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_shard, "a long, b long")


def components(nodes: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``nodes``: the least fingerprint that each reaches by links."""
    stars = smallest_reachable(links(nodes.select("fp")))
    return nodes.join(stars.select(F.col("a").alias("fp"), "b"), "fp", "left").withColumn("root", F.coalesce("b", "fp")).drop("b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of every document."""
    prints = checkpointed(fingerprints(docs))
    named = components(checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = checkpointed(named.join(least, "root").select("fp", "component_id"))
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _near(fp: np.ndarray, sig: np.ndarray, other_fp, other_sig) -> np.ndarray:
    """Whether rows may be near copies, by their fingerprints and least hashes."""
    return (np.bitwise_count(fp ^ other_fp) <= RADIUS) | ((sig == other_sig).sum(-1) >= SHARED)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles, ascending, have a similarity of ``ALIKE`` or more."""
    least, most = sorted((len(a), len(b)))
    if least < ALIKE * most:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b)))) if most else 0
    return both >= ALIKE * (len(a) + len(b) - both)


def _sets(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in rows["grams"].to_pylist()]


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, BANDS * BAND)
    return rows["fp"].to_numpy().view(np.uint64), sig


def _to_first(group: np.ndarray, fp: np.ndarray, sig: np.ndarray):
    """Of rows in order of ``group``: each group's first row, by row, and whether the row is near it."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    first = np.repeat(first, np.diff(np.r_[first, len(group)]))
    return first, np.concatenate([_near(fp[i : i + 8192], sig[i : i + 8192], fp[j], sig[j]) for i in range(0, len(fp), 8192) for j in [first[i : i + 8192]]])


def _band_shard(rows: pa.Table) -> pa.Table:
    """A spanning forest of all near pairs inside each (key, low, high)."""
    fp, sig = _columns(rows)
    group = np.unique(np.stack([rows[n].to_numpy() for n in ("key", "low", "high")], 1), axis=0, return_inverse=True)[1].ravel()
    by = np.argsort(group, kind="stable")
    group, fp, sig = group[by], fp[by], sig[by]
    first, near = _to_first(group, fp, sig)
    a, b = [np.flatnonzero(near)], [first[near]]
    ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
    for start in np.unique(first[~near]).tolist():
        stop = int(ends[np.searchsorted(ends, start, "right")])
        inside = np.arange(start, stop)
        known, left = inside[near[start:stop]][1:].tolist(), inside[~near[start:stop]]
        while len(left):
            if known:
                at = known.pop()
            else:
                at, left = left[0], left[1:]
            hit = _near(fp[left], sig[left], fp[at], sig[at])
            a.append(left[hit])
            b.append(np.full(hit.sum(), at))
            known += left[hit].tolist()
            left = left[~hit]
    nodes, own = np.unique(fp, return_inverse=True)
    parent = np.arange(len(nodes))
    unite(parent, own[np.concatenate(a)], own[np.concatenate(b)])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.table([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[parent[moved]].view(np.int64))], schema=_LINKS)


def _paired(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, fp, part, low, high): every two parts of a key's fingerprints meet once; ``hot`` has the parts of large keys."""
    salted = keyed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salted = salted.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("key", "fp", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def band_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all near fingerprints which share a band; ``nodes`` has durable columns fp, sig and bands, fp distinct."""
    keyed = nodes.select(F.explode(F.array_distinct("bands")).alias("key"), "fp")
    sizes = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shards = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS)
    parts = sizes.where(F.col("n") > PART).select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    met = _paired(keyed.join(sizes.select("key"), "key", "left_semi"), parts).join(nodes.select("fp", "sig"), "fp")
    dealt = met.withColumn("shard", F.pmod(F.xxhash64("key", "low", "high"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_band_shard, "a long, b long")


MEMBER = "root long, fp long, first_id long, sig binary, grams binary"
JUDGED = f"{MEMBER}, lead_id long"
_JUDGED = pa.schema([("root", pa.int64()), ("fp", pa.int64()), ("first_id", pa.int64()), ("sig", pa.binary()), ("grams", pa.binary()), ("lead_id", pa.int64())])
_MEMBER = _JUDGED.names[:5]


def _judge(rows: pa.Table) -> pa.Table:
    """Each component's members by first_id: lead_id is the first that stays and is alike, null of those that stay."""
    rows = rows.select(_MEMBER).sort_by([("root", "ascending"), ("first_id", "ascending"), ("fp", "ascending")])
    (fp, sig), sets = _columns(rows), _sets(rows)
    lead = np.full(len(fp), -1)
    for part in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(rows["root"].to_numpy())) + 1):
        while len(part) > 1:
            at, part = part[0], part[1:]
            near = _near(fp[part], sig[part], fp[at], sig[at])
            hit = near.copy()
            hit[near] = [alike(sets[at], sets[i]) for i in part[near].tolist()]
            lead[part[hit]] = at
            part = part[~hit]
    ids = rows["first_id"].to_numpy()
    return rows.append_column("lead_id", pa.array(ids[lead], mask=lead < 0)).cast(_JUDGED)


def _led(key, rows: pa.Table, leads: pa.Table) -> pa.Table:
    """``rows`` with the first of ``leads`` that each is alike."""
    rows, leads = rows.select(_MEMBER), leads.select(_MEMBER).sort_by("first_id")
    (fp, sig), sets = _columns(rows), _sets(rows)
    lead, mask, left = np.zeros(len(fp), np.int64), np.ones(len(fp), bool), np.arange(len(fp))
    for one, own, grams, at in zip(*_columns(leads), _sets(leads), leads["first_id"].to_pylist(), strict=True):
        near = _near(fp[left], sig[left], one, own)
        hit = near.copy()
        hit[near] = [alike(grams, sets[i]) for i in left[near].tolist()]
        lead[left[hit]], mask[left[hit]] = at, False
        left = left[~hit]
    return rows.append_column("lead_id", pa.array(lead, mask=mask)).cast(_JUDGED)


def _least(rows: DataFrame) -> DataFrame:
    """The ``TOGETHER`` members of least first_id of each root, chosen in parts first."""
    order = [F.col("first_id"), F.col("fp")]
    for by in (["root", F.pmod(F.xxhash64("fp"), F.lit(LEAD_PARTS))], ["root"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= TOGETHER).drop("place")
    return rows


def led(members: DataFrame) -> DataFrame:
    """(fp, lead_id) of the members (root, fp, first_id, sig, grams; durable) that are alike to one that stays.

    By first_id, a member stays if none that stays before it is alike.  Components of up to
    ``TOGETHER`` members are judged whole.  In larger ones the least members are judged
    first, then all others against those that stay, until the rest is small.
    """
    columns, found, left = _MEMBER, [], members
    while True:
        sizes = checkpointed(left.groupBy("root").agg(F.count("*").alias("n")))
        large = checkpointed(sizes.where(F.col("n") > TOGETHER).select("root", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts")))
        small = left.join(large, "root", "left_anti")
        some = not large.limit(1).count()
        shards = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // JUDGED_ROWS)
        heads = small if some else small.unionByName(_least(left.join(large, "root", "left_semi")))
        judged = checkpointed(heads.withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(shards))).groupBy("shard").applyInArrow(_judge, JUDGED))
        found.append(judged.where("lead_id is not null").select("fp", "lead_id"))
        if some:
            return reduce(DataFrame.unionByName, found)
        rest = left.join(large, "root").join(judged.select("fp"), "fp", "left_anti").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        stay = judged.where("lead_id is null").join(large, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rest, stay = rest.select(*columns, "part"), stay.select(*columns, "part")
        after = checkpointed(rest.groupBy("root", "part").cogroup(stay.groupBy("root", "part")).applyInArrow(_led, JUDGED))
        found.append(after.where("lead_id is not null").select("fp", "lead_id"))
        left = after.where("lead_id is null").select(*columns)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of every near copy of a document that stays.

    At a similarity of 0.8 over five-word shingles fingerprints differ in about 9 bits,
    too far for trees of radius 4.  Candidates therefore share a band, ``BAND`` least
    hashes of the four-word shingles (at 0.8 a pair misses all ``BANDS`` once in 10,000
    times), or are linked by the trees; those that share ``SHARED`` least hashes, or
    differ in ``RADIUS`` bits at most, make components.  In each, by doc_id, a document
    goes if its set of shingles is alike (``ALIKE``) to that of one that stays.
    """
    prints = checkpointed(sketches(docs.where("doc_id is not null")).distinct())
    first = F.min(F.struct("doc_id", "text_hash", "sig", "bands")).alias("x")
    nodes = checkpointed(prints.groupBy("fp").agg(first).select("fp", F.col("x.doc_id").alias("first_id"), "x.text_hash", "x.sig", "x.bands"))
    stars = smallest_reachable(links(nodes.select("fp")).unionByName(band_links(nodes)))
    rooted = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    named = rooted.join(nodes.select("fp", "first_id", "text_hash", "sig"), "fp")
    rows = texts(docs).where("doc_id is not null").select(F.col("doc_id").alias("first_id"), F.xxhash64("text").alias("text_hash"), "text")

    def run(it):
        for b in slices(it):
            grams = pa.array([shingle_set(t.encode()) for t in b["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b[n] for n in _MEMBER[:4]), grams], _MEMBER)

    members = checkpointed(named.join(rows, ["first_id", "text_hash"]).select(*_MEMBER[:4], "text").mapInArrow(run, MEMBER).dropDuplicates(["fp"]))
    gone = prints.join(led(members), "fp").where("doc_id <> lead_id").select("doc_id")
    return gone.unionByName(prints.join(nodes.select("fp", "first_id"), "fp").where("doc_id <> first_id").select("doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies of others; of rows that share a doc_id one stays, of rows without doc_id all."""
    left = docs.join(copies(docs).distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = checkpointed(again)
    if not again.limit(1).count():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
