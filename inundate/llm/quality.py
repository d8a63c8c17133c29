r"""Quality rules: base counts and distribution divergence.

Words are ``[^\x20\x09-\x0D]+``.  The base counts follow the query's contract.  The
method compares two histograms of a document, of character classes and of common
words, with those of every language's reference by Jensen-Shannon distance (base
2); the least distance over the languages counts.  Distances of words are measured
against the distance that a text without any common word has from the same
reference (``word_distance`` 1), as most words of any text are others.  A document is
kept if it does not fail the base rules and neither distance is over its limit; a
histogram with fewer than ``MIN_CHARS`` characters or ``MIN_WORDS`` words decides
nothing, and neither does a reference with less than ``MIN_COMMON`` common words.

References sum the histograms of all documents of a language that pass the base
rules.  The ``COMMON`` words of a language are those in most of its documents, all
counted; of words in as many documents the first by bytes.  Null text is empty
(base_failed); null lang adds to no reference; repeated rows give repeated rows; with
no reference at all (an empty or a tiny table) the distances are null and decide
nothing; other columns are left behind, whatever their names; texts are read whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .common import SPACES, batch, slices, texts

COMMON, PARTS = 40, 64
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CLASS, MAX_WORD = 0.30, 0.90
#: Share of common words that a reference needs to tell them from others.
MIN_COMMON = 0.05
MIN_BASE_WORDS = 50

LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, MARK, BEYOND, REST = range(9)
CLASS = np.full(256, MARK, np.uint8)
CLASS[np.arange(ord("a"), ord("z") + 1)] = LOWER
CLASS[np.arange(ord("A"), ord("Z") + 1)] = UPPER
CLASS[np.arange(ord("0"), ord("9") + 1)] = DIGIT
CLASS[list(SPACES)] = SPACE
CLASS[list(b".,;:!?'\"()-")] = STOP
CLASS[list(b"#*$%&|<>")] = SYMBOL
CLASS[0xC0:] = BEYOND
CLASS[0x80:0xC0] = REST  # inside a character
STRIP = b".,;:!?'\"()-"


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    key = codes[: n - width + 1]
    for k in range(1, width):
        key = np.unique(key, return_inverse=True)[1] * np.int64(len(known)) + codes[k : n - width + 1 + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line and not line.isspace() and line.split():
            if line in seen:
                n += 1
            seen.add(line)
    return n


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``, all summing to one."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def common_words(docs: DataFrame) -> list[bytes]:
    """The words that are in most documents of each language, counted over all documents."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(it):
        held: Counter = Counter()

        def out():
            return batch(schema, lang=[k[0] for k in held], word=[k[1] for k in held], n=list(held.values()))

        for b in slices(it):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                held.update((lang, w) for w in {x.strip(STRIP) for x in text.encode().lower().split()} if w)
                if len(held) > 300_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    known = texts(docs, "lang").where("lang is not null").mapInArrow(run, "lang string, word binary, n long")
    rows = known.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for by in (["lang", F.pmod(F.xxhash64("word"), F.lit(PARTS))], ["lang"]):  # no language's words meet in one task
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON).drop("place")
    return sorted({bytes(r.word) for r in rows.select("word").collect()})  # languages x COMMON


FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, base_failed boolean, hist binary"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")), ("base_failed", pa.bool_()), ("hist", pa.binary())])


def features(docs: DataFrame, common: list[bytes]) -> DataFrame:
    """Base counts and both histograms (four-byte counts: classes, common words, other words)."""
    place = {w: i for i, w in enumerate(common)}

    def run(it):
        for b in slices(it):
            rows = []
            for doc, lang, text in zip(*(b[n].to_pylist() for n in ("doc_id", "lang", "text")), strict=True):
                data = text.encode()
                words = data.split()
                classes = np.bincount(CLASS[np.frombuffer(data, np.uint8)], minlength=9)[:REST]
                hist = np.zeros(REST + len(place) + 1, "<u4")
                hist[:REST] = classes
                found = [place[w] for x in data.lower().split() if (w := x.strip(STRIP)) in place]
                hist[REST:-1] = np.bincount(found, minlength=len(place)) if found else 0
                n, chars = len(words), int(classes.sum())
                hist[-1] = n - len(found)
                again = repeated(words)
                rows.append((doc, lang, n, chars - int(classes[SPACE]), int(classes[SYMBOL]), repeated_lines(data), again, chars, n < MIN_BASE_WORDS or 100 * again > 50 * n, hist.tobytes()))
            yield batch(_FEATURES, **dict(zip(_FEATURES.names, zip(*rows, strict=True), strict=True)))

    return texts(docs, "lang").mapInArrow(run, FEATURES)


def references(rows: DataFrame, size: int) -> np.ndarray:
    """One summed histogram for each language, over all documents that pass the base rules."""

    def run(it):
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for lang, failed, hist in zip(*(b[n].to_pylist() for n in ("lang", "base_failed", "hist")), strict=True):
                if lang is not None and not failed:
                    h = np.frombuffer(hist, "<u4").astype(np.int64)
                    sums[lang] = sums[lang] + h if lang in sums else h
        for lang, h in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.arange(size)), pa.array(h)], ["lang", "bin", "n"])

    summed = rows.select("lang", "base_failed", "hist").mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x bins
        out.setdefault(r.lang, np.zeros(size))[r.bin] = r.n
    return np.array([out[k] for k in sorted(out)])


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
_VERDICT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, distances to the nearest language reference and the verdict, for every document."""
    common = common_words(docs)
    size = REST + len(common) + 1
    rows = checkpointed(features(docs, common))
    refs = references(rows, size)
    classes = [r[:REST] / r[:REST].sum() for r in refs]
    words = [p for r in refs for p in [r[REST:] / r[REST:].sum()] if 1 - p[-1] >= MIN_COMMON]
    none = np.zeros(size - REST)
    none[-1] = 1.0
    strange = [float(divergence(none, p)) for p in words]  # of a text without common words

    def run(it):
        for b in it:
            n = b.num_rows
            hist = np.frombuffer(b"".join(b["hist"].to_pylist()), "<u4").reshape(n, size).astype(float)
            out = {}
            for name, part, refs, units, least in (("class_distance", hist[:, :REST], classes, [1.0] * len(classes), MIN_CHARS), ("word_distance", hist[:, REST:], words, strange, MIN_WORDS)):
                total = part.sum(1)
                d = np.min([divergence(part / np.maximum(total, 1)[:, None], r) / unit for r, unit in zip(refs, units, strict=True)], 0) if refs else np.zeros(n)
                out[name] = np.where((total >= least) & bool(refs), d, np.nan)
            failed = b["base_failed"].to_numpy(zero_copy_only=False)
            far = (np.nan_to_num(out["class_distance"]) > MAX_CLASS) | (np.nan_to_num(out["word_distance"]) > MAX_WORD)
            same = {x: b[x] for x in _VERDICT.names if x in b.schema.names}
            arrays = [pa.array(out[f.name], from_pandas=True) if f.name in out else pa.array(~failed & ~far) if f.name == "kept" else same[f.name] for f in _VERDICT]
            yield pa.RecordBatch.from_arrays(arrays, schema=_VERDICT)

    return rows.mapInArrow(run, VERDICT)
