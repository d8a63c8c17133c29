r"""Secret scans: fixed rules and character Markov models.

Rules (leftmost, non-overlapping, per kind): ``assign`` a keyword, ``:`` or ``=``
and a value of 6 or more; ``access`` an AKIA key of 20 or more; ``hex`` a run of
24 or more.  The method adds ``random``: runs of ``[A-Za-z0-9+/_=-]`` of
``MIN_RUN`` or more whose log-likelihood ratio between two first-order character
models (random strings against ordinary identifiers) is over ``MIN_RATIO`` a
character, and that touch no rule's match.

Both models learn from labelled samples: values the rules found in a bounded
sample of documents and strings drawn from a seeded generator are random; the
other words of that sample, alone and joined as identifiers are, are ordinary.

Spans are code points, end exclusive.  Null text is empty and has no span;
repeated rows give repeated rows; an empty table gives an empty table; spans that
start alike are in the order of the kinds; other columns are left behind (the stage
of the pipeline keeps them), whatever their names; long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, piece, sample, slices, texts

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

MIN_RUN, MIN_RATIO = 20, 0.7
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Documents whose words train the models (a bound on fitting only; the scan reads all).
FIT_ROWS = 600
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(128, len(SYMBOLS), np.int64)
CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))


def rules(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules' matches, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _transitions(strings: list[str]) -> np.ndarray:
    n = len(SYMBOLS)
    counts = np.full((n + 1, n + 1), 0.2)
    for s in strings:
        c = CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8) & 127]
        c = c[c < n]
        np.add.at(counts, (np.r_[n, c[:-1]], c), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def fit(found: list[str], words: list[str], seed: int = 7) -> np.ndarray:
    """The table of log-likelihood ratios by (previous, next) symbol."""
    rng = random.Random(seed)
    drawn = []
    for alphabet in (SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[26:62], SYMBOLS[:26] + SYMBOLS[52:62], "0123456789abcdef"):
        drawn += ["".join(rng.choices(alphabet, k=rng.randint(16, 48))) for _ in range(1200)]
    plain = [w for w in words if w.isascii()] or ["value", "index", "name"]
    joined = []
    for _ in range(4000):
        parts = rng.choices(plain, k=rng.randint(2, 4))
        joined.append({0: "_".join, 1: "-".join, 2: "/".join, 3: lambda p: "".join(x.title() for x in p)}[rng.randrange(4)](parts) + rng.choice(["", "", "1", "2024", "_v2"]))
    return _transitions(found + drawn) - _transitions(plain[:20000] + joined)


def ratio(table: np.ndarray, run: str) -> float:
    c = CODE[np.frombuffer(run.encode(), np.uint8)]
    return float(table[np.r_[len(SYMBOLS), c[:-1]], c].mean())


def scan(text: str, table: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end): the rules' and those the models add."""
    found = rules(text)
    more = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if not any(s < b and a < e for s, _, e in found) and ratio(table, m[0]) > MIN_RATIO:
            more.append((a, 3, b))
    return sorted(found + more) if more else found


def train(docs: DataFrame) -> np.ndarray:
    rows = sample(texts(docs), FIT_ROWS, piece(F.col("text")).alias("text"))
    values, words = [], []
    for r in rows:
        spans = rules(r.text)
        values += [ASSIGN.sub(r"\2", r.text[a:b]) for a, _, b in spans]
        keep = r.text
        for a, _, b in reversed(spans):
            keep = keep[:a] + " " + keep[b:]
        words += re.findall(r"[A-Za-z]{2,}", keep)
    return fit(values, words)


SPANS = "doc_id long, starts array<int>, ends array<int>, kinds array<int>"
_SPANS = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32()))])


def find_secrets(docs: DataFrame, ratios: np.ndarray | None = None) -> DataFrame:
    """doc_id and its spans as three parallel arrays, in order of start, then kind."""
    learned = train(docs) if ratios is None else ratios

    def run(it):
        for b in slices(it):
            spans = [scan(t, learned) for t in b["text"].to_pylist()]
            yield batch(_SPANS, doc_id=b["doc_id"], starts=[[x[0] for x in s] for s in spans], ends=[[x[2] for x in s] for s in spans], kinds=[[x[1] for x in s] for s in spans])

    return texts(docs).mapInArrow(run, SPANS)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])


def digest(spans: DataFrame) -> DataFrame:
    """The counts, the digest of the rules' spans and all spans as text."""

    def run(it):
        for b in it:
            rows = []
            for starts, ends, kinds in zip(*(b[n].to_pylist() for n in ("starts", "ends", "kinds")), strict=True):
                said = [f"{KINDS[k]}:{s}:{e}" for s, e, k in zip(starts, ends, kinds, strict=True)]
                base = ",".join(x for x, k in zip(said, kinds, strict=True) if k < 3)
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), kinds.count(3)))
            n_assign, n_access, n_hex, sha, said, n_random = zip(*rows, strict=True) if rows else [[]] * 6
            yield batch(_DIGEST, doc_id=b["doc_id"], n_assign=n_assign, n_access=n_access, n_hex=n_hex, base_sha256=sha, spans=said, n_random=n_random)

    return spans.mapInArrow(run, DIGEST)


def redact(docs: DataFrame, mark: str = "[SECRET]", ratios: np.ndarray | None = None) -> DataFrame:
    """The documents with every span replaced by ``mark``; all columns and rows stay,
    a null text stays null.  n_chars, where there is one, follows a text that was changed."""
    learned = train(docs) if ratios is None else ratios
    at, sized = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(it):
        for b in slices(it):
            old, new = b["text"].to_pylist(), []
            for t in old:
                for a, _, e in _merged(scan(t, learned)) if t else ():
                    t = t[:a] + mark + t[e:]
                new.append(t)
            out = b.set_column(at, b.schema.field(at), pa.array(new, pa.string()))
            if sized is not None:
                n = [k if t is u else len(u) for k, t, u in zip(b["n_chars"].to_pylist(), old, new, strict=True)]
                out = out.set_column(sized, b.schema.field(sized), pa.array(n, b.schema.field(sized).type))
            yield out

    return bounded(docs).mapInArrow(run, docs.schema)


def _merged(spans):
    """Overlapping spans as one, last first."""
    out: list[list[int]] = []
    for a, k, e in spans:
        if out and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([a, k, e])
    return reversed(out)
