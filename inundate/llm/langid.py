"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of 64; two recurrent layers, one from
either side, give every byte position a distribution over the languages.  Each layer
starts ``AROUND`` bytes before the window it comes to, so every position has been
reached over that many bytes of its text at least, from both sides, and no character
or word is cut at a window's edge.  A
document's probabilities are the mean over all its positions; ``lang_pred`` is the
likeliest language and ``score`` its mean probability.  Training is plain
backpropagation through time with Adam on windows of a bounded sample of labelled
rows (``FIT_ROWS``), equal shares for each language.

A null text, or one without a letter, is ``und`` with score 0, as is every text
where no labelled row could be learned from.  Repeated rows give repeated rows; an
empty table gives an empty table; ties go to the language first by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, batch, bounded, piece, sample, slices, texts

STEPS, HIDDEN = 64, 12
#: Bytes on either side of a window that its layers read first, and bytes of a window with them.
AROUND = 16
WIDTH = STEPS + 2 * AROUND
FIT_ROWS, ROUNDS, FIT_BATCH, RATE = 1500, 300, 160, 0.02
AT_ONCE = 4096
UNKNOWN = "und"
#: A document of the pipeline stays if its language is known with this score or more.
MIN_SCORE = 0.4


def windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (windows, WIDTH), the first and the end of each window's places inside its text, and its text's number."""
    counts = np.array([-(-len(d) // STEPS) for d in data], np.int64)
    edge = bytes(AROUND)
    flat = np.frombuffer(b"".join(edge + d + bytes(-len(d) % STEPS) + edge for d in data if d), np.uint8)
    some = np.flatnonzero(counts)
    owner = np.repeat(some, counts[some])
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])  # of the window in its text
    begin = np.cumsum(STEPS * counts[some] + 2 * AROUND) - STEPS * counts[some] - 2 * AROUND
    at = np.repeat(begin, counts[some]) + STEPS * number
    x = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[at] if len(at) else np.zeros((0, WIDTH), np.uint8)
    sizes = np.array([len(d) for d in data], np.int64)[owner]
    return x, np.where(number == 0, AROUND, 0), np.minimum(WIDTH, sizes - STEPS * number + AROUND), owner


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, languages: list[str], seed: int = 5):
        self.languages = languages
        rng, h = np.random.default_rng(seed), HIDDEN
        shapes = {}
        for d in "fb":
            shapes |= {f"{d}_gates": (256, 2 * h), f"{d}_cand": (256, h), f"{d}_ugates": (h, 2 * h), f"{d}_ucand": (h, h), f"{d}_out": (h, len(languages))}
        self.w = {k: rng.normal(0, 0.3, s).astype("f4") for k, s in shapes.items()} | {"bias": np.zeros(len(languages), "f4")}

    def _forward(self, d: str, x: np.ndarray, valid: np.ndarray):
        """States after each step of one direction, and what its backward pass needs; x: (steps, n)."""
        w, n = self.w, x.shape[1]
        h = np.zeros((n, HIDDEN), "f4")
        states, kept = [], []
        for t in range(len(x)):
            zr = _sigmoid(w[f"{d}_gates"][x[t]] + h @ w[f"{d}_ugates"])
            c = h @ w[f"{d}_ucand"]
            cand = np.tanh(w[f"{d}_cand"][x[t]] + zr[:, HIDDEN:] * c)
            kept.append((h, zr, c, cand))
            h = (cand + zr[:, :HIDDEN] * (h - cand)) * valid[t][:, None]
            states.append(h)
        return states, kept

    def _backward(self, d: str, x, valid, kept, grads_in, g):
        w, H = self.w, HIDDEN
        dh = np.zeros_like(grads_in[0])
        by_gates, by_cand = [], []
        for t in range(len(x) - 1, -1, -1):
            h, zr, c, cand = kept[t]
            z, r = zr[:, :H], zr[:, H:]
            dh = (dh + grads_in[t]) * valid[t][:, None]
            da = dh * (1 - z) * (1 - cand * cand)
            dc = da * r
            dzr = np.concatenate([dh * (h - cand), da * c], 1) * zr * (1 - zr)
            dh = dh * z + dc @ w[f"{d}_ucand"].T + dzr @ w[f"{d}_ugates"].T
            g[f"{d}_ucand"] += h.T @ dc
            g[f"{d}_ugates"] += h.T @ dzr
            by_gates.append(dzr)
            by_cand.append(da)
        flat = x[::-1].ravel()
        order = np.argsort(flat, kind="stable")
        cuts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        for name, rows in ((f"{d}_gates", by_gates), (f"{d}_cand", by_cand)):
            g[name][flat[order][cuts]] += np.add.reduceat(np.concatenate(rows)[order], cuts)

    def step(self, x: np.ndarray, first: np.ndarray, end: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions and its gradients."""
        w, n = self.w, len(x)
        xt = np.ascontiguousarray(x.T)
        t = np.arange(WIDTH)[:, None]
        valid = ((t >= first) & (t < end)).astype("f4")
        fs, fk = self._forward("f", xt, valid)
        bs, bk = self._forward("b", xt[::-1], valid[::-1])
        hf, hb = np.array(fs), np.array(bs[::-1])
        logits = hf @ w["f_out"] + hb @ w["b_out"] + w["bias"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        total = valid.sum()
        loss = -float((np.log(p[:, np.arange(n), label] + 1e-9) * valid).sum() / total)
        p[:, np.arange(n), label] -= 1
        p *= (valid / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        flat = p.reshape(-1, p.shape[-1])
        g["f_out"], g["b_out"], g["bias"] = hf.reshape(-1, HIDDEN).T @ flat, hb.reshape(-1, HIDDEN).T @ flat, flat.sum(0)
        self._backward("f", xt, valid, fk, p @ w["f_out"].T, g)
        self._backward("b", xt[::-1], valid[::-1], bk, (p @ w["b_out"].T)[::-1], g)
        return loss, g

    def fit(self, x: np.ndarray, first: np.ndarray, end: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> list[float]:
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        losses = []
        for i in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(b, max(1, FIT_BATCH // len(by))) for b in by])
            loss, g = self.step(x[pick], first[pick], end[pick], label[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = RATE * min(1.0, 2 * (1 - i / (rounds + 1))) * min(1.0, 1 / max(norm, 1e-9))
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype("f4")
        return losses

    def _tables(self) -> dict[str, np.ndarray]:
        """Weights for prediction: the gates' are halved, so a sigmoid is one tanh."""
        w = {k: v / 2 if k.endswith("gates") else v for k, v in self.w.items()}
        bound = sum(np.abs(w[k]).sum(0).max() for k in ("f_out", "b_out")) + np.abs(w["bias"]).max()
        return w | {"bias": w["bias"] * min(1, 80 / bound), "f_out": w["f_out"] * min(1, 80 / bound), "b_out": w["b_out"] * min(1, 80 / bound)}  # exp() of any logit is finite

    def positions(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums over each window's own positions of the languages' probabilities."""
        w, n, H = self._tables(), len(x), HIDDEN
        xt, least, most = np.ascontiguousarray(x.T), int(end.min()), int(first.max())
        gates, cand, tmp, held = (np.empty((n, k), "f4") for k in (2 * H, H, 2 * H, H))
        states = np.empty((STEPS, n, H), "f4")
        out = np.zeros((n, len(self.languages)), "f4")
        ones = np.ones((len(self.languages), len(self.languages)), "f4")

        def step(d, t, h, into):
            np.take(w[f"{d}_gates"], xt[t], 0, gates, "clip")
            np.add(gates, np.matmul(h, w[f"{d}_ugates"], out=tmp), gates)
            np.tanh(gates, gates)
            np.multiply(gates, 0.5, gates)
            np.add(gates, 0.5, gates)
            np.matmul(h, w[f"{d}_ucand"], out=held)
            np.multiply(held, gates[:, H:], held)
            np.take(w[f"{d}_cand"], xt[t], 0, cand, "clip")
            np.add(cand, held, cand)
            np.tanh(cand, cand)
            np.subtract(h, cand, held)
            np.multiply(held, gates[:, :H], held)
            np.add(cand, held, into)

        h, spare = np.zeros((n, H), "f4"), np.empty((n, H), "f4")
        for t in range(AROUND + STEPS):
            into = states[t - AROUND] if t >= AROUND else spare
            step("f", t, h, into)
            if t < most:
                into *= (first <= t).astype("f4")[:, None]
            h, spare = into, h
        h, spare = np.zeros((n, H), "f4"), np.empty((n, H), "f4")
        for t in range(WIDTH - 1, AROUND - 1, -1):
            step("b", t, h, spare)
            h, spare = spare, h
            inside = (end > t).astype("f4")[:, None] if t >= least else None
            if inside is not None:
                h *= inside
            if t >= AROUND + STEPS:
                continue
            p = states[t - AROUND] @ w["f_out"]
            p += h @ w["b_out"]
            p += w["bias"]
            np.exp(p, p)
            p /= p @ ones
            if inside is not None:
                p *= inside
            out += p
        return out

    def documents(self, data: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for an empty one."""
        out = np.zeros((len(data), len(self.languages)))
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush():
            x, first, end, own = windows(held)
            own = np.array(owner)[own]
            for a in range(0, len(x), AT_ONCE):
                z = a + AT_ONCE
                np.add.at(out, own[a:z], self.positions(x[a:z], first[a:z], end[a:z]))

        for i, d in enumerate(data):
            if d:
                held.append(d)
                owner.append(i)
                size += -(-len(d) // STEPS)
            if size >= AT_ONCE:
                flush()
                held, owner, size = [], [], 0
        if held:
            flush()
        return out / np.maximum([len(d) for d in data], 1)[:, None]


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, keep=None) -> Network:
    """A network fitted on a bounded sample of the labelled rows ``keep`` allows."""
    rows = texts(docs, "lang").where("lang is not null and doc_id is not null")
    rows = rows if keep is None else rows.where(keep)
    got = [(r.lang, r.text.encode()) for r in sample(rows, FIT_ROWS, "lang", piece(F.col("text"), 1200).alias("text"))]
    got = [(lang, d) for lang, d in got if d]
    names = sorted({lang for lang, _ in got})
    net = Network(names)
    if len(names) > 1:
        x, first, end, owner = windows([d for _, d in got])
        net.fit(x, first, end, np.array([names.index(lang) for lang, _ in got])[owner])
    return net


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(net: Network, texts_: list) -> tuple[list[str], list[float]]:
    known = [t if t is not None and LETTER.search(t) else None for t in texts_]
    if not net.languages:
        return [UNKNOWN] * len(known), [0.0] * len(known)
    p = net.documents([b"" if t is None else t.encode() for t in known])
    best = p.argmax(1)
    return (
        [UNKNOWN if t is None else net.languages[k] for t, k in zip(known, best, strict=True)],
        [0.0 if t is None else min(1.0, float(q[k])) for t, q, k in zip(known, p, best, strict=True)],
    )


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from the rows that are not held out."""
    learned = train(docs, ~held_out(F.col("doc_id"))) if net is None else net

    def run(it):
        for b in slices(it):
            langs, scores = _predict(learned, b["text"].to_pylist())
            yield batch(_PREDICTED, doc_id=b["doc_id"], held_out=b["held_out"], lang_pred=langs, score=scores)

    return bounded(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, PREDICTED)


def keep_known(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The documents, unchanged, whose language is known with ``MIN_SCORE`` or more."""
    learned = train(docs, ~held_out(F.col("doc_id"))) if net is None else net

    def run(it):
        for b in slices(it):
            langs, scores = _predict(learned, b["text"].to_pylist())
            yield b.filter(pa.array([s >= MIN_SCORE and x != UNKNOWN for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
