"""Trained models: gradients, learning and held-out accuracy; sampled segmentations."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from .helpers import PARTS, documents, prose
from inundate.llm import langid, likelihood, segments

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_recurrent_gradients():
    net = langid.Network(["a", "b", "c"])
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, first, end, label = rng.integers(97, 100, (4, langid.WIDTH)).astype(np.uint8), np.array([16, 0, 16, 0]), np.array([96, 96, 25, 46]), np.array([0, 1, 2, 1])
    _, g = net.step(x, first, end, label)
    for name, grad in g.items():
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, eps = net.w[name][i], 1e-4
        net.w[name][i] = old + eps
        up = net.step(x, first, end, label)[0]
        net.w[name][i] = old - eps
        down = net.step(x, first, end, label)[0]
        net.w[name][i] = old
        assert grad[i] == pytest.approx((up - down) / (2 * eps), rel=0.05), name


def test_prediction_equals_the_training_pass():
    net = langid.Network(["a", "b"])
    data = [b"abc " * 40, b"xyz", b"", "é ü".encode() * 30, bytes(range(32, 127)) * 3, b"k" * 64, b"k" * 65]
    x, first, end, owner = langid.windows(data)
    t = np.arange(langid.WIDTH)[:, None]
    xt, valid = np.ascontiguousarray(x.T), ((t >= first) & (t < end)).astype("f4")
    f, b = net._forward("f", xt, valid)[0], net._forward("b", xt[::-1], valid[::-1])[0][::-1]
    logits = np.array(f) @ net.w["f_out"] + np.array(b) @ net.w["b_out"] + net.w["bias"]
    p = np.exp(logits)
    own = valid * ((t >= langid.AROUND) & (t < langid.AROUND + langid.STEPS))
    p = (p / p.sum(-1, keepdims=True) * own[:, :, None]).sum(0)
    want = np.array([p[owner == i].sum(0) / max(len(d), 1) for i, d in enumerate(data)])
    assert np.allclose(net.documents(data), want, atol=1e-4) and np.allclose(want.sum(1), [bool(d) for d in data], atol=1e-4)


def test_windows_hold_their_surroundings():
    """Every byte is the window's own once, with up to AROUND bytes of the same text before and after it."""
    data = [bytes(np.random.default_rng(i).integers(1, 255, n).astype(np.uint8)) for i, n in enumerate([1, 63, 64, 65, 200, 0, 16, 128])]
    x, first, end, owner = langid.windows(data)
    seen = {i: b"" for i in range(len(data))}
    for row, a, z, o in zip(x, first, end, owner, strict=True):
        at = len(seen[o])
        assert bytes(row[a:z]) == data[o][max(at - langid.AROUND, 0) : at + langid.STEPS + langid.AROUND]
        seen[o] += bytes(row[langid.AROUND : min(z, langid.AROUND + langid.STEPS)])
    assert list(seen.values()) == data


def test_positions_see_over_window_edges():
    """What comes before or after a window changes the probabilities of its positions."""
    net = langid.Network(["a", "b"])
    base = net.documents([b"x" * 64 + b"y" * 64])[0]
    alone = (net.documents([b"x" * 64])[0] + net.documents([b"y" * 64])[0]) / 2
    assert np.abs(base - alone).max() > 1e-4


def test_held_out_languages(spark):
    rng = random.Random(0)
    data = [(i, prose(rng, lang, rng.choice([8, 30, 80])), lang) for i in range(400) for lang in [rng.choice(list(PARTS))]]
    got = langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in data}
    held = [r for r in got if r.held_out]
    assert len(held) > 80 and np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_no_letters_is_unknown(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents(spark, n=30)).collect()}
    assert got[1000] == got[1001] == got[1006] == ("und", 0.0)


def by_hand(net, text, counts):
    """The score word by word, from the parameters and the corpus's counts."""
    ws = [likelihood.stripped(w) for w in likelihood.words(text)]
    place = net.place
    known = lambda w, n: place.get(w, n) < n
    target = lambda w: place[w] if known(w, likelihood.VOCAB) else likelihood.VOCAB + likelihood.shape(w)
    context = lambda w: place[w] if known(w, likelihood.CONTEXT) else likelihood.CONTEXT + likelihood.shape(w)
    totals, total = Counter(), 0.0
    for w, n in counts.items():
        totals[target(w)] += n
    for i, w in enumerate(ws):
        h = net.w["bias"].astype(float)
        for k, d in enumerate(likelihood.OFFSETS):
            h = h + net.w["context"][k][context(ws[i + d]) if 0 <= i + d < len(ws) else likelihood.CONTEXT + likelihood.OTHERS]
        logits = np.tanh(h) @ net.w["out"].astype(float) + net.w["out_bias"]
        total += logits[target(w)] - np.logaddexp.reduce(logits) + (0 if known(w, likelihood.VOCAB) else math.log(counts[w] / totals[target(w)]))
    return total


def test_pseudo_likelihood_learns():
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["a b c d", "a x y d"]) for _ in range(20)) for _ in range(60)]
    net = likelihood.Network([(w, 100) for w in (b"a", b"b", b"c", b"d", b"x", b"y")], np.ones(likelihood.CLASSES))
    losses = net.fit([net.codes(t) for t in texts], rounds=150)
    assert losses[-1] < 0.3 * losses[0]
    assert net.score([net.codes("a b c d")])[0] > net.score([net.codes("a b y d")])[0] + 1


def test_window_gradients():
    net = likelihood.Network([(w, 100) for w in (b"a", b"b", b"c")], np.ones(likelihood.CLASSES))
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    flat, at = net.laid_out([net.codes("a b c a zz b"), net.codes("c c a")])
    near, target = net.context_of[flat], net.target_of[flat]
    _, g = net.gradients(near, target, at)
    for name, grad in g.items():
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, eps = net.w[name][i], 1e-5
        net.w[name][i] = old + eps
        up = net.gradients(near, target, at)[0]
        net.w[name][i] = old - eps
        down = net.gradients(near, target, at)[0]
        net.w[name][i] = old
        assert grad[i] == pytest.approx((up - down) / (2 * eps), rel=1e-3), name


@pytest.mark.parametrize("sent", [65_536, 300])
def test_scores_equal_brute_force(spark, monkeypatch, sent):
    """Whether a word's count is sent or joined, its score is the class's probability times its share by the whole corpus."""
    monkeypatch.setattr(likelihood, "SENT", sent)
    monkeypatch.setattr(likelihood, "ROUNDS", 30)
    docs = documents(spark, n=40)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = Counter(likelihood.stripped(w) for t in texts.values() for w in likelihood.words(t))
    model = likelihood.train(docs)
    assert len(model.net.place) <= sent and (sent > 300) == (model.rare.count() == 0)
    assert model.net.place == {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))) if i < len(model.net.place)}
    for r in likelihood.score(docs, model).collect():
        n = len(likelihood.words(texts[r.doc_id]))
        assert r.n_words == n and r.log_prob == pytest.approx(by_hand(model.net, texts[r.doc_id], counts), rel=1e-4, abs=1e-3)
        assert (r.mean_log_prob is None) if n == 0 else r.mean_log_prob == pytest.approx(r.log_prob / n)


def test_gradients_of_all_documents(spark, monkeypatch):
    """Every document takes part, whatever the tasks, and steps along them lower the loss."""
    monkeypatch.setattr(likelihood, "TASKS", 2)
    docs = documents(spark, n=60)
    net = likelihood.train(docs).net
    net = likelihood.Network([(w, 1) for w in net.place], np.ones(likelihood.CLASSES))
    net.fit([net.codes("the of the")], rounds=3)
    loss, g = likelihood.corpus_gradients(docs, net)
    other, h = likelihood.corpus_gradients(docs.repartition(7), net)
    assert loss == pytest.approx(other, rel=1e-6) and all(np.allclose(g[k], h[k], atol=1e-6) for k in g)
    for _ in range(3):
        net.step(likelihood.corpus_gradients(docs, net)[1])
    assert likelihood.corpus_gradients(docs, net)[0] < loss


def test_gradients_count_every_word(spark):
    """Loss and gradients of long texts are those of all their words at once."""
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abcdefg") for _ in range(300 * (i + 1)))) for i in range(4)]
    net = likelihood.Network([(w, 100) for w in (b"a", b"b", b"c", b"d", b"e", b"f", b"g")], np.ones(likelihood.CLASSES))
    loss, g = likelihood.corpus_gradients(spark.createDataFrame(data, "doc_id long, text string"), net)
    flat, at = net.laid_out([net.codes(t) for _, t in data])
    whole, h = net.gradients(net.context_of[flat], net.target_of[flat], at)
    assert len(at) == 3000 and loss == pytest.approx(whole / len(at), rel=1e-5)
    assert all(np.allclose(g[k], h[k] / len(at), atol=1e-5) for k in g)


def test_gradients_do_not_hang_on_the_parts_of_a_text(spark, monkeypatch):
    """A long text is taken in parts that see their surroundings; a part has the gradients of its places alone."""
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice("abcdefg") for _ in range(n))) for i, n in enumerate([700, 0, 1, 2, 150])]
    docs, net = spark.createDataFrame(data, "doc_id long, text string"), likelihood.Network([(w, 100) for w in (b"a", b"b", b"c", b"d")], np.ones(likelihood.CLASSES))
    flat, at = net.laid_out([net.codes(t) for _, t in data])
    near, target = net.context_of[flat], net.target_of[flat]
    parts = [net.gradients(near, target, p) for p in np.array_split(at, 9)]
    whole, h = net.gradients(near, target, at)
    monkeypatch.setattr(likelihood, "PLACES", 50)
    loss, g = likelihood.corpus_gradients(docs, net)
    assert len(at) == 853 and loss * len(at) == pytest.approx(whole, rel=1e-5) and sum(x for x, _ in parts) == pytest.approx(whole, rel=1e-5)
    for k in g:
        assert np.allclose(g[k] * len(at), h[k], atol=1e-3) and np.allclose(sum(p[k] for _, p in parts), h[k], atol=1e-3)


def test_gradients_do_not_sort(monkeypatch):
    """Classes and neighbours are counted, not sorted; parameters at the bound of exp() give the loss and gradients of a plain softmax."""
    net = likelihood.Network([(w, 100) for w in (b"a", b"b", b"c")], np.ones(likelihood.CLASSES))
    rng = np.random.default_rng(3)
    net.w["out"] = rng.normal(0, 2, net.w["out"].shape).astype("f4")
    net.w["out_bias"] = rng.uniform(-60, 60, likelihood.CLASSES).astype("f4")
    net.hold()
    flat, at = net.laid_out([net.codes("a b c a zz b " * 200), net.codes("c c a")])
    at = np.r_[at, at[:50]]  # a place may come twice
    near, target = net.context_of[flat], net.target_of[flat]
    want = -net.log_probs(flat, at).sum()
    monkeypatch.setattr(np, "argsort", None)
    loss, g = net.gradients(near, target, at)
    w = {k: v.astype(float) for k, v in net.w.items()}
    h = np.tanh(sum(w["context"][k][near[at + d]] for k, d in enumerate(likelihood.OFFSETS)) + w["bias"])
    logits = h @ w["out"] + w["out_bias"]
    log_sums = np.logaddexp.reduce(logits, 1)
    error = np.exp(logits - log_sums[:, None])
    error[np.arange(len(at)), target[at]] -= 1
    assert loss == pytest.approx((log_sums - logits[np.arange(len(at)), target[at]]).sum(), rel=1e-4) == pytest.approx(want, rel=1e-4)
    assert np.allclose(g["out"], h.T @ error, rtol=1e-3, atol=0.05) and np.allclose(g["out_bias"], error.sum(0), rtol=1e-3, atol=0.05)
    assert np.allclose(g["bias"], ((error @ w["out"].T) * (1 - h * h)).sum(0), rtol=1e-3, atol=0.05)


def test_the_parameters_of_least_loss_stay(spark, monkeypatch):
    """A step that makes the whole corpus less likely is taken back, though scoring alone finds its loss."""
    monkeypatch.setattr(likelihood, "ROUNDS", 30)
    docs = documents(spark, n=40)
    monkeypatch.setattr(likelihood, "STEPS", 0)
    start = likelihood.train(docs)
    monkeypatch.setattr(likelihood, "STEPS", 1)
    monkeypatch.setattr(likelihood.Network, "step", lambda self, g: self.w.update({k: -v for k, v in self.w.items()}))
    got, want = ({r.doc_id: r.log_prob for r in likelihood.score(docs, m).collect()} for m in (None, start))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in got)


def test_words_of_the_corpus_tell_texts_apart(spark):
    """Of two strange texts alike in form, the one whose words occur elsewhere too is the likelier."""
    rng = random.Random(4)
    strange = ["".join(rng.choice("bcdfgk") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    once, twice = " ".join(strange[:30]), " ".join(strange[30:])
    data = [(i, prose(rng, "en", 60)) for i in range(40)] + [(100, once), (101, twice), (102, twice)]
    got = {r.doc_id: r.log_prob for r in likelihood.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[101] == pytest.approx(got[102]) and got[101] > got[100] + 10


@pytest.fixture(scope="module")
def model():
    return segments.Pieces(PIECES)


def every_segmentation(m, text):
    t = segments.MARK + text.replace(" ", segments.MARK)
    out = {}

    def go(i, ids, w):
        if i == len(t):
            out[tuple(ids)] = np.logaddexp(out.get(tuple(ids), -np.inf), w)
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in m.ids:
                go(j, [*ids, m.ids[t[i:j]]], w + m.log_weight[m.ids[t[i:j]]])
        if i < len(t) and t[i] not in m.ids:
            b = [m.byte_id[x] for x in t[i].encode()]
            go(i + 1, ids + b, w + m.fallback * len(b))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: float(v - z) for k, v in out.items()}


@pytest.mark.parametrize("text", ["the", "a b", "日 x", "in\nto", "hat ☃"])
def test_samples_follow_the_law(model, text):
    want, n, k = every_segmentation(model, text), 3000, 4
    first, second = Counter(), Counter()
    for samples in segments.sample_batch(model, list(range(n)), [text] * n, k):
        ids = [tuple(np.frombuffer(s[0], "<u2").tolist()) for s in samples]
        assert len(set(ids)) == len(ids) == min(k, len(want))
        assert all(s[1] == pytest.approx(want[i], abs=1e-6) for s, i in zip(samples, ids, strict=True))
        assert [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        assert all(0 <= s[3] <= 1 for s in samples) and all(segments.decode(model, s[0]) == text for s in samples)
        first[ids[0]] += 1
        if len(ids) > 1:
            second[ids[1]] += 1
    p = {i: math.exp(v) for i, v in want.items()}
    assert max(abs(first[i] / n - q) for i, q in p.items()) < 0.035
    if len(p) > 1:
        law = {j: sum(p[i] * p[j] / max(1 - p[i], 1e-12) for i in p if i != j) for j in p}
        assert max(abs(second[j] / n - q) for j, q in law.items()) < 0.035


def test_samples_do_not_depend_on_the_batch(model):
    texts = ["the cat sat", "", "x" * 300, "señor\nünder", "the cat sat"]
    whole = segments.sample_batch(model, [1, 2, 3, 4, 1], texts)
    for i, (key, t) in enumerate(zip([1, 2, 3, 4, 1], texts, strict=True)):
        alone = segments.sample_batch(model, [key], [t])[0]
        assert [s[0] for s in alone] == [s[0] for s in whole[i]]
        assert all(segments.decode(model, s[0]) == t for s in alone)
    assert [s[0] for s in whole[0]] == [s[0] for s in whole[4]]


def test_inclusion_scores(model):
    """Given the threshold, a sample's weight over its inclusion estimates a total without bias."""
    text, n = "the", 4000
    want = every_segmentation(model, text)
    total = np.mean([sum(math.exp(s[1]) / s[3] for s in r) for r in segments.sample_batch(model, list(range(n)), [text] * n, 3)])
    assert len(want) > 3 and total == pytest.approx(1.0, abs=0.03)




def test_cut_equals_the_pattern():
    texts = ["a b\nc d", "", " a", "a ", "a  b", "\na", "a\n\nb", "", "a \nb", "a\n b", "x\u2581y z", "one", "\n", " ", "é ü\nß", "a\n", "the end"]
    mark = segments.MARK
    want = [segments.UNIT.findall(mark + t.replace(" ", mark)) if t else [] for t in texts]
    assert segments.cut(pa.array(texts)).to_pylist() == want
    assert segments.cut(pa.array(["a b", "c"])).to_pylist() == [[mark + "a", mark + "b"], [mark + "c"]]


def test_words_beyond_those_kept(model, monkeypatch):
    texts = ["the cat sat on the mat", "señor under the hat", "the cat again"]
    whole = segments.sample_batch(model, [1, 2, 3], texts)
    monkeypatch.setattr(segments, "KEPT", 8)
    small = segments.Pieces(PIECES)
    for i, t in enumerate(texts):
        assert [s[0] for s in segments.sample_batch(small, [i + 1], [t])[0]] == [s[0] for s in whole[i]]
