"""The pipeline on small tables: every stage against what it should do to the one before."""

import random
import re

import corpus_pipeline
import pytest
from inundate.llm import langid, simhash
from pyspark.sql import functions as F

from .helpers import SCHEMA, documents, prose, with_clashes
from .test_exact import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = documents(spark, n=90).withColumn("text", F.when(F.col("doc_id") % 14 == 0, F.concat("text", F.lit(" password=hunter2hunter2"))).otherwise(F.col("text")))
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{folder}/documents.parquet"), *out]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns and t.dtypes == tables[0].dtypes for t in tables[1:-1])


def test_language_stage(tables):
    before, after = rows(tables[0]), rows(tables[1])
    predicted = {r.doc_id: r for r in langid.identify(tables[0]).collect()}
    assert set(after) == {i for i, r in predicted.items() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    assert all(after[i] == before[i] for i in after)


def test_near_dedup_stage(tables):
    before, after = rows(tables[1]), rows(tables[2])
    assert all(after[i] == before[i] for i in after)
    sets = {i: shingles(r.text) for i, r in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in set(before) - set(after):  # what goes has a copy that stays
        assert max(alike(i, j) for j in after) >= 0.8
    for i in after:  # what stays has none
        assert all(alike(i, j) < 0.8 for j in after if i < j)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    base = [prose(rng, "en", 120).split() for _ in range(25)]
    data = []
    for g, words in enumerate(base):
        for k in range(1 + g % 4):
            copy = list(words)
            for _ in range(2 * bool(k)):
                copy[rng.randrange(len(copy))] = "changed"
            data.append((g * 10 + k, " ".join(copy)))
    data.append((999, data[3][1]))
    docs = spark.createDataFrame(data + data[:2], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [g * 10 for g in range(25)]


def test_near_copies_are_found_and_others_stay(spark):
    """Against all pairs: hardly any copies of 0.8 stay together, and whatever goes has a copy of 0.8 that stays."""
    rng, data = random.Random(12), []
    for g in range(150):
        words = prose(rng, rng.choice(["en", "de", "es"]), rng.choice([40, 90, 200])).split()
        for k in range(rng.choice([1, 2, 4])):
            data.append((len(data), " ".join(words) if not k else edited(rng, words, rng.randint(1, max(2, len(words) // 30)))))
    passage = prose(rng, "en", 60)  # of many texts, which are no copies for that
    data += [(len(data) + i, prose(rng, "en", rng.choice([30, 60])) + " " + passage) for i in range(40)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    sets = {i: shingles(t) for i, t in data}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j]]
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    near = [p for p, x in alike.items() if x >= 0.8]
    assert len(near) > 60 and sum(i in kept and j in kept for i, j in near) <= 0.02 * len(near)
    best = {i: 0.0 for i in sets}
    for (i, j), x in alike.items():
        if j in kept:
            best[i] = max(best[i], x)
        if i in kept:
            best[j] = max(best[j], x)
    assert all(best[i] >= 0.8 for i in sets if i not in kept)


def edited(rng, words, n=2):
    copy = list(words)
    for _ in range(n):
        copy[rng.randrange(len(copy))] = "changed"
    return " ".join(copy)


def test_every_group_of_a_bag_of_words_goes_but_one(spark):
    """Texts of the same words in other orders have one word fingerprint; each has copies of its own."""
    rng = random.Random(11)
    bag, data = prose(rng, "de", 200).split(), []
    for g in range(20):
        rng.shuffle(bag)
        data += [(g * 10, " ".join(bag))] + [(g * 10 + k, edited(rng, bag)) for k in (1, 2, 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [g * 10 for g in range(20)]


def test_large_components_are_judged_whole(spark, monkeypatch):
    rng = random.Random(5)
    base = [prose(rng, "en", 100).split() for _ in range(6)]
    docs = spark.createDataFrame([(g + 6 * k, edited(rng, base[g], 3 * bool(k))) for g in range(6) for k in range(12)], "doc_id long, text string")
    want = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    monkeypatch.setattr(simhash, "TOGETHER", 3)
    monkeypatch.setattr(simhash, "TREE", 4)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want and want[:6] == list(range(6))


def test_repeat_stage(tables):
    before, after = rows(tables[2]), rows(tables[3])
    want = cut([(i, r.text) for i, r in before.items()])
    assert set(after) == set(before)
    whole = [i for i, w in want.items() if not w[1]]
    assert all(after[i] == before[i] for i in whole)
    assert all(len(after[i].text.encode()) <= want[i][0] - want[i][1] for i in before)


def test_secret_stage(tables):
    before, after = rows(tables[3]), rows(tables[4])
    assert set(after) == set(before)
    assert any("[SECRET]" in r.text for r in after.values())
    assert not any(re.search("password=hunter", r.text) for r in after.values())
    assert all(after[i].text == before[i].text for i in before if "[SECRET]" not in after[i].text)


def test_packing_stage_packs_everything(tables):
    pieces = tables[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in pieces} == set(rows(tables[4])) and all(r.n == r.t for r in pieces)


def test_run_equals_the_stages(spark, folder, tables):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == tables[-1].count() and set(got.columns) == set(tables[-1].columns)


def test_stages_take_empty_tables_and_more_columns(spark, folder):
    docs = with_clashes(spark.createDataFrame([], SCHEMA))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
