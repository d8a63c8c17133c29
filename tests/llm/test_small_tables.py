"""Every operator on odd rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from .helpers import SCHEMA, documents, rows, with_clashes
from inundate.llm import chat, fingerprints, langid, likelihood, packing, quality, secrets, segments, simhash, suffixes

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "quality": quality.judge,
    "langid": langid.identify,
    "langid_stage": langid.keep_known,
    "simhash": simhash.near_duplicates,
    "simhash_stage": simhash.keep_one,
    "secrets": lambda d: secrets.digest(secrets.find_secrets(d)),
    "secrets_stage": secrets.redact,
    "packing": lambda d: packing.pack(d, WORDS),
    "suffixes": suffixes.digest,
    "suffixes_stage": suffixes.cut_repeats,
    "segments": lambda d: segments.digest(segments.encode(d, PIECES), PIECES),
    "fingerprints": lambda d: fingerprints.digest(fingerprints.compare_with_edits(d)),
    "likelihood": likelihood.score,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = documents(spark, n=40)
    odd = with_clashes(docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "no id here", None, None, None)], SCHEMA)))
    got = OPERATORS[name](odd).collect()
    whole = {r[0] for r in rows(n=40)}
    if name.endswith("_stage"):
        assert set(got[0].asDict()) == set(odd.columns)
        assert {r.doc_id for r in got} <= whole | {None}
    else:
        assert {r.doc_id for r in got} == whole | {None}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_chat_empty_and_null(spark):
    schema = "conv_id long, turn long, role string, text string, segment string"
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).collect() == []
    got = chat.read_back(chat.format_conversations(spark.createDataFrame([(None, None, None, None, "x"), (1, 0, "assistant", None, "x")], schema))).collect()
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in got} == {(None, 1, 0), (1, 1, 0)}
