import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from inundate.llm import chat

HARD = st.text(alphabet=st.sampled_from(list("\\#< /turn>\nab: ")), max_size=40) | st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "\n</turn>\n", "x"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab\\\n: #", max_size=8), HARD)
def test_round_trip(role, text):
    segment, start, end = chat.round_trip(role, text)
    assert chat.parse(segment) == [(role, text, start, end)]
    assert chat.unescape(segment[start:end]) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), HARD), max_size=5))
def test_concatenated_turns_parse_back(turns):
    text = "".join(chat.round_trip(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


def test_plain_text_is_not_escaped():
    assert chat.round_trip("user", "a # b \\ c")[0] == "### user\na # b \\ c\n</turn>\n"


def test_unescaped_control_breaks_the_grammar():
    assert chat.parse("### user\nno ### here\n</turn>\n") is None


def test_digests(spark):
    rows = [(5, 1, "assistant", "b </turn>"), (5, 0, "user", "a"), (6, 0, "assistant", "x"), (6, 0, "assistant", "x"), (5, 2, "assistant", "é")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[5].turns_sha256 == sha("user\na\nassistant\nb </turn>\nassistant\né\n")
    assert (got[5].loss_chars, got[5].loss_sha256) == (10, sha("b </turn>é"))
    assert got[6].n_turns == 2
