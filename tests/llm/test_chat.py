import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from lectern.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
AWKWARD = st.lists(st.sampled_from(["###", "#", "</turn>", "</turn>\n", "\\", "\\\\", "\\/", "\\#", "\\.", ":", ": ", "a", "é", "\n", " ", "<", "### user: "]), max_size=8).map("".join)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(AWKWARD, AWKWARD), min_size=1, max_size=4), min_size=1, max_size=30))
def test_any_turns_come_back(spark, conversations):
    rows = [(c, t, role, text, "x", 1) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    read = {(r.conv_id, r.position): r for r in chat.read_conversations(formatted).collect()}
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    assert {k: (r.role, r.text) for k, r in read.items()} == {(c, t): (role, text) for c, t, role, text, *_ in rows}
    for r in read.values():
        written = whole[r.conv_id][r.start : r.start + r.length]
        assert "###" not in written and "</turn>" not in written
        assert (r.text == written) or "\\" in written
    assert all(r.round_trip for r in chat.digests(formatted).collect())


def test_order_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", "two", None, None), (1, 1, "user", None, None, None), (None, 1, None, "x", None, None)]
    rows += [(1, 3, "assistant", "two", None, None), (1, 3, "assistant", "two", None, None), (1, None, "system", "first", None, None)]
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found[1].n_turns == 5 and found[1].round_trip
    assert found[1].turns_sha256 == digest("system\nfirst\nuser\n\nassistant\ntwo\nassistant\ntwo\nassistant\ntwo\n")
    assert (found[1].loss_chars, found[1].loss_sha256) == (9, digest("twotwotwo"))
    assert found[None].turns_sha256 == digest("\nx\n") and found[None].loss_chars == 0


def test_clean_text_is_written_as_it_is(spark):
    rows = [(1, 1, "user", "a # b < c \\n", "", 0)]
    row = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.formatted == "### user: a # b < c \\n</turn>\n"


def test_long_text_and_empty_table(spark):
    rows = [(1, 1, "user", "</turn>x" * 200_000, "", 0)]
    assert chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first().round_trip
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_main_path_is_native(spark):
    rows = [(1, 1, "user", "x", "", 0)]
    plan = chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
