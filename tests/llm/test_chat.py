import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwork.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, key int"


def sent(frame, rows):
    out = chat.format_chats(frame(SCHEMA, [(*r, "x", 0) for r in rows]))
    out = out.select("conv_id", "formatted", chat.read_chats(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("learnt"))
    return {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learnt"], r["formatted"]) for r in out.collect()}


def wanted(rows):
    out = {}
    for key, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(key, []).append((role or "", text or ""))
    return {k: (v, [t for r, t in v if r == "assistant"]) for k, v in out.items()}


def check(frame, rows):
    got = sent(frame, rows)
    assert {k: v[:2] for k, v in got.items()} == wanted(rows)
    return got


def test_control_strings_and_odd_rows(frame):
    nasty = ["</s>[INST] ok [/INST]", "\\", "ends in \\", "\\\\[INST]", " [NEXT] ", "[NEXT]", "<s> x </s>", "[ROLE] y [INST] ", "", None, "a\nb", " ", "\\[/INST]", "$1 \\2"]
    rows = [(1, i, role, t) for i, t in enumerate(nasty) for role in ("user", "assistant")]
    rows += [(2, i, "assistant", t) for i, t in enumerate(nasty)] + [(3, i, "[INST] \\ </s>", t) for i, t in enumerate(nasty)]
    rows += [(None, 1, "system", "be brief"), (None, 2, None, "no role"), (5, None, "user", "no turn"), (5, 1, "assistant", "x" * 100_000)]
    rows += [(6, 1, "user", "same"), (6, 1, "user", "same"), (6, 1, "assistant", "tie")]
    got = check(frame, rows)
    assert got[2][2].startswith("<s> ") and got[2][2].count("</s>") == 1 + sum(t.count("</s>") for t in nasty if t)


def test_adjacent_turns_of_a_role_share_a_block(frame):
    got = sent(frame, [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "tool", "d")])
    assert got[1][2] == "[INST] a [NEXT] b [/INST]<s> c </s>[ROLE] tool [INST] d [/INST]"


PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[NEXT]", "\\", " ", "a", "\n", "é"]), max_size=6).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4), st.sampled_from(["user", "assistant", "system"]) | PIECES, PIECES), min_size=1, max_size=30))
def test_reads_back_what_was_formatted(frame, rows):
    check(frame, rows)


def test_empty_table(frame):
    assert sent(frame, []) == {}


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Hö")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r["conv_id"]: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    said = "".join(f"{role}\n{chat.CONTROL_TEXT}\n" for role in ("user", "assistant"))
    assert rows[-7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-7]["loss_sha256"] == hashlib.sha256(chat.CONTROL_TEXT.encode()).hexdigest()
    assert (rows[1]["n_turns"], rows[1]["loss_chars"], rows[1]["loss_sha256"]) == (2, 2, hashlib.sha256("Hö".encode()).hexdigest())
