"""Chat formatting in DataFrame operations only, and its exact reading back.

A conversation becomes one string of blocks, one for each run of turns of one role:

    [INST] text [/INST]                  role user
    <s> text </s>                        role assistant
    [ROLE] name [INST] text [/INST]      any other role

Merged turns stand in one block with `` [NEXT] `` between their texts. Control
strings inside texts and names get a backslash in front, and backslashes right
before them are doubled, so reading back gives the texts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

CONTROLS = r"(</?s>|\[/?INST\]|\[ROLE\]|\[NEXT\])"
NEXT, NEXT_PATTERN = " [NEXT] ", r" \[NEXT\] "
#: A control string of the template: none of its kind inside a text lacks the backslash.
BLOCK = (
    r"(?s)((?<!\\)\[ROLE\] .*? (?<!\\)\[INST\] .*? (?<!\\)\[/INST\]"
    r"|(?<!\\)\[INST\] .*? (?<!\\)\[/INST\]|(?<!\\)<s> .*? (?<!\\)</s>)"
)
USER, ASSISTANT = "user", "assistant"


def escaped(text) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROLS, r"$1$1\\$2")


def unescaped(text) -> Column:
    return F.regexp_replace(text, r"(\\*)\1\\" + CONTROLS, "$1$2")


def _blocks(turns: Column) -> Column:
    """Runs of turns of one role, each with its role and the escaped texts joined."""
    before = lambda i: F.get(turns, i - 1)["role"]
    starts = F.filter(
        F.transform(turns, lambda t, i: F.when((i == 0) | (before(i) != t["role"]), i)), lambda i: i.isNotNull()
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        F.get(turns, a)["role"].alias("role"),
        F.array_join(F.transform(F.slice(turns, a + 1, b - a), lambda t: escaped(t["text"])), NEXT).alias("body"),
    ))


def _before(role) -> Column:
    return (
        F.when(role == USER, "[INST] ").when(role == ASSISTANT, "<s> ")
        .otherwise(F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [INST] ")))
    )


def _after(role) -> Column:
    return F.when(role == ASSISTANT, " </s>").otherwise(" [/INST]")


def format_chats(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per key: formatted (string) and loss (array of start, length: code points of assistant texts).

    Turns are sorted by turn, then role, then text, nulls first; repeated rows
    are turns of their own. Null text and null role are empty strings; a null key
    is a conversation like any other. An empty table gives no rows. A conversation
    becomes one string, so its turns meet in one row; other columns stay behind.
    """
    turns = rows.select(
        F.col(key).alias("key"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("row"),
    )
    sorted_turns = turns.groupBy("key").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    blocks = sorted_turns.select("key", _blocks(F.col("turns")).alias("blocks"))
    parts = blocks.select("key", F.transform("blocks", lambda b: F.struct(
        b["role"].alias("role"), b["body"].alias("body"), _before(b["role"]).alias("before"), _after(b["role"]).alias("after")
    )).alias("blocks"))
    # where each block's body starts, and where the assistant's texts lie in it
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def walk(state, b):
        texts = F.split(b["body"], NEXT_PATTERN, -1)
        first = state["at"] + F.length(b["before"])
        spans = F.transform(texts, lambda t, i: F.struct(
            (first + F.length(F.array_join(F.slice(texts, 1, i), NEXT)) + F.when(i > 0, len(NEXT)).otherwise(0)).cast("int").alias("start"),
            F.length(t).alias("length"),
        ))
        own = F.when(b["role"] == ASSISTANT, spans).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct(
            (first + F.length(b["body"]) + F.length(b["after"])).cast("int").alias("at"), F.concat(state["loss"], own).alias("loss")
        )

    return parts.select(
        F.col("key").alias(key),
        F.array_join(F.transform("blocks", lambda b: F.concat(b["before"], b["body"], b["after"])), "").alias("formatted"),
        F.aggregate("blocks", start, walk)["loss"].alias("loss"),
    )


def read_chats(formatted) -> Column:
    """The turns (role, text) that a formatted string holds, in order."""
    inner = r" (?<!\\)(?:\[/INST\]|</s>)$"
    blocks = F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(1))

    def turns(block):
        role = (
            F.when(block.startswith("<s> "), ASSISTANT).when(block.startswith("[INST] "), USER)
            .otherwise(unescaped(F.regexp_extract(block, r"(?s)^\[ROLE\] (.*?) (?<!\\)\[INST\] ", 1)))
        )
        body = F.regexp_replace(F.regexp_replace(block, r"(?s)^(?:<s> |\[INST\] |\[ROLE\] .*? (?<!\\)\[INST\] )", ""), inner, "")
        return F.transform(F.split(body, NEXT_PATTERN, -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted, loss) -> Column:
    """The assistant's texts under the mask, as they were."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"])))


CONTROL_TEXT = "</s>[INST] ok [/INST]"

OP6_SQL = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked as (
  select *, coalesce(lag(role) over w = role, false) as goes_on,
    length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|\[ROLE\]|\[NEXT\])', '\1\1\\\2', 'g')) as chars,
    length(regexp_replace(role, '(\\*)(</?s>|\[/?INST\]|\[ROLE\]|\[NEXT\])', '\1\1\\\2', 'g')) as role_chars
  from given window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars + case when goes_on then 8 when role = 'user' then 15 when role = 'assistant' then 9 else 23 + role_chars end)::bigint
    as formatted_chars
from marked group by conv_id
"""


@query("op6_chat", OP6_SQL)
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, USER).otherwise(ASSISTANT).alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    out = format_chats(rows.unionByName(made)).select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        read_chats(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("learnt"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
