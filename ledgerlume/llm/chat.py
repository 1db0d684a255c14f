"""Chat formatting from an event log, in DataFrame functions only.

Events of one conversation are partitioned by `conv_id`, sorted by `seq` and folded per message:

    message     starts (or replaces) the message `turn` with `role` and `text`
    delta       appends `text` to it (streamed output)
    edit        replaces its text
    regenerate  empties it and everything after it; later deltas rebuild it
    delete      drops it

The final messages are rendered with turn markers. `#`, `<` and the escape sign itself are written
as escape pairs inside texts and roles, and `:` inside roles, so no text can hold a marker, no role ends
before its end, and rendering is reversible. A loss mask covers the texts of assistant turns as
code-point spans. A conversation is folded in one task, as its order is the result; others run beside it.

Defined results: a null text is empty, a null role is the role `unknown`, events with a null `turn`
are dropped, events with equal `seq` are folded by kind, then text, and exact repeats of an event
count once; two `message` events of one turn count as a replacement. A table of turns becomes a log in
which every row is a message of its own: rows that repeat a turn stay, by role and then text, and rows
without a turn come last. A null `conv_id` is a conversation. An empty log renders nothing. Columns
beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
HEAD, SPLIT, TAIL = "### ", ":\n", "</turn>\n"
#: Escape pairs; the escape sign comes first when writing and last when reading.
PAIRS = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_PAIRS = (*PAIRS, (":", "\\c"))
LOSS_ROLE = "assistant"


def escape(text: Column, pairs=PAIRS) -> Column:
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, pairs=PAIRS) -> Column:
    for raw, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text.

    Window functions find each message's last start and the conversation's last regeneration at or
    before the turn, so a conversation is sorted, not folded in one growing value.
    """
    rows = events.select(
        "conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).filter("turn IS NOT NULL")
    log = Window.partitionBy("conv_id").orderBy(F.col("seq"), "kind", "text").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("conv_id").orderBy(F.col("seq"), "kind", "text")
    event = F.struct("seq", "turn", "kind", "text")
    rows = rows.withColumn("at", F.count(F.lit(1)).over(log)).withColumn("repeat", F.lag(event).over(order).eqNullSafe(event))
    rows = rows.filter(~F.col("repeat"))
    # the last regeneration of this turn or an earlier one cuts what stood before it
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).over(
        Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("cut", F.coalesce(again, F.lit(0)))
    message = Window.partitionBy("conv_id", "turn")
    rows = rows.withColumn("said", F.last("role", ignorenulls=True).over(message.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sets = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate", "delete"), F.col("at"))).over(message)
    rows = rows.withColumn("sets", sets)
    live = rows.filter((F.col("at") >= F.col("cut")) & (F.col("at") >= F.coalesce("sets", F.lit(0))))
    parts = live.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("parts"), F.first("said").alias("role")
    )
    kept = parts.filter(F.element_at("parts", 1)["kind"] != "delete").filter(
        F.exists("parts", lambda p: p["kind"].isin("message", "edit", "delta"))
    )
    return kept.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.array_join(F.transform("parts", lambda p: F.when(p["kind"] == "regenerate", "").otherwise(p["text"])), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, segments: one conversation a row.

    `segments` lists every turn in order with the code-point span of its escaped text in
    `formatted` and whether the loss covers it.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_PAIRS), F.lit(SPLIT))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    size = F.char_length("head") + F.char_length("body") + F.lit(len(TAIL))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("stop", F.sum(size.cast("long")).over(before) - F.lit(len(TAIL)))
    piece = F.struct(
        "turn",
        F.concat("head", "body", F.lit(TAIL)).alias("piece"),
        F.struct(
            (F.col("stop") - F.char_length("body")).alias("start"),
            F.col("stop").alias("stop"),
            (F.col("role") == LOSS_ROLE).alias("loss"),
        ).alias("segment"),
    )
    pieces = F.array_sort(F.collect_list(piece))
    return turns.groupBy("conv_id").agg(pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.col("pieces.segment").alias("segments"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """Read conversations back: conv_id, formatted, turns (role, text), loss_texts.

    Texts under the mask are cut out by their spans, each within its own turn's piece, so the cost
    stays in proportion to the conversation.
    """
    pieces = F.split(F.col("formatted"), F.lit("</turn>\\n"), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    numbered = F.arrays_zip(pieces.alias("piece"), F.col("segments").alias("segment"))
    role = lambda p: unescape(F.substring(F.substring_index(p, SPLIT, 1), len(HEAD) + 1, 1 << 30), ROLE_PAIRS)
    text = lambda p: unescape(F.substr(p, F.char_length(F.substring_index(p, SPLIT, 1)) + F.lit(len(SPLIT) + 1)))
    marked = F.filter("numbered", lambda x: x["segment"]["loss"])
    under = lambda x: unescape(
        F.substr(
            x["piece"],
            (F.char_length(x["piece"]) - (x["segment"]["stop"] - x["segment"]["start"]) + 1).cast("int"),
            (x["segment"]["stop"] - x["segment"]["start"]).cast("int"),
        )
    )
    return rendered.withColumn("numbered", numbered).select(
        "conv_id",
        "formatted",
        F.transform("numbered", lambda x: F.struct(role(x["piece"]).alias("role"), text(x["piece"]).alias("text"))).alias("turns"),
        F.transform(marked, under).alias("loss_texts"),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as an event log: every row streams in as an opening and one delta of a message of its own.

    Messages are numbered within the conversation in the order of turn, role and text.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    row = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select("conv_id", F.row_number().over(place).cast("long").alias("turn"), "role", "text")
    return row.select(
        "conv_id",
        "turn",
        "role",
        F.explode(
            F.array(
                F.struct((F.col("turn") * 2).alias("seq"), F.lit("message").alias("kind"), F.lit("").alias("text")),
                F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"), F.col("text").alias("text")),
            )
        ).alias("event"),
    ).select("conv_id", F.col("event.seq").alias("seq"), "turn", F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"))


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    back = parse(render(fold_events(as_events(turns.unionByName(probe)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))
           + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
