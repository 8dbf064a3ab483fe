"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation, sorted by sequence and folded into messages; the messages
are rendered through a template that marks turns and keeps control strings out of the texts reversibly.
DataFrame functions only. Two exchanges: by message, where events are folded, and by conversation: a conversation's
text is one output value, so its messages meet in one task by nature; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import table

#: Marks of the template: before a role, between role and text, after a text.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Start of a control string, backslashes already put there, rest of a control string: these templates' own marks
#: and those of other common templates (<|..., </s>, <s>, <<SYS>>, [INST], [/INST]).
CONTROL = r"(?=\||/?s>|<SYS>>|/?INST\])"


def escaped(text: Column) -> Column:
    """Put one backslash behind the first character of every control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2")


def fold(events: DataFrame) -> DataFrame:
    """Messages of an event log.

    events: conv_id, seq, msg_id, kind, role, text. kind is `message` (a whole message), `delta` (more text of a
    message that streams), `edit` (new text in a message's place) or `regenerate` (drop the text so far; deltas
    follow). Events with one (conv_id, msg_id) make one message, whose place is its first event's; events of a
    conversation without msg_id are one message too. Null text is empty, a null kind is `message`. The role is the
    last one given, null if none is. Equal seq: ordered by kind, role, text, so repeated events count each. A message
    whose last reset has an empty text and no deltas stays, empty. Null conv_id is a conversation of its own. Texts of
    any length; no events, no rows.
    """
    e = events.select("conv_id", "seq", "msg_id", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    grouped = e.groupBy("conv_id", "msg_id").agg(log.alias("log"))
    last_reset = F.expr("array_max(transform(log, (x, i) -> IF(x.kind = 'delta', -1, i)))")
    grouped = grouped.withColumn("reset", F.greatest(last_reset, F.lit(0)))
    text = F.expr("array_join(transform(slice(log, reset + 1, size(log)), (x, i) -> IF(x.kind = 'regenerate', '', x.text)), '')")
    role = F.expr("element_at(concat(array(CAST(NULL AS STRING)), filter(transform(log, x -> x.role), r -> r IS NOT NULL)), -1)")
    return grouped.select("conv_id", F.expr("log[0].seq").alias("seq"), "msg_id", role.alias("role"), text.alias("text"))


def events_of(rows: DataFrame, draft: int = 16) -> DataFrame:
    """The log that a conversation's rows (conv_id, turn, role, text) come from, as a serving system would write it.

    An assistant's turn streams: the start of a draft, a regeneration, then its text in two deltas. Any other turn is
    sent as a draft and edited into its text. seq has 4 places for each turn; msg_id is the row's own, so rows that
    repeat stay apart. Null role or text stay null in the log. An empty table has an empty log.
    """
    half = F.expr("CAST(length(text) / 2 AS INT)")
    event = lambda k, kind, text: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    start = F.substring("text", 1, draft)
    streamed = F.array(event(0, "delta", start), event(1, "regenerate", F.lit(None).cast("string")), event(2, "delta", F.expr("left(text, CAST(length(text) / 2 AS INT))")), event(3, "delta", F.substring(F.col("text"), half + 1, F.length("text"))))
    sent = F.array(event(0, "message", start), event(1, "edit", F.col("text")))
    d = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("msg_id"))
    d = d.select("conv_id", "turn", "role", "msg_id", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(sent)).alias("e"))
    return d.select("conv_id", (4 * F.col("turn") + F.col("e.k")).alias("seq"), "msg_id", "e.kind", "role", "e.text")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted string, turns array of (start, text_start, text_chars, loss).

    messages: conv_id, seq, role, text (other columns are left out); ordered by seq, equal seq by role, text. Null role
    or text: empty. Repeated messages are turns each; no messages, no rows. A formatted text must stay under 2^31 bytes.
    Positions are code points in formatted; the loss mask is the text of the turns with loss true.
    """
    piece = F.concat(F.lit(TURN), F.col("esc_role"), F.lit(BODY), F.col("esc_text"), F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    m = (
        messages.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("esc_role", escaped(F.col("role")))
        .withColumn("esc_text", escaped(F.col("text")))
        .withColumn("piece", piece)
        .withColumn("chars", F.length("piece").cast("long"))
        .withColumn("end", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(order))
    )
    head = F.length("esc_role").cast("long") + len(TURN) + len(BODY)
    start = F.col("end") - F.col("chars")
    turn = F.struct("place", "piece", start.alias("start"), (start + head).alias("text_start"), F.length("esc_text").cast("long").alias("text_chars"), F.col("role").isin(*loss_roles).alias("loss"))
    return (
        m.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.expr("array_join(transform(t, x -> x.piece), '')").alias("formatted"),
                F.expr("transform(t, x -> struct(x.start, x.text_start, x.text_chars, x.loss))").alias("turns"))
    )


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(fold(events), loss_roles)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse `formatted` again: its turns, and what stands under the loss mask. Texts of any length that render() can
    make; empty ones are turns like others. No rows, no rows."""
    pieces = formatted.withColumn("p", F.split("formatted", r"<\|end\|>")).withColumn("p", F.expr("slice(p, 1, size(p) - 1)"))
    bodies = (
        pieces.withColumn("role", F.transform("p", lambda x: unescaped(F.substring_index(F.substring(x, len(TURN) + 1, 2147483647), BODY, 1))))
        .withColumn("body", F.transform("p", lambda x: unescaped(F.substring_index(x, BODY, -1))))
        # A turn's span is cut out of its own piece: the mask counts in the whole string, where that piece starts at `start`.
        .withColumn("under", F.expr("zip_with(p, turns, (x, t) -> IF(t.loss, substring(x, CAST(t.text_start - t.start + 1 AS INT), CAST(t.text_chars AS INT)), ''))"))
        .withColumn("loss_text", F.array_join(F.transform("under", unescaped), ""))
    )
    flat = F.array_join(F.zip_with("role", "body", lambda r, b: F.concat(r, F.lit("\n"), b, F.lit("\n"))), "")
    return bodies.select(
        "conv_id", F.size("p").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return read_back(format_chats(events_of(c.unionByName(extra))))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(\||/?s>|<SYS>>|/?INST\])')) AS marks FROM rows),
agg AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text) + marks + 8 + 8 + 7) AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(flat) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM agg
"""
