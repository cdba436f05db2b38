"""Chat logs as events: folded into final messages, rendered with a template, and read back.

Only DataFrame functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Order of events that share a sequence number.
KINDS = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, at, msg, part, role, text) of final messages from events (conv_id, seq, msg, kind, role, text).

    The events of a message, by seq: `message` opens it, `delta` appends to its text, `edit` and `regenerate` replace the
    text, deltas after them append to the new one. A message that is opened again is a further message. Its role is the
    first that is not null, and `at` the seq it was opened at. Events with equal seq are taken in the order of KINDS, then
    of role and text. Null texts count as empty, null roles as ''; null ids are ids of their own; other kinds are an error
    of the log and raise."""
    order = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.coalesce(order[F.col("kind")], F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    event = F.struct(F.col("seq").alias("seq"), kind.alias("kind"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("e"))
    opened = F.filter(F.transform("e", lambda x, i: F.when((i == 0) | (x["kind"] == 0), i)), lambda i: i.isNotNull())
    found = found.withColumn("opened", opened)
    found = found.select("conv_id", "msg", "e", F.posexplode("opened").alias("part", "first"), F.col("opened"))
    last = F.coalesce(F.try_element_at("opened", F.col("part") + 2), F.size("e"))
    found = found.select("conv_id", "msg", "part", F.slice("e", F.col("first") + 1, last - F.col("first")).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"] != KINDS["delta"], i).otherwise(0))
    found = found.withColumn("reset", F.array_max(resets))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    text = F.array_join(F.transform(F.slice("e", F.col("reset") + 1, F.size("e")), lambda x: x["text"]), "")
    return found.select("conv_id", F.col("e")[0]["seq"].alias("at"), "msg", "part", F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"), text.alias("text"))


def escape(text: Column) -> Column:
    """A backslash more between `<` and `|`: no control string of a template is left, and unescape() takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments) of each conversation: `segments` are the pieces of `formatted` in order, each with
    whether the loss counts there, which is the text of assistant messages. Messages go by at; those opened at the same seq
    by role, text, msg and part."""
    row = F.struct("at", "role", "text", "msg", "part")
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def pieces(t: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"]), t["role"] == "assistant"), piece(F.lit(END), F.lit(False)))

    out = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def message_events(table: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) of whole messages as events, one a message."""
    return table.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("msg"), F.lit("message").alias("kind"), "role", "text")


def log_of_table(table: DataFrame) -> DataFrame:
    """A log that folds into the messages of a table (conv_id, turn, role, text), as a chat service would have written it:
    every third turn is streamed by deltas, every third was drafted and edited, every third was generated anew. Events come
    in no order but that of seq. Each row is a message of its own; a row without a turn is one event."""
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    half = (n / 2).cast("int")
    first, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1, n - half)

    def event(step: int, kind: str, said: Column, role: Column | None = None) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), said.alias("text"))

    role, third = F.col("role"), (n / 3).cast("int")
    streamed = [event(0, "message", F.substr(text, F.lit(1), third), role), event(2, "delta", F.substr(text, 2 * third + 1, n - 2 * third)), event(1, "delta", F.substr(text, third + 1, third))]
    edited = [event(2, "delta", rest), event(1, "edit", first), event(0, "message", F.concat(rest, F.lit(" draft"), first), role)]
    anew = [event(1, "delta", F.lit(" and so on")), event(4, "delta", rest), event(0, "message", first, role), event(2, "regenerate", F.lit(None).cast("string")), event(3, "delta", first)]
    way = F.pmod("turn", F.lit(3))
    steps = F.when(way == 0, F.array(*streamed)).when(way == 1, F.array(*edited)).when(way == 2, F.array(*anew)).otherwise(F.array(event(0, "message", text, role)))
    rows = table.withColumn("msg", F.monotonically_increasing_id()).select("conv_id", "turn", "msg", F.explode(steps).alias("e"))
    return rows.select("conv_id", (F.col("turn") * 8 + F.col("e.step")).alias("seq"), "msg", "e.kind", "e.role", "e.text")


def format_log(events: DataFrame) -> DataFrame:
    """reconstruct() and render(). Repeated rows are messages of their own; very long texts are kept whole, and a conversation
    is put together in the memory of one task; an empty log gives an empty result; columns other than those of an event
    are not used."""
    return render(reconstruct(events))
