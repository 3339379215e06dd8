"""Chat formatting by event-sourced reconstruction (operator 8), in DataFrame functions only.

A log of events is dealt by conversation and sorted by sequence, and what was
streamed, edited and regenerated folds into the messages that stand at the end;
these are rendered with a template that marks turns and escapes its own control
characters in texts.

Conversations are put together in two steps, first runs of turns and then the
runs, so that sorting and escaping a very long conversation is shared by many
tasks, and only finished pieces meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Turns of a conversation that one task renders together.
RUN = 256
OPEN, MIDDLE, CLOSE = '<turn role="', '">\n', "</turn>\n"


def escape(text: Column) -> Column:
    """No control character is left: & and < and " are written as entities. Reversible."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _number(frame: DataFrame) -> Column:
    """The number of a turn, which stands alone or first in a struct with what parts turns of one number."""
    return F.col("turn.turn") if isinstance(frame.schema["turn"].dataType, T.StructType) else F.col("turn").cast("long")


def _run_of(number: Column, run: int) -> Column:
    return F.coalesce(F.floor(number / run), F.lit(-(1 << 62))).cast("long")


def fold_events(log: DataFrame, conversation: str = "conv_id", sequence: str = "seq") -> DataFrame:
    """(conversation, turn, role, text): the messages that a log of events ends with.

    Columns: kind, turn, role, text beside the conversation and the sequence.
    Kinds: ``message`` sets a turn's text, ``delta`` appends to it, ``edit``
    replaces it, ``regenerate`` empties it and drops all later turns, whose
    events after it build them anew, ``delete`` removes it.  Only what comes
    after a turn's last message, edit or regenerate counts, and of that the
    deltas, in order.  The role is the last one given.  Null texts are empty;
    events of a null turn or an unknown kind count for nothing; equal sequence
    numbers go by kind and text.

    The events of a turn meet in one row.  What cuts a turn, the last regenerate of
    an earlier one, is a running maximum over the runs of a conversation and over
    the turns of a run, so that a very long conversation is shared by many tasks.
    """
    known = log.filter(F.col("turn").isNotNull() & F.col("kind").isin("message", "delta", "edit", "regenerate", "delete"))
    event = F.struct(F.col(sequence).alias("seq"), "kind", F.coalesce(F.col("text"), F.lit("")).alias("text"), "role")
    rows = known.select(F.col(conversation).alias("_conv"), _run_of(_number(log), RUN).alias("_run"), F.col("turn").alias("_turn"), event.alias("_event"))
    anew = F.max(F.when(F.col("_event.kind") == "regenerate", F.col("_event.seq")))
    turns = rows.groupBy("_conv", "_run", "_turn").agg(F.array_sort(F.collect_list("_event")).alias("_events"), anew.alias("_anew"))
    earlier = Window.partitionBy("_conv").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_conv", "_run").agg(anew.alias("_anew")).select(F.col("_conv").alias("_c"), F.col("_run").alias("_r"), F.max("_anew").over(earlier).alias("_outside"))
    within = Window.partitionBy("_conv", "_run").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = turns.withColumn("_inside", F.max("_anew").over(within)).join(runs, F.expr("_conv <=> _c and _run = _r")).withColumn("_cut", F.greatest("_inside", "_outside"))
    live = cut.withColumn("_live", F.filter("_events", lambda e: F.col("_cut").isNull() | (e["seq"] > F.col("_cut")))).filter(F.size("_live") > 0)
    last = lambda events: F.try_element_at(events, F.lit(-1))
    based = live.withColumn("_base", last(F.filter("_live", lambda e: e["kind"] != "delta"))).withColumn("_role", last(F.filter("_live", lambda e: e["role"].isNotNull()))["role"])
    tail = F.filter("_live", lambda e: (e["kind"] == "delta") & (F.col("_base").isNull() | (e > F.col("_base"))))
    told = based.withColumn("_tail", tail).filter("_base is null or _base.kind != 'delete' or size(_tail) > 0")
    start = F.when(F.col("_base.kind").isin("message", "edit"), F.col("_base.text")).otherwise(F.lit(""))
    text = F.concat(start, F.array_join(F.transform("_tail", lambda e: e["text"]), ""))
    return told.select(F.col("_conv").alias(conversation), F.col("_turn").alias("turn"), F.coalesce("_role", F.lit("")).alias("role"), text.alias("text"))


def _numbered(conversations: DataFrame, conversation: str) -> DataFrame:
    """(conversation, number, turn, role, text); the turn is (number, nth), which parts rows that share a number, ordered by role and text."""
    same = Window.partitionBy(conversation, "turn").orderBy("role", "text")
    rows = conversations.select(conversation, F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("nth", F.row_number().over(same))
    return rows.select(conversation, F.col("turn").alias("number"), F.struct("turn", "nth").alias("turn"), "role", "text")


def message_events(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """A table of finished turns as a log: one message event a row.

    The turn of an event is (turn, nth): rows that share a number, repeated rows
    too, are messages of their own, ordered by role and text; a null number comes
    first.
    """
    return _numbered(conversations, conversation).select(conversation, F.col("number").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def streamed_events(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """A table of finished turns as the log of a service that streamed, edited and regenerated them; it folds back to the table.

    An assistant's turn begins as a message of its first half, someone answers that,
    it is regenerated, which drops the answer, and three deltas stream its text.  Any
    other turn is a message of its first half that an edit completes.  Turns are as in
    message_events; the sequence is (turn, nth, step).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half, third = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")), F.floor(F.length(text) / 3).cast("int")
    parts = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substr(text, 2 * third + 1)]
    none, answer = F.lit(None).cast("string"), F.struct(F.col("turn.turn").alias("turn"), (F.col("turn.nth") + 1).alias("nth"))

    def event(step: int, kind: str, turn: Column, role: Column, body: Column) -> Column:
        seq = F.struct(F.col("turn.turn").alias("turn"), F.col("turn.nth").alias("nth"), F.lit(step).alias("step"))
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), turn.alias("turn"), role.alias("role"), body.alias("text"))

    turn, role = F.col("turn"), F.col("role")
    streamed = [event(0, "message", turn, role, half), event(1, "message", answer, F.lit("user"), half), event(2, "regenerate", turn, none, none)]
    streamed += [event(3 + i, "delta", turn, none, part) for i, part in enumerate(parts)]
    edited = [event(0, "message", turn, role, half), event(1, "edit", turn, none, text)]
    events = F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*edited))
    return _numbered(conversations, conversation).select(conversation, F.explode(events).alias("e")).select(conversation, "e.seq", "e.kind", "e.turn", "e.role", "e.text")


def render(messages: DataFrame, conversation: str = "conv_id", run: int = RUN) -> DataFrame:
    """(conversation, run, n_turns, formatted, loss): pieces of the formatted conversations.

    A conversation's pieces in the order of ``run`` make its formatted text.
    loss has the spans (start, length in code points of the piece) of assistant
    texts.  Null texts and roles are empty; null turns come first; turns of one
    number are ordered by role and text, repeated rows stay.
    """
    role, text = escape(F.coalesce(F.col("role"), F.lit(""))), escape(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    number = _number(messages)
    nth = F.col("turn.nth") if isinstance(messages.schema["turn"].dataType, T.StructType) else F.lit(0)
    turns = messages.select(
        F.col(conversation).alias(conversation),
        _run_of(number, run).alias("run"),
        F.struct(F.coalesce(number, F.lit(-(1 << 62))).alias("turn"), nth.alias("nth"), role.alias("role"), F.concat(head, text, F.lit(CLOSE)).alias("marked"), F.length(head).alias("before"), F.length(text).alias("inside")).alias("t"),
    )
    pieces = turns.groupBy(conversation, "run").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = (F.lit(0), F.array().cast("array<struct<start:int,length:int>>"))

    def step(acc, t):
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["before"]).alias("start"), t["inside"].alias("length"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(t["marked"])).alias("at"), spans.alias("spans"))

    return pieces.select(
        conversation,
        "run",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["marked"]), "").alias("formatted"),
        F.aggregate("ts", F.struct(start[0].alias("at"), start[1].alias("spans")), step, lambda a: a["spans"]).alias("loss"),
    )


def read_back(pieces: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, run, turns, loss_text, formatted_chars) read from the formatted pieces alone.

    A piece without turns gives none; texts come back unescaped, empty ones too.
    """
    marked = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    plain = F.transform(
        marked,
        lambda x: F.concat(
            unescape(F.substring_index(F.substring_index(x, MIDDLE, 1), OPEN, -1)), F.lit("\n"), unescape(F.substr(x, F.instr(x, MIDDLE) + F.lit(len(MIDDLE)))), F.lit("\n")
        ),
    )
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return pieces.select(conversation, "run", F.size(marked).cast("long").alias("n_turns"), F.array_join(plain, "").alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(back: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row a conversation: what read_back found, joined in the order of the runs and digested.

    A conversation's whole text stands in one row; no conversations give no rows.
    """
    whole = back.groupBy(conversation).agg(
        F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("run", "turns", "loss_text"))).alias("p"), F.sum("formatted_chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("p", lambda x: x["loss_text"]), "")
    return whole.select(
        conversation,
        "n_turns",
        F.sha2(F.array_join(F.transform("p", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
