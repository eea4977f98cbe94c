"""Chat formatting by event-sourced reconstruction, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BEGIN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that a tokenizer or a template may treat as control; escaped inside texts as ~1, ~2, ...
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TILDE = "~"
#: Event kinds that start a message's text anew.
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """Reversible: ~ becomes ~0 and control string i becomes ~i, so no control string is left."""
    out = F.replace(text, F.lit(TILDE), F.lit("~0"))
    for i, c in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(c), F.lit(f"~{i}"))
    return out


def unescape(text: Column) -> Column:
    for i, c in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(f"~{i}"), F.lit(c))
    return F.replace(text, F.lit("~0"), F.lit(TILDE))


def as_log(turns: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One complete-message event per row of a plain conversation table."""
    return turns.select(
        F.col(conv).alias("conv"),
        F.col(seq).cast("bigint").alias("seq"),
        F.monotonically_increasing_id().alias("msg"),
        F.lit("message").alias("kind"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )


def fold_messages(log: DataFrame) -> DataFrame:
    """Final messages of a log (conv, seq, msg, kind, role, text): conv, seq, role, text.

    Events of a message are taken by seq, ties by kind, role and text. message and edit
    set the text, delta appends, regenerate empties it, delete removes the message
    unless a later event sets it again. Other kinds are ignored. A message stands where
    its first event stands and has the role of its last reset, or else of its first
    event. Null role and text are empty; a null conv is a conversation of its own.
    """
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = log.filter(F.col("kind").isin(*RESETS, "delta"))
    per = known.groupBy("conv", "msg").agg(F.sort_array(F.collect_list(event)).alias("ev"))
    resets = ", ".join(f"'{k}'" for k in RESETS)
    last = per.select(
        "conv", "msg", "ev", F.expr(f"array_max(transform(ev, (e, i) -> if(e.kind in ({resets}), i, -1)))").alias("at")
    )
    start = F.expr("if(at < 0, ev[0], ev[at])")
    text = F.expr("array_join(transform(slice(ev, greatest(at, 0) + 1, size(ev)), e -> if(e.kind in ('regenerate', 'delete'), '', e.text)), '')")
    alive = F.expr("at < 0 or ev[at].kind <> 'delete' or at < size(ev) - 1")
    return last.filter(alive).select("conv", F.expr("ev[0].seq").alias("seq"), start["role"].alias("role"), text.alias("text"))


def format_chats(log: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """conv, n_turns, formatted, formatted_chars, loss_spans (start, length in code points).

    Messages are ordered by seq, ties by role and text. Each becomes
    <|turn|>role<|body|>text<|end|> with both parts escaped; loss_spans cover the bodies
    of loss_roles. Messages fold per (conv, message) before conversations gather, so
    streamed deltas are combined first. A conversation is one output value and so has to
    fit a row. No row leaves the JVM.
    """
    msgs = fold_messages(log)
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(BODY))
    parts = msgs.select("conv", "seq", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.select(
        "conv", "seq", "role", "text",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.length("head").cast("bigint").alias("n_head"),
        F.length("body").cast("bigint").alias("n_body"),
    )
    by_seq = Window.partitionBy("conv").orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("n_head") + F.col("n_body") + len(END)
    placed = parts.select("conv", "role", "piece", "n_head", "n_body", F.row_number().over(by_seq).alias("k"), (F.sum(size).over(by_seq) - size).alias("start"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct((F.col("start") + F.col("n_head")).alias("start"), F.col("n_body").alias("length")))
    out = placed.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )
    return out.select("conv", "n_turns", F.array_join(F.col("pieces")["piece"], "").alias("formatted"), "loss_spans").withColumn("formatted_chars", F.length("formatted").cast("bigint"))


def read_turns(formatted: str = "formatted") -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    marks = "".join("\\" + c if c in "<|>[]/" else c for c in END)
    pieces = F.filter(F.split(F.col(formatted), marks, -1), lambda p: p != "")

    def turn(p):
        rest = F.substring(p, len(BEGIN) + 1, 2**31 - 1)
        return F.struct(unescape(F.substring_index(rest, BODY, 1)).alias("role"), unescape(F.substring_index(rest, BODY, -1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped texts under the loss mask, in order.

    Cut from UTF-32 bytes, where a slice costs its own length; the added first character
    keeps a leading byte-order mark from being swallowed.
    """
    cut = F.transform(
        F.array(F.encode(F.col(formatted), "UTF-32")),
        lambda b: F.transform(
            F.col(spans),
            lambda s: F.substring(
                F.decode(F.concat(F.unhex(F.lit("0000002E")), F.substring(b, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int"))), "UTF-32"), 2, 2**31 - 1
            ),
        ),
    )
    return F.transform(F.get(cut, F.lit(0)), unescape)
