"""Chat formatting with DataFrame functions only.

A declarative template gives the control strings, the turn's layout, the roles
that are learnt from, and the allowed role order as a finite-state machine. Each
turn becomes segments of text with a loss flag. Control strings that occur
inside texts are escaped, so the formatted string can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role (URL-encoded) + head_end + text + close for each turn.

    open and close have to be marks in angle brackets, in which / and letters may
    occur. moves: state -> {role: next state}; the first state is "start".
    """

    open: str = "<s>"
    head_end: str = "\n"
    close: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("answered", "asked")

    @property
    def marks(self) -> str:
        """Regular expression for what follows < in a control string."""
        return "(?:" + "|".join(x[1:] for x in (self.open, self.close)) + ")"


def escape(text: Column, t: Template) -> Column:
    r"""\ becomes \\ and the < of a control string becomes <\ ."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"<(?={t.marks})", r"<\\")


def unescape(text: Column, t: Template) -> Column:
    r"""Left to right: \\ becomes \ , and <\ before the rest of a control string becomes < ."""
    return F.regexp_replace(text, rf"(\\)\\|(<)\\(?={t.marks})", "$1$2")


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, segments, state, valid.

    Rows are taken by turn, then role, then text. A null text or role is empty; a
    null turn comes first; rows with a null conv_id are one conversation. Repeated
    rows are turns of their own. A role order that the machine refuses gives state
    "error" and valid false; the turns are formatted all the same. An empty table
    gives none. Other columns are not read.
    """
    t = template or Template()
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    turns = turns.withColumn("head", F.concat(F.lit(t.open), F.url_encode("t.role"), F.lit(t.head_end))).withColumn("body", escape(F.col("t.text"), t))
    each = F.struct("t.turn", "t.role", "t.text", "head", "body").alias("each")
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    table = F.create_map(*[x for state, moves in t.moves.items() for role, to in moves.items() for x in (F.lit(f"{state} {role}"), F.lit(to))])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(table, F.concat_ws(" ", s, x["role"])), F.lit("error")))
    loss = lambda role: role.isin(*t.loss_roles)
    piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(piece(x["head"], F.lit(False)), piece(x["body"], loss(x["role"])), piece(F.lit(t.close), F.lit(False)))))
    out = one.select("conv_id", segments.alias("segments"), state.alias("state"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*t.ends).alias("valid"))


def read_chats(formatted: Column, template: Template | None = None) -> Column:
    """The formatted string as array<struct<role, text>>."""
    t = template or Template()
    pieces = F.filter(F.split(formatted, t.close), lambda p: p != "")
    head = len(t.open)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring(p, F.lit(head + 1), F.locate(t.head_end, p) - (head + 1))).alias("role"),
            unescape(F.substring(p, F.locate(t.head_end, p) + len(t.head_end), F.length(p)), t).alias("text"),
        ),
    )


def chat_digests(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted conversations say, read back: counts and digests."""
    t = template or Template()
    made = format_chats(rows, t)
    made = made.withColumn("read", read_chats(F.col("formatted"), t))
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    whole = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    made = made.withColumn("learnt", learnt)
    return made.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )
