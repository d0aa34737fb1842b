"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags per segment.

A template names, for each role, what opens and closes a turn and whether its text is learnt. Texts are escaped so
that no control string can occur in them; the escape is reversible, and ``read_back`` recovers every turn and every
learnt text from the formatted output alone. Only built-in column functions are used.

The machine starts in ``start``; ``moves`` maps ``state>role`` to the next state. A conversation is ``valid`` if all
its moves exist and it ends in an accepting state. Others are formatted as well, flagged with the first wrong turn.

A conversation's turns meet in one row, as its formatted text is one value. Turns are put in order by
``(turn, role, text)``, so ties and repeated rows have a defined order and are kept. Null text and null role count as
empty; a null turn sorts first; rows with a null ``conv_id`` form one conversation with that id. Role names are
escaped like texts. An empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Template:
    """Control strings all start with ``mark``, one character; texts hold it only as ``escape`` + ``code``."""

    mark: str = "<"
    escape: str = "\\"
    code: str = "l"
    opens: str = "<turn "  # then the role and a line end
    closes: str = "</turn>\n"
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    accepts: tuple[str, ...] = ("assistant",)
    moves: dict[str, str] = field(
        default_factory=lambda: {
            "begin>system": "system",
            "begin>user": "user",
            "system>user": "user",
            "user>assistant": "assistant",
            "assistant>user": "user",
        }
    )

    def escaped(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(self.escape), F.lit(self.escape * 2)), F.lit(self.mark), F.lit(self.escape + self.code))

    def role_line(self, role: Column) -> Column:
        """A role as it stands on the opening line: line ends are escaped too."""
        return F.replace(self.escaped(role), F.lit("\n"), F.lit(self.escape + "n"))

    def plain(self, text: Column) -> Column:
        """The inverse of ``escaped`` and ``role_line``: escapes stand in pairs or before a code, from the left."""
        pairs = F.split(text, r"\Q" + self.escape * 2 + r"\E", -1)
        single = lambda x: F.replace(F.replace(x, F.lit(self.escape + self.code), F.lit(self.mark)), F.lit(self.escape + "n"), F.lit("\n"))
        return F.array_join(F.transform(pairs, single), self.escape)


CHAT = Template()


def walk(roles: Column, template: Template = CHAT) -> Column:
    """Struct ``state`` (empty after a wrong move) and ``wrong`` (number of the first wrong turn, from 0, or null)."""
    moves = F.create_map(*[F.lit(x) for pair in template.moves.items() for x in pair])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("wrong"))

    def step(now: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(now["state"], F.lit(">"), role)), F.lit(""))
        return F.struct(to.alias("state"), (now["at"] + 1).alias("at"), F.coalesce(now["wrong"], F.when(to == "", now["at"])).alias("wrong"))

    return F.aggregate(roles, begin, step)


def format_chats(rows: DataFrame, template: Template = CHAT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments, valid, wrong_turn``.

    ``segments`` are ``struct(text, loss)`` in order; joined they are ``formatted``.
    """
    clean = rows.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def parts(t: Column) -> Column:
        learnt = t["role"].isin(*template.learnt)
        piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.opens), template.role_line(t["role"]), F.lit("\n")), F.lit(False)),
            piece(template.escaped(t["text"]), learnt),
            piece(F.lit(template.closes), F.lit(False)),
        )

    shaped = grouped.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), walk(F.transform("turns", lambda t: t["role"]), template).alias("end"))
    return shaped.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.coalesce(F.col("end.state").isin(*template.accepts), F.lit(False)).alias("valid"),
        F.col("end.wrong").alias("wrong_turn"),
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """Turns ``array<struct<role, text>>`` parsed from formatted text."""
    # the first piece is the empty text before the first mark; a role line has no line end of its own
    blocks = F.split(formatted, r"\Q" + template.closes + r"\E", -1)
    blocks = F.filter(blocks, lambda b: b != "")

    def turn(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(template.opens) + 1), F.length(block))
        cut = F.instr(inner, "\n")
        return F.struct(template.plain(F.substring(inner, F.lit(1), cut - 1)).alias("role"), template.plain(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(blocks, turn)


def learnt_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.plain(s["text"])), "")


def chat_digest(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """What reading the formatted output back gives, per conversation."""
    turns = read_back(F.col("formatted"), template)
    read = chats.withColumn("turns_read", turns).withColumn("learnt_read", learnt_text(F.col("segments"), template))
    return read.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt_read").cast("long").alias("loss_chars"),
        F.sha2("learnt_read", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "wrong_turn",
    )
