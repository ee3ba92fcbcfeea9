"""Chat formatting with typed content parts, in SQL functions only.

A turn's content is a list of typed parts: text, image, audio or document. A visitor (``PartVisitor``) has one rule per kind; it
flattens the parts, in order, into text and placeholders, and records for every placeholder the attachment's reference,
its place and the number of tokens it will expand to. A turn is written as ``<s>[INST]role[/INST]body</s>``.

Control strings inside texts and roles (the turn marks and the placeholders) get one backslash more after their first
character: ``</s>`` becomes ``<\\/s>``, which itself would become ``<\\\\/s>``. Taking one away gives the text back, texts without
control strings stay as they are, and no body holds a control string that the template didn't write. Two text parts in a row
are kept apart by ``<text>``, so that none can arise where they meet.

``format_chats`` gives one row per conversation: the formatted string, the loss spans (code points, the assistant's text parts
only) and the attachments. ``read_turns`` reads roles and parts back from the string alone.

Results: null texts and roles count as empty; a null or empty list of parts is an empty body; parts of an unknown kind raise an
error; sizes that are null count as one token. Rows of a conversation go by turn, null turns first, then role and content, so
repeated rows are kept and their order is fixed; rows without a conversation id are one conversation. An empty table gives no rows.
A formatted conversation is one string, so it must fit one row (2 GB); shuffles move the raw turns once, by conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn marks and placeholders of the template: fixed values.
OPEN, SAID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
NEXT_TEXT = "<text>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
_ANGLE, _SQUARE = "/?s>|text>|image>|audio>|document>", "/?INST\\]"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """One backslash more inside every control string."""
    return F.regexp_replace(F.regexp_replace(text, f"<(\\\\*)({_ANGLE})", "<$1\\\\$2"), f"\\[(\\\\*)({_SQUARE})", "[$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"<\\\\(\\\\*)({_ANGLE})", "<$1$2"), f"\\[\\\\(\\\\*)({_SQUARE})", "[$1$2")


def _whole(c: Column) -> Column:
    """A size rounded up, at least one."""
    return F.greatest(F.ceil(F.coalesce(c, F.lit(0))).cast("long"), F.lit(1).cast("long"))


@dataclass(frozen=True)
class PartVisitor:
    """How many tokens each kind of attachment expands to, and what it leaves in the text."""

    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 256

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")

    def visit_image(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["image"]), _whole(part["width"] / self.patch) * _whole(part["height"] / self.patch)

    def visit_audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["audio"]), _whole(part["seconds"] * self.tokens_per_second)

    def visit_document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["document"]), _whole(part["pages"]) * self.tokens_per_page

    def piece(self, part: Column, before: Column) -> Column:
        """struct(kind, ref, piece, tokens) of a part; ``before`` is the kind of the part in front of it."""
        rules = [("text", self.visit_text), ("image", self.visit_image), ("audio", self.visit_audio), ("document", self.visit_document)]
        piece = tokens = None
        for kind, rule in rules:
            here, count = rule(part)
            if kind == "text":
                here = F.when(before == "text", F.concat(F.lit(NEXT_TEXT), here)).otherwise(here)
            is_it = part["kind"] == kind
            piece = F.when(is_it, here) if piece is None else piece.when(is_it, here)
            tokens = F.when(is_it, count) if tokens is None else tokens.when(is_it, count)
        unknown = F.raise_error(F.concat(F.lit("no rule for a part of kind "), F.coalesce(part["kind"], F.lit("null"))))
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), piece.otherwise(unknown.cast("string")).alias("piece"),
                        tokens.otherwise(F.lit(0).cast("long")).alias("tokens"))

    def pieces(self, parts: Column) -> Column:
        """The pieces of a list of parts, in order."""
        before = lambda i: F.when(i > 0, F.get(parts, i - 1)["kind"])
        return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p, i: self.piece(p, before(i)))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]))


def format_chats(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 loss_roles: tuple[str, ...] = ("assistant",), visitor: PartVisitor = PartVisitor()) -> DataFrame:
    """(conv_id, n_turns, formatted, loss array<start, length>, attachments array<turn_no, start, kind, ref, tokens>,
    attachment_tokens). Starts count code points from 0; ``parts`` is an array of structs with the fields of ``PART``."""
    raw = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                       parts.cast(f"array<{PART}>").alias("parts"))
    conversation = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    placed = raw.withColumn("turn_no", F.row_number().over(conversation) - 1)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAID))
    bodies = (placed.withColumn("pieces", visitor.pieces(F.col("parts"))).drop("parts").withColumn("head", head)
              .withColumn("rendered", F.concat("head", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(CLOSE))))
    starts = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("rendered").cast("long")).over(starts), F.lit(0).cast("long")) + F.char_length("head")
    lengths = F.transform("pieces", lambda p: F.char_length(p["piece"]).cast("long"))
    # the running total of a turn's few pieces
    before = F.transform("lengths", lambda _, i: F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    located = (bodies.withColumn("at", offset).withColumn("lengths", lengths).withColumn("before", before)
               .withColumn("pieces", F.transform("pieces", lambda p, i: F.struct(
                   (F.col("at") + F.get("before", i)).alias("start"), F.get("lengths", i).alias("length"), p["kind"].alias("kind"),
                   p["ref"].alias("ref"), p["tokens"].alias("tokens"), p["piece"].startswith(NEXT_TEXT).alias("parted")))))
    skip = lambda p: F.when(p["parted"], len(NEXT_TEXT)).otherwise(0)
    texts = F.filter("pieces", lambda p: p["kind"] == "text")
    loss = F.when(F.col("role").isin(*loss_roles), F.transform(texts, lambda p: F.struct((p["start"] + skip(p)).alias("start"), (p["length"] - skip(p)).alias("length"))))
    others = F.transform(F.filter("pieces", lambda p: p["kind"] != "text"), lambda p: F.struct(
        F.col("turn_no").cast("long").alias("turn_no"), p["start"].alias("start"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    row = located.select("conv_id", F.struct("turn_no", "rendered", F.coalesce(loss, F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("loss"),
                                             others.alias("others")).alias("row"))
    whole = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    done = whole.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.col("rows.rendered"), "").alias("formatted"),
                        F.flatten(F.col("rows.loss")).alias("loss"), F.flatten(F.col("rows.others")).alias("attachments"))
    return done.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<role, parts array<kind, text>> of a formatted conversation; attachments have no text, empty text parts are left out."""
    marks = "|".join([NEXT_TEXT, *PLACEHOLDERS.values()])
    kind = lambda p: F.regexp_extract(p, f"^({marks})", 1)

    def part(p: Column) -> Column:
        attached = kind(p).isin(*PLACEHOLDERS.values())
        return F.struct(F.when(attached, F.regexp_replace(kind(p), "[<>]", "")).otherwise("text").alias("kind"),
                        F.when(~attached, unescape(F.regexp_replace(p, f"^{NEXT_TEXT}", ""))).alias("text"))

    def turn(t: Column) -> Column:
        role_and_body = F.split(F.substr(t, F.lit(len(OPEN) + 1)), "\\[/INST\\]", 2)
        # an attachment ends where it begins to be text: cut in front of every mark and behind every placeholder
        cuts = F.split(F.get(role_and_body, F.lit(1)), f"(?={marks})|(?<={'|'.join(PLACEHOLDERS.values())})")
        return F.struct(unescape(F.get(role_and_body, F.lit(0))).alias("role"),
                        F.transform(F.filter(cuts, lambda p: p != ""), part).alias("parts"))

    return F.transform(F.filter(F.split(formatted, CLOSE), lambda x: x != ""), turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, ...) from the formatted strings and spans alone."""
    said = lambda t: F.array_join(F.transform(F.filter(t["parts"], lambda p: p["kind"] == "text"), lambda p: p["text"]), "")
    seen = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", under_loss(F.col("formatted"), F.col("loss")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), said(t), F.lit("\n"))), "")
    return seen.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
