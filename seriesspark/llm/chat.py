r"""Chat formatting with typed content parts.

A turn's content is an array of typed parts. The visitor walks it in order: a
text part becomes escaped text, an image, audio or document part becomes a
placeholder ``<image:k>`` (``k`` numbers the attachments of the conversation) and
adds an attachment row with its reference and the tokens it expands to.

Template, one turn: ``<turn:role>content</turn>`` and a line feed. Inside texts,
roles and references ``\`` is written ``\\``, ``<`` as ``\l`` and ``>`` as ``\g``,
so no text can hold a control string and ``unescape`` gives back every text.

Defined cases: a null role or text is empty; a null or empty part list is an
empty turn; equal ``turn`` values are ordered by role and then content, null
turns first; repeated rows are repeated turns; a null ``conv_id`` is a
conversation of its own; an empty table gives no conversations. One conversation
is one output string, so its turns meet in one row; the number of conversations
is what scales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Tokens that one attachment expands to. An image costs a base and
# a price per tile of 512 x 512, audio a price per second, a document per page.
IMAGE_BASE, IMAGE_TILE, TILE = 85, 170, 512
AUDIO_SECOND = 25
DOCUMENT_PAGE = 1500
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,units:double>"
KINDS = ("image", "audio", "document")


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    pieces = F.split(c, r"\\\\", -1)  # at each escaped backslash, left to right
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")),
                                                               F.lit("\\g"), F.lit(">"))), "\\")


def text_part(text: Column) -> Column:
    """One text part, for tables whose turns are plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
                            F.lit(None).cast("double").alias("units")).cast(PART))


def expanded_tokens(p: Column) -> Column:
    tiles = F.ceil(F.coalesce(p["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(p["height"], F.lit(0)) / TILE)
    units = F.coalesce(p["units"], F.lit(0.0))
    return F.when(p["type"] == "image", IMAGE_BASE + IMAGE_TILE * tiles) \
        .when(p["type"] == "audio", F.ceil(units * AUDIO_SECOND)) \
        .when(p["type"] == "document", F.ceil(units) * DOCUMENT_PAGE).otherwise(F.lit(0)).cast("long")


def format_chats(turns: DataFrame, parts: Column, *, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", learn: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens``.

    ``loss_spans`` are ``(start, length)`` in code points of ``formatted``, one
    for the content of each turn of role ``learn``. Part types other than text and
    the three attachment kinds are treated as text.
    """
    rows = turns.select(F.col(conv).alias("conv_id"),
                        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                 F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    is_media = lambda p: p["type"].isin(*KINDS)
    # attachments before each turn, so numbering runs through the conversation
    counts = F.transform("t", lambda t: F.size(F.filter(t["parts"], is_media)))
    firsts = F.transform(F.aggregate(
        counts, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))), lambda x: x)

    def content(t: Column, first: Column) -> Column:
        def placeholder(p: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(t["parts"], 1, i), is_media))
            return F.when(is_media(p), F.concat(F.lit("<"), p["type"], F.lit(":"), (first + earlier).cast("string"), F.lit(">"))) \
                .otherwise(escape(p["text"]))
        return F.array_join(F.transform(t["parts"], placeholder), "")

    chats = chats.select("conv_id", "t", F.zip_with("t", firsts, lambda t, k: F.when(t.isNotNull(), F.struct(
        F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">")).alias("head"),
        content(t, k).alias("body"), (t["role"] == learn).alias("learn")))).alias("f"))
    f = F.filter("f", lambda x: x.isNotNull())
    chats = chats.select("conv_id", "t", f.alias("f"))
    ends = F.transform(F.aggregate("f", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(
        F.element_at(a, -1) + F.length(x["head"]) + F.length(x["body"]) + len("</turn>\n")))), lambda x: x)
    spans = let(ends, lambda e: F.filter(F.transform("f", lambda x, i: F.when(x["learn"], F.struct(
        (e[i] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))), lambda s: s.isNotNull()))
    media = F.filter(F.flatten(F.transform("t", lambda t, i: F.transform(t["parts"], lambda p: F.when(is_media(p), F.struct(
        i.alias("turn_index"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))))),
        lambda x: x.isNotNull())
    text = F.array_join(F.transform("f", lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), "")
    return chats.select("conv_id", F.size("f").cast("long").alias("n_turns"), text.alias("formatted"),
                        spans.alias("loss_spans"), media.alias("attachments"),
                        F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a formatted conversation; placeholders stay as written."""
    turns = F.filter(F.split(formatted, r"</turn>\n", -1), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len("<turn:") + 1)), ">", 1)).alias("role"),
        unescape(F.substr(x, F.locate(">", x) + 1)).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
