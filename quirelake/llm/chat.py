"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them in order: text is
escaped and kept; image, audio and document parts become numbered placeholders,
with an attachment reference and the number of tokens the placeholder stands for.
Turns are rendered one by one in a narrow pass; a conversation, which is one output
row by definition, is then assembled by its key. Memory is bounded by one
conversation; a conversation key takes part in one shuffle of rendered turns.

Template: ``<s>``, then for each turn
``[INST] x [/INST]`` (user), ``<<SYS>> x <</SYS>>`` (system), `` x </s>`` (assistant)
or ``[ROLE name] x [/ROLE]`` (any other role, its name percent-encoded).
Inside texts a backslash is doubled and every control string gets a backslash after
its first character, so a rendered text holds no control string but the template's
own, and ``parse`` restores turns exactly. The loss mask covers the assistant's parts
(without markers).

Defined results: null text or content is empty text; a null role is the empty role;
rows with the same key and turn are all kept, ordered by role and content; a part of
unknown type or without a reference becomes a ``file`` placeholder with an empty
reference; rows with a null key are one conversation; a very long text is one string,
and a conversation, which is one output row and so one unsplit key, must fit a task;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]", "<|image:", "<|audio:", "<|document:", "<|file:")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
IMAGE_PATCH, AUDIO_RATE, DOCUMENT_PAGE = 28, 25.0, 256

_special = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_turn = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE (?P<name>[^\]]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _special.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class PartVisitor:
    """Visits the parts of one turn in order; ``body()``, ``attachments`` and ``tokens`` are what it has gathered.

    Texts that follow each other are escaped as one, so no control string arises where they meet.
    """

    def __init__(self):
        self.pieces: list[str] = []
        self.texts: list[str] = []
        self.attachments: list[tuple] = []
        self.tokens = 0

    def visit(self, part) -> None:
        kind = (part["type"] or "text").lower()
        getattr(self, f"visit_{kind}", self.visit_file)(part)

    def visit_text(self, part) -> None:
        self.texts.append(part["text"] or "")

    def visit_image(self, part) -> None:
        self._attach("image", part, math.ceil((part["width"] or 0) / IMAGE_PATCH) * math.ceil((part["height"] or 0) / IMAGE_PATCH))

    def visit_audio(self, part) -> None:
        self._attach("audio", part, math.ceil((part["seconds"] or 0.0) * AUDIO_RATE))

    def visit_document(self, part) -> None:
        self._attach("document", part, (part["pages"] or 0) * DOCUMENT_PAGE)

    def visit_file(self, part) -> None:
        self._attach("file", part, 0)

    def body(self) -> str:
        self._flush()
        return "".join(self.pieces)

    def _flush(self) -> None:
        self.pieces.append(escape("".join(self.texts)))
        self.texts = []

    def _attach(self, kind: str, part, tokens: int) -> None:
        self._flush()
        tokens = max(1, tokens)
        self.attachments.append((kind, part["ref"] or "", tokens))
        self.tokens += tokens
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")


def render(role: str | None, parts) -> tuple[str, int, int, list, int]:
    """Segment of one turn, start and length of its trained text in it, attachments, expanded tokens."""
    visitor = PartVisitor()
    for part in [] if parts is None else parts:
        if part is not None:
            visitor.visit(part)
    body, role = visitor.body(), role or ""
    if role == "user":
        segment = f"[INST] {body} [/INST]"
    elif role == "system":
        segment = f"<<SYS>> {body} <</SYS>>"
    elif role == "assistant":
        return f" {body} </s>", 1, len(body), visitor.attachments, visitor.tokens
    else:
        segment = f"[ROLE {quote(role, safe='')}] {body} [/ROLE]"
    return segment, 0, 0, visitor.attachments, visitor.tokens


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, unescaped text) of each turn of a formatted conversation."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        kind = m.lastgroup
        role = unquote(m["name"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind])))
        at = m.end()
    return turns


def text_part(text: Column) -> Column:
    """Content that is one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """One row for each conversation: key, n_turns, formatted, loss_spans, attachments, attachment_tokens.

    ``loss_spans`` are start and length in code points of ``formatted``. Attachments
    carry their turn's position and their number within the turn.
    """

    @F.pandas_udf("segment string, start long, length long, attachments array<struct<kind:string,ref:string,tokens:long>>, tokens long")
    def rendered(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [render(r, c) for r, c in zip(roles, contents, strict=True)]
        return pd.DataFrame([(s, a, n, [{"kind": k, "ref": f, "tokens": t} for k, f, t in found], tokens) for s, a, n, found, tokens in rows], columns=["segment", "start", "length", "attachments", "tokens"])

    rows = turns.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(role).cast("string").alias("role"), F.col(content).cast(f"array<{PART}>").alias("content"))
    rows = rows.select("key", "at", "role", rendered("role", "content").alias("r"))
    rows = rows.select("key", "at", "role", "r.*")
    # what stands before a turn is summed in the order of the turns, over the rows that the grouping needs together anyway
    w = Window.partitionBy("key").orderBy("at", "role", "segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.lit(len("<s>")) + F.coalesce(F.sum(F.length("segment")).over(w), F.lit(0)))
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "role", "segment", "before", "start", "length", "attachments", "tokens"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["before"] + t["start"]).cast("long").alias("start"), t["length"].alias("length")))
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a, k: F.struct(i.alias("turn"), (k + 1).alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return rows.select(
        F.col("key").alias(key),
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit("<s>"), F.concat_ws("", F.transform("turns", lambda t: t["segment"]))).alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("attachment_tokens"),
    )
