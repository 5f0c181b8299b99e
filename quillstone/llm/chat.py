"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio, document. A visitor walks the parts of a message in order. Runs of
text parts become one escaped text; every other part becomes a placeholder, and its reference is recorded with the
placeholder's place and the tokens that a model spends on it once it is expanded. A turn is

    <|turn|>role<|says|>content<|end|>

and a line break, so a conversation's text is its turns' segments one after another. What looks like a control string
inside a role or a text, of this template or of others, is broken by a backslash behind its first character, and
backslashes are doubled, so that no control string is left and the text can be restored exactly.

Segments are made row by row, where the rows are. Only what reads a conversation as a whole (conversation_texts,
read_back) brings its segments together, as a stream of sorted rows: a conversation of any length takes the memory of
one batch and one turn. The turns of one conversation are read by one task, since a digest of all its text depends on
their order; formatting them is not bound to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The template, and the control strings of other templates that texts must not smuggle in.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<place:int,kind:string,ref:string,tokens:long>>"
SPANS = "array<struct<start:long,stop:long>>"


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder expands to: an image by its patches, audio by its seconds, a document by its pages."""

    patch: int = 28
    image_unsized: int = 256
    audio_per_second: float = 25.0
    document_per_page: int = 512

    def of(self, part: dict) -> int:
        if part["type"] == "image":
            w, h = part.get("width") or 0, part.get("height") or 0
            return math.ceil(w / self.patch) * math.ceil(h / self.patch) if w > 0 and h > 0 else self.image_unsized
        if part["type"] == "audio":
            return math.ceil(max(0.0, part.get("seconds") or 0.0) * self.audio_per_second)
        return max(1, part.get("pages") or 1) * self.document_per_page


def control_pattern(foreign: Iterable[str] = FOREIGN) -> re.Pattern:
    """A backslash, or the first character of anything that is a control string; looking ahead finds overlapping ones too."""
    ahead = "|".join(re.escape(c[1:]) for c in sorted(foreign))
    first = "".join(sorted({re.escape(c[0]) for c in foreign} | {"<"}))
    return re.compile(rf"\\|[{first}](?=\|{'|' + ahead if ahead else ''})")


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BARE = re.compile(r"<\|(turn|says|end|image|audio|document)\|>")


def escaped(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    """The inverse of escaped: a backslash stands for nothing but the next character, which stays."""
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Visitor:
    """Flattens the parts of one message: `pieces` are escaped texts and placeholders in order, `spans` where texts lie."""

    pattern: re.Pattern
    costs: Costs
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0
    _run: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._run.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._placed(part)

    def visit_audio(self, part: dict) -> None:
        self._placed(part)

    def visit_document(self, part: dict) -> None:
        self._placed(part)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown content part {part.get('type')!r}")

    def _placed(self, part: dict) -> None:
        self.flush()
        self.attachments.append({"place": len(self.attachments), "kind": part["type"], "ref": part.get("ref"), "tokens": self.costs.of(part)})
        self.pieces.append(PLACEHOLDERS[part["type"]])
        self.length += len(self.pieces[-1])

    def flush(self) -> None:
        """Neighbouring texts are escaped as one, so that no control string arises where they meet."""
        if text := escaped("".join(self._run), self.pattern):
            self.spans.append((self.length, self.length + len(text)))
            self.pieces.append(text)
            self.length += len(text)
        self._run = []


def format_turn(role: str | None, parts: list[dict] | None, pattern: re.Pattern, costs: Costs, learned: frozenset[str]) -> dict:
    """One turn as its segment, with the spans that count in the loss and the attachments."""
    visitor = Visitor(pattern, costs)
    for part in parts or ():
        visitor.visit(part or {"type": "text"})
    visitor.flush()
    head = f"{TURN}{escaped(role or '', pattern)}{SAYS}"
    loss = [{"start": len(head) + a, "stop": len(head) + b} for a, b in visitor.spans] if (role or "") in learned else []
    segment = "".join([head, *visitor.pieces, END])
    return {"segment": segment, "loss": loss, "attachments": visitor.attachments, "n_chars": len(segment), "attached_tokens": sum(x["tokens"] for x in visitor.attachments)}


def text_part(text: Column) -> Column:
    """A plain text column as a message of one text part; null is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"))).cast("array<struct<type:string,text:string>>")


def format_turns(
    turns: DataFrame, content: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    learned: Iterable[str] = ("assistant",), foreign: Iterable[str] = FOREIGN, costs: Costs = Costs(),
) -> DataFrame:
    """One row for each turn: conversation, turn, role, segment, loss, attachments, n_chars, attached_tokens.

    content is an array of parts: structs with `type` (text, image, audio, document; null is text), `text`, `ref` and what Costs
    reads of `width`, `height`, `seconds`, `pages`; fields may be missing. loss has the code point spans of the texts of `learned`
    roles in their segment; placeholders are never in it. Null roles and texts, parts and lists are empty; an unknown type raises.
    Rows stay where they are. Repeated rows are turns of their own; other columns are left out; an empty table gives no rows.
    """
    pattern, learned = control_pattern(foreign), frozenset(learned)
    conv, turn = (turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    out = pa.schema({
        "segment": pa.string(), "loss": pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()})),
        "attachments": pa.list_(pa.struct({"place": pa.int32(), "kind": pa.string(), "ref": pa.string(), "tokens": pa.int64()})), "n_chars": pa.int64(), "attached_tokens": pa.int64(),
    })

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r.as_py(), p.as_py(), pattern, costs, learned) for r, p in zip(batch.column(2), batch.column(3))]
            columns = [pa.array([m[f.name] for m in made], f.type) for f in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[conv_col, turn_col, role_col, *out.names])

    schema = f"`{conv_col}` {conv}, `{turn_col}` {turn}, `{role_col}` string, segment string, loss {SPANS}, attachments {ATTACHMENTS}, n_chars long, attached_tokens long"
    rows = turns.select(conv_col, turn_col, F.col(role_col).cast("string").alias(role_col), content.alias(free_name(turns, "content")))
    return rows.mapInArrow(formatted, schema)


def in_order(segments: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """Each conversation in one partition, its turns in order; equal turns by segment, so that any run gives the same order."""
    return segments.repartition(conv_col).sortWithinPartitions(conv_col, turn_col, "segment")


def conversation_texts(segments: DataFrame, most_chars: int = 1 << 24, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conversation, piece, text, loss, attachments): whole turns joined to texts, which end before they outgrow most_chars.

    Nearly every conversation is one piece; longer ones have several, numbered from 0, so that no row holds an unbounded
    conversation. Spans are in code points of the piece's text; attachments are numbered within the piece.
    """
    kind = segments.schema[conv_col].dataType.simpleString()
    fields = {"piece": pa.int64(), "text": pa.string(), "loss": pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()})), "attachments": pa.list_(pa.struct({"place": pa.int32(), "kind": pa.string(), "ref": pa.string(), "tokens": pa.int64()}))}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number, length = [], None, 0, 0

        def piece(conv_type: pa.DataType) -> pa.RecordBatch:
            spans, attached, at = [], [], 0
            for segment, loss, attachments in held:
                spans += [{"start": at + s["start"], "stop": at + s["stop"]} for s in loss]
                attached += [a | {"place": len(attached) + k} for k, a in enumerate(attachments)]
                at += len(segment)
            values = ([number], ["".join(s for s, _, _ in held)], [spans], [attached])
            return pa.RecordBatch.from_arrays([pa.array([key], conv_type), *[pa.array(v, t) for v, t in zip(values, fields.values())]], names=[conv_col, *fields])

        conv_type = pa.null()
        for batch in batches:
            conv_type = batch.column(0).type
            for conv, segment, loss, attachments in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (conv != key or length + len(segment) > most_chars):
                    yield piece(conv_type)
                    number = number + 1 if conv == key else 0
                    held, length = [], 0
                elif not held:
                    number = 0
                key, length = conv, length + len(segment)
                held.append((segment, loss, attachments))
        if held:
            yield piece(conv_type)

    rows = in_order(segments, conv_col, turn_col).select(conv_col, "segment", "loss", "attachments")
    return rows.mapInArrow(joined, f"`{conv_col}` {kind}, piece long, text string, loss {SPANS}, attachments {ATTACHMENTS}")


def parsed_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, unescaped, without the placeholders."""
    place = 0
    while place < len(text):
        if not text.startswith(TURN, place):
            raise ValueError(f"no turn begins at {place}")
        says = text.index(SAYS, place)
        end = text.index(END, says)
        role, content = text[place + len(TURN) : says], text[says + len(SAYS) : end]
        yield unescaped(role), unescaped(_BARE.sub("", content))
        place = end + len(END)


def read_back(segments: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row for each conversation, read from its formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is over role, line break, text, line break of every turn; the loss figures over all text under the loss spans,
    unescaped, nothing between. A null id is a conversation of its own; an empty table gives no rows.
    """
    kind = segments.schema[conv_col].dataType.simpleString()
    fields = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, conv_type = None, None, pa.null()
        done: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (conv_type, *fields.values()))], names=[conv_col, *fields])

        def closed() -> tuple:
            n, turns, chars, loss, total = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            conv_type, done = batch.column(0).type, []
            for conv, segment, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        done.append(closed())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed_turns(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescaped(segment[span["start"] : span["stop"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
            if done:
                yield flushed()
        if state is not None:
            done = [closed()]
            yield flushed()

    rows = in_order(segments, conv_col, turn_col).select(conv_col, "segment", "loss")
    return rows.mapInArrow(read, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
