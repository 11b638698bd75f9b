r"""Chat formatting: conversations of typed content parts as one marked text with a loss mask, and back.

The content of a turn is a text, or a JSON list of parts.  A visitor walks the parts in order, documents inside out:

    {"type": "text", "text": ...}                        (or a plain string)
    {"type": "image", "ref": ..., "width": ..., "height": ...}
    {"type": "audio", "ref": ..., "seconds": ...}
    {"type": "document", "ref": ..., "pages": ...}       or with "parts": [...], which follow their document's placeholder

and leaves text, with a placeholder where an attachment stood.  Every attachment is recorded with its reference and the number of tokens
that its placeholder expands to (``Sizes``).  Output is

    <turn:ROLE>\n TEXT and <part:KIND:NUMBER> placeholders </turn>\n

per turn; numbers count a turn's attachments.  The loss mask is a list of (start, length) in code points: the text of assistant turns, without
marks and placeholders.

**Escaping.**  Control strings begin with ``<turn:``, ``</turn>``, ``<part:`` and their like.  In texts one backslash goes in after the ``<`` of
anything that would read so (``</turn>`` becomes ``<\/turn>``; what has backslashes there already gets one more), and reading takes one out.  So no
control string of the template stands in the output but where the template put it, nothing else in a text changes, and every text comes
back as it was.  Texts between two placeholders are joined before they are escaped, so parts cannot make up a control string together.

**Layout.**  Rows are ranged by (conversation, turn) and formatted as they stream by; a conversation is written as pieces of at most
``PIECE_TURNS`` turns or about ``PIECE_CHARS`` characters, (shard, place) in order.  So a conversation that holds a third of all rows is
formatted by many tasks, and a task holds one piece.  Reading parses a conversation of one piece where it lies; only those that were cut are
brought together, streamed piece by piece (a SHA-256 over a whole conversation is sequential by its definition).

Defined results: a null text is empty, a null role is the empty role; turns with the same number are ordered by role and the text's hash,
repeated rows are kept; a null conversation is one of its own, a null turn is its first; content that is not a JSON list is one text as
it stands; parts of an unknown type, or that are no objects, are attachments of kind ``other``; sizes that are missing or make no sense count as
``Sizes`` says; an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, materialize

PIECE_TURNS, PIECE_CHARS = 512, 1_000_000
LEARNT_ROLE = "assistant"

_CONTROL = re.compile(r"<turn:([^<>\n]*)>\n|</turn>\n|<part:([a-z]+):([0-9]+)>")
_TO_ESCAPE = re.compile(r"<(?=\\*/?(?:turn|part)[:>])")
_ESCAPED = re.compile(r"<\\(?=\\*/?(?:turn|part)[:>])")
_IN_ROLE = re.compile(r"[%<>\n]")

_SPANS = "array<struct<start: bigint, length: bigint>>"
_ATTACHED = "array<struct<turn: bigint, number: int, kind: string, ref: string, tokens: bigint>>"


class FormatError(ValueError):
    """A formatted text that the template cannot have written."""


# ---------------------------------------------------------------- one text

def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("<", text)


@dataclass(frozen=True)
class Sizes:
    """What an attachment's placeholder expands to."""

    patch: int = 28  # an image takes a token for every started square of so many pixels
    audio_per_second: float = 25.0
    document_per_page: int = 512
    image_unknown: int = 256  # where width or height is missing
    audio_unknown: int = 0
    pages_unknown: int = 1


def _number(value) -> float | None:
    usable = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and 0 <= value < 2**40
    return value if usable else None


@dataclass
class Visitor:
    """Walks content parts in order; ``out`` is the escaped text with placeholders, ``spans`` where its text is."""

    sizes: Sizes = field(default_factory=Sizes)
    out: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attached: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    length: int = 0
    pending: list[str] = field(default_factory=list)

    def walk(self, parts: list) -> None:
        waiting = list(reversed(parts))  # a stack, so that nesting is bounded by memory only
        while waiting:
            inner = self.visit(waiting.pop())
            waiting.extend(reversed(inner))
        self.settle()

    def visit(self, part) -> list:
        """Take one part; give the parts inside it, which come next."""
        if isinstance(part, str):
            return self.text({"text": part})
        kind = part.get("type") if isinstance(part, dict) else None
        return {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}.get(kind if isinstance(kind, str) else None, self.other)(part)

    def text(self, part: dict) -> list:
        said = part.get("text")
        self.pending.append(said if isinstance(said, str) else "" if said is None else json.dumps(said))
        return []

    def image(self, part: dict) -> list:
        width, height = _number(part.get("width")), _number(part.get("height"))
        known = width is not None and height is not None
        return self.attach("image", part, math.ceil(width / self.sizes.patch) * math.ceil(height / self.sizes.patch) if known else self.sizes.image_unknown)

    def audio(self, part: dict) -> list:
        seconds = _number(part.get("seconds"))
        return self.attach("audio", part, self.sizes.audio_unknown if seconds is None else math.ceil(seconds * self.sizes.audio_per_second))

    def document(self, part: dict) -> list:
        inner = part.get("parts")
        if isinstance(inner, list):
            self.attach("document", part, 0)  # its parts count for themselves
            return inner
        pages = _number(part.get("pages"))
        return self.attach("document", part, math.ceil(self.sizes.pages_unknown if pages is None else pages) * self.sizes.document_per_page)

    def other(self, part) -> list:
        return self.attach("other", part if isinstance(part, dict) else {"ref": json.dumps(part)}, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> list:
        self.settle()
        ref = part.get("ref")
        mark = f"<part:{kind}:{len(self.attached)}>"
        self.attached.append((len(self.attached), kind, ref if ref is None or isinstance(ref, str) else json.dumps(ref), tokens))
        self.out.append(mark)
        self.length += len(mark)
        return []

    def settle(self) -> None:
        """Write the text gathered since the last placeholder."""
        said, self.pending = escape("".join(self.pending)), []
        if said:
            self.spans.append((self.length, len(said)))
            self.out.append(said)
            self.length += len(said)


def parts_of(content: str) -> list:
    """The parts that a turn's content lists; any other content is one text."""
    try:
        found = json.loads(content)
    except (ValueError, RecursionError):
        return [content]
    return found if isinstance(found, list) else [content]


def format_turn(role: str, parts: list, sizes: Sizes = Sizes()) -> tuple[str, list[tuple[int, int]], list[tuple]]:  # noqa: B008
    """The turn's text, the spans of what is said in it, and its attachments (number, kind, ref, tokens)."""
    head = f"<turn:{_IN_ROLE.sub(lambda m: f'%{ord(m[0]):02X}', role)}>\n"
    seen = Visitor(sizes)
    seen.walk(parts)
    return f"{head}{''.join(seen.out)}</turn>\n", [(at + len(head), n) for at, n in seen.spans], seen.attached


def parse_turns(text: str) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """(role, text, placeholders) of every turn of a formatted text; FormatError if it is not one."""
    role, said, marks, at = None, [], [], 0
    for m in _CONTROL.finditer(text):
        if role is None:
            if m.start() != at or m[1] is None:
                raise FormatError(f"no turn begins at {at}")
            role, said, marks = re.sub(r"%([0-9A-F]{2})", lambda c: chr(int(c[1], 16)), m[1]), [], []
        elif m[1] is not None:
            raise FormatError(f"a turn begins inside another at {m.start()}")
        else:
            said.append(text[at : m.start()])
            if m[2]:
                marks.append((m[2], int(m[3])))
            else:
                yield role, "".join(map(unescape, said)), marks
                role = None
        at = m.end()
    if role is not None or at != len(text):
        raise FormatError(f"no turn ends after {at}")


# ---------------------------------------------------------------- inside tasks

_PIECE = ["conv", "shard", "place", "alone", "text", "loss", "n_turns", "attachments"]


def _pieces(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [
        conv, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.int64(),
        pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PIECE)


def _formatter(typed: bool, learnt: str, sizes: Sizes, most_turns: int, most_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, ready, size = TaskContext.get().partitionId(), 0, [], 0
        conv, kind, began, cut = None, None, False, True  # the shard's first conversation may have begun in an earlier one
        out, spans, attached, length, turns = [], [], [], 0, 0

        def close(alone: bool) -> None:
            nonlocal out, spans, attached, length, turns, place, size
            ready.append((
                conv, shard, place, alone, "".join(out), [{"start": a, "length": n} for a, n in spans], turns,
                [dict(zip(("turn", "number", "kind", "ref", "tokens"), a, strict=True)) for a in attached],
            ))
            place, size = place + 1, size + length
            out, spans, attached, length, turns = [], [], [], 0, 0

        for batch in arrow_rows(batches):
            kind = batch.column("conv").type
            ids = batch.column("conv").to_pylist()
            roles = batch.column("role").to_pylist()
            bodies = batch.column("body").to_pylist()
            for here, role, body in zip(ids, roles, bodies, strict=True):
                if began and here != conv:
                    close(not cut)
                    cut = False
                elif turns >= most_turns or length >= most_chars:
                    close(False)
                    cut = True
                conv, began = here, True
                content = (body or b"").decode("utf-8", "replace")
                text, said, marks = format_turn(role or "", parts_of(content) if typed else [content], sizes)
                if role == learnt:
                    spans += [(length + at, n) for at, n in said]
                attached += [(turns, *m) for m in marks]
                out.append(text)
                length, turns = length + len(text), turns + 1
            if size >= most_chars or len(ready) >= 512:
                yield _pieces(ready, kind)
                ready, size = [], 0
        if began:
            close(False)  # the last one may go on in the next shard
        if ready:
            yield _pieces(ready, kind)

    return run


class _Digest:
    def __init__(self):
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said, _ in parse_turns(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in loss:
            said = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.formatted_chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _digested(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation follow one another; one digest is open at a time."""
    conv, now, kind = None, None, None
    for batch in arrow_rows(batches, 64):
        kind, rows = batch.column("conv").type, []
        for here, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv", "text", "loss")), strict=True):
            if now is not None and here != conv:
                rows.append((conv, *now.row()))
                now = None
            conv, now = here, now or _Digest()
            now.add(text, loss)
        if rows:
            yield _digested(rows, kind)
    if now is not None:
        yield _digested([(conv, *now.row())], kind)


# ---------------------------------------------------------------- on Spark

def formatted(
    rows: DataFrame, name: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", typed: bool = False,
    learnt: str = LEARNT_ROLE, sizes: Sizes = Sizes(), most_turns: int = PIECE_TURNS, most_chars: int = PIECE_CHARS,  # noqa: B008
) -> DataFrame:
    """Pieces (conv, shard, place, alone, text, loss, n_turns, attachments) of all conversations, written to the shared folder.

    With ``typed``, content is read as a JSON list of parts; without, it is text whatever it looks like.  ``alone`` pieces are whole conversations.
    """
    took = rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"),
        F.col(f"`{content_col}`").cast("string").cast("binary").alias("body"),
    )
    order = ["conv", "turn", "role", F.xxhash64("body")]
    ranged = took.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = took.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, shard int, place bigint, alone boolean, text string, loss {_SPANS}, n_turns bigint, attachments {_ATTACHED}"
    return materialize(ranged.mapInArrow(_formatter(typed, learnt, sizes, most_turns, most_chars), schema), f"{name}_formatted")


def attachments(pieces: DataFrame) -> DataFrame:
    """(conv, shard, place, turn, number, kind, ref, tokens) of every attachment; ``turn`` counts the piece's turns."""
    return pieces.select("conv", "shard", "place", F.explode("attachments").alias("a")).select("conv", "shard", "place", "a.*")


def expanded(pieces: DataFrame) -> DataFrame:
    """(conv, kind, n, tokens): attachments of every conversation and the tokens they expand to."""
    return attachments(pieces).groupBy("conv", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def read_turns(pieces: DataFrame) -> DataFrame:
    """(conv, shard, place, at, role, text) of every turn, parsed from the pieces; ``at`` counts a piece's turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 16):
            for i, text in enumerate(batch.column("text").to_pylist()):
                roles, said = zip(*((r, t) for r, t, _ in parse_turns(text)), strict=True)
                own = [pa.array([batch.column(c)[i].as_py()] * len(roles), batch.column(c).type) for c in ("conv", "shard", "place")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(len(roles)), pa.int64()), pa.array(roles, pa.string()), pa.array(said, pa.string())], names=["conv", "shard", "place", "at", "role", "text"])

    kind = pieces.schema["conv"].dataType.simpleString()
    return pieces.mapInArrow(run, f"conv {kind}, shard int, place bigint, at bigint, role string, text string")


def read_digests(pieces: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from its pieces."""
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    columns = ["conv", "shard", "place", "text", "loss"]
    whole = pieces.where("alone").select(*columns).mapInArrow(_read_alone, schema)
    cut = pieces.where("not alone").select(*columns).repartition("conv").sortWithinPartitions("conv", "shard", "place")
    return whole.unionByName(cut.mapInArrow(_read_digests, schema))


def _read_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece is a conversation."""
    for batch in arrow_rows(batches, 64):
        rows = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv", "text", "loss")), strict=True):
            now = _Digest()
            now.add(text, loss)
            rows.append((conv, *now.row()))
        if rows:
            yield _digested(rows, batch.column("conv").type)
