"""Chat formatting from typed content parts, and reading it back.

A turn becomes one piece, ``<|im_start|>role\\nbody<|im_end|>\\n``; a conversation is
its pieces in order. The body is made by a visitor over the turn's parts: text is
escaped, an image, audio clip or document leaves an ordered placeholder and a record
of its reference and of the tokens it will expand to. Control strings inside texts get
one more backslash after their first character, so that a run of n backslashes
becomes n + 1: nothing in a text can be read as a mark, and removing one restores it.

Pieces depend on their own row alone, so formatting is narrow. Reading back needs a
conversation's pieces in order: rows are dealt out by conversation, sorted, and
streamed piece by piece through running digests, so that a task never holds a
conversation, however long. (One digest over a conversation is sequential work; a
conversation with a third of all turns takes its task that long, with constant memory.)

Defined cases: null text is empty, null role is the empty role, null parts are
skipped, an unknown part type is kept as a ``<|part|>`` placeholder; a null
conversation id is an id of its own; rows of equal turn follow by role and text as
formatted, so repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.llm.batches import add_columns, quoted

START, END = "<|im_start|>", "<|im_end|>"
_REST = r"(?=/?s>|/?INST\]|\|[a-z_]{1,32}\|>)"
_ESCAPE = re.compile(r"([<\[]\\*)" + _REST)
_UNESCAPE = re.compile(r"([<\[]\\*)\\" + _REST)

#: Patch side in pixels, audio tokens a second and tokens a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256

PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])
_ATTACHMENT = pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])
FORMATTED = T.StructType([
    T.StructField("piece", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("place", T.IntegerType()), T.StructField("type", T.StringType()),
        T.StructField("ref", T.StringType()), T.StructField("n_tokens", T.LongType())]))),
    T.StructField("n_tokens", T.LongType()),
])


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class Visitor:
    """Flattens the parts of one turn, in order."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[dict] = []
        self.n_tokens = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            kind = part.get("type") or "text"
            getattr(self, f"_{kind}" if kind in ("text", "image", "audio", "document") else "_other")(part)

    def _text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.body.append(escape(text))
        self.n_tokens += len(text.split())

    def _attach(self, part: dict, mark: str, n_tokens: int) -> None:
        self.body.append(f"<|{mark}|>")
        self.attachments.append({"place": len(self.attachments), "type": part.get("type"), "ref": part.get("ref"), "n_tokens": n_tokens})
        self.n_tokens += n_tokens

    def _image(self, part: dict) -> None:
        sides = (part.get("width") or 0, part.get("height") or 0)
        self._attach(part, "image", max(1, math.prod(-(-side // PATCH) for side in sides)))

    def _audio(self, part: dict) -> None:
        self._attach(part, "audio", max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def _document(self, part: dict) -> None:
        self._attach(part, "document", max(1, (part.get("pages") or 0) * PAGE_TOKENS))

    def _other(self, part: dict) -> None:
        self._attach(part, "part", 1)


def format_turn(role: str | None, parts: list[dict | None], loss_roles: frozenset[str]) -> tuple:
    v = Visitor()
    for part in parts:
        v.visit(part)
    head, body = f"{START}{escape_role(role or '')}\n", "".join(v.body)
    loss = [{"first": len(head), "end": len(head) + len(body)}] if (role or "") in loss_roles else []
    return f"{head}{body}{END}\n", loss, v.attachments, v.n_tokens


def format_turns(
    turns: DataFrame, *, role: str = "role", content: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Turns with ``piece``, ``loss`` (code point spans in the piece), ``attachments``
    and ``n_tokens`` (words of texts and expanded tokens of attachments). ``content``
    is a text, or an array of parts with the fields of ``PART``."""
    trained = frozenset(loss_roles)
    plain = isinstance(turns.schema[content].dataType, T.StringType)

    def start():
        def work(columns):
            roles, contents = columns[0].to_pylist(), columns[1].to_pylist()
            made = [
                format_turn(r, [{"type": "text", "text": c}] if plain else c or [], trained) for r, c in zip(roles, contents)
            ]
            pieces, loss, attachments, tokens = zip(*made) if made else ((), (), (), ())
            return [pa.array(pieces, pa.string()), pa.array(loss, pa.list_(_SPAN)),
                    pa.array(attachments, pa.list_(_ATTACHMENT)), pa.array(tokens, pa.int64())]

        return work

    return add_columns(turns, [F.col(role).cast("string"), content], FORMATTED, start)


def read_piece(piece: str, spans: list[dict]) -> tuple[str, str, str]:
    """Role, text and the text under the loss mask of one formatted turn."""
    if not piece.startswith(START) or not piece.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, body = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body), "".join(unescape(piece[s["first"] : s["end"]]) for s in spans)


class _Digest:
    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, spans: list[dict]) -> None:
        role, text, loss = read_piece(piece, spans)
        self.turns += 1
        self.chars += len(piece)
        self.loss_chars += len(loss)
        for part in (role, "\n", text, "\n"):
            self.all.update(part.encode())
        self.loss.update(loss.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, *, conv: str = "conv_id", order: tuple[str, ...] = ("turn", "piece")) -> DataFrame:
    """Per conversation, what its formatted pieces say when they are parsed again."""
    kind = formatted.schema[conv].dataType
    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*done)
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for key, piece, spans in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((current, *digest.row()))
                    current, digest = key, _Digest()
                digest.add(piece, spans)
            if len(done) >= 10_000:
                yield flush()
                done.clear()
        if digest is not None:
            done.append((current, *digest.row()))
            yield flush()

    return (
        formatted.select(*dict.fromkeys([conv, *order, "piece", "loss"])).repartition(quoted(conv))
        .sortWithinPartitions(quoted(conv), *[quoted(c) for c in order])
        .select(quoted(conv), "piece", "loss")
        .mapInArrow(run, schema)
    )
