"""Chat formatting: typed content parts flattened by a visitor into text with placeholders, turn marks and a loss mask.

A turn is `<s>`, its role, a newline, its content and `</s>`; a user's content stands between `[INST] ` and ` [/INST]`,
an assistant's alone, any other's between `[SYS] ` and ` [/SYS]`. Every control string begins with a `<` or `[` and
holds no other one. In texts and roles a backslash goes behind that character, before any that are there already; so
no text holds a control string, none can be completed over a border, and taking one backslash away gives the text back.
In roles a backslash is doubled and a newline becomes `\\n` first.

The visitor walks a turn's parts in order, nested documents included. Text parts side by side become one run of text;
an image, audio or document part becomes its placeholder, and its reference, kind, place and expanded token count (what
a model puts there) are recorded in the order of the placeholders. Rows are formatted apart from each other, before the
one shuffle by conversation; `assemble` then streams each conversation's turns, in order, into rows of about `MOST`
characters, so that a conversation of any length takes one such row of memory. Its digests are chains, so a
conversation is hashed by one task, whose memory doesn't grow with it.

Defined results: a null text or role is empty; rows with a null conv_id are one conversation; rows are ordered by turn,
nulls first, then by what they become, so that ties and repeated rows come out alike; all rows count; a parts column
that holds no JSON list is one text; unknown parts are kept as the JSON they are, as text; sizes that are missing, not
numbers or not positive count as one token; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

PLACES = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", *PLACES.values()]
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("", "")}
OTHER = ("[SYS] ", " [/SYS]")
MOST = 1 << 20
#: Sides of an image's patches, tokens for a second of audio, tokens for a page without parts of its own.
PATCH, RATE, PAGE = 14, 25, 256
ATTACHED = "array<struct<kind: string, ref: string, at: long, tokens: long>>"
TURNS = f"conv_id long, turn long, text string, mask array<struct<start: long, end: long>>, attachments {ATTACHED}"
PARTS = f"conv_id long, part int, n_turns long, text string, mask array<struct<start: long, end: long>>, attachments {ATTACHED}"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHED = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
_SPANS = [("text", pa.string()), ("mask", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHED))]

_SAFE = re.compile("|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_TAKE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>", re.S)
_PLACE = re.compile("|".join(map(re.escape, PLACES.values())))
_KINDS = {v: k for k, v in PLACES.items()}


def escape(text: str) -> str:
    return _SAFE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _TAKE.sub("", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _positive(x) -> float:
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x < 1e15 else 0


class Flattener:
    """Visits a turn's parts; `text` is the content so far, with escaped texts and placeholders."""

    def __init__(self, patch: int = PATCH, rate: int = RATE, page: int = PAGE):
        self.patch, self.rate, self.page = patch, rate, page
        self.run: list[str] = []
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def visit(self, part) -> None:
        if isinstance(part, str):
            return self.visit_text({"text": part})
        kind = part.get("type") if isinstance(part, dict) else None
        method = getattr(self, f"visit_{kind}", None) if kind in ("text", *PLACES) else None
        return method(part) if method else self.visit_text({"text": json.dumps(part, ensure_ascii=False)})

    def visit_text(self, part: dict) -> None:
        self.run.append(str(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        wide, high = (math.ceil(_positive(part.get(k)) / self.patch) for k in ("width", "height"))
        self.place(part, wide * high)

    def visit_audio(self, part: dict) -> None:
        self.place(part, math.ceil(_positive(part.get("seconds")) * self.rate))

    def visit_document(self, part: dict) -> None:
        inside = part.get("parts")
        if isinstance(inside, list) and inside:  # its own parts follow its placeholder
            self.place(part, 1)
            for p in inside:
                self.visit(p)
        else:
            self.place(part, math.ceil(_positive(part.get("pages"))) * self.page)

    def place(self, part: dict, tokens: int) -> None:
        self.close()
        ref = part.get("ref")
        self.attachments.append({"kind": part["type"], "ref": None if ref is None else str(ref), "at": self.size, "tokens": max(1, tokens)})
        self._put(PLACES[part["type"]])

    def close(self) -> str:
        """Escape the run of text that ends here; the content so far."""
        self._put(escape("".join(self.run)))
        self.run = []
        return "".join(self.out)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def content(text: str | None, parts: str | None = None) -> list:
    """The parts that a row holds: the JSON list in parts, or else its text."""
    if parts is None:
        return [text or ""]
    try:
        got = json.loads(parts)
    except (ValueError, RecursionError):
        got = None
    return got if isinstance(got, list) else [parts]


def format_turn(role: str | None, parts: list, **sizes: int) -> dict:
    """A turn's text, its loss mask and its attachments, at code points of the text."""
    role = role or ""
    f = Flattener(**sizes)
    for p in parts:
        f.visit(p)
    body = f.close()
    before, after = FRAMES.get(role, OTHER)
    head = f"<s>{escape_role(role)}\n{before}"
    mask = [{"start": len(head), "end": len(head) + len(body)}] if role == "assistant" else []
    return {"text": f"{head}{body}{after}</s>", "mask": mask, "attachments": [a | {"at": a["at"] + len(head)} for a in f.attachments]}


def read(text: str) -> list[tuple[str, list]]:
    """(role, parts) of every turn of formatted text; an attachment's part is its kind alone."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role, body, at = unescape_role(m[1]), m[2], m.end()
        before, after = FRAMES.get(role, OTHER)
        if not (body.startswith(before) and body.endswith(after) and len(body) >= len(before) + len(after)):
            raise ValueError(f"a turn of {role!r} without its frame")
        body = body[len(before) : len(body) - len(after)]
        parts, last = [], 0
        for p in _PLACE.finditer(body):
            parts += [unescape(body[last : p.start()])] * (p.start() > last) + [{"type": _KINDS[p[0]]}]
            last = p.end()
        turns.append((role, parts + [unescape(body[last:])] * (last < len(body))))
    return turns


def format_turns(conversations: DataFrame, parts: str | None = None, patch: int = PATCH, rate: int = RATE, page: int = PAGE) -> DataFrame:
    """Every row's turn, formatted. parts names a column of JSON lists of parts, used where it is not null."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), *_SPANS])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns():
            for b in rows:
                for c, t, role, text, more in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    yield {"conv_id": c, "turn": t} | format_turn(role, content(text, more), patch=patch, rate=rate, page=page)

        yield from batches(turns(), schema)

    own = F.col(parts).cast("string") if parts else F.lit(None).cast("string")
    ids = [F.col(n).cast("long").alias(n) for n in ("conv_id", "turn")]
    return conversations.select(*ids, F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), own.alias("parts")).mapInArrow(run, TURNS)


def assemble(turns: DataFrame, most: int = MOST) -> DataFrame:
    """format_turns()'s rows as conversations: whole turns in order, in rows of at most `most` characters (or one
    turn), numbered by part. The rows of a conversation follow each other in one partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), *_SPANS])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined():
            held, texts, size = None, [], 0
            for b in rows:
                for r in b.to_pylist():
                    new = held is None or r["conv_id"] != held["conv_id"]
                    if new or size + len(r["text"]) > most:
                        if held:
                            yield held | {"text": "".join(texts)}
                        held = {"conv_id": r["conv_id"], "part": 0 if new else held["part"] + 1, "n_turns": 0, "mask": [], "attachments": []}
                        texts, size = [], 0
                    held["n_turns"] += 1
                    held["mask"] += [{k: v + size for k, v in m.items()} for m in r["mask"]]
                    held["attachments"] += [a | {"at": a["at"] + size} for a in r["attachments"]]
                    texts.append(r["text"])
                    size += len(r["text"])
            if held:
                yield held | {"text": "".join(texts)}

        yield from batches(joined(), schema)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").mapInArrow(run, PARTS)


def digest(turns: DataFrame, most: int = MOST) -> DataFrame:
    """For every conversation of format_turns()'s rows, read back from its assembled text: turns, the digest of roles
    and texts, characters and digest of what the loss mask covers, characters in all."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            held = None
            for b in rows:
                for r in b.to_pylist():
                    if r["part"] == 0:
                        if held:
                            yield done(held)
                        held = {"conv_id": r["conv_id"], "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
                    for role, parts in read(r["text"]):
                        held["n_turns"] += 1
                        held["turns"].update(f"{role}\n{''.join(p for p in parts if isinstance(p, str))}\n".encode())
                    for m in r["mask"]:
                        text = unescape(_PLACE.sub("", r["text"][m["start"] : m["end"]]))
                        held["loss_chars"] += len(text)
                        held["loss"].update(text.encode())
                    held["formatted_chars"] += len(r["text"])
            if held:
                yield done(held)

        def done(h: dict) -> dict:
            return h | {"turns_sha256": h["turns"].hexdigest(), "loss_sha256": h["loss"].hexdigest()}

        yield from batches(({k: h[k] for k in schema.names} for h in conversations()), schema)

    return assemble(turns, most).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
