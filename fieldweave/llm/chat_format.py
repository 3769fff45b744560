"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn, in order: text is escaped, and image, audio and document parts become placeholders
that name their attachment and the tokens it expands to. One output row per turn holds the formatted segment, the
spans under the loss mask (texts of assistant turns), attachment references and expanded token counts; a
conversation's string is the concatenation of its segments.

Template: `<turn:ROLE>` TEXT `</turn>` newline. In texts, roles and references a backslash is written `\\\\`, `<` is `\\l`
and `>` is `\\g`, so no control string can come from them and reading back is exact.

Cases: null text is empty; null role is an empty role; turns are ordered by turn (null first), then role and text, so
repeated rows are turns of their own; null conv_id is a conversation of its own; an empty table gives no
rows; extra columns are ignored, and so is a column `parts` that is no array of structs with a type. Of typed parts, a null one gives
nothing; one of null or unknown type is formatted as the text that it has, if any; fields of other types are read as their strings.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices

_SEGMENT = "conv_id long, turn long, role string, segment string, loss_spans array<struct<start:int,end:int>>, attachments array<struct<kind:string,ref:string,tokens:int,start:int>>, expanded_tokens long"
_TURN = re.compile(r"<turn:([^<>]*)>(.*?)</turn>\n", re.S)
_HOLDER = re.compile(r"<(image|audio|document):([^<>]*):(\d+)>")
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {"\\": "\\", "l": "<", "g": ">"}
#: Tokens that an attachment expands to when its part gives none.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


class PartVisitor:
    """Flattens typed parts; one method a kind, so further kinds are added by subclassing."""

    def __init__(self):
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []
        self.expanded = 0
        self.texts: list[tuple[int, int]] = []

    def _put(self, s: str) -> int:
        start = self.length
        self.out.append(s)
        self.length += len(s)
        return start

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        s = escape("" if text is None else str(text))
        start = self._put(s)
        if s:
            self.texts.append((start, self.length))

    def _attachment(self, part: dict) -> None:
        kind, ref = part["type"], str(part.get("ref") or "")
        try:
            tokens = int(part.get("tokens"))
        except (TypeError, ValueError):
            tokens = DEFAULT_TOKENS[kind]
        start = self._put(f"<{kind}:{escape(ref)}:{tokens}>")
        self.attachments.append({"kind": kind, "ref": ref, "tokens": tokens, "start": start})
        self.expanded += tokens

    visit_image = visit_audio = visit_document = _attachment


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict], list[dict], int]:
    """(segment, loss spans, attachments, expanded tokens) of one turn; offsets count code points of the segment."""
    head = f"<turn:{escape(role or '')}>"
    v = PartVisitor()
    for part in parts:
        v.visit(part)
    n = len(head)
    spans = [{"start": n + a, "end": n + b} for a, b in v.texts] if role == "assistant" else []
    return f"{head}{''.join(v.out)}</turn>\n", spans, [a | {"start": a["start"] + n} for a in v.attachments], v.expanded


def parse(formatted: str) -> list[tuple[str, list[dict]]]:
    """Turns (role, parts) read back from a formatted string."""
    turns = []
    for m in _TURN.finditer(formatted):
        parts, at, body = [], 0, m[2]
        for h in _HOLDER.finditer(body):
            if h.start() > at:
                parts.append({"type": "text", "text": unescape(body[at : h.start()])})
            parts.append({"type": h[1], "ref": unescape(h[2]), "tokens": int(h[3])})
            at = h.end()
        if at < len(body) or not parts:
            parts.append({"type": "text", "text": unescape(body[at:])})
        turns.append((unescape(m[1]), parts))
    return turns


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn. Content is `parts` (array of structs type, text, ref, tokens) if there is such a column, else `text`."""
    kind = conversations.schema["parts"].dataType if "parts" in conversations.columns else None
    typed = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "type" in kind.elementType.names
    content = F.to_json("parts") if typed else F.col("text")

    def run(batches):
        import json

        for batch in batches:
            for part in slices(batch):
                rows = []
                for role, body in zip(part["role"].to_pylist(), part["content"].to_pylist()):
                    rows.append(format_turn(role, json.loads(body or "[]") if typed else [{"type": "text", "text": body}]))
                segments, spans, attachments, expanded = zip(*rows)
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                attached = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32()), ("start", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part["conv_id"], part["turn"], part["role"], pa.array(segments, pa.string()), pa.array(spans, span), pa.array(attachments, attached), pa.array(expanded, pa.int64())],
                    ["conv_id", "turn", "role", "segment", "loss_spans", "attachments", "expanded_tokens"],
                )

    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", content.alias("content"))
    return slim.mapInArrow(run, _SEGMENT)


def digests(segments: DataFrame) -> DataFrame:
    """What reading the output back gives, per conversation. Segments of a conversation stream by in order; only one is held at a time."""

    def run(batches):
        now, state, out = None, None, []

        def close():
            n, whole, loss_n, loss, chars = state
            return (now[0], n, whole.hexdigest(), loss_n, loss.hexdigest(), chars)

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

        for batch in batches:
            for part in slices(batch):
                for conv, segment, spans in zip(part["conv_id"].to_pylist(), part["segment"].to_pylist(), part["loss_spans"].to_pylist()):
                    if now != (conv,):
                        if now:
                            out.append(close())
                        now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, parts in parse(segment):
                        text = "".join(p.get("text", "") for p in parts)
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for s in spans:
                        text = unescape(segment[s["start"] : s["end"]])
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                    state[4] += len(segment)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if now:
            out.append(close())
        if out:
            yield batch_of(out)

    slim = segments.select("conv_id", "turn", "role", "segment", "loss_spans")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(Scratch(spark, "chat").write(format_turns(table.unionByName(own)), "formatted"))
