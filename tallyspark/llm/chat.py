"""Conversations rendered as training text, checked by a grammar round trip.

The template marks each turn as `<|turn|>role\\ntext<|end|>\\n`. A deterministic parser reads the rendered text back;
where a recovered turn differs from its source, the text is escaped and rendered again until they are identical. To
escape, one backslash is put behind the first character of each control string, also of one that already has
backslashes there; to unescape, one is taken away. So no escaped text has a control string, and escaping is undone
exactly. Control strings of other common templates are escaped in every text, so that a text cannot pose as markup.

The loss mask holds the spans of the assistants' texts. Conversations are read turn by turn in order, in bounded pieces of
BLOCK characters, with running digests, so a conversation's length doesn't matter for memory.

Defined cases: a null text counts as empty and a null role as an empty role; a null id is a conversation of its own; turns
are ordered by number (null first), then role, then text; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Control strings, of this template and of others.
CONTROL = r"(<|\[)(\\*)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|/INST\]|INST\])"
TURN, END = "<|turn|>", "<|end|>\n"
BLOCK = 1 << 22

_escape = re.compile(CONTROL)
_unescape = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))


def escape(text: str) -> str:
    return _escape.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2\3", text)


def role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, content as rendered, its start, its end) of each turn. Anything that the grammar has no rule for ends it
    with an error."""
    at = 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        line = text.find("\n", at)
        end = text.find(END, line + 1)
        if line < 0 or end < 0 or TURN in text[line + 1 : end]:
            raise ValueError(f"a turn without an end at {at}")
        yield text[at + len(TURN) : line], text[line + 1 : end], line + 1, end
        at = end + len(END)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]], list[tuple[int, int]]]:
    """The rendered turns, what the parser recovers from them, and the spans under the loss mask."""
    escaped = [_escape.search(text) is not None or _escape.search(role) is not None for role, text in turns]
    for _ in range(2):
        out = "".join(f"{TURN}{role_out(role)}\n{escape(text) if e else text}{END}" for (role, text), e in zip(turns, escaped, strict=True))
        try:
            found = list(parse(out))
            back = [(role_in(r), unescape(c)) for r, c, _, _ in found]
        except ValueError:
            back = []
        if back == turns:
            return out, back, [(a, b) for (role, _), (_, _, a, b) in zip(back, found, strict=True) if role == "assistant"]
        escaped = [True] * len(turns)
    raise ValueError("a conversation doesn't survive its round trip")


def _format(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, turn, role, text) sorted by id -> (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted, loss_starts, loss_ends)."""
    state: dict = {}
    done: list[dict] = []

    def flush() -> None:
        if not state["turns"]:
            return
        out, back, spans = render(state["turns"])
        for role, text in back:
            state["digest"].update(f"{role}\n{text}\n".encode())
        for a, b in spans:
            plain = unescape(out[a:b])
            state["loss"].update(plain.encode())
            state["loss_chars"] += len(plain)
            if texts:
                state["starts"].append(state["chars"] + a)
                state["ends"].append(state["chars"] + b)
        state["n"] += len(back)
        state["chars"] += len(out)
        if texts:
            state["out"].append(out)
        state["turns"], state["size"] = [], 0

    def close() -> None:
        flush()
        done.append(state.copy())

    def rows() -> pa.RecordBatch:
        columns = [
            pa.array([x["id"] for x in done], kind), pa.array([x["n"] for x in done], pa.int64()), pa.array([x["digest"].hexdigest() for x in done], pa.string()),
            pa.array([x["loss_chars"] for x in done], pa.int64()), pa.array([x["loss"].hexdigest() for x in done], pa.string()), pa.array([x["chars"] for x in done], pa.int64()),
            pa.array(["".join(x["out"]) if texts else None for x in done], pa.string()), pa.array([x["starts"] for x in done], pa.list_(pa.int64())), pa.array([x["ends"] for x in done], pa.list_(pa.int64())),
        ]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "loss_starts", "loss_ends"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not state or conv != state["id"]:
                if state:
                    close()
                state = {"id": conv, "n": 0, "digest": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "turns": [], "size": 0, "out": [], "starts": [], "ends": []}
                if len(done) >= 1000:
                    yield rows()
            state["turns"].append((role or "", text or ""))
            state["size"] += len(text or "") + 32
            if state["size"] >= BLOCK:
                flush()
    if state:
        close()
    if done:
        yield rows()


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted, loss_starts, loss_ends), one row for each
    conversation; all values are read back from the rendered text. texts: whether the last three columns are filled."""
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(turn_col)).alias("turn"), F.col(quoted(role_col)).cast("string").alias("role"), F.col(quoted(text_col)).cast("string").alias("text"))
    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(lambda b: _format(texts, b), f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss_starts array<long>, loss_ends array<long>")
