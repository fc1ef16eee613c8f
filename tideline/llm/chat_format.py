"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string; nothing is
known of it. Successive prefixes of a conversation are rendered and consecutive outputs
compared: what the newer one adds behind the older one is the new turn's span. If the
older output (but for an end that templates replace, such as a closing mark) is no
prefix of the newer one, the template has rewritten history, and the turn is marked.
Two probes in place of the turn's text show where the text stands inside the span.

Conversations stream through in the order of their turns; the state of one is all its
turns so far, and every prefix is rendered whole, as a template may look at any turn. Who
knows that a template looks at the last turns only can give a ``window``.

The ``chatml`` template marks turns with control strings and escapes those inside texts
and roles so that ``parse_piece`` gives back exactly what went in.

Defined results: null text or role is empty. Turns with equal numbers follow by role,
then text, and are turns of their own. Null ids are one conversation, null turns come
first. Texts without turns do not occur. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import shared

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
BATCH = 2_000
PROBES = ("\ue000", "\ue001")  # private-use characters that no template treats apart
SCHEMA = "conv_id long, turn long, role string, piece string, start long, body_start long, body_end long, loss boolean, rewrites boolean"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


# ---- the template ---------------------------------------------------------


def escape(text: str) -> str:
    """No ``<|`` is left: one backslash more between the two characters."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@lru_cache(maxsize=1024)
def _role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _unrole(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL))


def chatml(turns: Sequence[Turn]) -> str:
    return "".join(f"{OPEN}{_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def parse_piece(piece: str) -> Turn:
    """Role and text of one formatted turn of ``chatml``."""
    if not piece.startswith(OPEN) or not piece.endswith(CLOSE + "\n"):
        raise ValueError("no turn of this template")
    role, _, text = piece[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return _unrole(role), unescape(text)


# ---- black-box rendering --------------------------------------------------


def _common_head(a: str, b: str) -> int:
    """Length of the common prefix, by comparing whole slices."""
    least, most = 0, min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    while least + 1 < most:  # they agree up to least, not up to most
        middle = (least + most) // 2
        if a[least:middle] == b[least:middle]:
            least = middle
        else:
            most = middle
    return least


def _common_tail(a: str, b: str, most: int) -> int:
    """Length of the common suffix, ``most`` at most."""
    least, most = 0, max(0, most)
    while least < most:
        middle = (least + most + 1) // 2
        if a[len(a) - middle : len(a) - least] == b[len(b) - middle : len(b) - least]:
            least = middle
        else:
            most = middle - 1
    return least


class Watched:
    """One conversation's rendering, turn by turn."""

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window
        self.turns: list[Turn] = []
        self.before = template([])
        self.done = len(self.before)  # characters rendered so far

    def add(self, role: str, text: str) -> tuple[str, int, int, int, bool]:
        """(piece, start, text's start and end in the whole output, rewrites)."""
        if self.window is not None and len(self.turns) >= self.window:
            self.turns = self.turns[-(self.window // 2) :]
            self.before = self.template(self.turns)
        now = self.template([*self.turns, (role, text)])
        one, two = (self.template([*self.turns, (role, p)]) for p in PROBES)
        same = _common_head(self.before, one)
        head = _common_head(one, two)
        tail = _common_tail(one, two, min(len(one), len(two)) - head - 1)
        # what the older output has behind the common part must be an end that the newer one also has
        rewrites = not one.endswith(self.before[same:]) or same < len(self.before) - tail
        rewrites |= now[:head] != one[:head] or not now.endswith(one[len(one) - tail :] if tail else "")
        cut = min(same, len(now))
        piece, start = now[cut:], self.done - (len(self.before) - cut)
        body = start + head - cut, start + len(now) - tail - cut
        self.turns.append((role, text))
        self.before, self.done = now, start + len(piece)
        return piece, start, *body, rewrites


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition(shared.shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _render(batches: Iterator[pa.RecordBatch], template: Template, window: int | None, learned: frozenset[str]):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    current, state = object(), None
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            conv, turn, role, text = (batch.column(c)[k].as_py() for c in range(4))
            if state is None or conv != current:
                current, state = conv, Watched(template, window)
            piece, start, a, z, rewrites = state.add(role, text)
            rows.append((conv, turn, role, piece, start, a, z, role in learned, rewrites))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def format_chats(conversations: DataFrame, template: Template = chatml, learned: Sequence[str] = ("assistant",), window: int | None = None, columns: Sequence[str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row per turn: its piece of the formatted conversation, where it and the text
    in it stand (code points), whether the loss counts there, and whether the template
    rewrote history."""
    conv, turn, role, text = columns
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    return _ordered(rows).mapInArrow(partial(_render, template=template, window=window, learned=frozenset(learned)), SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch], parse: Callable[[str], Turn], unescape_text: Callable[[str], str]):
    names = [f.split()[0] for f in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, state, done = object(), None, []

    def close():
        n, turns, loss_chars, loss, chars = state
        done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for k in range(batch.num_rows):
            conv, piece, start, a, z, learned = (batch.column(c)[k].as_py() for c in range(6))
            if state is None or conv != current:
                if state:
                    close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(piece)
            if learned:
                text = unescape_text(piece[a - start : z - start])
                state[2] += len(text)
                state[3].update(text.encode())
        if len(done) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done = []
    if state:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)


def digests(formatted: DataFrame, parse: Callable[[str], Turn] = parse_piece, unescape_text: Callable[[str], str] = unescape) -> DataFrame:
    """What the formatted turns hold, per conversation. A digest follows the order of
    turns, so one conversation streams through one task, a turn at a time."""
    rows = formatted.select("conv_id", "piece", "start", "body_start", "body_end", "loss")
    ordered = rows.repartition(shared.shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(partial(_digest, parse=parse, unescape_text=unescape_text), DIGEST)
