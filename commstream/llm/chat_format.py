"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) turns to a string, and nothing else is known of it. Successive
prefixes of the turns are rendered; where each output begins with the one before, the difference is the span of the
last turn, else the template rewrites history. Where a turn's text stands in its span is found by rendering too: the
same prefix with two other texts in its last turn, whose outputs part where the text begins and meet where it ends.

Every prefix is rendered whole, whatever the template, so a rewrite is found at any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_ID = -(1 << 63)
Turn = tuple[str, str]
#: Stand-ins for a text or a role; they differ in their first and in their last letter.
PROBES = ("qx0a", "za1q")


class PerTurn:
    """A template that joins one rendering for each turn. unescape undoes what it does to texts and, where roles
    stand verbatim in the output, to roles."""

    def __init__(self, render: Callable[[str, str], str], unescape: Callable[[str], str] | None = None, verbatim_roles: bool = False):
        self.render, self.unescape, self.verbatim_roles = render, unescape, verbatim_roles

    def __call__(self, turns: list[Turn]) -> str:
        return "".join([self.render(role, text) for role, text in turns])


def escape(text: str) -> str:
    """Put a backslash before each backslash and each character that a control string begins or ends with."""
    return re.sub(r"[\\#<:]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _marked(role: str, text: str) -> str:
    return f"### {escape(role)}: {escape(text)}</turn>\n"


#: ``### role: text</turn>`` and a line feed for each turn, with control strings in role and text escaped.
marked_template = PerTurn(_marked, unescape, verbatim_roles=True)


class RewritesHistory(ValueError):
    """A longer prefix of the turns did not begin with the output of the shorter one."""


def added(template: Callable[[list[Turn]], str], before: str, turns: list[Turn]) -> str:
    """What the last turn adds to the output ``before`` of the turns before it."""
    now = template(turns)
    if not now.startswith(before):
        raise RewritesHistory(f"turn {len(turns)} changed the output of the turns before it")
    return now[len(before) :]


def turn_spans(template: Callable[[list[Turn]], str], turns: list[Turn]) -> list[str]:
    """The output that each turn adds."""
    before, found = template([]), []
    for n in range(1, len(turns) + 1):
        found.append(added(template, before, turns[:n]))
        before += found[-1]
    return found


def located(span: str, others: list[str]) -> tuple[int, int]:
    """Where the part of span stands that differs between the renderings ``others`` of two probes; the whole span
    where what is around that part is not the same in span."""
    a, b = others
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), 0)
    end = len(span) - tail
    if start > end or span[:start] != a[:start] or (tail and span[end:] != a[-tail:]):
        return 0, len(span)
    return start, end


class _Conversation:
    def __init__(self, key: int, template, keep_text: bool):
        self.key, self.template, self.text = key, template, [] if keep_text else None
        self.turns: list[Turn] = []
        self.before = template([])
        self.n = self.loss_chars = 0
        self.chars = len(self.before)
        self.rewrites = False
        self.undo = getattr(template, "unescape", None) or (lambda x: x)
        self.all, self.loss, self.mask = hashlib.sha256(), hashlib.sha256(), []
        if self.text is not None:
            self.text.append(self.before)

    def add(self, role: str, text: str) -> None:
        self.n += 1
        if self.rewrites:
            return
        past = self.turns
        try:
            span = added(self.template, self.before, [*past, (role, text)])
            start, end = located(span, [added(self.template, self.before, [*past, (role, p)]) for p in PROBES])
            told = role
            if getattr(self.template, "verbatim_roles", False):
                a, b = located(span, [added(self.template, self.before, [*past, (p, text)]) for p in PROBES])
                told = self.undo(span[a:b])
        except RewritesHistory:
            self.rewrites = True
            return
        own = self.undo(span[start:end])
        self.all.update(f"{told}\n{own}\n".encode())
        if told == "assistant":
            self.loss.update(own.encode())
            self.loss_chars += len(own)
            if self.text is not None:
                self.mask.append(f"{self.chars + start}:{self.chars + end}")
        self.chars += len(span)
        if self.text is not None:
            self.text.append(span)
        self.turns.append((role, text))
        self.before += span

    def row(self) -> dict:
        own = {"key": self.key, "n_turns": self.n, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "rewrites": self.rewrites}
        return own | ({"formatted": "".join(self.text), "loss_spans": ",".join(self.mask)} if self.text is not None else {})


_SCHEMA = "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def _format(template, keep_text: bool):
    kinds = [("key", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())]
    schema = pa.schema(kinds + ([("formatted", pa.string()), ("loss_spans", pa.string())] if keep_text else []))

    def run(batches):
        now, at, done = None, None, []
        for batch in batches:
            for key, own, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or (key, own) != at:
                    if now is not None:
                        done.append(now.row())
                    now, at = _Conversation(key, template, keep_text), (key, own)
                now.add(role, text)
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def format_conversations(turns: DataFrame, template: Callable[[list[Turn]], str] = marked_template, id_col: str = "conv_id", keep_text: bool = True) -> DataFrame:
    """A row for each conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites.

    All of it is read back from the formatted text (of a template that does not show roles verbatim, roles are those
    given; texts are as the template shows them unless it has an unescape). keep_text adds the text itself
    (formatted) and where the assistant texts stand in it (loss_spans, start:end in code points, escapes included).
    Turns come in order of turn, null last, then role and text (ties); null roles and texts count as empty; a row
    without an id is a conversation of its own. Rows that repeat stand as often as they come. With a template that
    rewrites history, rewrites is true and what was read before it is kept. Rows of a conversation stream through one
    task in order; the whole conversation is held and rendered five times for each turn, so time grows with the square
    of its length. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    # Rows without an id are spread by a number of their own; of two with the same number in one place, own parts them.
    rows = rows.withColumn("key", F.coalesce("id", F.lit(NULL_ID))).withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(-1)).drop("id")
    ordered = rows.repartition("key", "own").sortWithinPartitions("key", "own", F.col("turn").asc_nulls_last(), "role", "text").select("key", "own", "role", "text")
    schema = _SCHEMA + (", formatted string, loss_spans string" if keep_text else "")
    out = ordered.mapInArrow(_format(template, keep_text), schema)
    return out.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias(id_col), *[c for c in out.columns if c != "key"])


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(more), keep_text=False)
