"""Chat formatting in budgeted windows.

Turns are formatted and their tokens counted once.  Prefix sums of these counts choose spans of whole
turns; a window is the system turn, as many turns before the span as the history budget takes, and
the span.  Repeated turns are masked: the loss covers the text of each assistant turn in one window
only.

Prefix sums are two-level (blocks of turn numbers, then turns).  They also cut a conversation into
chunks of CHUNK_WINDOWS windows' tokens; a chunk gets the turns that may be its history along, and
fills its windows one after the other.  So a very long conversation is spread over many tasks, at the
cost of one window in CHUNK_WINDOWS that may not be full.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import byte_blocks, discard, materialise, tidy
from docloom.llm.packing import byte_bpe

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer models or templates; inside a text they are escaped.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Turn numbers that share a block of the two-level prefix sums.
TURN_BLOCK = 256
#: Windows' worth of tokens that one chunk of a conversation holds.
CHUNK_WINDOWS = 64


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how many of them repeated history and the system turn may take."""

    window: int = 2_048
    history: int = 256
    #: The largest system turn that every window repeats; None: half the window.
    system: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.history < self.window // 2:
            raise ValueError("history must be less than half the window")

    @property
    def largest_system(self) -> int:
        return self.window // 2 if self.system is None else self.system


_TAILS = "|".join(sorted((re.escape(c[1:]) for c in CONTROL if c[0] == "<"), key=len, reverse=True))
_SQUARE = "|".join(sorted((re.escape(c[1:]) for c in CONTROL if c[0] == "["), key=len, reverse=True))
#: A backslash, or the first character of a control string.  None occurs inside another but at its start.
ESCAPED = rf"\\|<(?={_TAILS})|\[(?={_SQUARE})"
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(rf"{re.escape(START)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escaped(text: Column) -> Column:
    """A backslash before each backslash, and after the first character of each control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(<)(?={_TAILS})|(\[)(?={_SQUARE})", r"$1$2\\")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted window."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(window)]


def _counted(turns: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """``tokens`` of the formatted turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*vocabulary)
        for batch in batches:
            for block in byte_blocks(iter([batch]), batch.schema.get_field_index("formatted"), 4_000_000):
                tokens = [len(bpe.encode(text.as_py())) // 4 for text in block.column("formatted")]
                yield block.append_column("tokens", pa.array(tokens, pa.int64()))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(tidy(run), f"{names}, tokens bigint")


def _with_prefixes(turns: DataFrame) -> DataFrame:
    """``pos`` (a turn's place) and ``before`` (tokens of the turns before it)."""
    keys = turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / TURN_BLOCK))
    sums = keys.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("c", "block", F.coalesce(F.sum("n").over(earlier), zero).alias("n0"), F.coalesce(F.sum("t").over(earlier), zero).alias("t0"))
    inside = Window.partitionBy("c", "block").orderBy("turn", "role", "digest", "formatted")
    rows = keys.withColumn("n1", F.row_number().over(inside) - 1).withColumn("t1", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero))
    return rows.join(sums, ["c", "block"]).withColumn("pos", F.col("n0") + F.col("n1")).withColumn("before", F.col("t0") + F.col("t1"))


def _spans(tokens: list[int], system: int, led_by: list[int], budget: Budget) -> Iterator[tuple[int, int, int]]:
    """(first of the history, first of the span, end of the span) over the turns of a chunk, after those
    that lead it; places count from the first that leads."""
    sizes, i = [*led_by, *tokens], len(led_by)
    while i < len(sizes):
        low, held = i, 0
        while low and held + sizes[low - 1] <= budget.history:
            low -= 1
            held += sizes[low]
        if sizes[i] > budget.window - system - held:  # such a turn comes without history
            low, held = i, 0
        end, used = i + 1, system + held + sizes[i]
        while end < len(sizes) and used + sizes[end] <= budget.window:
            used += sizes[end]
            end += 1
        yield low, i, end
        i = end


_SYSTEM, _LEADS, _OWN = 0, 1, 2
_WINDOW = pa.schema(
    [
        ("conv_id", pa.int64()), ("start", pa.int64()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("tokens", pa.int64()), ("oversize", pa.bool_()),
        ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _chunk_windows(turns: list[dict], budget: Budget) -> Iterator[dict]:
    """The windows of a chunk, whose turns stand in order: the system turn, those that lead, its own."""
    system = [t for t in turns if t["kind"] == _SYSTEM]
    own = [t for t in turns if t["kind"] == _OWN]
    leads = [t for t in turns if t["kind"] == _LEADS]
    first_chunk = turns[0]["chunk"] == 0
    spans = list(_spans([t["tokens"] for t in own], sum(t["tokens"] for t in system), [t["tokens"] for t in leads], budget))
    if not own and first_chunk:
        spans = [(len(leads), len(leads), len(leads))]  # nothing but a system turn
    rest = leads + own
    for k, (low, start, end) in enumerate(spans):
        opens = first_chunk and not k
        parts = [*system, *rest[low:end]]
        repeated = start - low + (0 if opens else len(system))
        loss, at, fresh = [], 0, {id(t) for t in (*rest[start:end], *(system if opens else ()))}
        for t in parts:
            if t["role"] == "assistant" and id(t) in fresh:
                loss.append({"start": at + t["at"], "end": at + len(t["formatted"]) - len(END) - 1})
            at += len(t["formatted"])
        tokens = sum(t["tokens"] for t in parts)
        place = rest[start]["pos"] if start < len(rest) else system[0]["pos"]
        yield {"conv_id": turns[0]["conv_id"], "start": place, "n_repeated": repeated, "n_turns": len(parts), "tokens": tokens, "oversize": tokens > budget.window, "text": "".join(t["formatted"] for t in parts), "loss": loss}


def chat_windows(conversations: DataFrame, vocabulary: tuple[str, str], budget: Budget = Budget()) -> DataFrame:
    """One row for each window of each conversation in ``conversations`` (conv_id, turn, role, text):
    conv_id, start (the place of its first new turn), n_repeated, n_turns, tokens, oversize, text,
    loss (spans of code points in text, end exclusive).

    Turns stand by turn number (null first), then role and text.  A first turn whose role is
    ``system`` is repeated in every window if it has ``budget.largest_system`` tokens at most; a
    longer one is an ordinary turn of the first windows, so that it does not multiply.  A span takes
    turns as long as the window has room.  ``oversize`` marks windows above the budget: besides the
    system turn they hold one turn, which is too large; nothing is cut.  Null role and text are
    empty; rows with a null conv_id are one conversation; repeated rows are turns of their own;
    other columns are ignored; no rows give no rows.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), F.regexp_replace(escaped(role), "\n", "\\\\\n"), F.lit("\n"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("none")).alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("digest"), F.length(head).alias("at"), F.concat(head, escaped(text), F.lit(f"{END}\n")).alias("formatted"))
    counted = materialise(_counted(turns, vocabulary), "turns")
    cell = F.lit(CHUNK_WINDOWS * budget.window)
    placed = _with_prefixes(counted).withColumn("chunk", F.floor(F.col("before") / cell))
    columns = ["c", "conv_id", "pos", "role", "at", "formatted", "tokens"]
    placed = materialise(placed.select(*columns, "chunk", "before"), "placed")
    discard(counted)

    led = (F.col("pos") == 0) & (F.col("role") == "system") & (F.col("tokens") <= budget.largest_system)
    chunks = placed.select("c", "chunk").distinct()
    systems = placed.where(led).select(*columns).join(chunks, "c").withColumn("kind", F.lit(_SYSTEM))
    leads = F.col("before") >= (F.col("chunk") + 1) * cell - F.lit(budget.history)
    places = F.when(leads, F.array(F.struct("chunk", F.lit(_OWN).alias("kind")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(_LEADS).alias("kind")))).otherwise(F.array(F.struct("chunk", F.lit(_OWN).alias("kind"))))
    body = placed.where(~led).withColumn("place", F.explode(places)).select(*columns, "place.chunk", "place.kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def finished() -> list[dict]:
            own = held and (held[-1]["kind"] == _OWN or held[0]["chunk"] == 0)  # else nothing begins in the chunk
            done = list(_chunk_windows(held, budget)) if own else []
            held.clear()
            return done

        for batch in batches:
            for block in byte_blocks(iter([batch]), batch.schema.get_field_index("formatted"), 4_000_000):
                out: list[dict] = []
                for turn in block.to_pylist():
                    if held and (turn["c"], turn["chunk"]) != (held[0]["c"], held[0]["chunk"]):
                        out += finished()
                    held.append(turn)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)
        if out := finished():
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)

    dealt = systems.select(*columns, "chunk", "kind").unionByName(body).repartition("c", "chunk").sortWithinPartitions("c", "chunk", "kind", "pos")
    return dealt.mapInArrow(tidy(run), "conv_id long, start long, n_repeated int, n_turns int, tokens long, oversize boolean, text string, loss array<struct<start:long,end:long>>")


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Read back from windows, one row for each conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    turns_sha256 covers role, line end, text, line end of each turn, repeated ones left out;
    loss_sha256 the unescaped text under the loss spans.  A digest runs through a conversation's
    windows in order, a window at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = ...
        state: list = []

        def row() -> list:
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out: list[list] = []
            ids, repeated, texts, losses = (batch.column(i).to_pylist() for i in range(4))
            for conv, skip, text, loss in zip(ids, repeated, texts, losses, strict=True):
                if conv != now:
                    if now is not ...:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text)[skip:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if out:
                yield _digest_batch(out)
        if now is not ...:
            yield _digest_batch([row()])

    order = windows.select("conv_id", "n_repeated", "text", "loss", "start").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return order.drop("start").mapInArrow(tidy(run), schema)


def _digest_batch(rows: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
