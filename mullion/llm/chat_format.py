"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose each span; the leading system
turn stands in every window, some turns before the span are repeated as history within a budget of their own, and the
targets of repeated turns are masked, so each assistant text is under the loss mask once. Control strings inside texts
and roles are escaped reversibly. A turn that alone is over the budget gets a window of its own, whole.

Cases: null text or role: empty; null conv_id: a conversation like any other; turns sort by turn, then role and text
(nulls first), so ties and repeated rows have one order; empty table: no windows; other columns are not read. One
conversation streams through one task in turn order and holds a budget's worth of turns, however long it is. Texts of any
length are counted whole, white space of any length included.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.llm.common import written

TOKEN_BUDGET, HISTORY_BUDGET = 2048, 256
#: Tokens that the marks around a turn count for.
TURN_TOKENS = 5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Control strings: an opening character, then one of these.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)")
#: White space that is counted by itself: the tokenizer's pattern engine can't go back over runs of several 100,000.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
TURN = re.compile(r"<s>(.*?)\[INST\] (.*?) \[/INST\]</s>\n", re.DOTALL)
WINDOW = "conv_id bigint, window int, formatted string, loss array<struct<start:int,stop:int>>, n_repeated int, n_turns int, n_tokens bigint, over_budget boolean"


def escape(text: str) -> str:
    """Puts one more backslash after the opening character of every control string, escaped or not."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where the text stands in it."""
    head = f"<s>{escape(role)}[INST] "
    body = escape(text)
    return f"{head}{body} [/INST]</s>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a window."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def tokenizer(path: str | None = None) -> Callable[[str], int]:
    import base64

    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        total, at = 0, 0
        for gap in LONG_SPACE.finditer(text):
            # the pattern takes white space up to the last character, which the next match may begin with; at the end, all
            stop = gap.end() if gap.end() == len(text) else gap.end() - 1
            total += len(encoding.encode_ordinary(text[at : gap.start()])) + len(contract(text[gap.start() : stop].encode(), ranks))
            at = stop
        return total + len(encoding.encode_ordinary(text[at:]))

    return count


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern: the leftmost pair of least rank is joined, again and again."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes, bytes]] = []

    def push(x: int, y: int) -> None:
        if x >= 0 and y < len(parts) and (rank := ranks.get(parts[x] + parts[y])) is not None:
            heapq.heappush(heap, (rank, x, parts[x], parts[y]))

    for i in range(len(parts) - 1):
        push(i, i + 1)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        n = after[i]
        if parts[i] != a or n >= len(parts) or parts[n] != b:
            continue
        parts[i], parts[n], after[i] = a + b, None, after[n]
        if after[i] < len(parts):
            before[after[i]] = i
        push(before[i], i)
        push(i, after[i])
    return [ranks[p] for p in parts if p is not None]


def windows(turns: Iterator[tuple[str, str]], count: Callable[[str], int], budget: int, history: int) -> Iterator[tuple]:
    """(formatted, loss spans, repeated turns, turns, tokens, over budget) of one conversation's windows, as turns come.

    `sums` are prefix sums of tokens over the turns held, so turns i to j cost sums[j] - sums[i]. A window's new turns are
    the longest run whose cost, with the system turn and the history before it, is within the budget; the history is what
    a binary search in the sums puts within its own budget, less where the new turns need the room.
    """
    system: tuple[str, str] | None = None
    lead, shown_system = 0, False  # the system turn's tokens, and whether a window has had it
    held: list[tuple[str, str]] = []  # history, then new turns
    sums = [0]
    new = 0  # where the new turns begin in `held`

    def close() -> tuple:
        fresh = ([system] if system and not shown_system else []) + held[new:]
        repeated = ([system] if system and shown_system else []) + held[:new]
        out, at, loss = [], 0, []
        for k, (role, text) in enumerate(repeated + fresh):
            shown, a, b = render(role, text)
            if k >= len(repeated) and role == "assistant" and b > a:
                loss.append({"start": at + a, "stop": at + b})
            out.append(shown)
            at += len(shown)
        tokens = lead + sums[-1] - sums[0]
        return "".join(out), loss, len(repeated), len(repeated) + len(fresh), tokens, tokens > budget

    def forget(n: int) -> None:
        nonlocal new
        del held[:n], sums[:n]
        new -= n

    for k, (role, text) in enumerate(turns):
        cost = count(text) + TURN_TOKENS
        if not k and role == "system":
            system, lead = (role, text), cost
            continue
        if len(held) > new and lead + sums[-1] + cost - sums[0] > budget:
            yield close()
            shown_system, new = True, len(held)
            forget(bisect_left(sums, sums[-1] - history))
        if len(held) == new:  # history gives way to what is new
            forget(min(new, bisect_left(sums, lead + sums[-1] + cost - budget)))
        held.append((role, text))
        sums.append(sums[-1] + cost)
    if len(held) > new or (system and not shown_system):
        yield close()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema, strict=True)], schema=schema)


def format_chat(conversations: DataFrame, budget: int = TOKEN_BUDGET, history: int = HISTORY_BUDGET, vocabulary: str | None = None) -> DataFrame:
    """The windows of every conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(vocabulary)

        def made() -> Iterator[tuple]:
            for conv, rows in itertools.groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
                for k, w in enumerate(windows(((r or "", t or "") for _, r, t in rows), count, budget, history)):
                    yield conv, k, *w

        yield from _batched(made(), schema)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOW)


def read_back(formatted: DataFrame) -> DataFrame:
    """What each conversation says, read from its windows alone: digests of its turns and of the text under the mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in itertools.groupby(_rows(batches, "conv_id", "formatted", "loss", "n_repeated"), key=lambda r: r[0]):
                turns, loss, n, loss_chars, chars, n_windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for _, text, spans, repeated in rows:
                    for role, said in parse(text)[repeated:]:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        target = unescape(text[s["start"] : s["stop"]])
                        loss.update(target.encode())
                        loss_chars += len(target)
                    chars += len(text)
                    n_windows += 1
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows

        yield from _batched(made(), schema)

    kept = formatted.select("conv_id", "window", "formatted", "loss", "n_repeated")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(written(format_chat(rows), "chat"))
