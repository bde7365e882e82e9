"""Queries over the pieces of responses, held against plain Python on every response of a table, long texts included."""

import hashlib
import html
import re

from mullion.plans.catalogue import QUERIES
from mullion.sources.fixtures import fixture

SF = "/root/testdata/sf0.001"
CHUNK = re.compile(r"\s+|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|[^\sA-Za-z_0-9]")


def said(spark):
    rows = fixture(spark, SF, "responses").select("ordinal", "mode", "raw_response", "completion_tokens").collect()
    assert max(len(r.raw_response or "") for r in rows) > 5000 and not all((r.raw_response or "").isascii() for r in rows)
    return rows


def split(x):
    return CHUNK.findall(x) or [x]


def test_tokenize_chunks_of_all_responses(spark):
    whole = {(r.ordinal, r.mode): split(r.raw_response) for r in said(spark) if r.raw_response is not None}
    got = QUERIES["q_tokenize_chunks"](spark, SF).collect()
    assert {(r.ordinal, r.mode): (r.n, r.chunks) for r in got} == {k: (len(c), "|".join(c)) for k, c in whole.items()}
    assert len(got) == len(whole) and all(r.lossless for r in got)


def panes(spark):
    """By ordinal and mode: text, chunks, tokens and seconds of each pane."""
    made = {}
    for r in said(spark):
        text = r.raw_response or "gen_error: x"
        pieces = split(text)
        total = r.completion_tokens or max(1, len(pieces))
        made[r.ordinal, r.mode] = (text, pieces, total, 12.5 if r.ordinal % 2 == 0 else total / 40)
    return made


def test_pane_payload_of_all_responses(spark):
    got = QUERIES["q_pane_payload"](spark, SF).collect()
    want = {k: (k[1].upper(), total, seconds, len(pieces), False) for k, (_, pieces, total, seconds) in panes(spark).items()}
    assert {(r.ordinal, r.mode): (r.label, r.total_tokens, r.seconds, r.n_chunks, r.unsafe) for r in got} == want and len(got) == len(want)


def test_tps_over_all_modes(spark):
    want = {}
    for (ordinal, _), (_, _, total, seconds) in panes(spark).items():
        tps, horizon = want.get(ordinal, (0, 0))
        want[ordinal] = max(tps, total / max(seconds, 0.001)), max(horizon, seconds)
    got = QUERIES["q_tps"](spark, SF).collect()
    assert {r.ordinal: (r.tps, r.horizon) for r in got} == want and len(got) == len(want)


def test_replay_prefix_of_all_responses(spark):
    got = QUERIES["q_replay_prefix"](spark, SF).collect()
    want = {k: ("", "".join(pieces[: int(3.0 / 8.0 * len(pieces))]), text) for k, (text, pieces, _, _) in panes(spark).items()}
    assert {(r.ordinal, r.mode): (r.at_0, r.at_3, r.at_9) for r in got} == want and len(got) == len(want)


def test_split_close_of_all_responses(spark):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = {}
    for r in said(spark):
        if r.raw_response is not None:
            head, close, rest = r.raw_response.partition("</think>")
            want[r.ordinal, r.mode] = md5(head + close), md5(html.escape(rest, quote=False))
    got = QUERIES["q_split_close"](spark, SF).collect()
    assert {(r.ordinal, r.mode): (r.think, r.rest) for r in got} == want and len(got) == len(want)
