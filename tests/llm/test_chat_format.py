import hashlib
import random

from mullion.llm import chat_format as m


def turns_of(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def sample():
    rng = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<\\s>", " ", "hello", "\n", "é", "<", "["]
    rows = []
    for conv in range(12):
        rows += [(conv, t, "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant", None, "<s>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))])) for t in range(rng.randint(1, 40))]
    return [*rows, (None, 1, "user", "x"), (3, None, "assistant", "tie"), (3, None, "assistant", "tie")]


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "x"]) for _ in range(rng.randint(0, 9)))
        made = m.escape(text)
        assert m.unescape(made) == text
        assert not any(c in made for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_read_back_equals_what_was_said(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    for budget, history in ((40, 12), (100_000, 50), (1, 0)):
        made = m.format_chat(df, budget, history)
        got = {r.conv_id: r for r in m.read_back(made).collect()}
        for conv, turns in turns_of(rows).items():
            said = "".join(t for r, t in turns if r == "assistant")
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            r = got[conv]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        for w in made.collect():
            assert w.n_tokens <= budget or w.over_budget
            assert w.n_turns == len(m.parse(w.formatted))


def test_windows_keep_system_repeat_history_and_mask_it():
    turns = [("system", "s s"), *[("user" if k % 2 == 0 else "assistant", f"w{k} x") for k in range(8)]]
    count = lambda t: len(t.split())
    made = list(m.windows(iter(turns), count, 4 * 7, 7))
    assert len(made) > 1
    for k, (text, loss, repeated, n, tokens, over) in enumerate(made):
        parsed = m.parse(text)
        assert parsed[0] == turns[0] and not over and tokens <= 28 and n == len(parsed)
        assert repeated == (2 if k else 0)
        fresh = [t for r, t in parsed[repeated:] if r == "assistant"]
        assert [text[s["start"] : s["stop"]] for s in loss] == fresh


def test_empty_and_long(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert m.read_back(m.format_chat(spark.createDataFrame([], schema))).count() == 0
    long = "word " * 50_000
    w = m.format_chat(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", long)], schema), 100, 10).collect()
    assert [x.over_budget for x in w] == [False, True] and m.parse(w[-1].formatted)[-1] == ("assistant", long)


def test_long_white_space_is_counted_as_the_library_would(spark):
    count = m.tokenizer()
    for run in (" " * 1500, "\n" * 1203, " \n" * 700, "\t" * 1000 + " ", "\u3000" * 1001, " " * 999):
        for text in (run, f"a{run}b", f"{run}b", f"a{run}", f"a{run}. {run}\x1c{run}\n"):
            assert count(text) == len(encoding().encode_ordinary(text)), repr(text[:20])
    long = " " * 1_000_000
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = spark.createDataFrame([(1, 0, "user", long + "x"), (1, 1, "assistant", " \n" * 400_000)], schema)
    r = m.read_back(m.format_chat(rows)).first()
    assert (r.n_turns, r.loss_chars) == (2, 800_000)


def encoding():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(m.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_windows(costs, lead, budget, history):
    """(first repeated turn, first new turn, end) of each window, by adding up costs anew for every choice."""
    out, start, back = [], 0, 0
    while start < len(costs):
        back = next(h for h in range(back, start + 1) if h == start or lead + sum(costs[h : start + 1]) <= budget)
        end = start + 1
        while end < len(costs) and lead + sum(costs[back : end + 1]) <= budget:
            end += 1
        out.append((back, start, end))
        back = next(h for h in range(back, end + 1) if sum(costs[h:end]) <= history)
        start = end
    return out


def test_windows_are_the_longest_that_fit():
    rng = random.Random(4)
    for _ in range(300):
        n, system = rng.randint(1, 30), rng.random() < 0.5
        sizes = [rng.choice([0, 1, 2, 5, 30]) for _ in range(n)]
        turns = [("user" if rng.random() < 0.5 else "assistant", f"t{k}" + " w" * s) for k, s in enumerate(sizes)]
        costs = [len(t.split()) + m.TURN_TOKENS for _, t in turns]
        budget, history = rng.randint(1, 60), rng.randint(0, 25)
        lead = (2 + m.TURN_TOKENS) * system
        given = ([("system", "s s")] if system else []) + turns
        made = list(m.windows(iter(given), lambda t: len(t.split()), budget, history))
        want = plain_windows(costs, lead, budget, history)
        assert len(made) == len(want)
        for k, ((text, _, repeated, _, tokens, _), (back, start, end)) in enumerate(zip(made, want, strict=True)):
            assert m.parse(text)[system:] == turns[back:end]
            assert repeated == start - back + (system and k > 0) and tokens == lead + sum(costs[back:end])
