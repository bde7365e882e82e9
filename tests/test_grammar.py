import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from mullion.functions import grammar as g
from mullion.plans.grammars import OPEN_PLAN, grammar

THIRD = r"""
# a list of pairs, as "a=1;bb=22"
root ::= pair (";" pair)* end?
pair ::= [a-c]{1,2} "=" ("0" | [1-9] [0-9]*)
end  ::= "." | "!\n"
"""


def plain_match(text):
    """THIRD, read from left to right by hand."""
    at, n = 0, len(text)

    def pair(at):
        k = at
        while k < n and k - at < 2 and text[k] in "abc":
            k += 1
        if k == at or k >= n or text[k] != "=":
            return None
        k += 1
        if k < n and text[k] == "0":
            return k + 1
        m = k
        while m < n and text[m] in "0123456789":
            m += 1
        return m if m > k and text[k] != "0" else None

    at = pair(0)
    while at is not None and at < n and text[at] == ";":
        at = pair(at + 1)
    return at is not None and text[at:] in ("", ".", "!\n")


def texts():
    rng = random.Random(1)
    some = ["", "a=1", "ab=10;c=0", "abc=1", "a=01", "a=1;", "a=1;b=2.", "a=1!\n", "a=1!", "a=1\n", "é=1", None, "a=1;" * 400 + "b=2", "a=1;" * 400]
    return some + ["".join(rng.choice("abc=;019.!\n") for _ in range(rng.randint(1, 8))) for _ in range(600)] + [
        ";".join(f"{rng.choice(['a', 'bc', 'abc', ''])}={rng.choice(['0', '7', '10', '00', ''])}" for _ in range(rng.randint(1, 3))) + rng.choice(["", ".", "!\n", "!"]) for _ in range(400)
    ]


def test_third_grammar_equals_a_plain_matcher(spark):
    third = g.Grammar(THIRD)
    assert not third.plain
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    got = rows.select("t", g.conforms(F.col("t"), third).alias("by_automaton"), F.col("t").rlike(third.pattern).alias("by_pattern")).collect()
    for r in got:
        want = None if r.t is None else plain_match(r.t)
        assert (r.by_automaton, r.by_pattern) == (want, want), r.t
    assert sum(bool(r.by_automaton) for r in got) > 30


@pytest.mark.parametrize("name", ["plan_3", "plan_5"])
def test_automaton_and_pattern_agree_near_the_language(spark, name):
    rng = random.Random(2)
    labels = {"plan_3": ("GOAL", "APPROACH", "EDGE"), "plan_5": ("GOAL", "STATE", "ALGO", "EDGE", "VERIFY")}[name]
    good = "<think>\n" + "".join(f"{x}: é {x} 😀\n" for x in labels) + "</think>\n\nx = 1\r\n"
    rows = [good]
    for _ in range(300):
        k = rng.randrange(len(good))
        rows.append(good[:k] + rng.choice(["", "\n", "x", "é", good[k] * 2]) + good[k + 1 :])
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select("t", g.in_language(F.col("t"), grammar(name)).alias("a"), F.col("t").rlike(grammar(name).pattern).alias("p"), g.fields(F.col("t"), grammar(name)).alias("f")).collect()
    own = re.compile(r"\A<think>\n" + "".join(rf"{x}: ([^\n]+\n)" for x in labels) + r"</think>\n\n([\x09\x0A\x0D\x20-\x7E]+)\Z")
    for r in got:
        m = own.match(r.t)
        assert r.a == r.p == bool(m), r.t
        assert (tuple(r.f) if r.f else None) == (m.groups() if m else None)
    assert 1 < sum(r.a for r in got) < 301


def test_fields_are_named_by_label_or_rule():
    assert grammar("plan_3").fields == ["goal", "approach", "edge", "code"]
    assert grammar("plan_5").fields == ["goal", "state", "algo", "edge", "verify", "code"]
    assert g.Grammar('root ::= a " " a " B: " a (a | "x")\na ::= [a-z]+').fields == ["a_1", "a_2", "b"]
    assert g.Grammar(OPEN_PLAN).fields == ["rest"]


def test_long_texts_without_backtracking(spark):
    trap = g.Grammar('root ::= (part+ ";")+\npart ::= "a"+')
    df = spark.createDataFrame([("a" * 5000 + ";" + "a" * 5000,), ("a" * 5000 + ";",)], "t string")
    assert [r[0] for r in df.select(g.conforms(F.col("t"), trap)).collect()] == [False, True]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ('root ::= "(" root ")" | "x"', "'root' is recursive"),
        ("root ::= a\na ::= [b] b\nb ::= a?", r"'a' is recursive \(root -> a -> b -> a\)"),
        ("root ::= other", "'other' is not defined"),
        ('start ::= "a"', "'root' is not defined"),
        ('root ::= ("a"', "isn't closed"),
        ('root ::= "a"\nroot ::= "b"', "there twice"),
        ("root ::= * ", "repeats nothing"),
        ('root ::= "a" ;', "line 1: cannot read"),
        (r"root ::= [^\U00000000-\U0010FFFF]", "holds no character"),
    ],
)
def test_what_cannot_be_compiled_says_why(text, said):
    with pytest.raises(g.GrammarError, match=said):
        g.Grammar(text)


@pytest.mark.parametrize("expression", [r'"a"{2,3}', r'"ab"{2}', r'("a" | "ab"){1,} "c"?', r'[^a]*', r'. "a"', r'[a\-b]+', r'"\x61" | "\""', '"a" |\n "b" # or\n "c"', r"[\]a]{0,2}"])
def test_all_short_texts(spark, expression):
    """Against the standard library's patterns, all texts of up to five of these characters."""
    own = {r'"a"{2,3}': "a{2,3}", r'"ab"{2}': "(ab){2}", r'("a" | "ab"){1,} "c"?': "(a|ab)+c?", "[^a]*": "[^a]*", '. "a"': "(?s:.)a", r"[a\-b]+": r"[ab\-]+", r'"\x61" | "\""': 'a|"', '"a" |\n "b" # or\n "c"': "a|bc", r"[\]a]{0,2}": r"[\]a]{0,2}"}[expression]
    made = g.Grammar(f"root ::= {expression}")
    every = ["".join(t) for n in range(5) for t in itertools.product('abc"-]', repeat=n)]
    got = spark.createDataFrame([(t,) for t in every], "t string").select("t", g.in_language(F.col("t"), made).alias("a"), F.col("t").rlike(made.pattern).alias("p")).collect()
    for r in got:
        want = re.fullmatch(own, r.t) is not None
        assert (r.a, r.p) == (want, want), r.t
