"""What must follow a rule's literal selects lines before they meet the expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.operators import rule_table as T

REGEXES = ["(?i)abk[a-c]*[.,;]", "abk[a-c]{1,2}?s", "(?i)x?abk+[s.]c", "abk(?=s)[a-s]+[.]", "abk[^a]", "abk.[.]", "abk[k][a-c]*[a-c]*;", "^abk[.]$", "abks", "(abk)[.]", "abk[.]|abk;", "abk[é.]", "abk[,]x*abk[;]"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcABCKkſsS.,;\nxé", max_size=80), st.sampled_from([1, 5, 1000]))
def test_tails_lose_no_line(text, piece):
    groups = [T.needed(r) for r in REGEXES]
    tails = [T.tail(r, g[0][0]) if g and len(g[0]) == 1 else None for r, g in zip(REGEXES, groups, strict=True)]
    T.PIECE, old = piece, T.PIECE
    try:
        got = {(i, r) for i, _, rules in T.Automaton(groups, tails).lines(text) for r in rules}
    finally:
        T.PIECE = old
    found = {(i, r) for i, line in enumerate(text.split("\n")) for r, x in enumerate(REGEXES) if T.required(x) and re.search(x, line)}
    assert found <= got


@pytest.mark.parametrize(("regex", "literal", "accepts", "not_"), [
    ("(?i)word[a-z]*[.,;]", "word", ["s.", ",", "ſK;"], ["", " .", "s s."]), ("word[A-B]{2}", "word", ["ab", "BA"], ["a", "ac"]), ("ab[a-z&&[^b]]", "ab", None, None), (r"ab\d", "ab", None, None), ("ab[é.]", "ab", None, None),
])
def test_tail(regex, literal, accepts, not_):
    made = T.tail(regex, literal)
    assert (made is None) == (accepts is None)
    for x in accepts or ():
        assert re.match(made, x)
    for x in not_ or ():
        assert not re.match(made, x)


def test_lines_leave_a_task_only_where_a_rule_can_match(spark, monkeypatch):
    texts = spark.createDataFrame([("p", "words and words and\nwords, here\nno wordless ones.\nnone")], "path string, text string")
    pairs, real = [], T._verified
    monkeypatch.setattr(T, "_verified", lambda found, *rest: pairs.append(found.count()) or real(found, *rest))
    got = T.matches(texts, [("a", "(?i)word[a-z]*[.,;]"), ("b", "WORDLESS")], "name string, regex string").select("_pos", "name").collect()
    assert sorted(map(tuple, got)) == [(1, "a")] and sum(pairs) == 2  # the line of the comma, and of the word in lower case
