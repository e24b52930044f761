"""Tolerant JSON and chapter transactions against versions written out step by step."""

import itertools
import json

import numpy as np
import pytest

from wordloom.functions import loosejson as J
from wordloom.operators import transactions as X


def test_loose_objects():
    intact = {"thought": 'a "b" {c}', "args": {"n": [1, {"x": "}"}]}}
    text = json.dumps(intact)
    assert J.loose_object(text) == (text, "whole")
    assert J.loose_object(f"```json\n{text}\n```") == (text, "whole")
    assert J.loose_object(f"{{so}} it is {{: {text} and }} more") == (text, "embedded")
    assert J.loose_object("[1, 2]") == J.loose_object("3") == J.loose_object('"{}"') == (None, None)
    assert J.loose_object(None) == J.loose_object("") == J.loose_object("{ no") == (None, None)
    assert J.loose_object('{"a": {"b": 1}') == ('{"b": 1}', "embedded")
    assert J.loose_object("{" * 20_000) == (None, None)


def test_bare_quotes_are_escaped():
    """Values with quotes inside, with and without what follows the object."""
    rng = np.random.default_rng(1)
    pieces = ["green", ' "way" ', "“quoted”", ' "a b"。', "{x}", "\\n", "\\\\", " ok"]
    for _ in range(300):
        # a quote that JSON's own marks follow is an end by rule, so a piece with a bare quote never stands last
        value = "".join(rng.choice(pieces, 3)) + "end"
        told = '{"k": "' + value + '", "n": 1}'
        want = {"k": json.loads('"' + value.replace('"', '\\"') + '"'), "n": 1}
        for tail in ("", " and so on", " {"):
            found, how = J.loose_object(told + tail)
            assert json.loads(found) == want and how in ("whole", "embedded", "repaired")
            assert (how == "repaired") == ('"' in value)


def test_escaping_leaves_legal_json_alone():
    for value in ["", 'say "x"', "\\", "a: {b}, [c]", "\n\t", "é”"]:
        text = json.dumps({"a": value, "b": [value, {"c": value}]}, ensure_ascii=False)
        assert J.escaped(text) == text and J.balanced(text, 0) == text


def test_json_columns(spark):
    rows = [(1, '{"a": 1}'), (2, "x {\"a\": 2} y"), (3, None), (4, "none"), (5, '{"a": 3, "b": "p "q" r"}')]
    got = spark.createDataFrame(rows, "id int, text string").select("id", J.read("text", "a int, b string").alias("j")).collect()
    assert {r.id: r.j and tuple(r.j) for r in got} == {1: (1, None), 2: (2, None), 3: None, 4: None, 5: (3, 'p "q" r')}


def replay(rounds, max_repairs=2, allowed=2):
    """One chapter, round by round."""
    best, error, verdict, styled, reviewed, used, more = None, None, None, 0, 0, 0, True
    while more:
        if used == len(rounds):
            return ("in_progress", used, None, None, None)
        used += 1
        v, findings, flagged = rounds[used - 1]
        more = False
        if v is None:
            error = "writer failed"
        elif v == "reject":
            verdict, error = v, "gate rejected"
        else:
            verdict = v
            if v == "repair":
                more = True
            else:
                if best is None or findings < best[1] or (findings == best[1] and best[2] and not flagged):
                    best = (used, findings, flagged)
                if findings > allowed and not styled:
                    styled, more = 1, True
                if flagged and not reviewed:
                    reviewed, more = 1, True
        more = more and used <= max_repairs
    if best:
        return ("committed", used, best[0], "pass", None)
    return ("failed" if error else "rolled_back", used, None, verdict or "reject", error or "repairs used up")


@pytest.mark.parametrize("max_repairs", [0, 2, 3])
def test_every_course_of_a_transaction(spark, max_repairs):
    """All sequences of up to three rounds over the verdicts, findings and flags that matter, and some of four."""
    kinds = [(None, 0, False), ("reject", 0, False), ("repair", 1, False)] + [("pass", f, g) for f in (0, 3, 5) for g in (False, True)]
    courses = [c for n in (1, 2, 3) for c in itertools.product(kinds, repeat=n)]
    rng = np.random.default_rng(2)
    courses += [tuple(kinds[i] for i in rng.integers(0, len(kinds), 4)) for _ in range(200)] + [(kinds[2],) * 4]
    rows = [("b", at, k + 1, *r, None) for at, course in enumerate(courses) for k, r in enumerate(course)]
    attempts = spark.createDataFrame(rows, "book string, ord int, attempt int, verdict string, findings int, flagged boolean, error string")
    got = {r.ord: (r.status, r.attempts, r.chosen, r.verdict, r.error) for r in X.settled(attempts, max_repairs).collect()}
    for at, course in enumerate(courses):
        assert got[at] == replay(course, max_repairs), course
    assert {s for s, *_ in got.values()} == {"committed", "failed", "rolled_back"} | ({"in_progress"} if max_repairs else set())


def test_commit_and_roll_back(spark):
    schema = "book string, ord int, attempt int, verdict string, findings int, flagged boolean, error string"
    rows = [("b", 1, 1, "repair", 0, False, None), ("b", 1, 2, "pass", 1, False, None), ("b", 2, 1, None, None, None, "timeout"), ("b", 3, 1, "pass", 0, None, None), ("b", 3, 1, "pass", 4, None, None), ("b", 4, 2, "pass", 0, False, None), ("b", 5, 1, "pass", 0, False, None)]
    records = X.recorded(X.settled(spark.createDataFrame(rows, schema)), spark.createDataFrame([("b", 3), ("b", 2)], "book string, ord int"))
    got = {r.ord: (r.status, r.attempts, r.chosen, r.error) for r in records.collect()}
    # chapter 4 has no first round: nothing is known of it; chapter 3 passed, but the store refused it
    assert got == {1: ("committed", 2, 2, None), 2: ("failed", 1, None, "timeout"), 3: ("failed", 1, None, "commit refused"), 4: ("in_progress", 0, None, None), 5: ("committed", 1, 1, None)}
    texts = spark.createDataFrame([("b", i, k, f"new {i}.{k}") for i in range(1, 6) for k in (1, 2)], "book string, ord int, attempt int, text string")
    before = spark.createDataFrame([("b", 1, "old 1", "draft"), ("b", 2, "old 2", "human-confirmed"), ("b", 3, "old 3", "draft"), ("c", 1, "other", "draft")], "book string, ord int, text string, status string")
    after = {(r.book, r.ord): (r.text, r.status) for r in X.manuscripts_after(records, texts, before).collect()}
    assert after == {("b", 1): ("new 1.2", "auto-accepted"), ("b", 2): ("old 2", "human-confirmed"), ("b", 3): ("old 3", "draft"), ("b", 5): ("new 5.1", "auto-accepted"), ("c", 1): ("other", "draft")}
    assert {r.status for r in X.manuscripts_after(records, texts, before, auto_accept=False).filter("ord in (1, 5) and book = 'b'").collect()} == {"draft"}
    chapters = spark.createDataFrame([("b", i, "t", "event", f"first\nlast {i}") for i in range(1, 6)], "book string, ord int, title string, core_event string, text string")
    sums = {r.ord: (r.gist, r.source) for r in X.summaries_after(records, spark.createDataFrame([("b", 1, "told"), ("b", 2, "unread")], "book string, ord int, gist string"), chapters).collect()}
    assert sums == {1: ("told", "model"), 5: ("event；last 5", "mechanical")}
    cursors = X.cursors_after(records, spark.createDataFrame([("b", 2), ("c", 9), ("d", None)], "book string, cursor int")).collect()
    assert {r.book: r.cursor for r in cursors} == {"b": 5, "c": 9, "d": 0}
    assert [r.ord for r in X.unsteady(records, 2).collect()] == [3]
    empty = X.settled(spark.createDataFrame([], schema))
    assert empty.count() == 0
    with pytest.raises(ValueError, match="max_repairs"):
        X.settled(spark.createDataFrame([], schema), -1)
