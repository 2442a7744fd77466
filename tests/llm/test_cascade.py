"""The rule cascade: counts against plain versions, verdicts that do not hang on the order, and the order's own rule."""

import random
import re

import pytest

from pagevault.llm import cascade
from pagevault.llm.common import WordHashes

from cases import clashing, documents, odd_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    own = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(own) - 7):
        seen.setdefault(tuple(own[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            covered.update(i + j for i in starts for j in range(8))
    return {
        "n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_letters": len(re.findall("[A-Za-z]", text)), "n_capitals": len(re.findall("[A-Z]", text)), "n_same_words": sum(a == b for a, b in zip(own, own[1:])),
    }


def texts():
    rng = random.Random(5)
    menu = "\n".join(f"{words(rng, 1)} | {words(rng, 1)} | more" for _ in range(30))
    chorus = "\n".join(["the same line of words comes again and again"] * 12 + [words(rng, 15)])
    loud = words(rng, 50).upper()
    blanks = "a\x0bb\x0cc\rd\te f g\x1fh" * 30
    shifted = words(rng, 40)
    return [*odd_texts(), menu, chorus, loud, blanks, "na " * 9, "na " * 400, f"{shifted} x {shifted}", "\n\n \n" * 50, words(rng, 19), words(rng, 20), "*" * 300 + " 漢" * 30]


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_counts(monkeypatch, part):
    monkeypatch.setattr(cascade, "PART", part)
    for text in texts():
        counts = cascade.Counts((text or "").encode(), WordHashes())
        want = plain(text)
        assert {name: counts[name] for name in want} == want


def test_verdicts_do_not_hang_on_the_order(spark):
    df = clashing(documents(spark, texts())).repartition(3)
    want = sorted((i, not any(r.fails(plain(t)) for r in cascade.RULES)) for i, t in enumerate(texts()))
    assert {k for _, k in want} == {True, False}
    learnt = cascade.plan(df)
    assert set(learnt.rules) == set(cascade.RULES) and len(learnt.rejects) == len(learnt.costs) == len(cascade.RULES)
    for order in (learnt, cascade.Plan(cascade.RULES), cascade.Plan(cascade.RULES[::-1])):
        out = cascade.judge(df, order, with_counts=cascade.REPORTED)
        assert sorted((r.doc_id, r.kept) for r in out.collect()) == want
        rest = cascade.kept_rows(df, order)
        assert rest.columns == df.columns and sorted(r.doc_id for r in rest.collect()) == [i for i, k in want if k]
    for r in out.collect():
        assert {c: r[c] for c in cascade.REPORTED} == {c: plain(texts()[r.doc_id])[c] for c in cascade.REPORTED}


def test_short_circuit():
    """What no rule before the broken one asks for is not computed."""
    counts = cascade.Counts(b"too few", WordHashes())
    assert cascade.Plan(cascade.RULES).broken(counts) == cascade.RULES[0] and set(counts) == {"n_words"}


def test_order_by_rejection_per_cost():
    a, b, c = (cascade.Rule(n, p, 1) for n, p in (("a", "n_symbols"), ("b", "n_capitals"), ("c", "n_same_words")))
    cheap, dear = {"n_symbols": 1e3, "n_capitals": 1e3, "hashes": 1e6}, {"n_symbols": 1e5, "n_capitals": 1e5, "hashes": 1e8}
    # c rejects most but costs more; b rejects only what a rejects, so it comes last
    plan = cascade.ordered((a, b, c), [(0, 10, cheap), (0b011, 30, dear), (0b001, 10, dear), (0b100, 50, dear)])
    assert [r.name for r in plan.rules] == ["a", "c", "b"] and plan.rejects == (0.4, 50 / 60, 0.0)
    shared = (cascade.Rule("x", "n_repeat_words", 1), cascade.Rule("y", "n_same_words", 1), b)
    plan = cascade.ordered(shared, [(0, 50, {"hashes": 5e7, "n_capitals": 3e6}), (0b001, 20, {}), (0b010, 6, {}), (0b100, 5, {})])
    assert [r.name for r in plan.rules] == ["b", "x", "y"] and plan.costs[2] == cascade.COMPARING  # the hashes are there already


def test_empty_table_and_nulls(spark):
    from cases import COLUMNS

    none = spark.createDataFrame([], COLUMNS)
    assert cascade.judge(none, cascade.plan(none)).count() == 0
    rows = [(None, None, None, None, None), (1, words(random.Random(1), 40), None, None, None), (1, words(random.Random(1), 40), None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(repr, map(tuple, cascade.judge(df, cascade.plan(df)).collect()))) == ["(1, True)", "(1, True)", "(None, False)"]
