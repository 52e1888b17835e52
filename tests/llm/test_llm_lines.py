import random
import re
import uuid

import pytest

from parlance.llm import common
from parlance.llm.line_dedup import Spread, line_dedup
from parlance.llm.quality_rules import Limits, quality_rules
from tests.llm.helpers import python_free


def repeat_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, three in enumerate(threes):
        if threes.count(three) > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c", "a a a a", "x a b c y a b c a b c", "\u00a0 b\x0bc"])
def test_signals(docs_of, text):
    row = quality_rules(docs_of((1, text))).first()
    assert row.n_repeat_words == repeat_words(text)
    assert row.base_failed and not row.kept


def test_counts(docs_of):
    row = quality_rules(docs_of((1, "a|b #1\n\na|b #1\nc\r\nc\r\n c"))).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (7, 13, 4, 2)


def spelled(n):
    return "".join(chr(97 + int(d)) for d in str(n))


def prose(seed, n=80):
    return " ".join(f"{spelled(seed)}x{spelled(i)}" for i in range(n))


def test_frequent_lines_go_and_depleted_documents_are_rejected(docs_of, with_clashes):
    limits = Limits(line_texts=3, line_percent=20)
    rows = [(i, "Shared  LINE 12\n" + prose(i), "a") for i in range(10)]
    rows += [(20, "shared line 12\n" * 40 + "x y", "a"), (21, "shared line 12\n" + prose(99), "b")]
    rows += [(22, prose(1), None), (23, None, "a")]
    got = quality_rules(with_clashes(docs_of(*rows)), limits=limits)
    assert python_free(got)
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 14
    assert all(by[i].kept and by[i].left_text == prose(i) for i in range(10))
    assert not by[20].kept and by[21].left_text.startswith("shared") and by[21].kept
    assert by[22].kept and not by[23].kept and by[23].left_text is None
    assert (by[0].n_frequent_lines, by[0].n_left_words, by[0].n_left_chars) == (1, 80, len(prose(0).replace(" ", "")))
    assert (by[20].n_frequent_lines, by[20].n_left_words, by[20].n_left_chars) == (40, 2, 2)
    assert (by[21].n_frequent_lines, by[23].n_frequent_lines, by[23].n_left_words) == (0, 0, 0)
    assert by[0].host == "own host"


def test_copies_are_one_text(docs_of):
    text = "\n".join(prose(i, 10) for i in range(10))
    rows = [(i, text, "a") for i in range(50)] + [(60, prose(7), "a")]
    assert all(r.kept for r in quality_rules(docs_of(*rows), limits=Limits(line_texts=3)).collect())


def test_a_text_that_is_too_short_without_frequent_lines_is_rejected(docs_of):
    line = prose(500, 15)
    rows = [(i, f"{line}\n{prose(i, 60 if i else 40)}", "a") for i in range(12)]
    by = {r.doc_id: r for r in quality_rules(docs_of(*rows)).collect()}
    assert all(not by[i].base_failed and by[i].n_frequent_lines == 1 for i in by)
    assert not by[0].kept and by[0].n_left_words == 40
    assert 2 * by[0].n_left_chars >= by[0].word_chars
    assert all(by[i].kept for i in range(1, 12))


@pytest.mark.parametrize("many, frequent", [(20, 0), (19, 1)])
def test_on_a_large_host_many_texts_are_enough(docs_of, many, frequent):
    # 20 of 300 texts are fewer than the share asks for.
    rows = [(i, ("the line\n" if i < 20 else "") + prose(i), "a") for i in range(300)]
    limits = Limits(line_texts=3, line_percent=10, many_texts=many)
    by = {r.doc_id: r for r in quality_rules(docs_of(*rows), limits=limits).collect()}
    assert {by[i].n_frequent_lines for i in range(20)} == {frequent}
    assert {by[i].n_frequent_lines for i in range(20, 300)} == {0}


def test_lines_that_differ_in_numbers_are_different_lines(docs_of):
    rows = [(i, "\n".join(f"row {i} has the value {n}" for n in range(20)), f"s{i}") for i in range(40)]
    judged = quality_rules(docs_of(*((i, t, "a") for i, t, _ in rows)), limits=Limits(line_texts=3))
    assert {r.n_frequent_lines for r in judged.collect()} == {0}
    assert {r.n_removed for r in line_dedup(docs_of(*rows)).collect()} == {0}


def compared(line):
    single = " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
    return re.sub("[A-Z]+", lambda m: m[0].lower(), single)


def without_spread(rows, min_sites):
    """Brute force: (n_lines, n_removed, left text) of each (text, site)."""
    sites, texts = {}, {}
    for text, site in rows:
        for line in filter(None, map(compared, (text or "").split("\n"))):
            if site is not None:
                sites.setdefault(line, set()).add(site)
                texts.setdefault(line, set()).add(text)
    spread = {line for line in sites if min(len(sites[line]), len(texts[line])) >= min_sites}
    out = []
    for text, _ in rows:
        parts = [(p, compared(p)) for p in (text or "").split("\n")]
        left = None if text is None else "\n".join(p for p, c in parts if c not in spread)
        n_lines = sum(bool(c) for _, c in parts)
        out.append((n_lines, sum(c in spread for _, c in parts), left))
    return out


def test_spread_lines_by_brute_force(docs_of):
    rng = random.Random(11)
    pool = [prose(i, 4) for i in range(12)] + ["", " \t", "SAME line", "same  LINE", "7 of 8", "7 of 9"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(6))) for _ in range(60)] + [None]
    rows = [(rng.choice(texts), rng.choice(["a", "b", "c", "d", None])) for _ in range(150)]
    got = line_dedup(docs_of(*((i, t, s) for i, (t, s) in enumerate(rows))), spread=Spread(min_sites=4))
    found = [(r.n_lines, r.n_removed, r.left_text) for r in sorted(got.collect(), key=lambda r: r.doc_id)]
    assert found == without_spread(rows, 4) and any(n for _, n, _ in found)


def test_what_is_stored_on_the_way_is_deleted(docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path / uuid.uuid4().hex))
    for operator in (line_dedup, quality_rules):
        got = operator(docs_of(*((i, f"the line\n{prose(i)}", f"s{i}") for i in range(12))))
        assert len(got.collect()) == 12
    assert len(list(tmp_path.iterdir())) == 2


def test_spread_lines_go(docs_of, with_clashes):
    rows = [(i, f"{prose(i, 20)}\nAll Rights  reserved\n\n{prose(i + 50, 20)}", f"s{i}") for i in range(12)]
    rows += [(20, "all rights reserved\nALL rights reserved", "s1"), (21, None, "s2"), (22, "only " + prose(1, 3), None)]
    # One text on many sites is left to near-dedup.
    rows += [(30 + i, f"{prose(70)}\n{prose(71)}", f"s{i}") for i in range(12)]
    rows += [(0, rows[0][1], "s0")]
    got = line_dedup(with_clashes(docs_of(*rows)))
    assert python_free(got)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    for i in range(12):
        assert by[i].left_text == f"{prose(i, 20)}\n\n{prose(i + 50, 20)}"
        assert (by[i].n_lines, by[i].n_removed) == (3, 1)
    assert all(by[30 + i].n_removed == 0 for i in range(12))
    assert (by[20].n_removed, by[20].left_text) == (2, "") and by[21].left_text is None and by[22].n_removed == 0


@pytest.mark.parametrize("sites", [8, 9, 10, 11, 12])
def test_near_the_threshold_counts_are_exact(docs_of, sites):
    rows = [(i, f"{prose(i, 9)}\nthe line", f"s{i % sites}") for i in range(24)]
    removed = {r.n_removed for r in line_dedup(docs_of(*rows), spread=Spread(min_sites=10, lg_k=4)).collect()}
    assert removed == ({1} if sites >= 10 else {0})


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules(empty).collect() == [] and line_dedup(empty).collect() == []


def test_long_text(docs_of):
    text = "\n".join(prose(i, 200) for i in range(400))
    row = quality_rules(docs_of((1, text))).first()
    assert row.n_words == 80_000 and row.kept
