"""Problem 8: evaluation passages in documents."""

import random

from permeate.llm.leakage import PassageIndex, find_leaks, item_texts, offsets, squeeze

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{i}" for i in range(70)]
PASSAGE = " ".join(WORDS[:60]) + "."
INDEX = PassageIndex([(7, PASSAGE), (8, " ".join(reversed(WORDS)))])


def items(text):
    return [(i, w) for i, w, *_ in INDEX.find(text)]


def test_whole_and_part():
    assert items("before " + PASSAGE + " after") == [(7, 60)]
    assert items("before " + " ".join(WORDS[10:40]) + " after")[0][0] == 7
    assert items("before " + " ".join(WORDS[10:25]) + " after") == []


def test_changed_words():
    words = WORDS[5:50]
    for k in range(3, 45, 9):
        words[k] = "other"
    assert items("x " + " ".join(words) + " y")[0][0] == 7
    words = WORDS[5:50]
    for k in range(0, 45, 4):
        words[k] = "other"
    assert items(" ".join(words)) == []


def test_forms():
    part = WORDS[8:40]
    assert items(" ".join(part).upper())
    assert items("; ".join(part))
    assert items("".join(f"<b>{w}</b>&nbsp;\n" for w in part))
    broken = " ".join(part).replace("x2", "-\nx2")
    assert items(broken)
    dropped = part[:10] + part[11:20] + ["extra"] + part[20:]
    assert items(" ".join(dropped))


def test_offsets_point_into_the_original():
    text = "Lead <i>in</i>: " + "; ".join(w.title() for w in WORDS[:30]) + ". Tail"
    (_, _, _, a, b), *_ = INDEX.find(text)
    assert text[a:b].startswith("Wa") and squeeze(text[a:b]).endswith(squeeze(WORDS[29]))
    assert len(offsets(text)) == len(squeeze(text))


def test_random_windows_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        n, a = rng.randint(10, 50), rng.randint(0, 10)
        n = min(n, 60 - a)
        words = ["lead%d" % i for i in range(5)] + WORDS[a : a + n] + ["tail%d" % i for i in range(5)]
        found = bool([x for x in items(" ".join(words)) if x[0] == 7])
        # words beside the match may count as changed ones, at most one in eight
        best = max((n + e for e in range(0, 7) if (n + e) // 8 >= e and n + min(e, 3 + 3) <= 60), default=n)
        if n >= 25:
            assert found
        if best < 25:
            assert not found


def test_table(spark):
    docs = spark.createDataFrame([(1, "a " + PASSAGE, 5), (1, "a " + PASSAGE, 5), (2, None, 1), (3, "", 1), (4, "pad " * 20000 + PASSAGE, 1)], "doc_id long, text string, item_id int")
    evals = spark.createDataFrame([(7, PASSAGE), (8, None), (9, "too short")], "item_id long, text string")
    want = [(1, 7), (1, 7), (4, 7)]
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, evals).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, evals, max_items=1).collect()) == want
    assert find_leaks(docs.limit(0), evals).count() == 0 and find_leaks(docs, evals.limit(0)).count() == 0


def test_random_changes_against_brute_force():
    rng = random.Random(8)
    cases = [(25, {8, 11}), (25, {5, 7, 20}), (32, {12, 13, 14, 15}), (25, {7, 12, 18})]
    for _ in range(300):
        n = rng.randint(25, 50)
        cases.append((n, set(rng.sample(range(n), rng.randint(0, n // 8)))))
    for n, changed in cases:
        words = [f"other{k}" if k in changed else w for k, w in enumerate(WORDS[4 : 4 + n])]
        (found,) = [x for x in INDEX.find("lead " + " ".join(words) + " tail") if x[0] == 7]
        assert found[1] >= n and found[2] * 8 <= found[1]


def test_too_many_changes_are_no_case():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(25, 50)
        changed = {k + rng.randrange(5) for k in range(0, n, 6)}
        kept = [k not in changed for k in range(n)]
        # brute force: windows of at least 25 of the 60 words, all words outside the quotation being changed
        flags = [False] * 4 + kept + [False] * (56 - n)
        want = any((b - a) >= 25 and flags[a:b].count(False) * 8 <= b - a for a in range(60) for b in range(a + 25, 61))
        words = [w if ok else f"other{k}" for k, (w, ok) in enumerate(zip(WORDS[4 : 4 + n], kept))]
        assert bool(items("lead " + " ".join(words) + " tail")) == want


def test_questions_and_answers_count_in_whole():
    question, answer = "At which pH was the scaffold protein of Galkin kept before freezing?", "It was kept at pH seven in the apo form of the third helix, as seen in mutants."
    index = PassageIndex([(1, question, "question"), (1, answer, "answer"), (1, "no", "answer"), (2, PASSAGE, "passage")])
    parts = lambda text: [(h[0], h[1]) for h in index.find_parts(text)]
    assert parts("Lead. " + question.upper() + " Tail.") == [(1, "question")]
    assert parts("Lead. " + question.replace("scaffold", "other") + " Tail.") == [(1, "question")]
    assert parts("Lead. " + " ".join(question.split()[:9]) + " Tail.") == []
    assert parts(f"{answer.replace('third', 'fourth')} {PASSAGE} no") == [(1, "answer"), (2, "passage")]
    rng = random.Random(3)
    words = answer.split()
    for _ in range(100):  # one change in eight, anywhere
        changed = set(rng.sample(range(len(words)), len(words) // 8))
        assert parts("lead " + " ".join(f"other{k}" if k in changed else w for k, w in enumerate(words)) + " tail") == [(1, "answer")]


def test_parts_in_a_table(spark):
    docs = spark.createDataFrame([(1, "a " + PASSAGE), (2, "the whole question of seven words stands here")], "doc_id long, text string")
    evals = spark.createDataFrame([(7, PASSAGE, "the whole question of seven words stands", None)], "item_id long, passage string, question string, answer string")
    assert sorted((r.doc_id, r.item_id, r.part) for r in find_leaks(docs, item_texts(evals)).collect()) == [(1, 7, "passage"), (2, 7, "question")]
