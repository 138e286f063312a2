"""Leaks planted in documents are found, and nothing else."""

import random

import pytest

from quillspan.llm import leakage as L

R = random.Random(8)
VOCABULARY = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ale", "orn", "ist", "und", "eck", "ovi", "amp", "ury")]
ITEM = " ".join(R.choice(VOCABULARY) for _ in range(60)) + " in 40 days and 40 nights"
OTHER = " ".join(R.choice(VOCABULARY) for _ in range(60))
FILL = " ".join(R.choice("the a panel report data was will be sent of to in shared".split()) for _ in range(150))
WORDS = ITEM.split()


def planted(part):
    return f"{FILL}. {part} {FILL}"


def changed(every, at):
    return " ".join("other" if i % every == at else w for i, w in enumerate(WORDS))


CASES = {
    "whole": (planted(ITEM), True),
    "upper": (planted(ITEM.upper()), True),
    "markup": (planted("<p>" + ITEM.replace(" ", " <b> </b>\n", 9) + "</p>&nbsp;"), True),
    "long tag": (planted(ITEM.replace(" ", f' <b class="{"x y " * 100}">', 1)), True),
    "punctuation": (planted(", ".join(WORDS)), True),
    "third": (planted(" ".join(WORDS[10:34])), True),
    "changed here and there": (planted(changed(9, 4)), True),
    "every fifth changed": (planted(changed(5, 2)), True),
    "every fourth changed": (planted(changed(4, 1)), True),
    "left out here and there": (planted(" ".join(w for i, w in enumerate(WORDS) if i % 9 != 4)), True),
    "every fifth left out": (planted(" ".join(w for i, w in enumerate(WORDS) if i % 5 != 4)), True),
    "added here and there": (planted(" ".join(w + (" other" if i % 7 == 4 else "") for i, w in enumerate(WORDS))), True),
    "less than a third": (planted(" ".join(WORDS[10:29])), False),
    "two short runs": (planted(" ".join(WORDS[0:15]) + " " + FILL + " " + " ".join(WORDS[30:45])), False),
    "shuffled": (planted(" ".join(R.sample(WORDS, len(WORDS)))), False),
    "nothing": (FILL, False),
    "re-parameterised": (planted(ITEM.replace("40", "90")), True),
    "short repeats after a run": (planted(" ".join(WORDS[10:34])) + (" " + " ".join(WORDS[0:7])) * 60, True),
    "short repeats before a run": ((" ".join(WORDS[0:7]) + " ") * 60 + planted(" ".join(WORDS[10:34])), True),
}


def find(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in L.find_leaks(d, i, **kw).collect()}


@pytest.fixture(scope="module")
def found(spark):
    return find(spark, [(k, CASES[c][0]) for k, c in enumerate(CASES)] + [(100, planted(ITEM.replace("40", "90", 1)))], [(1, ITEM), (2, OTHER)])


@pytest.mark.parametrize("case", CASES)
def test_case(found, case):
    k = list(CASES).index(case)
    assert [i for d, i in found if d == k] == [1] * CASES[case][1]


def test_slots(found):
    r = found[list(CASES).index("re-parameterised"), 1]
    assert r.share == 1 and r.density == 1 and (r.slots, r.changed_slots, r.consistent) == (3, 2, True)
    r = found[100, 1]
    assert r.density < 1 and r.changed_slots == 1 and not r.consistent


def test_recall_of_edited_copies(spark):
    docs = [(k, planted(changed(5, k % 5)) if k < 5 else planted(" ".join("other" if R.random() < 0.2 else w for w in WORDS))) for k in range(100)]
    assert len(find(spark, docs, [(1, ITEM)])) >= 90


def test_query(spark):
    names = list(CASES)
    data = [(i, CASES[c][0]) for i, c in enumerate(names)] + [(100, None), (101, ""), (102, planted(ITEM)), (102, planted(ITEM)), (103, FILL * 300 + ITEM)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in data], "doc_id long, text string, item_id string, share double")
    items = spark.createDataFrame([(1, ITEM, "clash"), (2, OTHER, "clash"), (3, None, ""), (4, "", "")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id) for r in L.find_leaks(docs, items).collect())
    assert got == sorted([(i, 1) for i, c in enumerate(names) if CASES[c][1]] + [(102, 1)] * 2 + [(103, 1)])
    assert L.find_leaks(docs.limit(0), items).collect() == [] and L.find_leaks(docs, items.limit(0)).collect() == []


def test_company_of_items_does_not_matter(spark):
    a = "the panel met Brenda in the yard and gave her brass keys before supper near the old mill gate"
    b = "then the clerk met Arthur in a cold hall and gave him paper keys after breakfast near that new mill pond"
    docs = [(1, a.replace("Brenda", "Carla")), (2, b.upper()), (3, a.lower())]
    alone = find(spark, docs, [(1, a)]) | find(spark, docs, [(2, b)])
    assert set(alone) == {(1, 1), (2, 2), (3, 1)}
    assert set(find(spark, docs, [(1, a), (2, b)])) == set(alone)
    assert set(find(spark, docs, [(1, a), (2, b)], broadcast_windows=0)) == set(alone)


def test_random_numbers_leak_nothing(spark):
    def numbers(n):
        return " ".join(str(R.randint(1, 10**6)) for _ in range(n))

    items = [(k, numbers(40)) for k in range(50)]
    assert find(spark, [(1, numbers(200)), (2, items[7][1])], items).keys() == {(2, 7)}


def test_one_word_over_and_over(spark):
    assert find(spark, [(1, "ha " * 3_000)], [(1, "ha " * 30)]).keys() == {(1, 1)}


def test_short_items(spark):
    assert find(spark, [(1, "well, this is it then"), (2, ""), (3, "this is")], [(7, "this is it")]).keys() == {(1, 7)}
