import random

import pytest

from llm_helpers import ODD_TEXTS, words

from ledgerloom.llm.substring_dedup import remove_repeated


def by_hand(rows, window):
    """Kept words of each row, by comparing all windows; a null id is the largest."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), order(i))
    found = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        found.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(found, key=repr)


def found(df):
    rows = df.select("row.doc_id", "n_words", "n_removed", "kept").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("window", [4, 7, 12])
def test_against_all_windows(documents, prose, window):
    pick = random.Random(window)
    passages = [prose(100 + k, pick.randint(2, 30)) for k in range(8)]
    rows = []
    for i in range(60):
        parts = [pick.choice(passages) if pick.random() < 0.5 else prose(1000 + i * 7 + k, pick.randint(1, 15)) for k in range(4)]
        rows.append((i * 3, "\n".join(parts)))
    rows += [(500 + k, t) for k, t in enumerate(ODD_TEXTS)]
    rows += [(600, "a b " * 60), (601, "b a " * 50), (602, "a " * 90), (603, "a " * 91)]  # periodic
    rows += [(700 + k, rows[5][1]) for k in range(5)]  # copies
    rows += [(2, rows[9][1]), (2, rows[9][1]), (2, passages[0] + " " + passages[1]), (None, rows[7][1])]  # shared and null ids
    pick.shuffle(rows)
    df = remove_repeated(documents(rows, odd=True), window, one_space=True)
    assert found(df) == by_hand(rows, window)


def test_layout_is_kept_and_columns_pass(documents, prose):
    passage = prose(1, 60)
    docs = documents([(1, passage), (2, f"start here\n{passage}\nthe  end")], odd=True)
    rows = {r["row"]["doc_id"]: r for r in remove_repeated(docs).collect()}
    assert rows[2]["kept"] == "start here\nthe  end"
    assert rows[1]["kept"] == passage
    assert rows[2]["row"]["a.b"] == "x" and rows[2]["row"]["order"] == "x"


def test_empty_table(documents):
    assert remove_repeated(documents([])).collect() == []


def test_many_equal_rows_and_a_long_text(documents, prose):
    passage, long = prose(1, 60), prose(3, 200_000)
    rows = [(1, passage)] + [(2, f"{passage} {prose(2, 30)}")] * 10_000 + [(3, long), (4, f"x {long} y")]
    result = {}
    for r in found(remove_repeated(documents(rows))):
        result.setdefault(r[:3], 0)
        result[r[:3]] += 1
    assert result == {(1, 60, 0): 1, (2, 90, 60): 10_000, (3, 200_000, 0): 1, (4, 200_002, 200_000): 1}


def test_no_candidate_survives(documents, prose):
    rows = [(k, prose(10 + k, 80)) for k in range(5)] + [(9, prose(10, 80))]
    assert [r[2] for r in found(remove_repeated(documents(rows)))] == [0, 0, 0, 0, 0, 80]
