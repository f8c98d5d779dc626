import random

import numpy as np

from ledgerloom.llm import near_copies, simhash_dedup
from ledgerloom.llm.near_copies import LIKENESS, buckets, keep_one, keep_one_of_both, shingle_sets
from llm_helpers import ODD_TEXTS, words


def shingles(text):
    w = words((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= LIKENESS * len(a | b)


def edited(text, pick, changes):
    w = text.split()
    for _ in range(changes):
        w[pick.randrange(len(w))] = "changed" + str(pick.randrange(999))
    return " ".join(w)


def kept_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])]
    group = {i: i for i in sets}
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return {i for i in group if group[i] == i}


def test_near_copies_against_all_pairs(documents, prose):
    pick = random.Random(6)
    rows = [(i, prose(i, 40 + 9 * i)) for i in range(20)]
    rows += [(100 + 20 * c + i, edited(t, pick, c)) for c in (1, 2, 3, 5) for i, t in rows[:20]]
    rows += [(300, rows[3][1].upper()), (301, "short one"), (302, "Short one"), (303, "short two")]
    rows += [(400 + k, t) for k, t in enumerate(ODD_TEXTS)]
    chain = rows[7][1].split()
    rows += [(500 + k, " ".join([*chain[4 * k :], *prose(90 + k, 4 * k).split()])) for k in range(8)]  # links of a chain
    docs = documents(rows, odd=True)
    kept = keep_one(docs).collect()
    assert {r["doc_id"] for r in kept} == kept_by_hand(rows) and kept[0]["a.b"] == "x"
    # Copies that differ in more bits than op8 links.
    assert len(kept) < simhash_dedup.keep_one(docs).count() - 20


def test_turns_change_no_group(documents, prose, monkeypatch):
    """Copies that are alike to what they were edited from, but not to each other."""
    pick = random.Random(11)
    base = prose(5, 120)
    rows = [(k, edited(base, pick, 2)) for k in range(60)] + [(99, base)]
    rows += [(200 + k, edited(prose(6, 120), pick, 7)) for k in range(40)]  # hardly any two alike
    pairs, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda r, p, asked, n: pairs.append(asked.count()) or links(r, p, asked, n))
    kept = {}
    for turns in (0, 4):
        pairs.clear()
        kept[turns] = {r["doc_id"] for r in keep_one(documents(rows), turns).collect()}, sum(pairs)
    assert kept[0][0] == kept[4][0] == kept_by_hand(rows) and kept[4][1] < kept[0][1]


def test_candidates_meet(prose):
    pick = random.Random(9)
    pairs = [(t, edited(t, pick, n // 45)) for n in (50, 100, 300) for t in (prose(1000 * n + k, n) for k in range(60))]
    pairs = [(a, b) for a, b in pairs if alike(shingles(a), shingles(b))]
    left, right = (buckets(shingle_sets([p[k].encode() for p in pairs])) for k in (0, 1))
    assert len(pairs) > 100 and (left == right).any(1).mean() > 0.99


def test_repeated_rows_and_no_rows(documents):
    docs = documents([(1, "same words here"), (1, "same words here"), (1, "other words here now"), (2, "same words here")])
    assert sorted(r["text"] for r in keep_one(docs).collect()) == ["other words here now", "same words here"]
    assert keep_one(documents([])).collect() == [] and not np.any([len(s) for s in shingle_sets([b"", b" "])])


def test_prints_and_sets_close_groups_together(documents, prose):
    # Prints weigh repeats, so 1 and 2 differ in their sets alone; 3 is an edit of 2 by few repeated words.
    repeated = "one two three " * 400
    tails = [prose(k, 12) for k in (31, 32)]
    rows = [(1, repeated + tails[0]), (2, repeated + tails[1]), (3, "one two three " * 3 + tails[1])]
    rows += [(4, prose(33, 80)), (5, prose(34, 80))]
    prints = {i: simhash_dedup.fingerprint(t.lower().encode().split()) for i, t in rows}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 < (prints[2] ^ prints[3]).bit_count()
    assert not alike(shingles(rows[0][1]), shingles(rows[1][1])) and not alike(shingles(rows[0][1]), shingles(rows[2][1]))
    assert alike(shingles(rows[1][1]), shingles(rows[2][1]))
    assert kept_by_hand(rows) == {1, 2, 4, 5}
    assert {r.doc_id for r in keep_one_of_both(documents(rows)).collect()} == {1, 4, 5}
    assert keep_one_of_both(documents([*rows, *rows])).count() == 3


def test_what_has_led_its_bucket_is_not_compared_again(documents, prose, monkeypatch):
    """Texts that share a bucket but aren't alike: the first turn compares all pairs of two and three of them."""
    pick = random.Random(12)
    rows = [(10 * k + i, edited(prose(70 + k, 120), pick, 9 * i)) for k in range(30) for i in range(2)]
    apart, across = [], near_copies._across
    monkeypatch.setattr(near_copies, "_across", lambda r, p, rest: apart.append(rest.count()) or across(r, p, rest))
    kept = {r["doc_id"] for r in keep_one(documents(rows)).collect()}
    assert kept == kept_by_hand(rows) and apart == [0]


def test_links_of_prints_and_sets_need_no_groups_of_their_own(documents, prose, monkeypatch):
    """Groups are closed once over the links of both; with nothing alike by sets, in one run."""
    runs, closed = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda links: runs.append(1) or closed(links))
    monkeypatch.setattr(simhash_dedup, "components", None)
    rows = [(k, prose(200 + k, 60)) for k in range(6)] + [(10, "one two three " * 400 + "tail"), (11, "one two three " * 300)]
    prints = [simhash_dedup.fingerprint(t.lower().encode().split()) for _, t in rows[-2:]]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    assert {r.doc_id for r in keep_one_of_both(documents(rows)).collect()} == {*range(6), 10} and len(runs) == 1
