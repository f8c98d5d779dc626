import random

import pytest
import xxhash

from ledgerloom.llm.graphs import components
from ledgerloom.llm.simhash_dedup import fingerprint, keep_one, links, near_duplicates
from llm_helpers import ODD_TEXTS, words


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def by_hand(text):
    w = lowered(text).split()
    size = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(len(w) - size + 1 if w else 0)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(pairs, nodes):
    """Smallest reachable node of each node."""
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def test_fingerprint(prose):
    for text in [*ODD_TEXTS, "One two", "A b A b A b", prose(1, 70), "é ü " + prose(2, 9)]:
        assert fingerprint(lowered(text).split()) == by_hand(text)
    assert fingerprint(words(prose(3, 40)) * 3) != 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowded", [512, 2])
def test_links_are_all_pairs_within_two_bits(spark, crowded):
    pick = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        base = pick.getrandbits(64)
        for _ in range(6):  # near copies, also over the edges of the halves and of what the code covers
            places = pick.sample([0, 30, 31, 32, 62, 63, pick.randint(1, 29)], pick.randint(0, 3))
            prints.add(base ^ sum(1 << b for b in places))
    half = pick.getrandbits(32)
    prints |= {pick.getrandbits(32) << 32 | half for _ in range(30)}  # one half in common
    df = spark.createDataFrame([(signed(p),) for p in [*prints, *list(prints)[:9]]], "print long")
    found = {tuple(r) for r in links(df, crowded).collect()}
    expected = {
        tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2
    }
    assert found == expected and len(found) > 50


def test_components_of_chains_hubs_and_loops(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    random.Random(1).shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 5), (6, None)], "a long, b long")
    expected = closed([p for p in pairs if p[0] != p[1]], {n for p in pairs if p[0] != p[1] for n in p})
    assert {r["node"]: r["component"] for r in components(df).collect()} == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_against_all_pairs(documents, prose):
    rows = [(i * 2 + 1, prose(i, 60)) for i in range(30)]
    rows += [(200 + i, t + " extra") for i, (_, t) in enumerate(rows[:10])] + [(400 + i, t.upper()) for i, (_, t) in enumerate(rows[5:9])]
    rows += [(500 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(3, prose(77, 30)), (None, rows[2][1]), (None, "alone here")]
    prints = [by_hand(t) for _, t in rows]
    order = [1 << 62 if i is None else i for i, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    group = closed(pairs, range(len(rows)))
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, 1 << 62), order[k])
    public = lambda x: None if x == 1 << 62 else x
    expected = sorted((i, f"{prints[k]:016x}", public(least[group[k]])) for k, (i, _) in enumerate(rows) if i is not None)
    docs = documents(rows, odd=True)
    found = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(r for r in found if r[0] is not None) == expected
    assert sorted(str(r[2]) for r in found if r[0] is None) == ["5", "None"]
    kept = keep_one(docs).collect()
    assert len(kept) == len(set(group.values())) and kept[0]["a.b"] == "x"


def test_one_row_of_each_group_stays_whatever_repeats(documents):
    docs = documents([(1, "same words here"), (1, "same words here"), (1, "other words here now"), (2, "same words here")])
    assert sorted(r["text"] for r in keep_one(docs).collect()) == ["other words here now", "same words here"]
    assert near_duplicates(documents([])).collect() == [] and keep_one(documents([])).collect() == []
