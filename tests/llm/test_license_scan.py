import random
import re

import pytest

from ledgerloom.llm.license_rules import Rule, rules
from ledgerloom.llm.frames import identified
from ledgerloom.llm.license_scan import BASE, SPAN, _detections, _with_words, scan
from llm_helpers import ODD_TEXTS, alnum_words


def by_hand(rows, signatures):
    compiled = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in signatures]
    out = []
    for i, text in rows:
        w = [x.decode() for x in alnum_words(text)]
        at, labels = [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            places = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += places
            labels |= {label} if places else set()
        line = " " + " ".join(w) + " " if w else " "
        found = sorted((m.start(), -m.end(), r.priority, r.label, r.confidence) for r, c in compiled for m in c.finditer(line))
        outer = [e for k, e in enumerate(found) if all(-f[1] < -e[1] for f in found[:k])]
        standing = [e for e in outer if not any(o[0] < -e[1] and -o[1] > e[0] and o[2] < e[2] for o in outer)]
        score = max([0.0, *(e[4] for e in standing), *([0.6] if labels else [])])
        all_labels = labels | {e[3] for e in standing}
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(all_labels)), score))
    return sorted(out, key=repr)


LINES = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.",
    "CC-BY 4.0",
    "cc by cc by",
    "This work is licensed under CC BY-NC-SA 4.0",
    "GNU General Public License, version 3",
    "the GNU Lesser General Public License v2.1",
    "All rights reserved. all  RIGHTS\nreserved",
    "SPDX-License-Identifier: BSD-3-Clause",
    "Copyright (c) 2019 the authors",
    "creative commons attribution share alike license version 3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit freundlichen; permit licenses",
    "ＡＬＬ rights reservedé all rights",
]


def test_against_plain_regexes(documents, prose):
    pick = random.Random(2)
    rows = [(i, "\n".join(pick.choice(LINES) if pick.random() < 0.5 else prose(50 * i + k, 6) for k in range(6))) for i in range(80)]
    rows += [(100 + k, t) for k, t in enumerate([*LINES, *ODD_TEXTS])]
    rows += [(4, LINES[2]), (4, LINES[2]), (None, LINES[0]), (300, "all rights reserved " * 700)]
    found = sorted((tuple(r) for r in scan(documents(rows, odd=True)).collect()), key=repr)
    assert found == by_hand(rows, rules())


def test_priority_and_containment(documents):
    signatures = [
        Rule(0, "ab", "a b", "a b", 0.9),
        Rule(1, "abc", "b c", "a b c", 0.8),
        Rule(2, "cd", "c d", "c d", 0.5),
        Rule(3, "same", "a b c", "a b c", 0.7),
    ]
    rows = [(1, "a b"), (2, "a b c"), (3, "a b c d"), (4, "c d a b")]
    found = {r["doc_id"]: r["labels"] for r in scan(documents(rows), signatures).collect()}
    # The longer one covers the better one inside; of equal ones and of partial overlaps the better stands.
    assert found == {1: "ab", 2: "abc", 3: "abc", 4: "ab,cd"}


def test_any_two_that_overlap(documents):
    # Of three that all overlap the best is no neighbour of the last.
    signatures = [Rule(1, "a", "aa", "aa bb cc dd", 0.9), Rule(5, "b", "bb", "bb cc dd ee", 0.8), Rule(3, "c", "cc", "cc dd ee ff", 0.7)]
    rows = [(1, "aa bb cc dd ee ff"), (2, "bb cc dd ee ff"), (3, "cc dd ee ff aa bb cc dd")]
    found = {r["doc_id"]: r["labels"] for r in scan(documents(rows), signatures).collect()}
    assert found == {1: "a", 2: "c", 3: "a,c"}


def test_matches_have_a_bound():
    assert max(re._parser.parse(r.pattern).getwidth()[1] for r in rules()) < SPAN


def test_many_repeats_of_what_rules_repeat(documents):
    """Very long texts of one phrase; a pattern that loops by recursion ends the session."""
    n = 100_000
    texts = [f"creative commons attribution{part * n}" for part in (" license", " international", " licence unported")]
    texts += [f"creative commons attribution v4 0{' generic' * n}", "all rights reserved " * n, "licensed under the " * n]
    texts += ["without prior written permission " * n, "neither the name of " + "x " * n, "may not be reproduced " + "y" * n]
    rows = scan(documents(list(enumerate(texts)))).collect()
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[0] == labels[1] == labels[2] == "cc-by" and labels[4] == "reserved" and rows[0]["n_words"] > 0


def test_keywords_stand_in_their_patterns():
    assert len(rules()) > 200
    for rule in rules():
        plain = re.sub(r"\(\?:[^()]*\)(?:[?*]|{[^}]*})|\[sc\]|[()?:*]", "", rule.pattern)
        assert all(part[:4] in plain or part[:4] in rule.pattern for part in rule.keyword.split())


def test_empty_table(documents):
    assert scan(documents([])).collect() == []


@pytest.mark.parametrize("text, label", [("Apache License 2.0", "apache-2.0"), ("gnu gpl v3", "gpl"), ("see the LICENSE file for details", "license")])
def test_names(documents, text, label):
    (row,) = scan(documents([(1, text)])).collect()
    assert row["labels"] == label and row["n_base"] == 0


def samples(parsed):
    """Texts that a parsed pattern matches: a plain one, and one for each alternative, option and character."""
    plain, variants = [], []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(value)]
        elif name == "IN":
            own = ["x"] if str(value[0][0]) == "NEGATE" else [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
        elif name == "NOT_LITERAL":
            own = ["x"]
        elif name == "BRANCH":
            own = [t for branch in value[1] for t in samples(branch)]
        elif name == "SUBPATTERN":
            own = samples(value[3])
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            least, most, inner = value
            once = samples(inner)
            own = [once[0] * least, *once] if most > least else [t * least for t in once]
        variants += [(len(plain), t) for t in own[1:]]
        plain.append(own[0])
    return ["".join(plain), *("".join([*plain[:k], t, *plain[k + 1 :]]) for k, t in variants)]


def test_prefilter_hides_no_match(documents):
    signatures = rules()
    texts = sorted({t for r in signatures for t in samples(re._parser.parse(r.pattern))})
    lines = [f" {' '.join(x.decode() for x in alnum_words(t))} " for t in texts]
    expected = set()
    for r in signatures:
        c = re.compile(f"(?<= )(?:{r.pattern})(?= )")
        expected |= {(k, r.priority, m.start(), m.end()) for k, line in enumerate(lines) for m in c.finditer(line)}
    rows = identified(documents(list(enumerate(texts))).select("doc_id", "text"))
    found = _detections(_with_words(rows, "order", "copy"), signatures).select("order", "priority", "first", "after")
    assert {tuple(r) for r in found.collect()} == expected


@pytest.mark.parametrize(
    "text, label",
    [
        ("FreeBSD License", "bsd-2-clause"),
        ("released under the 0BSD license", "0bsd"),
        ("see the licence for details", "license"),
        ("under the terms of the licence agreement", "license"),
    ],
)
def test_names_behind_the_prefilter(documents, text, label):
    (row,) = scan(documents([(1, text)])).collect()
    assert row["labels"] == label


def test_repeated_rows_count_once(documents):
    text = "Creative Commons Attribution"
    found = scan(documents([(1, text), (1, text), (2, text), (1, "other words")])).collect()
    assert sorted((r["doc_id"], r["labels"], r["score"]) for r in found) == [
        (1, "", 0.0), (1, "cc-by", 0.7), (1, "cc-by", 0.7), (2, "cc-by", 0.7)
    ]
