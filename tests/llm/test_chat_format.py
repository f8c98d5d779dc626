import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest

from ledgerloom.llm.chat_format import escape, parse, parts, prefix_tree, read_back, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, key string, rank string"


@pytest.mark.parametrize(
    "text", ["", "\\", "\\\\n", "#", "### user: x</turn>\n", "</turn", "<", "</turn></turn>\n### a: ", "a\\</turn>", "é\n\n", "</turn>\n"]
)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text
    turns = [("user", text), (text, "x"), ("assistant", text)]
    assert parse("".join("".join(parts(*t)) for t in turns)) == turns


def conversations(spark, convs):
    rows = [(c, k, role, text, "x", "y") for c, turns in convs for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def convs():
    pick = random.Random(6)
    made = []
    for c in range(60):
        turns = [("system", "be kind")] if pick.random() < 0.5 else []
        for k in range(pick.randint(1, 5)):
            turns += [("user", f"question {pick.randint(0, 1)}"), ("assistant", f"answer {pick.randint(0, 1)} </turn> #")]
        made.append((c, turns))
    made += [(100, [("user", None)]), (101, [(None, "")]), (102, [("assistant", "")]), (None, [("user", "x"), ("assistant", "ü")])]
    return made


def test_read_back(spark, convs):
    forest = prefix_tree(conversations(spark, convs), PATH)
    found = {r["conv_id"]: tuple(r)[1:5] for r in read_back(forest, PATH).collect()}
    for c, turns in convs:
        turns = [(role or "", text or "") for role, text in turns]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        learned = "".join(text for role, text in turns if role == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert found.pop(c) == (len(turns), digest(said), len(learned), digest(learned))
    assert not found


def test_layout(spark, convs):
    forest = prefix_tree(conversations(spark, convs), PATH)
    nodes = {bytes(n["key"]): n for n in forest.nodes.collect()}
    prefixes = {tuple(turns[: k + 1]) for _, turns in convs for k in range(len(turns))}
    assert len(nodes) == len(prefixes)  # each shared turn once
    trees = defaultdict(list)
    for n in nodes.values():
        trees[bytes(n["tree"])].append(n)
    for own in trees.values():
        at = 0
        for n in sorted(own, key=lambda n: n["start"]):
            assert n["start"] == at
            at += len(n["ids"])
    for r in forest.conversations.collect():
        position, before = 0, []
        for key in r["keys"]:
            n = nodes[bytes(key)]
            assert n["position"] == position
            assert [i for a in n["attends"] for i in range(a["first"], a["after"])] == before
            before = before + list(range(n["start"], n["start"] + len(n["ids"])))
            assert before == sorted(before)  # depth first: ancestors stand before
            position += len(n["ids"])
    assert any(len(n["attends"]) > 1 for n in nodes.values())


def test_repeated_turns_and_no_rows(spark):
    twice = spark.createDataFrame([(1, 0, "user", "a", "", "")] * 2 + [(1, None, "user", "b", "", "")], SCHEMA)
    (row,) = read_back(prefix_tree(twice, PATH), PATH).collect()
    assert row["n_turns"] == 3
    forest = prefix_tree(spark.createDataFrame([], SCHEMA), PATH)
    assert forest.nodes.collect() == [] and read_back(forest, PATH).collect() == []
