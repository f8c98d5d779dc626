import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.language_id import PENALTY, UNKNOWN, best_paths, held_out, identify, learn
from llm_helpers import ODD_TEXTS

SAID = {
    "en": "the house and the garden with that other thing which was there then",
    "de": "das haus und der garten mit einem anderen ding welches dort gewesen ist",
    "ru": "дом и сад с той другой вещью которая там была тогда",
    "el": "το σπίτι και ο κήπος με εκείνο το άλλο πράγμα που ήταν εκεί",
    "zh": "房子 和 花园 还有 那里 的 其他 东西",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text, lang) for lang, text in SAID.items() for i in range(4)] + [(9, "junk junk", None), (10, None, "de")]
    return learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def best_score(scores, penalty):
    value = scores[0].astype(float)
    for row in scores[1:]:
        value = np.maximum(value, value.max() - penalty) + row
    return value.max()


@pytest.mark.parametrize("seed", range(20))
def test_paths_are_the_best_of_all(seed):
    pick = np.random.default_rng(seed)
    counts = pick.integers(0, 30, 8)
    scores = pick.normal(0, pick.choice([1, 4, 9]), (counts.sum(), pick.integers(1, 5))).astype(np.float32)
    path, at = best_paths(scores, counts, 8.0), 0
    for n in counts:
        if n:
            own, p = scores[at : at + n], path[at : at + n]
            score = own[np.arange(n), p].astype(float).sum() - 8.0 * np.count_nonzero(np.diff(p))
            assert score == pytest.approx(best_score(own, 8.0), abs=1e-3)
        at += n


def test_languages_spans_and_odd_texts(spark, documents, model):
    mixed = f"{SAID['en']} {SAID['de']} {SAID['en']}"
    rows = [(k, t) for k, t in enumerate(SAID.values())] + [(20, mixed), (21, "12 34 !"), (22, "שלום עולם"), (23, "THE House")]
    rows += [(30 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(20, mixed), (None, SAID["ru"])]
    found = identify(documents(rows, odd=True), model).select("row.*", "lang_pred", "score", "spans").collect()
    by = {r["doc_id"]: r for r in found}
    assert [by[k]["lang_pred"] for k in range(5)] == list(SAID) and by[0]["score"] == 1.0
    assert [(s["first"], s["after"], s["lang"]) for s in by[20]["spans"]] == [(0, 13, "en"), (13, 26, "de"), (26, 39, "en")]
    assert by[20]["lang_pred"] == "en" and by[20]["score"] == pytest.approx(26 / 39)
    assert by[21]["lang_pred"] == UNKNOWN and by[23]["lang_pred"] == "en"
    assert by[22]["lang_pred"] in SAID and by[22]["score"] == 0.0 and by[22]["spans"] == []  # a script nobody learned
    assert [by[30 + k]["lang_pred"] == UNKNOWN for k in range(4)] == [True] * 4
    assert by[None]["lang_pred"] == "ru" and len(found) == len(rows) and found[0]["a.b"] == "x"


def test_scripts_narrow_languages(model):
    scores = model.emissions("дом house σπίτι".encode())
    names = [model.languages[k] for k in scores.argmax(1)]
    assert names[0] == "ru" and names[2] == "el" and PENALTY > 0


def test_nothing_learned_and_no_rows(documents, model):
    empty = learn(documents([]))
    assert [r["lang_pred"] for r in identify(documents([(1, "some words")]), empty).collect()] == [UNKNOWN]
    assert identify(documents([]), model).collect() == []


def test_held_out_ids(spark):
    rows = spark.range(40).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


OTHERS = {
    "te": "ఇల్లు మరియు తోట ఆ ఇతర వస్తువుతో అక్కడ ఉంది",
    "kn": "ಮನೆ ಮತ್ತು ತೋಟ ಆ ಇತರ ವಸ್ತುವಿನೊಂದಿಗೆ ಅಲ್ಲಿತ್ತು",
    "km": "ផ្ទះ និង សួន ជាមួយ វត្ថុ ផ្សេង ទៀត",
    "am": "ቤቱ እና የአትክልት ቦታው ከዚያ ሌላ ነገር ጋር",
    "jv": "ꦲꦺꦴꦩꦃ ꦭꦤ꧀ ꦏꦼꦧꦺꦴꦤ꧀ ꦏꦭꦶꦪꦤ꧀",
    "en": SAID["en"],
}


def test_languages_of_any_script(spark, documents):
    rows = [(i, text, lang) for lang, text in OTHERS.items() for i in range(4)]
    learned = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rows = [*enumerate(OTHERS.values()), (10, f"{OTHERS['te']} house"), (11, "ਘਰ ਅਤੇ ਬਾਗ"), (12, "house。 々 the ™")]
    found = {r["row"]["doc_id"]: r for r in identify(documents(rows), learned).collect()}
    assert [found[k]["lang_pred"] for k in range(len(OTHERS))] == list(OTHERS)
    assert all(found[k]["score"] == 1.0 for k in range(len(OTHERS)))
    assert found[10]["lang_pred"] == "te" and found[11]["score"] == 0.0 and found[12]["lang_pred"] == "en"
