"""The license scan against brute force, and its defined results."""

import math
import re

from pyspark.sql import functions as F

from meridex.llm import licenses

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates, phrases, containment):
    """Places of phrases, and the best containment of each template over all its blocks."""
    w = words(text)
    places = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    found = {}
    for label, t in templates:
        own = set(words(t))
        step = licenses.block_step(len(words(t)))
        got = max((len(own & set(w[k : k + 2 * step])) for k in range(0, len(w), step)), default=0)
        if got >= math.ceil(round(containment * len(own), 9)):
            found[label] = max(found.get(label, 0), got / len(own))
    return len(w), sorted(places), found


def test_blocks_against_brute_force(spark):
    mit = dict(licenses.TEMPLATES)["mit"]
    cut = mit.split()
    texts = [
        "see CC BY-NC 4.0, cc-by and Cc By", "all rights\n\nreserved. all rights are reserved", "x " * 37 + mit + " y" * 90, " ".join(cut[: len(cut) * 9 // 10]), " ".join(cut[: len(cut) // 2]),
        "the license, version 2 of apache, the", "THE GNU\tGeneral — Public License", "gnu general public", "GNU gnu License license PUBLIC general the", "licensé under the mit license", "a b c d e f g h under the mit license", "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for containment in (0.5, licenses.CONTAINMENT, 1.0):
        for r in licenses.scan(df, containment=containment).collect():
            n, places, found = brute(r.text, licenses.TEMPLATES, licenses.PHRASES, containment)
            got = r.license
            assert got.n_words == n and got.n_base == len(places)
            assert (got.first_word, got.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert got.base_labels == sorted({label for _, label in places})
            best = {}
            for m in got.matches:
                best[m.label] = max(best.get(m.label, 0), m.containment)
                assert 0 <= m.start_word < n and m.start_word + m.n_words <= n
            assert best == found


def test_order_of_words_changes_nothing(spark):
    """The count of words sets what is looked at first, never what is found."""
    df = spark.createDataFrame([(k, "under the mit license " + "license mit the " * k) for k in range(20)], "doc_id long, text string")
    assert licenses.scan(df).where(F.size("license.matches") == 1).count() == 20


def test_other_templates_and_columns(spark):
    df = spark.createDataFrame([("one two three", 1, 2.0), (None, None, None), ("one two three", 1, 2.0)], "body string, license int, containment double")
    got = licenses.scan(df, templates=[("x", "Three two ONE"), ("nothing", "...")], phrases=[("two three", "p")], text="body")
    assert got.columns == ["body", "containment", "license"]
    rows = [r.license for r in got.collect()]
    assert [r.n_base for r in rows] == [1, 0, 1] and [[m.label for m in r.matches] for r in rows] == [["x"], [], ["x"]]
    assert licenses.scan(df.limit(0), text="body").count() == 0
    assert [r.license.n_words for r in licenses.scan(df, templates=[], phrases=[], text="body").collect()] == [3, 0, 3]
