"""Values for nulls, empty and long texts, ties, repeated rows, null and repeated keys, and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from meridex.llm import decontam, lines, lm, media, ngrams, packing, pii, quality, shared, suffixes, urls

SAME = "same words again and again in a text that is long enough to be cut into several shingles of words and more than a hundred bytes"
ROWS = [(None, SAME), (1, None), (2, ""), (3, "  \n\t"), (4, "Word"), (4, "Word"), (5, SAME), (6, SAME), (7, SAME + " changed"), (8, "x " * 30_000), (9, SAME), (9, "another text of the same key")]
CLASH = ("score", "block", "line", "leaf", "doc", "id", "n", "k", "key", "unit", "part", "template", "print", "replaced", "contamination", "media", "shard", "component", "forms", "host", "sequence_id", "salt_number")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(1.5) for c in CLASH})


@pytest.fixture(params=[0, 1_000_000], ids=["shuffled", "broadcast"])
def broadcast(request, monkeypatch):
    for module in (shared, ngrams):
        monkeypatch.setattr(module, "BROADCAST_ROWS", request.param)


def values(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_media(docs):
    got = values(media.media_features(media.store_payload(docs)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert got == sorted(want, key=repr)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(2, 1), (4, 0), (5, 1), (None, 1), (6, None), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"] and got.count() == len(ROWS)
    by = {}
    for r in got.collect():
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in by.values())
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_surrogates(spark, broadcast):
    rows = [(None, "mail a@b.com"), (1, None), (2, ""), (3, "mail a@b.com and A@B.com"), (3, "none"), (4, "word " * 30_000 + "a@b.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("replaced", F.lit(1))
    got = values(pii.pseudonymise(df, "k"), "doc_id", "text")
    new = next(t for i, t in got if i is None).split()[1]
    assert new != "a@b.com" and new.endswith(".com")
    swap = {i: t for i, t in got if i != 3}
    assert swap[1] is None and swap[2] == "" and swap[4] == "word " * 30_000 + new and (3, "none") in got
    assert [t.lower() for i, t in got if i == 3 and t != "none"] == [f"mail {new} and {new}"]


def test_urls(spark, broadcast):
    pages = spark.createDataFrame([(None, "http://A.com/x"), (1, None), (2, ""), (3, "no scheme"), (4, "http://a.com"), (4, "http://a.com"), (5, "HTTP://a.COM/" + "p/" * 5000)], "page_id long, url string").withColumns({c: F.lit(1) for c in CLASH})
    labels = spark.createDataFrame([(4, 0), (None, 0), (5, None)], "doc_id long, quality int")
    got = values(urls.judge(pages, labels, ()), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(None, "a.com", "/x", None, "block"), (1, "", "", None, "block"), (2, "", "", None, "block"), (3, "", "", None, "block"), (4, "a.com", "", None, "block"), (4, "a.com", "", None, "block"), (5, "a.com", "/" + "p/" * 5000, None, "block")], key=repr)
    assert {r.verdict for r in urls.judge(pages, labels.limit(0), ()).collect()} == {"allow"}


def test_ngrams(docs, broadcast):
    n = len(SAME.split()) - 2
    want = [(None, n, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, n, 5), (6, n, 5), (7, n + 1, 5), (8, 1, 8), (9, n, 5), (9, 4, 5)]
    assert values(ngrams.classes(docs, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_pipeline_join(spark, docs, broadcast):
    got = values(ngrams.one_of_each(spark, docs, ""), "doc_id", "text")
    assert [i for i, _ in got if i in (5, 6, 7)] == [5] and (None, SAME) in got and (1, None) in got and got.count((4, "Word")) == 1


def test_lines(docs, broadcast):
    got = lines.drop_recurring(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = [(i, "" if t == SAME else t, 1 if (t or "").strip() else 0, int(t == SAME)) for i, t in ROWS]
    assert values(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=repr)


def test_language_model(docs):
    got = lm.score(docs, F.col("doc_id") != 6).collect()
    count = {}
    for i, t in ROWS:
        if i != 6:
            for w in [*(t or "").lower().split(), None]:
                count[w] = count.get(w, 0) + 1
    assert len(got) == len(ROWS) and {r.train_tokens for r in got} == {sum(count.values())}
    assert values(docs.sparkSession.createDataFrame(got), "doc_id", "n_tokens", "n_known") == sorted([(i, len((t or "").split()) + 1, len((t or "").split()) + 1) for i, t in ROWS], key=repr)
    assert all(r.score <= 0 and r.base_score <= 0 for r in got) and {r.train for r in got if r.doc_id == 6} == {False} and {r.train for r in got if r.doc_id is None} == {True}


def test_repeats(docs, broadcast):
    rows = [(i, (t or "").encode()) for i, t in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    seen, want = set(), []
    for i, b in rows:
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            s = b[at : at + 100]
            if s in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(s)
        want.append((i, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing(docs):
    model = packing.tokenizer(packing.default_tokenizer())
    got = packing.pack(docs, packing.default_tokenizer()).collect()
    sizes = sorted((len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS))
    assert sorted(r.doc_tokens for r in got if r.start == 0) == sizes and sum(r.length for r in got) == sum(sizes)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, SAME), (2, None), (3, ""), (None, "word"), (1, SAME)], "item_id long, text string")
    got = decontam.mark(docs, items)
    assert set(got.columns) == set(docs.columns)
    found = values(got.select("doc_id", F.inline("contamination")), "doc_id", "item_id", "n_words")
    n = len(SAME.split())
    want = [(i, 1, n) for i, t in ROWS if (t or "").startswith(SAME) for _ in range(2)] + [(4, None, 1)] * 2
    assert found == sorted(want, key=repr)
