"""Pages, entities, cards and JSON-LD against hand-made cases and Python's own reading of entities."""

import html
import random

import pytest
from pyspark.sql import functions as F

from meridex.functions import articles as A
from meridex.functions import text as T
from meridex.operators import joins as J
from meridex.operators import records as R
from meridex.sources import sinks as SK


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t"))).collect())]


def test_all_entities_are_read_as_python_reads_them(spark):
    rnd = random.Random(1)
    names = list(html.entities.html5)
    texts = [" ".join(f"a&{n}" for n in names[k : k + 200]) for k in range(0, len(names), 200)]
    texts += ["&quot;&#39;&laquo;&eacute;&raquo;", "&ampx &notit; &not &AMP &am &zzz; & && &amp;amp; &#x41;&#X1F600;&#65 &#; &#x; &#xZ;", "&#0;&#55296;&#1114112;&#99999999999999999999;&#150;&#x80;&#129;&#13;&#xFDD0;&#65534;&#10;&#0000000000065;&#1;", "", "plain", None]
    texts += ["".join(rnd.choice(["&", "#", "x", ";", "amp", "lt", "4", "1", "é", " ", "<", "not", "in"]) for _ in range(40)) for _ in range(200)]
    assert values(spark, texts, T.unescape) == [t if t is None else html.unescape(t) for t in texts]


def test_page_text_and_headings(spark):
    page = "<SCRIPT>var a='<b>';</SCRIPT><style>p{}</style><h1 class=x>\n A&nbsp;&amp; <i>B</i> </H1><p>x<>y &lt;b&gt;</p>"
    assert values(spark, [page, None, ""], T.html_to_text) == ["A & B x<>y <b>", None, ""]
    assert values(spark, [page, "<h1></h1>", "<p>x</p>", None, "<h1>a</h1><h1>b</h1>"], lambda c: T.tag_text(c, "h1")) == ["A & B", "", None, None, "a"]
    long = "word " * 100
    shells = [f"<h1>t</h1>{long}", f"<h1></h1>{long}", f"<h1> &nbsp;</h1>{long}", long, "<h1>t</h1>short", f"<h1>t</h1>{long}<DIV ID=\"root\">", f"<h1>t</h1>{long} you need to enable javascript", f"<h1>t</h1>{long}/static/js/main.1.js"]
    assert values(spark, shells, T.is_shell) == [False] + [True] * 7
    assert values(spark, [shells[5], "<h1>t</h1>short"], lambda c: T.is_shell(c, 3, ())) == [False, False]


def test_cards(spark):
    rows = [("РЕМОНТ", " на  улице А"), ("Ремонт улица", None), ("Перекрытие", ""), (None, None), ("Ремонт улица ремонт, асфальт", "мост")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = [r.c for r in sorted(df.select("i", T.prefilter_card(F.col("a"), F.col("b"), A.CARD_STRONG, A.CARD_WEAK, A.CARD_CONTEXT).alias("c")).collect())]
    assert [(c.strong, c.weak, c.context, c.score, c.selected) for c in got] == [
        ([], ["ремонт"], [], 1, False), ([], ["ремонт"], ["улица"], 2, True), (["перекрытие"], [], [], 2, True), ([], [], [], 0, False), (["асфальт"], ["ремонт"], ["улица", "мост"], 5, True),
    ]
    assert [c.rejection_reason is None for c in got] == [c.selected for c in got]
    assert values(spark, ["Straße ΣΑΣ", None, "ﬁ"], T.casefolded) == ["strasse σασ", None, "fi"]
    assert values(spark, ["  Ⅳ\tﬁ ", None], T.normalised) == ["iv fi", ""] and values(spark, ["   ", " x ", None], T.blank_to_null) == [None, "x", None]


def test_transport(spark):
    kinds = [("Football cinema", "very_high"), ("матч", "very_high"), ("матч", "high"), ("матч", "medium"), ("матч", None), ("Форум", "high"), ("forum", "unknown"), ("лекция", "high"), ("лекция", None), (None, None), ("мастер-класс концерт", "high")]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, t string, tier string")
    got = [tuple(r)[1:] for r in sorted(df.select("i", *[c.alias(n) for n, c in A.transport_impact(F.col("t"), F.col("tier")).items()]).collect())]
    assert [g[1] for g in got] == [0, 5, 4, 3, 3, 4, 3, 2, 1, 1, 0] and [g[3] for g in got if g[3]] == ["cinema", "workshop"]
    assert all(g[0] == (g[1] >= 3) for g in got) and [g[2] for g in got][:5] == ["exclude", "very_high", "high", "high", "high"]
    tiers = A.venue_tier(spark.createDataFrame([(1, "EXPO Congress Center"), (2, "at Expo"), (3, None), (4, "БАРЫС Арена")], "i int, v string"), "i", F.col("v"))
    assert {r.i: r.tier for r in tiers.collect()} == {1: "high", 2: "medium", 3: "unknown", 4: "very_high"}


def test_events_at_any_depth(spark):
    inner = '{"@type":"Event","name":"n5","startDate":"5"}'
    for k in (4, 3, 2):
        inner = f'{{"@type":["Thing","SomeEVENT"],"name":"n{k}","startDate":"{k}","subEvent":[[{inner}]]}}'
    page = f'<script type=\'application/ld+json\'>{{"@graph":[{{"@type":"Place","itemListElement":[{{"item":{inner}}}]}}]}}</script>'
    twice = '<script type="application/ld+json">{"@type":"Event","name":" A &amp;amp; B ","startDate":"1","endDate":"9","subEvent":{"@type":"Event","name":"A & B","startDate":"1","endDate":"2"}}</script>'
    other = '<script type="application/ld+json">[{"@type":"Eventful","name":"x","startDate":"1"},{"@type":"Event","startDate":"1"},{"@type":"Event","name":"y"},{"@type":"Event","name":"z","startDate":"1","location":"Hall","url":"/z"}, 5, null, "s"]</script><script type="application/ld+json">{broken</script>'
    df = spark.createDataFrame([("p", page), ("t", twice), ("o", other), ("n", None), ("e", "")], "k string, h string")
    got = {}
    for r in T.jsonld_events(df, "k", "h").collect():
        got.setdefault(r.k, []).append((r.name, r.start, r.end))
    assert sorted(got["p"]) == [(f"n{k}", str(k), None) for k in (2, 3, 4, 5)] and got["t"] == [("A & B", "1", "2")] and got["o"] == [("z", "1", None)]
    assert T.jsonld_events(df.where("false"), "k", "h").count() == 0


def test_directories_of_any_size(spark, monkeypatch):
    rnd = random.Random(6)
    letters = "abcé "
    word = lambda a, b: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    texts = [(k, word(0, 60)) for k in range(120)] + [(500, None), (501, ""), (502, "x" * 50_000 + "needle" + "y" * 1000)]
    names = sorted({word(1, 7) for _ in range(150)} | {"needle", "x" * 30}) + ["", None]
    rows = [(n, rnd.randint(0, 9), f"c{i}") for i, n in enumerate(names)]
    df, directory = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(rows, "alias string, p int, code string")
    want = {}
    for k, t in texts:
        hits = sorted((p, a, c) for a, p, c in rows if a and t and a in t)
        if hits:
            want[k] = hits[0][2]
    for aliases, keys in ((10_000, 2_000), (64, 2_000), (64, 3)):
        monkeypatch.setattr(J, "INLINE_ALIASES", aliases)
        monkeypatch.setattr(J, "INLINE_KEYS", keys)
        assert {r.k: r.code for r in J.alias_lookup(df, "k", F.col("t"), directory, "alias", "p", "code").collect()} == want
    assert J.alias_lookup(df, "k", F.col("t"), directory.where("false"), "alias", "p", "code").count() == 0


def test_public_view_and_levels(spark):
    df = spark.createDataFrame([(1, float("inf"), [1.0, float("nan")], (2.0, float("-inf")), "secret")], "id int, p double, a array<double>, s struct<x:double,y:double>, hidden string")
    got = R.public_view(df, ["id", "p", "a", "s", "absent"], {"context": {"prob": "p", "none": "nothing"}}).first()
    assert tuple(got) == (1, None, [1.0, None], (2.0, None), None, (None, None)) and "secret" not in str(got)
    rows = spark.createDataFrame([(1, 0.1, "low"), (2, 0.5, "high")], "id int, p double, level string")
    geo = spark.createDataFrame([(i, [(0.0, 0.0), (1.0, 1.0)]) for i in (1, 2)], "id int, line array<struct<x:double,y:double>>")
    ranges = [(0.0, "low"), (0.4, "high")]
    assert SK.geojson_features(rows, geo, "id", ["p"], "level", "p", ranges).count() == 2
    with pytest.raises(ValueError, match="levels"):
        SK.geojson_features(rows.withColumn("level", F.lit("low")), geo, "id", ["p"], "level", "p", ranges)
