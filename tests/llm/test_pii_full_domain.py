"""Surrogates where a domain is full."""

from meridex.llm import pii


def test_entities_of_a_full_domain_get_free_surrogates(spark):
    names = [n.capitalize() for n in pii.NAMES["cyrillic", "f"]]
    texts = [f"г-жа {n} пришла" for n in names] + ["password=________ stays", "token: ++++++++"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.pseudonymise(df, pii.DEMO_KEY).collect()
    new = [r.text[s.start : s.end] for r in rows for s in r.replaced]
    real = set(names) | {"________", "++++++++"}
    assert len(new) == len(texts) and len({n.lower() for n in new}) == len(new) and not real & set(new)
    assert all(pii.entities(r.text) == [(k, s.start, s.end) for s in r.replaced for k in ["name:f" if s.kind == "name" else s.kind]] for r in rows)
    assert sorted(r.text for r in rows) == sorted(r.text for r in pii.pseudonymise(df, pii.DEMO_KEY).collect())


def test_longer_forms_differ():
    for kind, values in (("name:f", ["ян", "лео", "eva"]), ("secret", ["00ff00ff"]), ("email", ["a@b.co"])):
        for v in values:
            made = [pii.longer(kind, v, n, 500, 0, pii.DEMO_KEY) for n in range(500)]
            assert len(set(made)) == 500 and all(len(m.partition("@")[0]) > len(v.partition("@")[0]) for m in made)
