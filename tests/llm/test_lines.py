"""Recurring lines: the operator, and the pipeline's stage that leaves copies to the join."""

import pytest

from meridex.llm import lines, shared

SCHEMA = "doc_id long, text string"


def words(name, n):
    return " ".join(f"{name}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(n))


def test_a_passage_of_most_words_is_dropped_and_copies_stay(spark):
    passage = words("common", 60)
    own = [words(f"own{c}", 40) for c in "pqrst"]
    copied = "\n".join(words(f"copy{c}", 12) for c in "uvwxyz")
    near = copied.replace("copyzaa", "changed")
    rows = [(i, f"{passage}\n{text}") for i, text in enumerate(own)] + [(i, copied) for i in (10, 11, 12)] + [(13, near), (20, f"{passage}\n{copied}"), (30, None), (None, "x")]
    got = {r.doc_id: r.text for r in lines.drop_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert [got[i] for i in range(5)] == own
    assert [got[i] for i in (10, 11, 12, 13)] == [copied, copied, copied, near]
    assert passage not in got[20] and got[30] is None and got[None] == "x"


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_documents_of_boilerplate_alone_become_empty(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    text = "all rights are reserved by us\n\nplease read the terms of use"
    rows = [(i, text) for i in range(5)] + [(7, "text of its own\n" + text), (8, ""), (8, "text of two rows"), (None, None)]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA), counts=True).collect()), key=repr)
    assert got == sorted([(i, "", 2, 2) for i in range(5)] + [(7, "text of its own\n", 3, 2), (8, "", 0, 0), (8, "text of two rows", 1, 0), (None, None, 0, 0)], key=repr)


def test_a_leaf_holds_several_templates(spark):
    """Two families and many unrelated lines of one length and one beginning; names vary in the families."""
    names = ["ann", "bob", "cid", "dan", "eve"]
    rows = [(i, f"posted in the forum by {n} on a sunny day") for i, n in enumerate(names)]
    rows += [(10 + i, f"posted in the archive about {n} for all our readers") for i, n in enumerate(names)]
    rows += [(20 + i, f"posted in the {words(f'own{chr(97 + i)}', 7)}") for i in range(20)]
    rows += [(50 + i, f"we are the {n}") for i, n in enumerate(names)]  # nothing but the beginning in common
    got = {r.doc_id: r.n_dropped for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA), counts=True).collect()}
    assert got == {k: int(k < 15) for k, _ in rows}


def test_names_of_columns_are_free(spark):
    rows = spark.createDataFrame([(i, "the same line in all of them", 1.5) for i in range(3)], SCHEMA + ", all double")
    for c in ("__drop", "__gone", "print", "row", "lost", "new", "own", "pos", "a`b", "x.y", "n_chars"):
        rows = rows.selectExpr("*", f"1L as `{c.replace('`', '``')}`")
    got = lines.drop_recurring(rows)
    assert got.columns == rows.columns and [(r.text, r["all"], r["x.y"], r.n_chars) for r in got.collect()] == [("", 1.5, 1, 0)] * 3
