"""Words of lines, against Python, and how often and how fast they are made."""

import random
import re
import time

from pyspark.sql import functions as F

from meridex.llm import lines

PIECES = ["a", "bc", "<*>", "<*><*>", "7", "x9y", "é1", "中", "٣", " 4 ", " ", "  ", " ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\n", "\n"]


def seen(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("print", F.xxhash64("text"))
    return lines._lines(rows)


def test_lines_of_odd_texts(spark):
    rnd = random.Random(5)
    texts = ["", " \n\t", "<*> 7\n<*> <*>\n<*><*>\n<*> a", *("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(2000))]
    want = []
    for doc, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09\x0b\x0c\x0d]+", line)]
            if w:
                want.append((doc, pos, len(w), " ".join(w[: lines.LEAD]), " ".join(w), any(x != "<*>" for x in w)))
    hashed = spark.createDataFrame(want, "doc long, pos int, n int, lead string, words string, fixed boolean")
    hashed = hashed.select("doc", "pos", "n", F.xxhash64("n", "lead"), F.xxhash64("words"), "fixed")
    got = seen(spark, texts).select("doc", "pos", "n", "leaf", "line", "fixed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hashed.collect()))


def test_words_are_masked_once(spark):
    plan = seen(spark, ["a 7"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", <*>, 1)") == 1


def test_a_long_word_takes_time_by_its_length(spark):
    begin = time.monotonic()
    got = seen(spark, ["7 " + "x" * 400_000]).collect()
    assert [(r.n, r.fixed) for r in got] == [(2, True)] and time.monotonic() - begin < 20
