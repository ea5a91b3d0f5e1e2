r"""Removing recurring lines by a log-template tree (operator 6), in DataFrame operations only.

A line's words are its runs of characters other than blanks; a word with a digit is variable and becomes `<*>`.
The tree has a fixed depth: the number of words, the leading `LEAD` words, and, where lines of a leaf differ, the anchor:
of a line's further words the one (word and place) that most documents of the leaf have. So a leaf has a template for
each anchor. A template holds at each further place the word that at least half of the documents have there, and `<*>`
elsewhere; a line belongs to it if more than half of its further words are the template's. Any other line is a template
of its own.

A template recurs if at least `MIN_DOCS` documents have a line of it and it has a word that isn't variable. Lines of
recurring templates are dropped whatever their share of a document; a document of nothing else becomes empty.

The pipeline's stage, which comes before copies are dropped, sets `copies`: all documents of which at least that share of
words recur count as one document for each template. So what copies and near copies have in common stays for the join
that follows, and what other documents repeat goes from all of them.

Each line is normalised once; further steps use its position in the text. Keys, hashes, positions and counts of lines are
shuffled until the last join; counting is partial before each shuffle, and joins on lines are broadcast or salted.

Defined results: null and empty texts have one empty line, which stays; blank lines always stay and aren't counted
as lines with words; rows that repeat a key count as one document; null keys count as one document, too; the other
columns stay as they are, but `n_chars` follows the text; names of input columns are free but for `text`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import large, salted, small, stored

LEAD = 3
MIN_DOCS = 3
#: The join that follows in the pipeline takes documents of this similarity.
COPIES = 0.8
#: Tables of words or lines of leaves are broadcast up to this many rows (about 10 MB).
WORD_ROWS = 100_000
_BLANK = r"\\x20\\x09\\x0B\\x0C\\x0D"
#: Words with a digit, each tried from its beginning alone, without going back.
_VARIABLE = f"(?<![^{_BLANK}])[^{_BLANK}0-9]*+[0-9][^{_BLANK}]*+"
_MASK = rf"if({{0}} rlike '[0-9\\x09\\x0B\\x0C\\x0D]', regexp_replace(regexp_replace({{0}}, '{_VARIABLE}', '<*>'), '[{_BLANK}]+', ' '), {{0}})"
_NORMAL = "trim(if(contains({0}, '  '), regexp_replace({0}, ' +', ' '), {0}))"


def _normal(lines: DataFrame, raw: str, *others: str) -> DataFrame:
    """(others, normal): the words of the column `raw`, masked, with one blank between them."""
    masked = lines.select(*others, F.expr(_MASK.format(raw)).alias("masked"))
    return masked.select(*others, F.expr(_NORMAL.format("masked")).alias("normal"))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc, print, pos, n, leaf, line, fixed) for each line that has words; leaf and line are hashes."""
    one = rows.select("doc", "print", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    one = one.where(f"raw rlike '[^{_BLANK}]'")  # a condition on the words would have them made twice
    words = _normal(one, "raw", "doc", "print", "pos")
    words = words.withColumn("n", F.expr("cast(1 + octet_length(normal) - octet_length(replace(normal, ' ', '')) as int)"))
    leaf = f"xxhash64(n, substring_index(normal, ' ', {LEAD}))"
    fixed = "not (startswith(normal, '<*>') and normal = rtrim(repeat('<*> ', n)))"
    return words.select("doc", "print", "pos", "n", F.expr(leaf).alias("leaf"), F.xxhash64("normal").alias("line"), F.expr(fixed).alias("fixed"))


def _words_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(leaf, line, docs, w) of `lines` (leaf, line, docs, at: doc, print and pos of one of each)."""
    per = lines.groupBy(F.col("at.doc").alias("own"), F.col("at.print").alias("own_print")).agg(F.collect_list(F.struct("at.pos", "leaf", "line", "docs")).alias("wanted"))
    found = rows.join(large(per), F.col("doc").eqNullSafe(F.col("own")) & (F.col("print") == F.col("own_print"))).select("wanted", F.split("text", "\n").alias("all"))
    one = found.select(F.explode(F.expr("transform(wanted, x -> struct(x.leaf, x.line, x.docs, all[x.pos] as raw))")).alias("x"))
    words = _normal(one.select("x.*"), "raw", "leaf", "line", "docs").select("leaf", "line", "docs", F.split("normal", " ").alias("w"))
    return words.dropDuplicates(["leaf", "line"])


def templates(rows: DataFrame, seen: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, template): the lines of templates that recur. `rows`: (doc, print, text); `seen`: their lines."""
    once = seen.where("fixed").groupBy("leaf", "line", "doc").agg(F.min(F.struct("print", "pos")).alias("at"))
    each = stored(once.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "at.print", "at.pos")).alias("at")), "line-counts")
    alone = each.where(F.col("docs") >= min_docs).select("line", F.col("line").alias("template"))
    mixed = each.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where((F.col("kinds") > 1) & (F.col("docs") >= min_docs))
    kinds = stored(_words_of(rows, each.join(small(stored(mixed.select("leaf"), "mixed-leaves")), "leaf", "left_semi")), "mixed-lines")
    words = kinds.select("leaf", "line", "docs", F.expr("size(w)").alias("n"), F.posexplode("w").alias("place", "word")).where(F.col("place") >= LEAD)
    held = stored(words.where("word <> '<*>'").groupBy("leaf", "place", "word").agg(F.sum("docs").alias("held")), "held")
    best = F.max(F.struct("held", (-F.col("place")).alias("place"), "word"))
    anchor = salted(words, held, ["leaf", "place", "word"], "line", rows=WORD_ROWS).groupBy("leaf", "line").agg(best.alias("a"))
    anchor = stored(anchor.select("leaf", "line", F.xxhash64("leaf", "a.place", "a.word").alias("template")), "anchors")
    words = stored(words.join(small(anchor, WORD_ROWS), ["leaf", "line"]).select("template", "line", "docs", "n", "place", "word"), "anchored-words")
    counted = words.groupBy("template", "place", "word").agg(F.sum("docs").alias("docs"))
    top = counted.groupBy("template", "place").agg(F.max(F.struct("docs", "word")).alias("top"), F.sum("docs").alias("total"))
    shape = top.where("top.docs * 2 >= total and top.word <> '<*>'").select("template", "place", F.col("top.word").alias("word"))
    same = salted(words, stored(shape, "shapes"), ["template", "place", "word"], "line", rows=WORD_ROWS).groupBy("template", "line").agg(F.count("*").alias("same"), F.first("n").alias("n"))
    members = stored(same.where(f"2 * same > n - {LEAD}").select("line", "template"), "members")
    support = salted(seen.select("line", "doc"), members, "line", "doc").select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    recurring = members.join(large(support.where(F.col("docs") >= min_docs)), "template").select("line", "template")
    return stored(alone.union(recurring).distinct(), "templates")


def _without_copies(seen: DataFrame, found: DataFrame, copies: float, min_docs: int) -> DataFrame:
    """`found` again, where the documents of which so large a share recurs count as one for each template."""
    gone = salted(seen, found.select("line").distinct(), "line", "doc").groupBy(F.col("doc").alias("copy")).agg(F.sum("n").alias("gone"))
    mostly = seen.groupBy("doc").agg(F.sum("n").alias("words")).join(large(gone), F.col("doc").eqNullSafe(F.col("copy"))).where(F.col("gone") >= copies * F.col("words"))
    mostly = stored(mostly.select("copy"), "mostly-recurring")
    having = salted(seen.select("line", "doc"), found, "line", "doc").select("template", "doc").distinct()
    having = having.join(small(mostly.withColumn("one", F.lit(True))), F.col("doc").eqNullSafe(F.col("copy")), "left")
    having = having.groupBy("template").agg(F.count(F.when(F.col("one").isNull(), 1)).alias("docs"), F.max(F.coalesce("one", F.lit(False))).cast("int").alias("more"))
    return stored(found.join(large(having.where(F.col("docs") + F.col("more") >= min_docs).select("template")), "template", "left_semi"), "templates")


def drop_recurring(df: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS, counts: bool = False, copies: float | None = None) -> DataFrame:
    """`df` with recurring lines taken out of `text`; `counts` adds n_lines (with words) and n_dropped."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = df.select(F.struct(*map(name, df.columns)).alias("row"), name(key).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    seen = stored(_lines(rows), "lines")
    found = templates(rows, seen, min_docs)
    if copies is not None:
        found = _without_copies(seen, found, copies, min_docs)
    lost = salted(seen.select("doc", "print", "pos", "line"), found.select("line").distinct(), "line", "doc")
    per = lost.groupBy(F.col("doc").alias("own"), F.col("print").alias("own_print")).agg(F.collect_set("pos").alias("lost"))
    out = rows.join(large(per), F.col("doc").eqNullSafe(F.col("own")) & (F.col("print") == F.col("own_print")), "left").withColumn("all", F.split("text", "\n"))
    kept = "array_join(transform(array_except(sequence(0, size(all) - 1), lost), i -> all[i]), '\n')"
    out = out.withColumn("new", F.expr(f"if(lost is null, row.text, {kept})"))
    made = {c: F.col("row").getField(c).alias(c) for c in df.columns} | {"text": F.col("new").alias("text")}
    if "n_chars" in made:
        made["n_chars"] = F.expr("if(lost is null, row.n_chars, cast(length(new) as bigint))").alias("n_chars")
    with_words = r"cast(size(filter(all, x -> x rlike '[^\\x20\\x09\\x0B\\x0C\\x0D]')) as bigint)"
    extra = [F.expr(with_words).alias("n_lines"), F.expr("if(lost is null, 0L, cast(size(lost) as bigint))").alias("n_dropped")] if counts else []
    return out.select(*made.values(), *extra)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without recurring lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs, counts=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the lines that recur across documents; copies are left to the join.

    Every document stays, an emptied one with an empty text; null and empty texts stay as they are.
    """
    return drop_recurring(docs, copies=COPIES)


OP6_SQL = r"""
WITH raw AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), lines AS (
  SELECT doc_id, pos, line, list_filter(string_split_regex(
      regexp_replace(line, '[^\x20\x09\x0B\x0C\x0D]*[0-9][^\x20\x09\x0B\x0C\x0D]*', '<*>', 'g'), '[\x20\x09\x0B\x0C\x0D]+'), lambda x: x <> '') AS w
  FROM raw
), seen AS (
  SELECT doc_id, pos, len(w) AS n, array_to_string(w, ' ') AS norm, concat(len(w), ' ', array_to_string(w[1:3], ' ')) AS leaf,
         len(list_filter(w, lambda x: x <> '<*>')) > 0 AS fixed
  FROM lines WHERE len(w) > 0
), each AS (
  SELECT leaf, norm, count(DISTINCT doc_id) AS docs FROM seen WHERE fixed GROUP BY leaf, norm
), mixed AS (
  SELECT leaf FROM each GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 3
), kinds AS (
  SELECT leaf, norm, docs, string_split(norm, ' ') AS w FROM each WHERE leaf IN (SELECT leaf FROM mixed)
), words AS (
  SELECT leaf, norm, docs, len(w) AS n, i AS place, w[i] AS word FROM (SELECT *, unnest(generate_series(4, len(w))) AS i FROM kinds WHERE len(w) > 3)
), held AS (
  SELECT leaf, place, word, sum(docs) AS held FROM words WHERE word <> '<*>' GROUP BY ALL
), anchor AS (
  SELECT leaf, norm, arg_max(concat(place, ' ', word), (held, -place, word)) AS a FROM words JOIN held USING (leaf, place, word) GROUP BY leaf, norm
), anchored AS (
  SELECT * FROM words JOIN anchor USING (leaf, norm)
), counted AS (
  SELECT leaf, a, place, word, sum(docs) AS docs FROM anchored GROUP BY ALL
), top AS (
  SELECT leaf, a, place, sum(docs) AS total, max({'docs': docs, 'word': word}) AS t FROM counted GROUP BY leaf, a, place
), shape AS (
  SELECT leaf, a, place, t.word AS word FROM top WHERE t.docs * 2 >= total AND t.word <> '<*>'
), members AS (
  SELECT leaf, a, norm FROM anchored JOIN shape USING (leaf, a, place, word) GROUP BY leaf, a, norm, n HAVING 2 * count(*) > n - 3
), support AS (
  SELECT leaf, a FROM seen JOIN members USING (leaf, norm) GROUP BY leaf, a HAVING count(DISTINCT doc_id) >= 3
), recurring AS (
  SELECT norm FROM each WHERE docs >= 3 UNION SELECT norm FROM members JOIN support USING (leaf, a)
), per AS (
  SELECT doc_id, count(*) AS n_lines FROM seen GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(s.norm IN (SELECT norm FROM recurring), false) AS dropped
  FROM raw l LEFT JOIN seen s ON s.doc_id = l.doc_id AND s.pos = l.pos
)
SELECT k.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text,
       coalesce(max(p.n_lines), 0) AS n_lines, count(*) FILTER (dropped) AS n_dropped
FROM kept k LEFT JOIN per p ON p.doc_id = k.doc_id GROUP BY k.doc_id
"""
