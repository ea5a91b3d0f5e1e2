"""URL filter with a path-template tree (operator 4).

Paths are cut into `LEVELS` segments, the last holding the rest. Per host, a tree of them is built level by level:

1. Variable segments become wildcards by their form: runs of digits turn into `#`.
2. The branches of a node are compared by their labels. Those whose share of good pages is within 1.96 standard errors of
   the share of all branches of the node, and those without labels, are merged into `*`; the rest of a node's branches
   keep their segment. Below, merged branches are one node. So slugs and other one-off segments become wildcards, too.
3. A template is rejected if its smoothed purity, (good + ALPHA * prior) / (labelled + ALPHA), is under `MIN_PURITY`;
   the prior is the share of good pages of all labelled ones.

Explicit rules come first: a rule fits its host and all subdomains if the path starts with its path; the longest
rule wins. The tree is built on counts per host and path of forms, not on pages; its result is broadcast to the pages if
it is small, and else joined with salted keys, so a host with a third of all urls isn't one task. The labels are those of
`labels.quality` for the document of the same number as the page.

Defined results: a null url or one without `://` has an empty host and path; repeated rows count each; pages without
labels follow the smoothed prior (1 where there are no labels at all); of several labels of a page the best counts; a
null id stays null and has no label; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import salted, stored

LEVELS = 4
MIN_PURITY = 0.5
ALPHA = 4.0
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _by_rule(rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, kind) of the longest rule that fits; nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("kind"))
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, forms, template) for (host, forms, n, good): forms of segments with labelled and good pages."""
    tree = paths.withColumn("template", F.lit(""))
    for i in range(1, LEVELS + 1):
        at = tree.where(F.size("forms") >= i).withColumn("form", F.col("forms")[i - 1])
        branch = at.groupBy("host", "template", "form").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        node = branch.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))
        apart = (F.col("good") * F.col("all_n") - F.col("n") * F.col("all_good")).cast("double")
        bound = 3.8416 * F.col("n") * F.col("all_good") * (F.col("all_n") - F.col("all_good"))
        like = (F.col("branches") > 1) & ((F.col("n") == 0) | (apart * apart <= bound))
        token = salted(branch, node, ["host", "template"], "form").select("host", "template", "form", F.when(like, "*").otherwise(F.col("form")).alias("token"))
        named = salted(at, stored(token, f"branches-{i}"), ["host", "template", "form"], "forms").select("host", "forms", "n", "good", F.concat("template", F.lit("/"), "token").alias("template"))
        ended = tree.where(F.size("forms") < i).select("host", "forms", "n", "good", "template")
        tree = stored(named.union(ended), f"tree-{i}")
    return tree


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of (page_id, url)."""
    raw = F.regexp_extract("url", "://([^/?#]*)", 1)
    cut = pages.select("page_id", F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")).alias("host"), F.coalesce(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    forms = F.expr(f"transform(slice(split(path, '/', {LEVELS + 1}), 2, {LEVELS}), s -> regexp_replace(s, '[0-9]+', '#'))")
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("quality"))
    cut = cut.withColumn("forms", forms).join(known, "page_id", "left")
    paths = stored(cut.groupBy("host", "forms").agg(F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good")), "paths")
    prior = paths.agg(F.coalesce(F.sum("good") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("prior"))
    tree = template_tree(paths)
    pure = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).crossJoin(F.broadcast(prior))
    pure = pure.select("host", "template", ((F.col("good") + ALPHA * F.col("prior")) / (F.col("n") + ALPHA)).alias("purity"))
    judged = stored(salted(tree, pure, ["host", "template"], "forms").select("host", "forms", "template", "purity"), "templates")
    out = salted(cut.drop("quality"), judged, ["host", "forms"], "page_id").withColumn("by", _by_rule(rules))
    own = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "by.rule", F.coalesce("by.kind", own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: by explicit rule, or else by its template's purity."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_LEVEL = """), branch{i} AS (
  SELECT host, template, s{i} AS form, sum(n) AS n, sum(good) AS good FROM tree{j} WHERE s{i} IS NOT NULL GROUP BY ALL
), node{i} AS (
  SELECT host, template, count(*) AS branches, sum(n) AS all_n, sum(good) AS all_good FROM branch{i} GROUP BY ALL
), token{i} AS (
  SELECT host, template, form, CASE WHEN branches > 1 AND (n = 0 OR power(CAST(good * all_n - n * all_good AS DOUBLE), 2) <= 3.8416 * n * all_good * (all_n - all_good)) THEN '*' ELSE form END AS token
  FROM branch{i} JOIN node{i} USING (host, template)
), tree{i} AS (
  SELECT t.* EXCLUDE (template), CASE WHEN s{i} IS NULL THEN t.template ELSE concat(t.template, '/', token) END AS template
  FROM tree{j} t LEFT JOIN token{i} k ON k.host = t.host AND k.template = t.template AND k.form = t.s{i}
"""
OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), segments AS (
  SELECT *, string_split(path, '/') AS s FROM cut
), tree0 AS (
  SELECT page_id, host, path, '' AS template, regexp_replace(s[2], '[0-9]+', '#', 'g') AS s1, regexp_replace(s[3], '[0-9]+', '#', 'g') AS s2, regexp_replace(s[4], '[0-9]+', '#', 'g') AS s3,
    CASE WHEN len(s) > 4 THEN regexp_replace(array_to_string(s[5:], '/'), '[0-9]+', '#', 'g') END AS s4,
    CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n, coalesce(quality, 0) AS good
  FROM segments LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) ON doc_id = page_id
LEVELS), prior AS (
  SELECT coalesce(sum(good) * 1.0 / nullif(sum(n), 0), 1.0) AS prior FROM tree4
), pure AS (
  SELECT host, template, (sum(good) + 4.0 * any_value(prior)) / (sum(n) + 4.0) AS purity FROM tree4, prior GROUP BY host, template
), rules AS (
  SELECT unnest(['block', 'allow', 'allow', 'block', 'block']) AS kind, unnest(['com/en/', 'example.com/en/7', 'net/de/', 'example.net/de/8', 'org/es/']) AS rule
), fits AS (
  SELECT DISTINCT ON (t.host, t.path) t.host, t.path, rule, kind FROM (SELECT DISTINCT host, path FROM tree4) t, rules
  WHERE (t.host = split_part(rule, '/', 1) OR ends_with(t.host, '.' || split_part(rule, '/', 1))) AND starts_with(t.path, substr(rule, strpos(rule, '/')))
  ORDER BY length(rule) DESC
)
SELECT page_id, t.host, t.path, rule, coalesce(kind, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(purity, 6) AS purity
FROM tree4 t JOIN pure p ON p.host = t.host AND p.template = t.template LEFT JOIN fits f ON f.host = t.host AND f.path = t.path
""".replace("LEVELS", "".join(_LEVEL.format(i=i, j=i - 1) for i in range(1, 5)))
