"""Text, HTML and number extraction as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.tables import cut

# Texts that tell a page which is filled in by scripts.
SHELL_MARKERS = ('<div id="root"', "You need to enable JavaScript", "/static/js/main")
_BLANKS = "(?U)[\\s\\x1c-\\x1f]+"

def squeeze(c: Column) -> Column:
    """Runs of blanks become one, ends are trimmed."""
    return F.regexp_replace(F.trim(c), "[ \t\n]+", " ")


def blank_to_null(c: Column) -> Column:
    """Without blanks at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def _beyond_ascii(c: Column, change) -> Column:
    return F.when(c.rlike("[^\\x00-\\x7f]"), change(c)).otherwise(c)


def normalised(c: Column) -> Column:
    """Compatible forms of characters (NFKC), runs of blanks as one, no blanks at the ends, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(_beyond_ascii(F.coalesce(c, F.lit("")), _compatible), _BLANKS, " ")))


def casefolded(c: Column) -> Column:
    """Case folded, as for comparison: ß as ss, final sigma as sigma."""
    return F.when(c.rlike("[^\\x00-\\x7f]"), _folded(c)).otherwise(F.lower(c))


def list_items(c: Column) -> Column:
    """Items of a list-like text: ['60', '70'], or values between , ; / and |."""
    parts = F.split(F.regexp_replace(c, r"[\[\]'\"]", ""), r"[,;/|]")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def largest_number(c: Column, digits: int = 9) -> Column:
    """The largest whole number of at most `digits` digits in a text; null if there is none."""
    found = F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    return F.array_max(F.transform(F.filter(found, lambda x: F.length(x) <= digits), lambda x: x.cast("long")))


def is_clock_time(c: Column) -> Column:
    return c.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")


def date_and_clock(epoch_ms: Column, clock: Column, zone: str) -> Column:
    """The local date of an epoch in ms and a HH:MM text as a timestamp without zone; null if the text is no time."""
    local = F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone)
    return F.try_to_timestamp(F.when(is_clock_time(clock), F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd"), clock)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


_PIECES = r"(?s)(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&)"
#: Names of entities that are read without a semicolon too, longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Entities that most pages have; names are looked up one after the other.
_FREQUENT = ("quot;", "amp;", "nbsp;", "lt;", "gt;", "apos;", "copy;", "laquo;", "raquo;", "mdash;", "ndash;", "middot;", "hellip;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "bull;", "reg;", "euro;", "eacute;", "uuml;", "ouml;", "auml;", "szlig;")
_APART = "\ue000"  # a private character between names, and between what they stand for


def _book(pairs: dict[str, str]) -> Column:
    names, values = (F.lit(_APART.join(x)) for x in (pairs.keys(), pairs.values()))
    return F.map_from_arrays(F.split(names, _APART), F.split(values, _APART))


def _character(code: Column) -> Column:
    """The character of a number, as browsers read it: Windows' for 128 to 159, U+FFFD for what is none."""
    western = {str(n): bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(128, 160)}
    control = (code < 9) | (code == 11) | ((code > 13) & (code < 32)) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) > 0xFFFD)
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(none | code.isNull(), "\ufffd").when(code.between(128, 159), F.try_element_at(_book(western), code.cast("string"))).when(code == 13, "\r").when(control, "").otherwise(text)


def unescape(c: Column) -> Column:
    """Reads all entities: by name (the longest known one), by number and by hexadecimal number, with or without semicolon."""
    names = _book({k: html5[k] for k in (*_FREQUENT, *html5)})

    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, "^&#0*([0-9]+)", 1)
        hexed = F.regexp_extract(p, "^&#[xX]0*([0-9a-fA-F]+)", 1)
        code = F.when(F.length(number) > 7, F.lit(0x110000)).otherwise(number.try_cast("long"))
        from_hex = F.when(F.length(hexed) > 6, F.lit(0x110000)).otherwise(F.conv(hexed, 16, 10).cast("long"))
        known = F.try_element_at(names, F.substr(p, F.lit(2)))
        bare = F.regexp_extract(p, f"^&({_BARE})", 1)
        named = F.coalesce(known, F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substr(p, F.length(bare) + 2))), p)
        return F.when(~p.startswith("&") | (p == "&"), p).when(number != "", _character(code)).when(hexed != "", _character(from_hex)).otherwise(named)

    read = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECES), 1), piece), "")
    return F.when(F.contains(c, F.lit("&")), read).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Without scripts, styles and tags; entities read, blanks squeezed."""
    c = F.regexp_replace(c, r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]+>", " ")), _BLANKS, " "))


def tag_text(c: Column, tag: str) -> Column:
    """The text of the first element of a tag, as `html_to_text` reads it; null if there is none."""
    pattern = rf"(?i)<{re.escape(tag)}[^>]*>([\s\S]*?)</{re.escape(tag)}>"
    return F.when(c.rlike(pattern), html_to_text(F.regexp_extract(c, pattern, 1)))


def is_shell(c: Column, least: int = 400, markers: tuple[str, ...] = SHELL_MARKERS) -> Column:
    """A page without text in its first heading, with little text, or with a marker of a page that scripts fill in."""
    bad = (F.coalesce(tag_text(c, "h1"), F.lit("")) == "") | (F.length(html_to_text(c)) < least)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(m.lower())) for m in markers], bad)


def links(df: DataFrame, key: str, html: str, pattern: str, base: str) -> DataFrame:
    """(key, link, place): distinct absolute links of each page in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), 1))
    return df.select(key, F.posexplode(found).alias("p", "l")).select(key, F.concat(F.lit(base), F.col("l")).alias("link"), (F.col("p") + 1).alias("place"))


def first_keyword(c: Column, rules: dict[str, str], default: str) -> Column:
    """The class of the first keyword, in order, that the text contains."""
    out = None
    for word, kind in rules.items():
        hit = F.contains(c, F.lit(word))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def group_score(c: Column, groups: list[str]) -> Column:
    """How many of the groups of words (alternations) the text has."""
    return reduce(lambda a, b: a + b, [c.rlike(g).cast("int") for g in groups])


def matched(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Those of the words that the text contains, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), w) for w in words]).cast("array<string>"))


def prefilter_card(title: Column, snippet: Column, strong: tuple[str, ...], weak: tuple[str, ...], context: tuple[str, ...]) -> Column:
    """A struct: matched words of each kind, score, selected, and why not.

    A card is selected for a strong word, or for a weak one with one of context. Strong words count twice.
    """
    text = normalised(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    found = {k: matched(text, w) for k, w in (("strong", strong), ("weak", weak), ("context", context))}
    n = {k: F.size(v) for k, v in found.items()}
    selected = (n["strong"] > 0) | ((n["weak"] > 0) & (n["context"] > 0))
    reason = F.when(~selected, "no_strong_road_event_term_or_weak_term_with_road_context")
    return F.struct(*[v.alias(k) for k, v in found.items()], (2 * n["strong"] + n["weak"] + n["context"]).alias("score"), selected.alias("selected"), reason.alias("rejection_reason"))


#: Members of a JSON-LD node that hold more nodes, in the order in which these count.
_INNER = ("@graph", "itemListElement", "item", "subEvent")
_LAST = 1 << 30


def jsonld_events(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, venue, start, end, category, address, city, url): events of JSON-LD blocks at any depth.

    Nodes are taken from lists, @graph, itemListElement, item and subEvent, level by level until none is left (a job for
    each level of the data). A node is an event if one of its types ends with "event" in any case; events without a name
    or start are dropped. Of events with one name, venue and start the first counts, inner ones before the one around
    them. Blocks that aren't JSON give nothing; entities are read before JSON is.
    """
    raw = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<script[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>"), 1)
    blocks = df.select(F.col(key).alias("_key"), F.posexplode(raw).alias("_b", "j"))
    of = lambda v, path, kind: F.try_variant_get(v, path, kind)
    listed = lambda v: F.coalesce(of(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))
    parsed = blocks.select("_key", "_b", F.try_parse_json(F.trim(F.regexp_replace(unescape(F.col("j")), "[\n\r\t]+", " "))).alias("v"))
    level = cut(parsed.select("_key", "_b", F.posexplode(listed(F.col("v"))).alias("i", "v")).select("_key", F.array("_b", "i").alias("_at"), "v"))
    text = lambda v, *path: of(v, "$" + "".join(f'["{p}"]' for p in path), "string")
    found = None
    while not level.isEmpty():
        v, at = F.col("v"), F.col("_at")
        items = of(v, "$", "array<variant>")
        types = F.coalesce(of(v, '$["@type"]', "array<string>"), F.array(of(v, '$["@type"]', "string")))
        event = F.exists(types, lambda t: F.coalesce(F.lower(t).endswith("event"), F.lit(False)))
        place = F.coalesce(of(v, '$["location"][0]', "variant"), of(v, '$["location"]', "variant"))
        address = of(place, '$["address"]', "variant")
        nodes = level.where(items.isNull() & event).select(
            "_key", F.concat("_at", F.array(F.lit(_LAST))).alias("_at"), text(v, "name").alias("name"), text(place, "name").alias("venue"), text(v, "startDate").alias("start"), text(v, "endDate").alias("end"),
            F.coalesce(F.nullif(text(v, "category"), F.lit("")), F.array_join(types, ", ")).alias("category"), F.coalesce(text(address, "streetAddress"), F.when(F.schema_of_variant(address) == "STRING", text(address))).alias("address"), text(address, "addressLocality").alias("city"), text(v, "url").alias("url"),
        )
        found = nodes if found is None else found.unionByName(nodes)
        inner = F.concat(*[listed(of(v, f'$["{k}"]', "variant")) for k in _INNER])
        level = cut(level.select("_key", "_at", F.posexplode(F.coalesce(items, inner)).alias("i", "v")).where("v is not null").select("_key", F.concat("_at", F.array("i")).alias("_at"), "v"))
    names = ["name", "venue", "start", "end", "category", "address", "city", "url"]
    if found is None:
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` string" for n in names))
    clean = F.transform(F.array(*names), lambda x: F.nullif(F.trim(F.regexp_replace(unescape(x), _BLANKS, " ")), F.lit("")))
    found = found.select("_key", "_at", clean.alias("t")).select("_key", "_at", *[F.col("t")[i].alias(n) for i, n in enumerate(names)])
    one = found.where("name is not null and start is not null").groupBy("_key", "name", "venue", "start").agg(F.min_by(F.struct(*names), "_at").alias("e"))
    return one.select(F.col("_key").alias(key), "e.*")


def json_list(c: Column) -> Column:
    """The items of a JSON list as texts; empty for nulls, other JSON and what isn't JSON."""
    items = F.from_json(c, "array<string>")
    return F.when(F.ltrim(c).startswith("["), F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
