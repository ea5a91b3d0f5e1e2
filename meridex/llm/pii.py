"""Surrogates for personal data and secrets (operator 3).

Found entities are e-mail addresses, phone numbers (international, or of ten digits), IPv4 addresses, card numbers (with a
right check digit), access keys, passwords, tokens, and names: words after a title, and a given name of the lists with
the word after it. Their words, in either case of letters, are names wherever else they stand capitalised in that text;
parts of a hyphenated name are words of their own. Each entity is replaced by a keyed surrogate of its own kind:

* characters of one class (digits, small or capital letters) become characters of that class, so the format stays; the
  classes of a text make a mixed-radix number, which a keyed Feistel network permutes. That is a bijection for each
  format, so different entities get different surrogates;
* an address's octets stay octets, a card's check digit stays right, a phone's first area digit stays in its range;
* a given name in the lists becomes another of the same script and gender (a keyed permutation of the list); any other
  word of a name becomes a made-up name of the same script and case, with a vowel or a consonant at its end as before,
  which is what tells a name's gender where no list does.

The surrogate is a function of kind, value and key alone, so an entity reads the same in every document, whatever title
it has and in either case of letters. Collisions: over the whole corpus, surrogates that equal another entity's text or
another surrogate are given to the next attempt (another permutation, names one syllable longer), `ATTEMPTS` times at
most. What is open then (the names of a full list, a secret without letters) gets a longer made-up form of its kind by
the rank of its value, checked in the same way; kinds of fixed length (addresses, numbers, access keys) raise an error
instead. These exceptions are joined to documents; very frequent ones are salted.

The key is a secret: who has it can undo the permutations. The query takes it from `spark.meridex.pii.key`.

Defined results: null texts stay null, empty ones empty; texts without entities stay the same byte for byte; repeated
rows get equal results; the other columns stay.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..operators.records import global_rank
from .shared import salted, stored

#: Permutations that are tried for an entity before it gets a longer form.
ATTEMPTS = 4
#: Exceptions of documents that are sent to all tasks; more are joined by a shuffle.
MOST_PAIRS = 100_000
KEY_SETTING = "spark.meridex.pii.key"
#: For made-up data and tests, where the setting is absent.
DEMO_KEY = "no-secret"
# Given names by script and gender.
NAMES = {
    ("latin", "f"): "anna maria laura julia sarah emma clara elena sofia nina alice jane mary susan linda karen lisa nancy helen marie claire sophie camille petra sabine monika carmen lucia isabel pilar".split(),
    ("latin", "m"): "john james robert michael david thomas peter paul mark george henry jack louis pierre jean antoine hans klaus stefan jürgen carlos miguel pedro josé luis pablo daniel simon martin felix".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина татьяна светлана екатерина юлия".split(),
    ("cyrillic", "m"): "иван александр сергей дмитрий андрей алексей михаил николай владимир павел".split(),
}
# Titles that come before a name, by the gender they tell.
TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|г-н", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа", "": "Dr|Prof"}
TITLES = {gender: f"{words}|{words.upper()}" for gender, words in TITLES.items()}
# Capitalised words that are no name after a given name.
NO_NAMES = set("the a an and or of in on is was he she it der die das und le la les et el los las y i".split())
_CAPITAL = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_WORD = rf"(?:[{_CAPITAL}]['’])?[{_CAPITAL}](?:[a-zß-öø-ÿа-яё]+|[{_CAPITAL}]+)"
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?P<access>AKIA[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9]))"
    r"|(?<![0-9.])(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]))(?![0-9]|\.[0-9])"
    r"|(?<![0-9])(?P<card>[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7})(?![0-9])"
    r"|(?:(?i:password|passwd|secret|token|api_key|apikey)\s?[=:]\s?\"?)(?P<secret>[A-Za-z0-9+/_-]{8,})"
    rf"|(?<!\w)(?:(?P<male>{TITLES['m']})|(?P<female>{TITLES['f']})|{TITLES['']})\.? (?P<name>{_WORD}(?:[ -]{_WORD}){{0,3}})(?!\w)"
)
_NAME = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_PAIR = re.compile(rf"(?<!\w)({_WORD}) (?=({_WORD})(?!\w))")
#: A text without any of these has no entity.
QUICK = re.compile(rf"@|AKIA|\+[0-9]|\([0-9]{{3}}\)|[0-9]\.[0-9]+\.[0-9]|[0-9]{{4}}|(?i:passw|secret|token|api_?key)|(?:{'|'.join(TITLES.values())})\.? [{_CAPITAL}]|[{_CAPITAL}][\w’']+ [{_CAPITAL}]")
LISTED = {name: gender for (_, gender), names in NAMES.items() for name in names}
#: Parts of made-up names by script: consonants and vowels of a syllable, ends after a consonant and after a vowel.
_MADE = {
    "latin": ("bdfgklmnprstvz", "aeiou", ("lin", "mar", "ros", "ton", "bert", "dan"), ("na", "ria", "lia", "sa", "nda", "vea")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("нов", "рин", "мир", "слав", "тан", "дар"), ("на", "рия", "лова", "са", "нина", "мила")),
}
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "àâäæçéèêëîïíìñóòôöœúùûüýÿß"]
_SPEECH = ["bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзйклмнпрстфхцчшщъь", "аеёиоуыэюя", "àâäæéèêëîïíìóòôöœúùûüýÿ", "çñß"]


def luhn(digits: str) -> int:
    """The check sum modulo 10; 0 for a right number."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def permute(value: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: four Feistel rounds, walked on until the result is in range."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask, wide = (1 << half) - 1, -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        for r in range(4):
            f = hmac.new(key, bytes([r]) + right.to_bytes(wide, "little"), hashlib.sha512).digest()
            while len(f) < wide:
                f += hashlib.sha512(f).digest()
            left, right = right, left ^ (int.from_bytes(f[:wide], "little") & mask)
        value = left << half | right
        if value < size:
            return value


def by_class(text: str, key: bytes, classes: list[str], fixed: set[int] = frozenset(), radix: dict[int, str] | None = None) -> str:
    """Permutes the characters of each place within their class; others, and the places of `fixed`, stay."""
    places, shape = [], []
    for i, c in enumerate(text):
        of = (radix or {}).get(i) or next((k for k in classes if c.lower() in k), None)
        if of and i not in fixed and c.lower() in of:
            places.append((i, of))
            shape.append(of[0])
        else:
            shape.append(c)
    number, size = 0, 1
    for i, of in places:
        number, size = number * len(of) + of.index(text[i].lower()), size * len(of)
    number = permute(number, size, hashlib.sha256(key + "".join(shape).lower().encode()).digest())
    out = list(text)
    for i, of in reversed(places):
        number, k = divmod(number, len(of))
        out[i] = of[k].upper() if text[i].isupper() and of[k].upper().lower() == of[k] and len(of[k].upper()) == 1 else of[k]
    return "".join(out)


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The replacement of an entity; each attempt is another permutation."""
    k = hashlib.sha256(f"{key}|{kind.split(':')[0]}|{attempt}".encode()).digest()
    if kind == "ip":
        n = 0
        for part in value.split("."):
            n = n * 256 + int(part)
        n = permute(n, 1 << 32, k)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        places = [i for i, c in enumerate(value) if c.isdigit()]
        out = by_class(value, k, _CLASSES[:1], {places[0], places[-1]})
        head, tail = out[: places[-1]], out[places[-1] + 1 :]
        return next(head + d + tail for d in "0123456789" if luhn(re.sub("[^0-9]", "", head + d + tail)) == 0)
    if kind == "phone":
        places = [i for i, c in enumerate(value) if c.isdigit()]
        area = max(len(places) - 10, 0)
        first = "01" if value[places[area]] in "01" else "23456789"
        return by_class(value, k, _CLASSES[:1], set(places[:area]), {places[area]: first})
    if kind == "email":
        return by_class(value, k, _CLASSES[:2], set(range(value.rindex("."), len(value))))
    if kind == "access":
        return value[:4] + by_class(value[4:], k, _CLASSES[:2])
    if kind == "secret":
        whole_hex = re.fullmatch(r"[0-9a-f]+", value)
        return by_class(value, k, ["0123456789abcdef"] if whole_hex else _CLASSES[:2])
    out = []
    for word in value.split(" "):
        script, low = "cyrillic" if re.search("[А-Яа-яЁё]", word) else "latin", word.lower()
        if low in LISTED:
            of = NAMES[script, LISTED[low]]
            new = of[permute(of.index(low), len(of), k + script.encode() + of[0].encode())]
        else:
            new = made_name(low, script, k, 3 + attempt)
        out.append(cased(new, word))
    return " ".join(out)


def cased(new: str, word: str) -> str:
    """A name in the case of another: all capitals, or the first."""
    letters = [c for c in word if c.isalpha()]
    return new.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else new[0].upper() + new[1:]


def made_name(word: str, script: str, key: bytes, syllables: int) -> str:
    """A made-up name of so many syllables, the last of them an end like the word's: after a vowel or a consonant."""
    consonants, vowels, hard, soft = _MADE[script]
    ends = soft if word[-1] in "aeiouyàâäéèêëîïíìóòôöúùûüаеёиоуыэюя" else hard
    n = int.from_bytes(hmac.new(key, word.encode(), hashlib.sha256).digest(), "little")
    out = ""
    for _ in range(syllables - 1):
        n, c = divmod(n, len(consonants))
        n, v = divmod(n, len(vowels))
        out += consonants[c] + vowels[v]
    return out + ends[n % len(ends)]


def longer(kind: str, value: str, number: int, count: int, extra: int, key: str) -> str:
    """Replacement `number` of `count` in a form longer than `value`; different numbers give different ones."""
    script = "cyrillic" if re.match("[А-Яа-яЁё]", value) else "latin"
    head, at, _ = value.partition("@")
    letters = ["0123456789abcdef"] if kind == "secret" and re.fullmatch("[0-9a-f]+", value) else _SPEECH[2:4] if script == "cyrillic" else _SPEECH[:2]
    width, size = 0, 1
    while width <= len(head) + extra or size < count:
        size, width = size * len(letters[width % len(letters)]), width + 1
    number = permute(number, size, hashlib.sha256(f"{key}|{kind.split(':')[0]}|{letters[0]}|{width}|longer".encode()).digest())
    out = ""
    for i in range(width):
        number, k = divmod(number, len(letters[i % len(letters)]))
        out += letters[i % len(letters)][k]
    return out + (at + surrogate(kind, value, key).partition("@")[2] if at else "")


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, in order."""
    if not text or not QUICK.search(text):
        return []
    out, names = [], {}
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if kind == "card":
            digits = re.sub("[^0-9]", "", m["card"])
            if not 13 <= len(digits) <= 19 or luhn(digits):
                continue
        if kind == "name":
            of = "name:" + ("m" if m["male"] else "f" if m["female"] else "")
            for w in re.finditer(r"[^ -]+", m["name"]):
                out.append((names.setdefault(w[0].lower(), of), m.start("name") + w.start(), m.start("name") + w.end()))
            continue
        out.append((kind, m.start(kind), m.end(kind)))
    for m in _PAIR.finditer(text):  # a given name and the word after it
        if m[1].lower() in LISTED and m[2].lower() not in NO_NAMES:
            of = "name:" + LISTED[m[1].lower()]
            names.setdefault(m[1].lower(), of)
            names.setdefault(m[2].lower(), of)
    if names:  # the same words without a title
        taken = iter([*out, (None, len(text) + 1, 0)])
        (_, begin, end), again = next(taken), []
        for w in _NAME.finditer(text):
            while end and end <= w.start():
                _, begin, end = next(taken)
            if w[0].lower() in names and w.end() <= begin:
                again.append((names[w[0].lower()], w.start(), w.end()))
        out = sorted(out + again, key=lambda e: e[1])
    return out


def _root(kind: str) -> str:
    return kind.partition(":")[0]


def _norm(kind: str, value: str) -> str:
    return value.lower() if kind == "email" or kind.startswith("name") else value


def exceptions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, value, surrogate) of the entities whose first surrogate collides with an entity or another surrogate.

    Kinds have no gender here: a value of one kind is one entity.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(_root(k), _norm(k, t[a:b])) for t in batch.column("text").to_pylist() for k, a, b in entities(t)}
            kinds, values = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    def give(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [_norm(k, surrogate(k, v, key, attempt)) for k, v in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

        return run

    schema = "kind string, value string, surrogate string"
    known = stored(df.select(F.col(text).alias("text")).mapInArrow(find, "kind string, value string").distinct(), "entities")
    taken = known.select("kind", F.col("value").alias("surrogate"))
    settled, open_, moved = None, known, None
    for attempt in range(ATTEMPTS):
        given = open_.select("kind", "value").mapInArrow(give(attempt), schema)
        rivals = given.groupBy("kind", "surrogate").agg(F.min("value").alias("winner"))
        used = taken if settled is None else taken.union(settled.select("kind", "surrogate"))
        marked = given.join(rivals, ["kind", "surrogate"]).join(used.withColumn("hit", F.lit(True)).distinct(), ["kind", "surrogate"], "left")
        marked = stored(marked.withColumn("bad", F.coalesce("hit", F.lit(False)) | (F.col("value") != F.col("winner"))), "surrogates")
        good = marked.where("not bad").select("kind", "value", "surrogate")
        settled = good if settled is None else settled.union(good)
        if attempt:
            moved = good if moved is None else moved.union(good)
        open_ = marked.where("bad")
        if open_.isEmpty():
            break
    else:
        more = _longer_forms(open_.select("kind", "value"), taken.union(settled.select("kind", "surrogate")), key)
        moved = more if moved is None else moved.union(more)
    return known.select("kind", "value", F.lit("").alias("surrogate")).where("false") if moved is None else moved


def _longer_forms(open_: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for each of `open_`: longer forms that differ from each other and from `taken`."""
    fixed = open_.where("kind not in ('name', 'email', 'secret')").first()
    if fixed:
        raise ValueError(f"no free surrogate is left for an entity of kind {fixed.kind}")
    open_ = stored(global_rank(open_, [F.col("kind"), F.col("value")], "number"), "open")
    count, done, extra = open_.count(), None, 0

    def give(extra: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in ("kind", "value", "number")), strict=True)
                made = [longer(k, v, n - 1, count, extra, key) for k, v, n in rows]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "surrogate"])

        return run

    while True:  # ends: a form longer than the longest of `taken` is free
        used = taken if done is None else taken.union(done.select("kind", "surrogate"))
        given = open_.select("kind", "value", "number").mapInArrow(give(extra), "kind string, value string, number long, surrogate string")
        marked = stored(given.join(used.distinct().withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left"), "longer")
        good = marked.where("hit is null").select("kind", "value", "surrogate")
        done = good if done is None else done.union(good)
        open_, extra = marked.where("hit"), extra + 1
        if open_.isEmpty():
            return done.select("kind", "value", "surrogate")


def pseudonymise(df: DataFrame, key: str, text: str = "text", key_column: str = "doc_id", column: str = "replaced") -> DataFrame:
    """`df` with surrogates in `text` and a `column` of (kind, start, end) in the new text; one of that name is replaced."""
    df = df.drop(column)
    moved = exceptions(df, key, text)
    own = "_moved"
    while own in df.columns:
        own += "_"
    spans = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    if not moved.isEmpty():
        pairs = stored(salted(_document_entities(df, text, key_column), moved, ["kind", "value"], "k", rows=100_000), "pairs")
        per = pairs.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "surrogate"))).alias(own))  # a text's own
        per = F.broadcast(per) if pairs.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS else per
        k = F.col("_right.k")
        df = df.alias("_left").join(per.alias("_right"), F.col(f"_left.{key_column}").eqNullSafe(k), "left").select("_left.*", f"_right.{own}")
    names = [c for c in df.columns if c != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            given = [dict(m or ()) for m in batch.column(own).to_pylist()] if own in batch.schema.names else [{}] * batch.num_rows
            texts, found = [], []
            for t, others in zip(batch.column(text).to_pylist(), given, strict=True):
                parts, at, size, spots = [], 0, 0, []
                for k, a, b in entities(t):
                    new = others.get(f"{_root(k)}|{_norm(k, t[a:b])}")
                    if new is None:
                        new = surrogate(k, t[a:b], key)
                    elif _root(k) == "name":
                        new = cased(new, t[a:b])
                    parts += [t[at:a], new]
                    size += a - at
                    spots.append({"kind": _root(k), "start": size, "end": size + len(new)})
                    size, at = size + len(new), b
                texts.append("".join([*parts, t[at:]]) if spots else t)
                found.append(spots)
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*names, column])

    schema = StructType([df.schema[c] for c in names] + [StructField(column, ArrayType(spans))])
    return df.mapInArrow(run, schema)


def _document_entities(df: DataFrame, text: str, key_column: str) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, _root(k), _norm(k, t[a:b])) for i, t in enumerate(batch.column("text").to_pylist()) for k, a, b in entities(t)]
            at, kinds, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["k", "kind", "value"])

    one = df.select(F.col(key_column).alias("k"), F.col(text).alias("text"))
    return one.mapInArrow(find, f"k {df.schema[key_column].dataType.simpleString()}, kind string, value string").distinct()


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and how many entities were replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} isn't set: a key that everybody knows is used, so surrogates can be undone", stacklevel=2)
    done = pseudonymise(docs, key or DEMO_KEY)
    return done.select("doc_id", "text", F.size("replaced").alias("n_entities"), F.array_sort(F.array_distinct("replaced.kind")).alias("kinds"))
