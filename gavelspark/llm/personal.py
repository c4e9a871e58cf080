"""Problem 8: personal information in free text.

Addresses, phone numbers, identity numbers and e-mail addresses have forms of their own and are found by grammars.
Names have none: which capitalised words are names is estimated from the corpus. Over all documents the
co-occurrence of a word with protected entities is counted, that is with listed given names and initials in
front of it or after it. A word discloses a person as far as seeing it raises the odds of one there
(``disclosure``, in bits), and it must do so with several given names: a set phrase, such as a gallery of
art, has one. Given names that the list lacks, and the words after which names stand, are weighed in the same
way by their company of such family names.

Found pieces become typed placeholders; the family names of a document are generalised also where they stand
alone in it, since they exceed the threshold of disclosure by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.session import materialize

#: Least disclosure in bits, least number of different companions and least share of uses as a name.
BITS, COMPANIONS, SHARE = 2.0, 2, 0.5
#: Rare words are weighed by their last letters: lengths of endings, and least number of different words with one beside given names.
ENDINGS, ENDING_WORDS = (4, 3), 4
#: Uses of a context from which on it can be trusted, and the share of names among them.
CONTEXT_USES, CONTEXT_SHARE = 5, 0.8

# Words in front of names that are not part of them.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "herr", "frau", "señor", "señora", "sr", "sra", "monsieur", "madame", "mme", "m"}
# Kinds of streets, by order of words.
STREETS_AFTER = r"(?:road|rd|street|st|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way|place|pl|square|sq|terrace|gardens|row|close|crescent|mews|grove|hill|walk|parkway|pkwy|circle|trail)"
STREETS_JOINED = r"(?:straße|strasse|str\.?|weg|gasse|allee|platz|ring|damm|ufer)"
STREETS_BEFORE_FR = r"(?:rue|avenue|boulevard|chemin|impasse|place|allée|allee|quai|route|cours|square)"
STREETS_BEFORE_ES = r"(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|travesía)"
# Labels of numbers.
PHONE_LABELS = r"(?:tel(?:ephone|éfono)?|phone|call|text|mobile|cell|fax|contact|number is|num(?:ber|éro)|handy|móvil|ring|whatsapp|sms)"
ID_LABELS = r"(?:ssn|social security(?: n(?:umber|o))?|tax(?:payer)?(?: (?:id|number|no))?|tin|itin|steuer-?(?:id|nummer)|insurance(?: n(?:umber|o))?|national (?:insurance|id)(?: n(?:umber|o))?|ni(?:no| number| no)?|passport(?: n(?:umber|o))?|reisepass|travel document|identity card|id card|personalausweis|ausweis|dni|nie)"

_PLAIN = r"[^\W_]"
_LOCAL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\})\s*"
_DOT = r"(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\})\s*|\s+dot\s+)"
EMAIL = re.compile(
    rf"{_LOCAL}(?:@|{_AT}){_LABEL}(?:(?:\.|{_DOT}){_LABEL})*(?:\.|{_DOT})[A-Za-z]{{2,}}(?![\w@])|{_LOCAL}[ \t]+at[ \t]+{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?!\w)",
    re.I,
)
_AT_MARK = re.compile(r"[\[({]\s*at\s*[\])}]", re.I)
_EXT = r"(?:\s*(?:,\s*)?(?:ext(?:ension)?\.?|x)\s*\d{1,5})?"
_PHONE_FORMS = [
    r"\+\d{1,3}[ .-]?\(0\)[ .-]?\d{1,4}(?:[ .-]?\d{2,4}){1,4}",
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?)(?:[ .-]?\d{2,5}){1,5}",
    r"\+\d{9,14}",
    r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}",
    r"(?:1[ .-])?\d{3}-\d{3}-\d{4}",
    r"(?:1\.)?\d{3}\.\d{3}\.\d{4}",
    r"0\d{1,4}/\d{5,9}",
    r"0\d{4} \d{3} \d{3}",
    r"00\d{1,3}(?: \d{2,6}){2,5}",
    r"0\d(?:\.\d\d){4}",
    r"0\d(?: \d\d){4}",
    r"\(0\d{1,4}\)[ ]?\d{3,4}[ ]?\d{3,6}",
]
PHONE = re.compile(rf"(?<![\w.+/@-])(?:{'|'.join(_PHONE_FORMS)})(?![\w/@]|[.-]\d){_EXT}", re.I)
_LABELLED_PHONE = re.compile(rf"\b{PHONE_LABELS}\b[\s:=.]*(?:is\s+)?[\"']?([+(]?\d[\d ()./-]{{7,18}}\d{_EXT})", re.I)
# a national insurance number has two letters that no other form has: the prefix of examples or letters in use; in front of a
# passport number stands one letter
_PLAIN_ID = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}(?![\w-])|\d{9}-[A-Z]\d(?!\w)|(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])(?: ?\d\d){3} ?[A-D](?!\w)|[A-Z]\d{7}(?!\w))")
_PLAIN_ID_SMALL = re.compile(_PLAIN_ID.pattern, re.I)
_LABELLED_ID = re.compile(rf"\b{ID_LABELS}\b[\s.:=#]*(?:(?:is|ist|es)\s+)?[\s:=]*(\d{{3}}[ -]?\d{{2}}[ -]?\d{{4}}|[A-Z]{{1,2}}\d{{6,8}}|[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-Z]|\d{{8}}[A-Z]|\d{{9,11}}(?:-[A-Z]\d)?)(?!\w)", re.I)
_CAP = r"[^\W\d_][^\W\d_'’]*"
_TOWN = rf"{_CAP}(?:-{_CAP})*"
_GAP = r",\s+"
_US = rf"(?:{_GAP}(?:(?:apt|suite|ste|unit|apartment|floor|fl|room|rm)\.?\s+\w+|#\s*\w+))?{_GAP}{_TOWN}(?:{_GAP}[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?)?"
# address forms by the words that they cannot do without
ADDRESSES = [
    (STREETS_AFTER, rf"(?<![\w.-])(?:(?:flat|apartment|unit)\s+\w+{_GAP})?\d{{1,5}}[a-z]?\s+(?:{_CAP}\s+){{1,3}}{STREETS_AFTER}\b\.?{_US}"),
    (rf"\w*{STREETS_JOINED}", rf"(?<![\w.-])\b[^\W\d_]{{3,}}{STREETS_JOINED}\s+\d{{1,4}}[a-z]?{_GAP}\d{{4,5}}\s+{_TOWN}"),
    (STREETS_BEFORE_FR, rf"(?<![\w.-])\d{{1,4}}(?:\s+(?:bis|ter|quater))?,?\s+{STREETS_BEFORE_FR}\s+(?:[^\W\d_][\w'’.-]*\s+){{0,4}}?[^\W\d_][\w'’.-]*{_GAP}\d{{4,5}}\s+{_TOWN}"),
    (STREETS_BEFORE_ES, rf"(?<![\w.-])\b{STREETS_BEFORE_ES}\s+(?:[^\W\d_][\w'’.-]*\s+){{1,5}}?\d{{1,4}}(?:{_GAP}\d{{1,2}}\s?[ºª°](?:\s?[A-Z])?)?{_GAP}\d{{4,5}}\s+{_TOWN}"),
]
_ADDRESSES = [(re.compile(words, re.I), re.compile(form, re.I)) for words, form in ADDRESSES]
_PART = r"(?:[^\W\d_]['’])?[^\W\d_]{2,}"
_FAMILY = re.compile(rf"(?<![\w@.+-])({_PART}(?:-{_PART})?)(?![\w@])")
# the same for words that begin with none of the usual small letters
_CAPITAL = re.compile(rf"(?<![\w@.+-])(?![a-zß-öø-ÿа-яё\u4e00-\u9fff])({_PART}(?:-{_PART})?)(?![\w@])")
_SMALL_WORD = re.compile(r"[^\W\d_]+")
# words of the labels
_ID_WORDS = {"ssn", "social", "tax", "taxpayer", "tin", "itin", "steuer", "steuerid", "steuernummer", "insurance", "national", "ni", "nino", "passport", "reisepass", "travel", "identity", "id", "personalausweis", "ausweis", "dni", "nie"}
_PHONE_WORDS = {"tel", "telephone", "teléfono", "phone", "call", "text", "mobile", "cell", "fax", "contact", "number", "num", "numéro", "handy", "móvil", "ring", "whatsapp", "sms"}
_BEFORE = re.compile(r"(?<![\w@.+-])([^\W\d_]{2,}|[^\W\d_]\.?)(\s+[^\W\d_]\.?)?\s+$")
_AFTER = re.compile(r",\s+([^\W\d_]{2,}(?!\w)(?![@.+-]\w)(?:\s+[^\W\d_]\.(?!\w))?|[^\W\d_]\.(?!\w)(?:\s*[^\W\d_]\.(?!\w))?)")
_CONTEXT = re.compile(r"([^\W\d_]+)[^\w]*\s*([^\W\d_]+)?[^\w]*$")


@lru_cache(200_000)
def _street(word: str) -> int:
    """Bits of the address forms that a word may stand for."""
    return sum(1 << k for k, (words, _) in enumerate(_ADDRESSES) if words.fullmatch(word))


def _spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all pieces but names; of overlapping ones the kind that comes first here."""
    taken: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or b <= start for a, b, _ in taken):
            taken.append((start, end, kind))

    # each form is tried only where a character or word stands that it cannot do without
    small = text.lower()
    held = set(_SMALL_WORD.findall(small))
    if "@" in text or _AT_MARK.search(text) or "at" in held and "dot" in held:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    streets = 0
    for word in held:
        streets |= _street(word)
    for k, (_, form) in enumerate(_ADDRESSES):
        if streets >> k & 1:
            for m in form.finditer(text):
                add(*m.span(), "address")
    for m in (_PLAIN_ID_SMALL if small == text else _PLAIN_ID).finditer(text):
        add(*m.span(), "id")
    if not held.isdisjoint(_ID_WORDS):
        for m in _LABELLED_ID.finditer(text):
            add(*m.span(1), "id")
    for m in PHONE.finditer(text):
        add(*m.span(), "phone")
    if not held.isdisjoint(_PHONE_WORDS):
        for m in _LABELLED_PHONE.finditer(text):
            add(*m.span(1), "phone")
    return taken


def _context(text: str, start: int) -> str:
    """The word right in front, and the two words in front, joined by a bar."""
    m = _CONTEXT.search(text[max(0, start - 40) : start])
    if not m:
        return ""
    first, second = (x.lower() if x else "" for x in m.groups())
    return f"{second or first}|{first} {second}"


def name_candidates(text: str, spans: list[tuple[int, int, str]], uses: Counter) -> list[tuple[int, int, int, str, str, str, int]]:
    """(start, end, place of the family name, given, family, context, side) of everything of the form of a name.

    Both words begin with a capital, or the given name is an initial; in texts without capitals any two words
    may be a name. side 0: given name first, 1: family name first. Capitalised words are counted in ``uses``.
    """
    out = []
    no_capitals = text == text.lower()
    # a word of the text stands in a found piece if its start does
    inside = sorted((a, b) for a, b, _ in spans)
    for m in (_FAMILY if no_capitals else _CAPITAL).finditer(text):
        word = m.group(1)
        if not no_capitals:
            if not word[0].isupper():
                continue
            uses[word.lower().split("-")[0]] += 1
        if any(a <= m.start() < b for a, b in inside):
            continue
        family = word.lower().split("-")[0]
        near = text[max(0, m.start() - 40) : m.start()]
        last = near.rsplit(None, 1)[-1] if near[-1:].isspace() and near.strip() else ""
        before = _BEFORE.search(near) if last and (no_capitals or last != last.lower()) else None
        if before:
            first, start = before.group(1), max(0, m.start() - 40) + before.start(1)
            middle = before.group(2)
            if middle and first.lower() in TITLES:
                first, start = middle.strip(), max(0, m.start() - 40) + before.start(2) + len(middle) - len(middle.strip())
            elif middle and len(first.rstrip(".")) > 1 and not first[0].isupper() and not no_capitals:
                first, start = middle.strip(), max(0, m.start() - 40) + before.start(2) + len(middle) - len(middle.strip())
            initial = len(first.rstrip(".")) == 1
            good = (first[0].isupper() or no_capitals) and first.lower() not in TITLES and (not initial or first.endswith(".") or not first.isascii() or no_capitals)
            if good and not any(a < m.start() and start < b for a, b in inside):
                out.append((start, m.end(), m.start(), "." if initial else first.lower(), family, _context(text, start), 0))
        after = _AFTER.match(text, m.end()) if text.startswith(",", m.end()) else None
        if after:
            given = re.split(r"[\s.]", after.group(1))[0]
            if (given[0].isupper() or no_capitals) and given.lower() not in TITLES:
                out.append((m.start(), after.end(), m.start(), "." if len(given) == 1 else given.lower(), family, _context(text, m.start()), 1))
    return out


_PIECE = T.StructType(
    [T.StructField(n, t) for n, t in (("kind", T.StringType()), ("found", T.StringType()), ("at", T.IntegerType()), ("start", T.IntegerType()), ("given", T.StringType()), ("family", T.StringType()), ("context", T.StringType()), ("side", T.IntegerType()))]
)


def pieces(documents: DataFrame) -> DataFrame:
    """All found pieces, all candidates for names, and how often each capitalised word is used (kind ``word``, number in
    ``at``, partially summed), of documents (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            uses: Counter = Counter()
            for doc, text in zip(f.doc_id, f.text):
                spans = _spans(text)
                rows += [(doc, kind, text[a:b], a, a, None, None, None, 0) for a, b, kind in spans]
                rows += [(doc, "name", text[a:b], at, a, given, family, context, side) for a, b, at, given, family, context, side in name_candidates(text, spans, uses)]
            rows += [(None, "word", None, n, None, None, word, None, None) for word, n in uses.items()]
            table = pd.DataFrame(rows, columns=["doc_id", *_PIECE.names])
            yield table.astype({c: "Int64" for c in ("at", "start", "side")})

    schema = T.StructType([documents.schema["doc_id"], *_PIECE.fields])
    return documents.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(run, schema)


def _endings(c: str):
    return F.explode(F.array(*[F.substring(F.col(c), -n, n) for n in ENDINGS]))


def weigh(candidates: DataFrame, uses: DataFrame, given_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Families (family, disclosure) among the words of the candidates, given names and contexts that the corpus shows to be those of people.

    ``uses`` (family, uses) tells how often each word stands in the corpus at all. The disclosure of a word is log2 of
    the odds that one of its uses has a listed given name or initial beside it, over those of all words. Everything is an aggregation over all candidates, with partial sums before the shuffle.
    """
    listed = given_names.select(F.lower(F.trim("given_name")).alias("given")).where("given is not null").distinct().withColumn("listed", F.lit(1))
    known = candidates.join(listed, "given", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    not_given = known.join(listed.select(F.col("given").alias("family")), "family", "left_anti")
    person = (F.col("listed") == 1) | (F.col("given") == ".")
    total, named = (uses.agg(F.sum("uses")).first()[0] or 0), not_given.where("listed = 1").count()
    base = max(named, 1) / max(total - named, 1)
    stats = not_given.groupBy("family").agg(F.sum(person.cast("int")).alias("k"), F.countDistinct(F.when(F.col("listed") == 1, F.col("given"))).alias("companions"), F.max((F.col("given") == ".").cast("int")).alias("initials"))
    stats = stats.where("k > 0").join(uses, "family", "left").withColumn("n", F.greatest("k", F.coalesce("uses", "k")))
    bits = F.log2((F.col("k") + 0.5) / (F.col("n") - F.col("k") + 0.5) / F.lit(base))
    stats = materialize(stats, "stats")
    revealing = (bits >= BITS) & (F.col("k") >= SHARE * F.col("n"))
    families = stats.where(revealing & (F.col("companions") + F.col("initials") >= COMPANIONS)).select("family", bits.alias("disclosure"))
    # a word that is too rare to tell counts as its ending does, over all uses of words with that ending
    ends = stats.withColumn("ending", _endings("family")).groupBy("ending").agg(F.sum("k").alias("k"), F.count_if(F.col("companions") > 0).alias("words"))
    ends = ends.join(uses.withColumn("ending", _endings("family")).groupBy("ending").agg(F.sum("uses").alias("n")), "ending").where(revealing & (F.col("words") >= ENDING_WORDS)).select("ending", bits.alias("disclosure"))
    words = not_given.select("family").distinct().withColumn("ending", _endings("family")).join(ends, "ending").select("family", "disclosure")
    families = families.union(words).groupBy("family").agg(F.max("disclosure").alias("disclosure"))
    families = materialize(families, "families")
    with_family = not_given.join(families, "family", "left").withColumn("sure", F.col("disclosure").isNotNull().cast("int"))
    by_given = with_family.where("listed = 0 and given <> '.'").groupBy("given").agg(F.count("*").alias("n"), F.sum("sure").alias("k"), F.countDistinct(F.when(F.col("sure") == 1, F.col("family"))).alias("companions"))
    givens = by_given.where((F.col("companions") >= COMPANIONS) & (F.col("k") >= SHARE * F.col("n"))).select("given")
    givens = materialize(givens.union(listed.select("given")).distinct(), "givens")
    both = with_family.join(givens.withColumn("is_given", F.lit(1)), "given", "left")
    sure = (F.col("sure") == 1) & (F.col("is_given").isNotNull() | (F.col("given") == "."))
    seen = both.where("context <> ''").select(F.explode(F.split("context", r"\|")).alias("context"), sure.alias("sure"), "family")
    contexts = seen.groupBy("context").agg(F.count("*").alias("n"), F.sum(F.col("sure").cast("int")).alias("k"), F.countDistinct("family").alias("words"))
    contexts = contexts.where((F.col("n") >= CONTEXT_USES) & (F.col("k") >= CONTEXT_SHARE * F.col("n")) & (F.col("words") >= COMPANIONS)).select("context")
    return families, givens, materialize(contexts, "contexts")


def found_pieces(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, kind, found, start): every place of personal information in documents (doc_id, text).

    Null, empty and blank texts hold none; rows with a null doc_id are left out; without given names only
    grammars are applied; empty tables give no rows; other columns are not read. Very long texts are read whole.
    """
    every = materialize(pieces(documents), "pieces")
    candidates = every.where("kind = 'name'")
    uses = every.where("kind = 'word'").groupBy("family").agg(F.sum("at").alias("uses"))
    families, givens, contexts = weigh(candidates, uses, given_names)
    joined = candidates.join(families.withColumn("is_family", F.lit(True)), "family", "left").join(givens.withColumn("is_given", F.lit(True)), "given", "left")
    for k in (0, 1):
        joined = joined.join(contexts.select(F.col("context").alias(f"context{k}"), F.lit(True).alias(f"trusted{k}")), F.get(F.split("context", r"\|"), F.lit(k)) == F.col(f"context{k}"), "left")
    joined = joined.join(givens.select(F.col("given").alias("family"), F.lit(True).alias("family_is_given")), "family", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    is_given = yes("is_given") | (F.col("given") == ".")
    family, trusted = yes("is_family"), yes("trusted0") | yes("trusted1")
    named = ((family & is_given) | (trusted & (family | is_given))) & ~yes("family_is_given")
    names = joined.where(named).groupBy("doc_id", "at").agg(F.min(F.struct("side", "start", "found")).alias("r")).select("doc_id", F.lit("name").alias("kind"), "r.found", "r.start")
    return every.where("kind not in ('name', 'word')").select("doc_id", "kind", "found", "start").union(names)


def redacted(documents: DataFrame, found: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, text) with every found piece (doc_id, kind, found, start) replaced by its kind in brackets; all rows of ``documents`` stay.

    Pieces are replaced where they stand; of overlapping ones the first. Family names are replaced also where they stand alone as
    whole words, and so are pieces of another delivery of the document; ``given_names`` are left there, since they
    disclose too little. Only findings are joined with the documents; a null text stays null.
    """
    pieces = found.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "found", "kind"))).alias("pieces"))
    parts = found.where("kind = 'name'").select("doc_id", F.explode(F.split("found", r"[^\p{L}]+")).alias("part")).where("length(part) >= 2")
    listed = given_names.select(F.lower(F.trim("given_name")).alias("given")).where("given is not null").distinct()
    parts = parts.join(listed, F.lower("part") == F.col("given"), "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_set("part"), asc=False).alias("parts"))
    joined = documents.select("doc_id", "text").join(pieces.join(parts, "doc_id", "left"), "doc_id", "left")

    placeholder = lambda p: F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]"))
    stands = lambda p: F.substring(F.col("text"), p["start"] + 1, F.length(p["found"])) == p["found"]
    rest = lambda acc: F.substring(F.col("text"), acc["at"] + 1, F.length("text"))

    def put(acc, p):
        here = F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, p["start"] - acc["at"]), placeholder(p)).alias("done"), (p["start"] + F.length(p["found"])).cast("int").alias("at"))
        return F.when(stands(p) & (p["start"] >= acc["at"]), here).otherwise(acc)

    in_place = F.aggregate("pieces", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), put, lambda acc: F.concat(acc["done"], rest(acc)))
    word = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}_])"))
    elsewhere = F.aggregate(F.filter("pieces", lambda p: ~stands(p)), in_place, lambda acc, p: F.regexp_replace(acc, word(p["found"]), placeholder(p)))
    alone = F.aggregate(F.coalesce("parts", F.array().cast("array<string>")), elsewhere, lambda acc, x: F.regexp_replace(acc, word(x), F.lit("[NAME]")))
    return joined.select("doc_id", F.when(F.col("pieces").isNull() | F.col("text").isNull(), F.col("text")).otherwise(alone).alias("text"))
