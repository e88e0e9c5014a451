"""Problem 10: personal information inside free text, found and replaced by keyed surrogates or typed placeholders."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentarium.llm.languages import PIECE_FILE, TOKENIZER_DIR
from commentarium.session import ship_bytes, written
from commentarium.tables import load

KINDS = ("email", "phone", "id_number", "address", "name")
#: Variable that holds the key of the surrogates; who knows the key can tell which value a surrogate stands for.
KEY_VARIABLE = "SURROGATE_KEY"
#: A family name that is also an ordinary word must follow so many different given names.
DISTINCT_GIVENS, DISTINCT_FAMILIES = 2, 2

# Words of addresses and titles.
STREETS_EN = "Street|St|Lane|Ln|Avenue|Ave|Road|Rd|Drive|Dr|Court|Ct|Boulevard|Blvd|Place|Terrace|Square|Crescent|Close|Way"
STREETS_DE = "straße|strasse|str\\.|weg|allee|gasse|platz|ring|ufer|damm|steig"
STREETS_FR = "rue|chemin|avenue|boulevard|allée|impasse|place|quai|route|cours|sentier"
STREETS_ES = "Calle|C/|Plaza|Avenida|Avda\\.?|Paseo|Camino|Carretera|Ronda|Rua|Travessa|Praça|Via|Viale|Piazza|Corso"
STREETS_RU = "улица|ул\\.|проспект|пр\\.|переулок|пер\\.|бульвар|набережная"
TITLES = (
    "mr mrs ms miss dr prof sir madam herr frau señor señora sr sra don doña monsieur madame mademoiselle m mme mlle "
    "signor signora sig dottor senhor senhora dona господин госпожа"
).split()

_L, _CAP = r"\p{L}", r"[\p{Lu}][\p{L}'’\-]+"
EMAIL = regex.compile(
    r"(?<![\w.+\-])(?P<user>[\w](?:[\w.+\-]*[\w])?)(?:@|\s?[\(\[\{]\s?(?:at|AT|@)\s?[\)\]\}]\s?|\s(?:AT|at)\s(?=[\w\-]+(?:\s(?:DOT|dot)\s[\w\-]+)+))"
    r"(?P<host>[\w\-]+(?:(?:\.|\s?[\(\[\{]\s?(?:dot|DOT|\.)\s?[\)\]\}]\s?|\s(?:DOT|dot)\s)[\w\-]+)+)"
)
DOT = regex.compile(r"\s?[\(\[\{]\s?(?:dot|DOT|\.)\s?[\)\]\}]\s?|\s(?:DOT|dot)\s")
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}+]|[\p{N}][.\-/ ]|[\p{L}]-)", r"(?![\p{L}\p{N}]|[\-./ ]\p{N}|-\p{L})"
PHONE = regex.compile(
    rf"{_BEFORE}(?:\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{1,12}}(?:[ .\-]\d{{2,8}}){{0,5}}"
    r"|(?:1[\-. ])?(?:\(\d{3}\) ?|\d{3}[\-.])\d{3}[\-. ]\d{4}"
    r"|0\d(?:[ .\-]\d{2}){4}|0\d{2,4}[ /]\d{5,8}(?:[ \-]\d{2,5})?)" + _AFTER
)
ID_NUMBER = regex.compile(
    rf"{_BEFORE}(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}} \d{{2}} \d{{4}}|[1-4] \d\d \d\d \d\d \d{{3}} \d{{3}} \d\d|[1-4]\d{{14}}"
    rf"|(?:[A-Z]{{2}} ?|[a-z]{{2}}(?=\d))\d{{4}} ?\d{{3}}|\d{{8}}[\- ]?[A-Za-z]){_AFTER}"
)
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}\-:.])(?:\d{{1,4}}[a-zA-Z]? (?:{_CAP} ){{1,3}}(?:(?i:{STREETS_EN}))(?![\p{{L}}])(?! {_CAP})"
    rf"|\d{{1,4}}[a-z]? (?!(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?|miles?|meters?|km) )[\p{{Ll}}]{{3,}} (?:street|st|lane|avenue|ave|road|rd|drive|court)(?![\p{{L}}])"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|BIS|TER))?,? (?i:{STREETS_FR}) (?:(?i:de la |de l['’]|du |des |de |d['’]))?[\p{{L}}][\p{{L}}'’\-]+"
    rf"|(?:[\p{{L}}][\p{{L}}\-]{{2,}}(?i:{STREETS_DE})|{_CAP} (?i:straße|allee|weg|gasse|platz)),? \d{{1,4}} ?[a-zA-Z]?(?![\p{{L}}\p{{N}}])"
    rf"|(?:(?i:{STREETS_ES}) ?(?i:de las |de los |de la |del |de |da |do |dos |das |della |dei )[\p{{L}}]|(?:{STREETS_ES}) ?[\p{{Lu}}])[\p{{L}}'’\-]+(?: {_CAP})?,? (?:n\.?º? ?)?\d{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])"
    rf"|(?i:{STREETS_RU}) {_CAP},? (?:д\. ?)?\d{{1,4}})"
)
GERMAN_NUMBER = regex.compile(r"^(.* \d{1,4}) [a-zA-Z]$")
FORWARD = regex.compile(rf"(?<![\p{{L}}\p{{N}}@#_.+\-])(?P<given>{_CAP})(?: \p{{Lu}}\.)? (?P<family>{_CAP})(?![\p{{L}}\p{{N}}@])")
BACKWARD = regex.compile(rf"(?<![\p{{L}}\p{{N}}@#_.+\-])(?P<family>{_CAP}), (?P<given>{_CAP})(?: \p{{Lu}}\.)?(?![\p{{L}}\p{{N}}@])")
LED = regex.compile(rf"(?:{_CAP}|\p{{Lu}}\.) $")
#: Quick looks that tell whether the slower patterns can match.
MAY_BE_EMAIL = re.compile(r"@|[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:AT|at)\s[\w\-]+\s(?:DOT|dot)\s")
MAY_BE_NUMBER = re.compile(r"\d")
#: Stretches that an address cannot leave: it holds no other characters, and no dot after these letters (none ends an abbreviation of streets) or digits.
STRETCH = re.compile(r"[\w ,'’\-/]+(?:(?<![b-mo-qs-z0-9])\.[\w ,'’\-/]*)*")


@lru_cache(maxsize=2)
def _ordinary(name: str) -> frozenset[str]:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return frozenset(f.read().split("\n"))


def _addresses(text: str) -> Iterator[regex.Match]:
    """Matches of ``ADDRESS`` in the stretches that hold a digit, which every address does."""
    for part in STRETCH.finditer(text):
        if MAY_BE_NUMBER.search(text, *part.span()):
            yield from ADDRESS.finditer(text, *part.span())


def patterned(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, begin, end, value) of what a pattern tells: mails, phones, identity numbers, addresses; none overlap."""
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    for m in EMAIL.finditer(text) if MAY_BE_EMAIL.search(text) else ():
        user, host = m["user"], DOT.sub(".", m["host"])
        if user.lower().startswith("mailto:"):
            user = user[7:]
        if regex.fullmatch(r"[\w\-]+(?:\.[\w\-]+)*\.\p{L}{2,}", host):
            taken.append(m.span())
            yield "email", m.start("user"), m.end(), f"{user}@{host}".lower()
    if not MAY_BE_NUMBER.search(text):
        return
    for kind, found in (("id_number", ID_NUMBER.finditer(text)), ("phone", PHONE.finditer(text)), ("address", _addresses(text))):
        for m in found:
            a, b = m.span()
            value = m.group()
            if kind == "address":
                if (cut := GERMAN_NUMBER.match(value)) and value[-1].isupper():
                    value = cut[1]
                    b = a + len(value)
                value = value.lower()
            else:
                value = "".join(c for c in value if c.isalnum()).lower()
                if kind == "phone" and not 9 <= len(value) <= 15:
                    continue
            if free(a, b):
                taken.append((a, b))
                yield kind, a, b, value


def _extracting(ordinary_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = _ordinary(ordinary_name)
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                rows += [(k, kind, a, b, value, None, None, False, False) for kind, a, b, value in patterned(text)]
                for m in FORWARD.finditer(text, overlapped=True):
                    given, family = m["given"].lower(), m["family"].lower()
                    rows.append((k, "name", *m.span(), f"{given} {family}", given, family, given in ordinary, family in ordinary))
                for m in BACKWARD.finditer(text):
                    if not LED.search(text, max(0, m.start() - 40), m.start()):
                        given, family = m["given"].lower(), m["family"].lower()
                        rows.append((k, "name", *m.span(), f"{given} {family}", given, family, given in ordinary, family in ordinary))
            cols = list(zip(*rows)) if rows else [[]] * 9
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            names = ["id", "kind", "first", "last", "value", "given", "family", "plain_given", "plain_family"]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], types))], names=names)

    return run


def _common_words(piece_path: str) -> str:
    """Whole lower-cased words of the public vocabulary, one a line: what counts as an ordinary word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return "\n".join(sorted({p[1:].lower() for p in pieces if p.startswith("▁") and len(p) > 2}))


def known_names(pairs: DataFrame, given_names: DataFrame, given: str) -> tuple[DataFrame, DataFrame]:
    """(given names, family names) that the corpus shows: words after known given names, then words before those, until no given name is new.

    An ordinary word is a family name only after ``DISTINCT_GIVENS`` different given names, so that what one given
    name often precedes ("Grace Period") isn't one. A new given name precedes ``DISTINCT_FAMILIES`` family names.
    """
    seeds = given_names.select(F.lower(F.trim(given)).alias("given")).filter("given <> ''").distinct()

    def families(givens: DataFrame) -> DataFrame:
        met = pairs.join(givens, "given", "left_semi").groupBy("family").agg(F.countDistinct("given").alias("n"), F.max("plain_family").alias("plain"))
        named = met.filter(~F.col("plain") | (F.col("n") >= DISTINCT_GIVENS)).select("family")
        return named.join(seeds.withColumnRenamed("given", "family"), "family", "left_anti")

    givens, known = seeds, -1
    while (n := givens.count()) > known:
        known = n
        met = pairs.join(families(givens), "family", "left_semi").filter(~F.col("given").isin(TITLES))
        learned = met.filter(~F.col("plain_given")).groupBy("given").agg(F.countDistinct("family").alias("n")).filter(F.col("n") >= DISTINCT_FAMILIES)
        givens = written(seeds.union(givens).union(learned.select("given")).distinct(), "givens")
    return givens, families(givens)


def find_pii(df: DataFrame, ident: str, text: str, given_names: DataFrame, given: str, piece_file: str | None = None) -> DataFrame:
    """``ident, pii_kind, pii_value, first, last, given, family`` of every finding: kind, normal form, place in the text, a name's parts.

    Patterns find mails (also spelled with "at" and "dot"), phones, identity numbers and street addresses. Names are
    pairs of capitalised words, in either order, of which the corpus shows that one is a given and the other a family
    name; those lists are joined, never gathered.

    Null, empty and blank texts give no rows, null ids none; repeated ids come out per row; an empty table or no
    given names give no names; other columns are ignored, whatever their names. Texts are searched whole.
    """
    common = ship_bytes(df.sparkSession, _common_words(piece_file or os.path.join(TOKENIZER_DIR, PIECE_FILE)).encode(), ".words")
    rows = df.filter(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, kind string, first int, last int, value string, given string, family string, plain_given boolean, plain_family boolean"
    found = written(rows.mapInArrow(_extracting(common), schema), "pii")
    people = found.filter("kind = 'name'")
    pairs = written(people.select("given", "family", "plain_given", "plain_family").distinct(), "pairs")
    givens, families = known_names(pairs, given_names, given)
    names = people.join(givens, "given", "left_semi").join(families, "family", "left_semi")
    columns = [F.col("id").alias(ident), F.col("kind").alias("pii_kind"), F.col("value").alias("pii_value"), "first", "last", "given", "family"]
    return found.filter("kind <> 'name'").select(*columns).unionByName(names.select(*columns))


# Syllables of surrogate family names and street names, in Latin and in Cyrillic letters.
SYLLABLES = "bar den fal gor hen kel lom mar nes pol rin sal tem vor wes zan".split()
SYLLABLES_RU = "бар ден фал гор хен кел лом мар нес пол рин сал тем вор вес зан".split()
CYRILLIC = regex.compile(r"\p{Cyrillic}")
#: From this draw on, a value's form is widened by a digit, a syllable or a second given name, as the form may be exhausted.
WIDENED_FROM = 3
#: Kinds of values that surrogates are drawn for; a name is made of its parts, so that they stay the same in other names.
DRAWN = ("email", "phone", "id_number", "address", "given", "family")


def _digest(key: str, kind: str, value: str, salt: int) -> bytes:
    return hmac.new(key.encode(), f"{kind}\x00{value}\x00{salt}".encode(), hashlib.sha256).digest()


def _made_word(digest: bytes, parts: int, like: str) -> str:
    """A word of syllables, in the script of ``like``."""
    syllables = SYLLABLES_RU if CYRILLIC.search(like) else SYLLABLES
    return "".join(syllables[b % len(syllables)] for b in digest[:parts])


def _feminine(given: str) -> bool:
    """By the ending, as no table tells the gender."""
    return given[-1:] in "aeéая"


def surrogate(key: str, kind: str, value: str, salt: int, givens: list[str]) -> str:
    """Another value of the same kind, form and script, decided by the key alone; ``salt`` numbers the draws.

    Widened draws (see ``WIDENED_FROM``) are longer, so that no form runs out of values.
    """
    d, wider = _digest(key, kind, value, salt), max(0, salt - WIDENED_FROM + 1)
    if kind == "email":
        return f"{_made_word(d, 3, 'a')}.{d[3 : 8 + min(wider, 20)].hex()}@mail.example"
    if kind in ("phone", "id_number"):
        out = []
        for k, c in enumerate(value + "0" * wider):
            x = d[k % len(d)] if k < len(d) else _digest(key, kind, value, salt + 1_000_000 * (k // len(d)))[k % len(d)]
            keep = kind == "phone" and k < 2
            out.append(c if keep else str(x % 10) if c.isdigit() else chr(97 + x % 26))
        return "".join(out)
    if kind == "address":
        words = regex.findall(r"\p{L}{4,}", value)
        longest = max(words[1:] or words or ["street"], key=len)
        name = _made_word(d[4:], 4 + wider, longest)
        made = regex.sub(r"\d+", lambda m: str(1 + int.from_bytes(d[:2], "big") % 10 ** max(2, len(m.group()))), value)
        return made.replace(longest, name + next((s for s in STREETS_DE.split("|") if longest.endswith(s)), ""), 1)
    if kind == "family":
        return _made_word(d[4:], 4 + wider, value)
    russian = bool(CYRILLIC.search(value))
    alike = [g for g in givens if bool(CYRILLIC.search(g)) == russian and g.isalpha()]
    alike = [g for g in alike if _feminine(g) == _feminine(value)] or alike
    if not alike:
        return _made_word(d[4:], 2 + wider, value) + (("а" if russian else "a") if _feminine(value) else "")
    drawn = [alike[int.from_bytes(d[4 * k : 4 * k + 4], "big") % len(alike)] for k in range(min(2, 1 + salt))]
    return "-".join([*drawn, _made_word(d[8:], 1 + wider, value)] if wider else drawn)


def assign_surrogates(findings: DataFrame, key: str, given_names: list[str]) -> DataFrame:
    """``pii_kind, pii_value, surrogate``: one surrogate per distinct value over the whole corpus, no two alike.

    Names are split: given and family names have a surrogate each, so persons of one family keep a common name, and a
    mail address whose user part is made of known names gets theirs. Of equal surrogates all but one are drawn again,
    as is every mail, number, address and family name that really occurs; this goes on until none is left, with wider
    forms from the third draw on.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values, salts = (b.column(k).to_pylist() for k in range(3))
            made = [surrogate(key, *row, given_names) for row in zip(kinds, values, salts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "surrogate"])

    schema = "pii_kind string, pii_value string, salt int, surrogate string"
    values = findings.select("pii_kind", "pii_value", "given", "family").distinct()
    people = values.filter("pii_kind = 'name'")
    parts = people.select(F.lit("given").alias("pii_kind"), F.col("given").alias("pii_value")).union(people.select(F.lit("family"), "family"))
    real = written(values.filter("pii_kind <> 'name'").select("pii_kind", "pii_value").union(parts).distinct(), "values")
    drawn = written(real.withColumn("salt", F.lit(0)).mapInArrow(draw, schema), "drawn")
    occurs = real.filter("pii_kind <> 'given'").select("pii_kind", F.col("pii_value").alias("surrogate"), F.lit(True).alias("occurs"))
    place = F.row_number().over(Window.partitionBy("pii_kind", "surrogate").orderBy("salt", "pii_value"))
    while True:
        judged = written(drawn.withColumn("place", place).join(occurs, ["pii_kind", "surrogate"], "left"), "judged")
        again = judged.filter("place > 1 OR occurs")
        if again.limit(1).count() == 0:
            break
        redrawn = again.select("pii_kind", "pii_value", (F.col("salt") + 1).alias("salt")).mapInArrow(draw, schema)
        drawn = written(judged.filter("place = 1 AND occurs IS NULL").select(*drawn.columns).union(redrawn), "drawn")
    single = drawn.drop("salt")
    given, family = (single.filter(F.col("pii_kind") == k).select(F.col("pii_value").alias(k), F.col("surrogate").alias(f"s_{k}")) for k in ("given", "family"))
    named = people.join(given, "given").join(family, "family").withColumn("surrogate", F.concat_ws(" ", "s_given", "s_family"))
    users = F.split(F.substring_index("pii_value", "@", 1), "[._-]")
    mails = single.filter("pii_kind = 'email'").select("pii_value", F.col("surrogate").alias("own"), users[0].alias("u0"), users[1].alias("u1"), F.size(users).alias("n"))
    orders = people.select(F.col("given").alias("u0"), F.col("family").alias("u1")).union(people.select("family", "given")).distinct()
    made = mails.filter("n = 2").join(orders, ["u0", "u1"], "left_semi")
    either = given.toDF("u", "s").withColumn("first", F.lit(0)).union(family.toDF("u", "s").withColumn("first", F.lit(1)))
    either = either.groupBy("u").agg(F.min(F.struct("first", "s"))["s"].alias("s"))
    personal = made.join(either.toDF("u0", "s0"), "u0").join(either.toDF("u1", "s1"), "u1")
    personal = personal.select("pii_value", F.concat(F.col("s0"), F.lit("."), F.col("s1"), F.lit("@"), F.regexp_extract("own", "([a-z]+[.][0-9a-f]+)@", 1), F.lit(".example")).alias("better"))
    plain = single.filter("pii_kind NOT IN ('given', 'family')").join(personal, "pii_value", "left")
    plain = plain.select("pii_kind", "pii_value", F.when(F.col("pii_kind") == "email", F.coalesce("better", "surrogate")).otherwise(F.col("surrogate")).alias("surrogate"))
    return plain.union(named.select("pii_kind", "pii_value", "surrogate").dropDuplicates(["pii_value"]))


def written_like(value: str, made: str, kind: str) -> str:
    """A surrogate in the form in which the value stands in the text: case, order of names, signs between digits."""
    if kind in ("phone", "id_number"):
        letters = iter(made)
        shown = "".join((x.upper() if c.isupper() else x) if c.isalnum() and (x := next(letters, "0")) else c for c in value)
        return shown + "".join(letters)
    if kind == "name":
        given, _, family = made.partition(" ")
        made = f"{family}, {given}" if "," in value else made
        return made.upper() if value.isupper() else made.title()
    if kind == "address":
        return made.upper() if value.isupper() else made if value.islower() else made.title()
    return made


def _replacing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with placeholders and with surrogates, and the values that don't stand in them any more."""
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        marked, disguised, gone = [], [], []
        for text, found in zip(texts, spans):
            a, b, at, values = [], [], 0, set()
            for s in sorted(found or (), key=lambda s: (s["first"], -s["last"])):
                values.add((s["pii_kind"], s["pii_value"]))
                if s["first"] < at:  # begins inside a longer finding; what stands out of it is taken along
                    at = max(at, s["last"])
                    continue
                here = text[s["first"] : s["last"]]
                a += (text[at : s["first"]], f"[{s['pii_kind'].upper()}]")
                b += (text[at : s["first"]], written_like(here, s["surrogate"], s["pii_kind"]))
                at = s["last"]
            marked.append(text if text is None else "".join((*a, text[at:])))
            disguised.append(text if text is None else "".join((*b, text[at:])))
            gone.append([{"pii_kind": k, "pii_value": v} for k, v in sorted(values)])
        kinds = pa.list_(pa.struct([("pii_kind", pa.string()), ("pii_value", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marked, pa.string()), pa.array(disguised, pa.string()), pa.array(gone, kinds)], names=["id", "placeholders", "surrogates", "replaced"]
        )


def replace_pii(df: DataFrame, ident: str, text: str, given_names: DataFrame, given: str, key: str) -> DataFrame:
    """``ident, placeholders, surrogates, replaced``: texts with typed placeholders, with keyed surrogates, and the values replaced.

    The rest of the text stays as it is. Rows without findings, null and empty texts come out unchanged. ``ident``
    must be unique, as findings are brought back to their text by it; the findings of one text are gathered, no more.
    Without a key there are no surrogates: an empty one is refused. Given names are drawn from all of ``given_names``,
    a list of names, so of a bounded size.
    """
    if not key:
        raise ValueError("surrogates need a key")
    findings = written(find_pii(df, ident, text, given_names, given), "findings")
    givens = sorted(r[0] for r in given_names.select(F.lower(F.trim(given))).filter(F.col(given).isNotNull()).distinct().collect())
    made = assign_surrogates(findings, key, givens)
    spans = findings.join(made, ["pii_kind", "pii_value"]).groupBy(ident).agg(F.collect_list(F.struct("first", "last", "pii_kind", "pii_value", "surrogate")).alias("spans"))
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(spans.withColumnRenamed(ident, "id"), "id", "left")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, placeholders string, surrogates string, replaced array<struct<pii_kind: string, pii_value: string>>"
    return rows.mapInArrow(_replacing, schema).withColumnRenamed("id", ident)


def _replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses the key in ``KEY_VARIABLE`` or, where it isn't set, one made for this run and then forgotten."""
    key = os.environ.get(KEY_VARIABLE) or secrets.token_hex(32)
    return replace_pii(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "given_names"), "given_name", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that were replaced in each document."""
    gone = _replaced_documents(spark, sf_dir).select("doc_id", F.explode("replaced").alias("r"))
    return gone.select("doc_id", "r.pii_kind", "r.pii_value").distinct()


def p10_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders and with surrogates."""
    return _replaced_documents(spark, sf_dir).drop("replaced")


QUERIES = {"p10_found": p10_found, "p10_replaced": p10_replaced}
SQL: dict[str, str] = {}
