"""Problem 6: one consistent form for text that looks the same but is written with other characters."""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.tables import load

# Letters of two scripts that look alike, each pair as "Latin other".
CYRILLIC_PAIRS = (
    "aа eе oо pр cс yу xх iі sѕ jј dԁ hһ qԛ wԝ kк "
    "AА BВ EЕ KК MМ HН OО PР CС TТ YУ XХ IІ SЅ JЈ GԌ WԜ QԚ"
)
GREEK_PAIRS = "oο vν aα pρ iι uυ kκ xχ yγ AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ"
#: Forms that compatibility decomposition undoes and that only differ in look.
FORM_TAGS = ("<wide>", "<narrow>", "<font>", "<compat>", "<circle>", "<square>")
#: Kinds of changes in the order in which they are reported.
KINDS = ("form", "accent", "invisible", "blank", "script", "punctuation")
#: Kinds that make a value a case; full-width punctuation by itself is none.
CASES = ("form", "accent", "invisible", "blank", "script")
#: Scripts that one word may mix, by the first word of the characters' Unicode names.
TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "HANGUL": "CJK", "BOPOMOFO": "CJK", "KATAKANA-HIRAGANA": "CJK"}
SCRIPTS = frozenset(
    "LATIN CYRILLIC GREEK ARMENIAN HEBREW ARABIC SYRIAC DEVANAGARI BENGALI GURMUKHI GUJARATI TAMIL TELUGU KANNADA "
    "MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR GEORGIAN ETHIOPIC CHEROKEE KHMER MONGOLIAN COPTIC CJK".split()
)

EMOJI = r"\p{So}\p{Sk}\p{Emoji_Presentation}"
INVISIBLE = regex.compile(
    rf"(?<![{EMOJI}️⃣\U000E0020-\U000E007F])‍|‍(?![{EMOJI}\p{{Emoji=Yes}}])"
    rf"|(?<=[[\p{{L}}\s]--\p{{Emoji=Yes}}]|^)[︀-️]|(?<=\p{{N}})[︀-️](?!⃣)"
    rf"|(?<![{EMOJI}\U000E0020-\U000E007F])[\U000E0020-\U000E007F]"
    r"|[\p{Cf}͏ᅟᅠ឴឵ㅤﾠ--[‍\U000E0020-\U000E007F]]",
    regex.V1,
)
BLANK = regex.compile(r"[\p{Zs}\t--[\ ]]", regex.V1)
IS_EMOJI = regex.compile(r"\p{Emoji=Yes}")
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
#: Scripts as the JVM knows them; those that one word may mix stand together.
JVM_SCRIPTS = (
    ("Cyrillic",), ("Greek",), ("Armenian",), ("Hebrew",), ("Arabic",), ("Syriac",), ("Devanagari",), ("Bengali",), ("Gurmukhi",), ("Gujarati",), ("Tamil",), ("Telugu",),
    ("Kannada",), ("Malayalam",), ("Sinhala",), ("Thai",), ("Lao",), ("Tibetan",), ("Myanmar",), ("Georgian",), ("Ethiopic",), ("Cherokee",), ("Khmer",), ("Mongolian",),
    ("Coptic",), ("Han", "Hiragana", "Katakana", "Hangul", "Bopomofo"),
)
_BETWEEN = r"[\p{N}\p{M}]*"
#: Ranges of suspect characters are joined over gaps of up to so many others, beyond the blocks of Latin letters.
GAP, LATIN_END = 64, 0x250


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        found = defaultdict(list)
        for x in list(self.parent):
            found[self.find(x)].append(x)
        return found


@lru_cache(maxsize=65_536)
def script(char: str) -> str:
    """Script of a letter; empty for what belongs to none or to all."""
    if unicodedata.category(char)[0] != "L":
        return ""
    first = unicodedata.name(char, "").split(" ")[0]
    first = TOGETHER.get(first, first)
    return first if first in SCRIPTS else ""


@lru_cache(maxsize=1)
def _links() -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[tuple[str, str]]]:
    """Pairs that look the same: form and plain; letter with combining accent and composed letter; letters across scripts."""
    forms, accents = [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        parts = unicodedata.decomposition(char)
        if not parts or IS_EMOJI.match(char):
            continue
        if parts.startswith(FORM_TAGS):
            plain = unicodedata.normalize("NFKC", char)
            if plain != char and not plain.isspace() and not unicodedata.combining(plain[0]) and plain[0] != " ":
                forms.append((char, plain))
        elif not parts.startswith("<") and " " in parts and unicodedata.normalize("NFC", char) == char:
            accents.append((unicodedata.normalize("NFD", char), char))
            base, mark = (chr(int(x, 16)) for x in parts.split())
            accents.append((base + mark, char))
    across = [tuple(pair) for pair in (*CYRILLIC_PAIRS.split(), *GREEK_PAIRS.split())]
    return forms, accents, across


def _ranges(points: Iterable[int]) -> str:
    """A few ranges, as in a character class, that hold all of ``points``."""
    joined: list[list[int]] = []
    for p in sorted(points):
        if joined and p - joined[-1][1] <= (GAP if joined[-1][1] >= LATIN_END else 1):
            joined[-1][1] = p
        else:
            joined.append([p, p])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in joined)


@lru_cache(maxsize=1)
def suspect() -> str:
    """What a value must hold to be looked at more closely; for the JVM, so that plain values never reach Python.

    Made from the same pairs as the rewriting, so it misses nothing that the rewriting changes: any form, anything
    that may combine, be invisible, a blank, or unknown to the JVM, and two neighbouring letters of different scripts.
    ASCII, which most values are written in, is told apart by quick classes first.
    """
    forms, accents, _ = _links()
    after = {ord(pair[-1]) for pair, _ in accents if unicodedata.category(pair[-1])[0] != "M"}
    found = _ranges({ord(a) for a, _ in forms} | after)
    groups = ["".join(f"\\p{{Is{name}}}" for name in names) for names in JVM_SCRIPTS]
    others = "|".join(rf"[{group}]{_BETWEEN}[\p{{L}}&&[^{group}]]" for group in groups)
    latin = rf"{_BETWEEN}[\p{{L}}&&[^\p{{IsLatin}}]]"
    return (
        rf"\t|[a-zA-Z](?![a-zA-Z ]){latin}"
        rf"|(?=[^\x00-\x7F])(?:[\p{{M}}\p{{Cf}}\p{{Zs}}\p{{Cn}}\x{{115F}}\x{{1160}}\x{{3164}}\x{{FFA0}}{found}]|\p{{IsLatin}}{latin}"
        rf"|[\p{{L}}&&[\p{{IsCommon}}\p{{IsInherited}}]]{_BETWEEN}\p{{L}}|{others})"
    )


class Rewriter:
    """Representatives and automata for given corpus frequencies of strings."""

    def __init__(self, counts: dict[str, int]):
        forms, accents, across = _links()
        #: Classes within a script: every member is written as the one that the corpus has most often.
        same = Classes()
        for a, b in (*forms, *accents):
            same.union(a, b)
        kind = {a: ("form" if b[0].isalnum() else "punctuation") for a, b in forms} | {a: "accent" for a, _ in accents}
        self.automaton = ahocorasick.Automaton()
        plain = {b for _, b in (*forms, *accents)}
        for members in same.members().values():
            natural = [m for m in members if m in plain and m not in kind] or members
            best = max(natural, key=lambda m: (counts.get(m, 0), -len(m), m))
            for m in members:
                if m != best and m in kind:
                    self.automaton.add_word(m, (kind[m], best, len(m)))
        self.automaton.make_automaton()
        #: Classes across scripts: the member of each script, for words that mix scripts.
        mixed = Classes()
        for a, b in across:
            mixed.union(a, b)
        self.in_script: dict[str, dict[str, str]] = {}
        for members in mixed.members().values():
            best: dict[str, str] = {}
            for m in members:
                s = script(m)
                if s not in best or (counts.get(m, 0), m) > (counts.get(best[s], 0), best[s]):
                    best[s] = m
            for m in members:
                self.in_script[m] = best
        self.script_counts: Counter = Counter()
        for text, n in counts.items():
            for c in text:
                if s := script(c):
                    self.script_counts[s] += n

    def _word(self, word: str, kinds: set[str]) -> str:
        found = Counter(s for c in word if (s := script(c)))
        if len(found) < 2:
            return word
        kinds.add("script")

        def fits(target: str) -> tuple:
            stay = sum(n for s, n in found.items() if s == target)
            moved = sum(1 for c in word if script(c) not in ("", target) and target in self.in_script.get(c, {}))
            return (stay + moved, stay == 0, self.script_counts[target], stay)

        target = max(found, key=fits)
        return "".join(self.in_script.get(c, {}).get(target, c) if script(c) not in ("", target) else c for c in word)

    def rewrite(self, text: str) -> tuple[str, set[str]]:
        """The consistent form and the kinds of changes that led to it."""
        kinds: set[str] = set()
        if text.isascii() and "\t" not in text:
            return text, kinds
        out = INVISIBLE.sub("", text)
        if out != text:
            kinds.add("invisible")
        blanks = BLANK.sub(" ", out)
        if blanks != out:
            kinds.add("blank")
        for _ in range(2):  # forms first, then the accents that follow them
            parts, at = [], 0
            for end, (what, to, n) in self.automaton.iter_long(blanks):
                begin = end - n + 1
                parts += (blanks[at:begin], to)
                at = end + 1
                kinds.add(what)
            if not parts:
                break
            blanks = "".join((*parts, blanks[at:]))
        return WORD.sub(lambda m: self._word(m.group(), kinds), blanks), kinds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each code point, and of each letter with a combining mark after it, in this task's values."""
    singles, pairs = np.zeros(0x110000, dtype=np.int64), Counter()
    marks = np.array([p for p in range(0x300, 0x370)] + [0x3099, 0x309A], dtype=np.uint32)
    for batch in batches:
        for column in batch.columns:
            codes = np.frombuffer("\n".join(x for x in column.to_pylist() if x).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if not len(codes):
                continue
            top = np.bincount(codes)
            singles[: len(top)] += top
            after = np.flatnonzero(np.isin(codes[1:], marks) if top[0x300:].any() else np.zeros(0, bool))
            pairs.update(zip(codes[after].tolist(), codes[after + 1].tolist()))
    used = np.flatnonzero(singles)
    keys = [chr(p) for p in used if not 0xD800 <= p < 0xE000] + [chr(a) + chr(b) for a, b in pairs]
    values = [int(singles[p]) for p in used if not 0xD800 <= p < 0xE000] + list(pairs.values())
    yield pa.RecordBatch.from_pydict({"piece": pa.array(keys, pa.string()), "n": pa.array(values, pa.int64())})


def piece_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Corpus counts of code points and accented pairs over all values; as many as Unicode has, whatever the corpus."""
    values = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    total = values.mapInArrow(_counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in total.collect()}


def _rewriting(counts: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(counts)
        for batch in batches:
            done = [rewriter.rewrite(x) if x is not None else (None, ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            plain = pa.array([p for p, _ in done], pa.string())
            kinds = pa.array([[k for k in KINDS if k in found] for _, found in done], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], plain, kinds], names=[*batch.schema.names[:-1], "plain", "kinds"])

    return run


def consistent_forms(df: DataFrame, ident: str, columns: Iterable[str]) -> DataFrame:
    """``ident``, ``field_name``, ``plain`` and ``kinds`` of every value of ``columns`` that the consistent form changes.

    Look-alike classes come from the transitive closure of pairs over strings and code points: full-width, ligature
    and mathematical forms with plain letters, accented pairs with composed letters, letters across scripts. Each
    class is written as its member that the whole corpus has most often; a multi-pattern automaton rewrites
    greedily, the longest match first. Letters across scripts change only inside words that mix scripts, into the
    script that fits the most letters of the word. Emoji keep their joiners and selectors.

    Null and empty values, values already consistent and rows of an empty table give no rows. A null identifier
    stays null and repeated rows give repeated rows. Other columns don't come out, whatever their names. Values are
    rewritten whole, however long.
    """
    columns = list(columns)
    counts = piece_counts(df, columns)
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.col(ident).alias("id"), F.explode(fields).alias("f")).select("id", "f.field_name", "f.value")
    looked_at = long.filter(F.col("value").rlike(suspect()))
    kind = looked_at.schema["id"].dataType.simpleString()
    done = looked_at.mapInArrow(_rewriting(counts), f"id {kind}, field_name string, plain string, kinds array<string>")
    return done.filter(F.size("kinds") > 0).withColumnRenamed("id", ident)


def p6_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment's text or author that changes, in its one consistent form. Text and author of a comment never differ between deliveries."""
    rows = load(spark, sf_dir, "comments").filter(F.col("comment_id").isNotNull()).select("comment_id", "text", "author")
    return consistent_forms(rows, "comment_id", ["text", "author"]).dropDuplicates(["comment_id", "field_name"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.arrays_overlap("kinds", F.array(*map(F.lit, CASES)))
    return p6_rewritten(spark, sf_dir).filter(cases).select("comment_id", "field_name")


QUERIES = {"p6_found": p6_found, "p6_rewritten": p6_rewritten}

_FORMS = "[\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{FB00}-\\x{FB06}\\x{1D400}-\\x{1D7FF}]"
_HIDDEN = "[\\x{00AD}\\x{200B}\\x{200C}\\x{200E}\\x{200F}\\x{2060}\\x{FEFF}]|(?:^|[\\p{L}\\p{N}\\p{P}\\p{Z}])\\x{200D}|\\x{200D}(?:$|[\\p{L}\\p{N}\\p{P}\\p{Z}])"
_BLANKS = "[\\t\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
_MIXED = "|".join(f"\\p{{{a}}}[\\p{{L}}\\p{{N}}\\p{{M}}]*\\p{{{b}}}" for a in ("Latin", "Cyrillic", "Greek") for b in ("Latin", "Cyrillic", "Greek") if a != b)
SQL = {
    "p6_found": f"""
        WITH v AS (SELECT DISTINCT comment_id, unnest(['text', 'author']) AS field_name, unnest([text, author]) AS v FROM comments WHERE comment_id IS NOT NULL)
        SELECT DISTINCT comment_id, field_name FROM v
        WHERE regexp_matches(v, '{_FORMS}') OR regexp_matches(v, '{_HIDDEN}') OR regexp_matches(v, '{_BLANKS}') OR regexp_matches(v, '{_MIXED}')
           OR (regexp_matches(v, '[\\x{{0300}}-\\x{{036F}}]') AND nfc_normalize(v) <> v)
    """,
}
