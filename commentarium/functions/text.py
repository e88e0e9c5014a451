"""Text expressions. Patterns spell out Unicode classes, so that the JVM and other engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space other than the blank, as characters.
OTHER_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Edges of a word, as classes and not as \b, which engines define differently.
B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
S = f"[{WS}]"

# What links, handles and each spam rule look like, in the order of the rules. Beside each rule a code of ours and the words of which it needs one.
URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"
HANDLE = r"@[A-Za-z0-9_.]{3,}"
SPAM_RULES = (
    (rf"https?://[^{WS}]+", "link", ("http",)),
    (rf"www\.[^{WS}]+", "www", ("www.",)),
    (HANDLE, "handle", ("@",)),
    (rf"{B}subscribe{S}+to{S}+my{E}", "subscribe", ("subscribe",)),
    (rf"{B}check{S}+(?:out{S}+)?my{S}+(?:channel|page|profile){E}", "own channel", ("check",)),
    (rf"{B}follow{S}+me{E}", "follow", ("follow",)),
    (rf"{B}link{S}+in{S}+(?:my{S}+)?bio{E}", "bio", ("link",)),
    (rf"{B}(?:bitcoin|crypto|btc|eth|nft|usdt|solana){E}", "coins", ("bitcoin", "crypto", "btc", "eth", "nft", "usdt", "solana")),
    (rf"{B}giveaway{E}", "giveaway", ("giveaway",)),
    (rf"{B}dm{S}+me{E}", "message", ("dm",)),
    (rf"{B}whatsapp{E}", "messenger w", ("whatsapp",)),
    (rf"{B}telegram{E}", "messenger t", ("telegram",)),
    (rf"{B}earn{S}+[$]", "earn", ("earn",)),
    (rf"{B}make{S}+money{E}", "money", ("make",)),
    (rf"{B}cash{S}*app{E}", "cash", ("cash",)),
    (rf"^{S}*first{S}*[!.]*{S}*$", "first", ("first",)),
    (rf"{B}who'?s?{S}+(?:here|watching){S}+in{S}+2[0-9]{{3}}{E}", "who watches", ("who",)),
    (rf"{B}still{S}+watching{S}+in{S}+2[0-9]{{3}}{E}", "still watches", ("still",)),
    (rf"{B}like{S}+if{S}+you'?r?e?{S}+(?:still{S}+)?watching{E}", "like if", ("like",)),
    (rf"{B}gang{S}*[!.]*$", "gang", ("gang",)),
    (rf"{B}notification{S}+squad{E}", "squad", ("notification",)),
)
# Signals of sarcasm.
SARCASM = (
    rf"{B}yeah right{E}|{B}not{S}+[\p{{L}}\p{{N}}_]+{S}+(?:good|great|amazing|best|elite|special|incredible){E}"
    rf"|{B}overrated+d*{E}|{B}lmao{E}|{B}lmfao{E}|💀|🙄|{B}sooo+{S}+(?:good|great|amazing|elite){E}"
)
SARCASM_SLICE = (
    rf"{B}yeah right{E}|{B}sure jan{E}|{B}oh{S}+sure{E}|{B}suuure{E}|{B}obviously{E}|{B}totally{E}|{B}wow{S}+wow{S}+wow{E}"
    rf"|{B}sooo+{S}+(?:good|great|amazing|elite){E}|{B}waow{E}|{B}overrated+d*{E}|{B}(?:definitely|clearly){S}+not{E}"
    rf"|{B}not{S}+[\p{{L}}\p{{N}}_]+{S}+(?:good|great|amazing|best|elite|special|incredible){E}"
    r'|(?:^|[^\p{L}\p{N}_])"[^"]{3,40}"' + r"|'[^']{3,30}'|💀|🙄|😒|🤡|😬"
    rf"|{B}(?:lmao|lol|bruh|smh|kek|kappa){E}|{B}my{S}+sides{E}|{B}sure{S}+(?:buddy|bro|man|pal|champ){E}"
    rf"|{B}he(?:'?s)?{S}+(?:so|such{S}+a){S}+(?:bad|terrible|awful|garbage|trash){E}|{B}what{S}+a{S}+(?:joke|clown|fraud){E}"
    rf"|{B}sure{S}+he{S}+(?:can|will|does){E}"
)
MIN_CLEANED_LENGTH, MIN_TOKEN_COUNT, MIN_LANGUAGE_LENGTH = 4, 2, 20


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, whatever the case; null counts as no."""
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def nfc(text: Column) -> Column:
    """Composed form; plain ASCII stays as it is, without a call."""
    safe = F.coalesce(text, F.lit(""))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), safe, F.lit(False))
    return F.when(safe.rlike(r"^\p{ASCII}*$"), safe).otherwise(composed)


def collapsed(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS)), " {2,}", " "))


def _has(low: Column, parts: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | low.contains(p)
    return test


def cleaned(text: Column) -> Column:
    """Composed text without links and handles, white space collapsed; null gives the empty text.

    Patterns run only on texts that hold what they must begin with.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    out = nfc(text)
    out = F.when(_has(low, ("http", "www.")), F.regexp_replace(out, "(?iu)" + URL, " ")).otherwise(out)
    out = F.when(text.contains("@"), F.regexp_replace(out, HANDLE, " ")).otherwise(out)
    return collapsed(out)


def repeat_key(text: Column) -> Column:
    """MD5 of what is the same up to case, symbols and punctuation."""
    out = F.regexp_replace(F.lower(text), rf"[^a-z 0-9_\p{{L}}\p{{N}}{WS}]+", "")
    return F.md5(collapsed(out))


def too_little(clean: Column) -> Column:
    """Fewer characters than worth a look, or not two runs of ASCII letters."""
    return (F.length(clean) < MIN_CLEANED_LENGTH) | ~clean.rlike("(?s)[a-zA-Z]{2,}[^a-zA-Z].*?[a-zA-Z]{2}")


def spam_reason(original: Column, low: Column, clean: Column) -> Column:
    """Why a comment is spam: too little text, or the first rule that its original text meets; null if none.

    ``low`` is the lower-cased original: a rule's pattern runs only where one of its words occurs at all.
    """
    rules = [F.when(_has(low, parts) & matches(original, p), F.lit(why)) for p, why, parts in SPAM_RULES]
    return F.when(too_little(clean), "too little text").otherwise(F.coalesce(*rules))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def count_of(tokens: Column, wanted: list[str]) -> Column:
    """How many tokens are among the wanted words."""
    return F.size(F.filter(tokens, lambda t: t.isin(wanted))) if wanted else F.lit(0)


def keyword_pattern(keyword: str, flexible_space: bool = True) -> str:
    """A keyword between word edges; several words with any white space between, or with exactly one blank."""
    import re

    parts = [re.escape(p) for p in keyword.split()]
    return B + (f"{S}+" if flexible_space else " ").join(parts) + E
