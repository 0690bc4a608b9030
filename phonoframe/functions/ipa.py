"""IPA text functions as Spark expressions; one Arrow function for Unicode decomposition."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What normalising deletes and replaces.
STRIPPED = "[]/()"
REPLACED_FROM, REPLACED_TO = "g:'͜", "ɡːˈ͡"

# The token grammar. A base with marks and tied bases takes trailing modifiers; white space is in no token.
_MARKS = r"[\p{M}&&[^͜͡]]*"
_MODIFIERS = r"[ʰ-ˇˉ-ˋˍ-ˏ˒-˿]*"
TOKEN = rf"(?U)[\p{{L}}\p{{So}}\p{{Nd}}]{_MARKS}(?:[͜͡][\p{{L}}\p{{So}}]{_MARKS})*{_MODIFIERS}|[ˈˌ]|[ːˑ]|[.]|\p{{M}}+|\S"
#: A token of several characters: a base with what follows it, or marks alone.
SEVERAL = rf"(?U)[\p{{L}}\p{{So}}\p{{Nd}}](?=[\p{{M}}ʰ-ˇˉ-ˋˍ-ˏ˒-˿]){_MARKS}(?:[͜͡][\p{{L}}\p{{So}}]{_MARKS})*{_MODIFIERS}|\p{{M}}{{2,}}"
WORD_END = r"(?U)\s+"
#: What lies between the first and the last character of a run of ASCII; no token of several characters goes in there, as all but its bases are beyond ASCII.
INNER = r"(?<=[\x00-\x7F])[\x00-\x7F]+(?=[\x00-\x7F])"

#: Longer words are cut to pieces of about so many characters, each split to tokens on its own.
WORD_CHARS = 256
#: Where no token and no decomposition goes across: before all but marks, modifiers (U+0374 decomposes to one) and what Java's Unicode doesn't know yet, unless a tie bar is among the marks before it.
_CUT = r"(?<![͜͡]\p{M}{0,30})(?<!\p{M}{31})(?=[^\p{M}\p{Cn}ʰ-ˇˉ-ˋˍ-ˏ˒-˿\x{374}])"
PIECE = rf"(?s).{{1,{WORD_CHARS}}}(?:(?!{_CUT}).)*+"

# Sounds by class.
VOWELS = "i y ɨ ʉ ɯ u ɪ ʏ ʊ e ø ɘ ɵ ɤ o ə ɛ œ ɜ ɞ ʌ ɔ æ ɐ a ɶ ɑ ɒ".split()
PLOSIVES = "p b t d ʈ ɖ c ɟ k ɡ q ɢ ʔ".split()
NASALS = "m ɱ n ɳ ɲ ŋ ɴ".split()
TRILLS = "ʙ r ʀ".split()
TAPS = "ⱱ ɾ ɽ".split()
FRICATIVES = "ɸ β f v θ ð s z ʃ ʒ ʂ ʐ ç ʝ x ɣ χ ʁ ħ ʕ h ɦ".split()
LATERALS = "l ɭ ʎ ʟ ɬ ɮ".split()
APPROXIMANTS = "ʋ ɹ ɻ j ɰ w ʍ ɥ".split()
CLICKS = "ʘ ǀ ǃ ǂ ǁ".split()
IMPLOSIVES = "ɓ ɗ ʄ ɠ ʛ".split()
STRESS = "ˈ ˌ".split()
LENGTH = "ː ˑ".split()
MODIFIERS = "ʰ ʷ ʲ".split()
BOUNDARIES = [".", "-", " "]
COARSE_VOWELS = list("aɐɑæɒeɛəɜɞiɪɨoɔøœuʉʊɯʌyʏ")
# The fine classes in the order in which reports show them.
CLASSES = [
    ("vowel", "oral"), ("vowel", "nasalized"), ("consonant", "plosive"), ("consonant", "nasal"), ("consonant", "fricative"),
    ("consonant", "affricate"), ("consonant", "approximant"), ("consonant", "lateral"), ("consonant", "trill"), ("consonant", "tap/flap"),
    ("consonant", "click"), ("consonant", "implosive"), ("consonant", "ejective"), ("consonant", "other"), ("suprasegmental", "stress"),
    ("suprasegmental", "length"), ("suprasegmental", "tone"), ("modifier", "secondary articulation"), ("boundary", "syllable/word"), ("other", "unknown"),
]


def _named(*parts: str, start: bool = False, mark: bool = False) -> str:
    """A character class of what Unicode names so."""
    found = [i for i in range(0x80, 0x1E900) if any((n.startswith(p) if start else p in n) for n in [unicodedata.name(chr(i), "")] for p in parts) and (not mark or unicodedata.category(chr(i)) == "Mn")]
    runs: list[list[int]] = []
    for i in found:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


TONE, TONE_MARK, TILDE = _named("TONE"), _named("TONE", mark=True), _named("COMBINING TILDE", start=True)


#: Bytes of text, about, that a task holds as Python strings at once; one text at least.
TEXT_BYTES = 1 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about TEXT_BYTES."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > TEXT_BYTES:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    yield texts.slice(start)


@F.arrow_udf(T.StringType())
def nfd(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode canonical decomposition; Spark has no function for it."""
    for texts in parts:
        done = [pa.array([None if t is None else unicodedata.normalize("NFD", t) for t in some.to_pylist()], pa.string()) for some in _slices(texts)]
        yield pa.concat_arrays(done)


def decomposed(text: Column) -> Column:
    """Only texts with a character beyond ASCII go to Python."""
    return F.coalesce(nfd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _replaced(text: Column, old: str, new: str) -> Column:
    """Each character of ``old`` as that of ``new``, or as nothing; one search for each of a few is faster than ``translate``, which looks up every character of a text."""
    for i, c in enumerate(old):
        text = F.replace(text, F.lit(c), F.lit(new[i : i + 1]))
    return text


#: White space as Unicode has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def unbracketed(text: Column) -> Column:
    return _replaced(text, STRIPPED, "")


def _alike(text: Column) -> Column:
    return _replaced(decomposed(text), REPLACED_FROM, REPLACED_TO)


def normalize_ipa(text: Column) -> Column:
    """Delete brackets and slashes, decompose, replace look-alikes, strip."""
    return strip(_alike(unbracketed(text)))


def tokenize(text: Column, normalize: bool = True) -> Column:
    """The phoneme tokens of a text, without white space; null for null."""
    return F.regexp_extract_all(normalize_ipa(text) if normalize else text, F.lit(TOKEN), F.lit(0))


def pieces(word: Column) -> Column:
    """A word as pieces whose tokens together are its own; a text without white space is one word, however long it is. Brackets go first, as tokens go on beyond them."""
    return F.when(F.length(word) > WORD_CHARS, F.regexp_extract_all(unbracketed(word), F.lit(PIECE), F.lit(0))).otherwise(F.array(word))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without a list of them; null for null."""
    return tokens_of_edges(unbracketed(text), edges(unbracketed(text)))


def edges(text: Column) -> Column:
    """A text with two characters at most of each run of ASCII, its first and last; these alone can be in a token of several characters."""
    return F.regexp_replace(text, INNER, "")


def tokens_of_edges(text: Column, short: Column) -> Column:
    """How many tokens a text without brackets has, given its ``edges`` too, which alone are decomposed.

    What the edges lack is a token each, but for white space; in the edges, tokens of several characters become one, all others are one.
    """
    length = lambda t, space: F.length(F.regexp_replace(t, space, ""))
    space = r"[\t\n\x0B\f\r ]+"
    return length(text, space) - length(short, space) + length(F.regexp_replace(_alike(short), SEVERAL, "x"), WORD_END)


def join_phones(phones: Column) -> Column:
    """White-space separated phones in one string."""
    return F.regexp_replace(F.coalesce(phones, F.lit("")), r"(?U)\s+", "")


def base_character(token: Column) -> Column:
    """The first character of a decomposed token."""
    return F.substring(token, 1, 1)


def coarse_category(token: Column) -> Column:
    """One of eight classes."""
    one, base = F.length(token) == 1, F.substring(token, 1, 1)
    return (
        F.when(one & token.isin(STRESS), "stress")
        .when(one & token.isin(LENGTH), "length")
        .when(one & (token == "."), "boundary")
        .when(one & token.rlike(TONE_MARK), "tone")
        .when(one & token.isin(COARSE_VOWELS), "vowel")
        .when(one, "consonant")
        .when(token.rlike(r"[͜͡]"), "affricate")
        .when(base.isin(COARSE_VOWELS), "vowel")
        .otherwise("consonant")
    )


def fine_category(token: Column) -> Column:
    """A struct (cat, subcat); tokens are decomposed, so that ç is a plosive by its base c."""
    base = base_character(token)
    pair = lambda c, s: F.struct(F.lit(c).alias("cat"), F.lit(s).alias("subcat"))
    rules = [
        (base.isin(STRESS), "suprasegmental", "stress"),
        (base.isin(LENGTH), "suprasegmental", "length"),
        (token.rlike(f"[˥˦˧˨˩]|{TONE}"), "suprasegmental", "tone"),
        (token.rlike(r"[͜͡]"), "consonant", "affricate"),
        (base.isin(VOWELS) & token.rlike(TILDE), "vowel", "nasalized"),
        (base.isin(VOWELS), "vowel", "oral"),
        (base.isin(CLICKS), "consonant", "click"),
        (base.isin(IMPLOSIVES), "consonant", "implosive"),
        (token.contains("ʼ"), "consonant", "ejective"),
        (base.isin(PLOSIVES), "consonant", "plosive"),
        (base.isin(NASALS), "consonant", "nasal"),
        (base.isin(TRILLS), "consonant", "trill"),
        (base.isin(TAPS), "consonant", "tap/flap"),
        (base.isin(FRICATIVES), "consonant", "fricative"),
        (base.isin(LATERALS), "consonant", "lateral"),
        (base.isin(APPROXIMANTS), "consonant", "approximant"),
        (token.isin(MODIFIERS), "modifier", "secondary articulation"),
        (token.isin(BOUNDARIES), "boundary", "syllable/word"),
        (base.rlike(r"\p{L}"), "consonant", "other"),
    ]
    out = F.when(rules[0][0], pair(*rules[0][1:]))
    for test, cat, sub in rules[1:]:
        out = out.when(test, pair(cat, sub))
    return out.otherwise(pair("other", "unknown"))


def code_points(token: Column, separator: str = " ", prefix: str = "U+") -> Column:
    """U+XXXX of each character."""

    def point(c: Column) -> Column:
        digits = F.hex(F.ascii(c))
        return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))

    return F.array_join(F.transform(F.split(token, ""), point), separator)


# Fixed values in what follows: the words of reports and the counts at which they change.


def rarity_notes(token: Column, count: Column) -> Column:
    """What a report says beside a token; a dash for nothing."""
    noted = F.concat_ws(", ", F.when(count < 10, "rare"), F.when(count < 100, "limited data"), F.when(token.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("U+"), code_points(token, "+", ""))))
    return F.when(noted == "", "—").otherwise(noted)


def coverage_rating(total: Column) -> Column:
    return F.when(total >= 10000, "Excellent").when(total >= 1000, "Good").when(total >= 100, "Limited").when(total >= 10, "Poor").otherwise("Minimal")


def recommendation(total: Column) -> Column:
    return F.when(total < 100, "Unlikely to work correctly").when(total < 500, "May produce inconsistent results").otherwise("Usable with caution")


def entry_id(code: Column, number: Column) -> Column:
    """As abq_007; a null number counts as 0 and larger ones keep all digits."""
    return F.format_string("%s_%03d", F.lower(code), F.coalesce(number, F.lit(0)))


def segment_key(filename: Column, number: Column) -> Column:
    return F.format_string("%s_%03d", filename, number)


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def artefact_step(path: Column, strict: bool = False) -> Column:
    """The number after the first _ of a file's stem; best_model is step 0. Others: 0, or null if ``strict``."""
    stem = file_stem(path)
    step = F.regexp_extract(stem, r"^[^_]*_(\d+)(_|$)", 1)
    return F.when(stem == "best_model", 0).when(step != "", step.try_cast("bigint")).otherwise(None if strict else 0).cast("bigint")
