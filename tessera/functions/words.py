"""Words of a text: tokens, stop words, language by frequent words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# The languages that are supported, in this order.
SUPPORTED = ("en", "de", "nl", "fr", "es", "pt", "it", "ru", "sv", "no", "da", "tr", "zh", "ko")
# Frequent words of the languages, left out of ranking.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are", "this", "be", "at", "by", "not", "have", "from", "or"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "den", "von", "zu", "ein", "eine", "auf", "im", "dem", "des", "sich", "auch", "für", "wird"),
    "nl": ("de", "het", "een", "en", "van", "ik", "te", "dat", "die", "in", "is", "niet", "zijn", "op"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "un", "dans", "que", "pour", "qui", "du", "pas", "sur", "par", "avec", "plus", "ce", "au"),
    "es": ("el", "la", "los", "y", "de", "que", "en", "es", "una", "un", "por", "con", "para", "las", "del", "se", "no", "como", "su", "al"),
    "pt": ("o", "a", "os", "as", "e", "de", "que", "em", "um", "uma", "para", "com", "não", "do"),
    "it": ("il", "lo", "la", "i", "gli", "le", "e", "di", "che", "un", "una", "in", "per", "con"),
    "ru": ("и", "в", "не", "на", "я", "что", "он", "с", "как", "это", "по", "но", "она", "к"),
    "sv": ("och", "det", "att", "i", "en", "jag", "hon", "som", "han", "på", "den", "med", "var", "sig"),
    "no": ("og", "i", "jeg", "det", "at", "en", "et", "den", "til", "er", "som", "på", "de", "med"),
    "da": ("og", "i", "jeg", "det", "at", "en", "den", "til", "er", "som", "på", "de", "med", "han"),
    "tr": ("ve", "bir", "bu", "da", "de", "için", "ile", "çok", "ne", "ama", "gibi", "daha", "o", "mi"),
}
LEAST_CHARS = 60
READ_CHARS = 20_000


def tokens(text: Column) -> Column:
    """Words of letters, digits, ``_``, ``-`` and ``/``, case folded."""
    return F.regexp_extract_all(T.folded(text), F.lit(r"(?U)[\w\-/]+"), F.lit(0))


def ranking_tokens(text: Column) -> Column:
    """Words of at least two letters, digits or ``_``, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0))


def stop_words(code: str | None) -> tuple[str, ...]:
    """Those of a language; of one that has none those of English, and none for Chinese and Korean."""
    return () if code in ("zh", "ko") else STOP_WORDS.get(code or "", STOP_WORDS["en"])


def language(text: Column, supported: tuple[str, ...] = ("en", "de", "fr", "es")) -> Column:
    """``code`` and ``share``: the language whose frequent words make up most of the text's words.

    Texts of fewer than LEAST_CHARS code points are too short to tell and count
    as English with a share of 0, as do those without any frequent word.
    """
    head = F.substring(text, 1, READ_CHARS)
    words = F.regexp_extract_all(F.lower(head), F.lit(r"(?U)\w+"), F.lit(0))
    share = lambda code: F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS[code]))) / F.greatest(F.size(words), F.lit(1))
    scored = F.array(*[F.struct(F.bround(share(c), 3).alias("share"), F.lit(-i).alias("_order"), F.lit(c).alias("code")) for i, c in enumerate(supported)])
    best = F.array_max(scored)
    known = (F.char_length(text) >= LEAST_CHARS) & (best["share"] > 0)
    return F.struct(F.when(known, best["code"]).otherwise("en").alias("code"), F.when(known, best["share"]).otherwise(0.0).alias("share"))


def chosen_language(override: Column, detected: Column, supported: tuple[str, ...] = SUPPORTED) -> Column:
    """A language that a person set wins if it is supported."""
    return F.when(override.isin(*supported), override).otherwise(detected)
