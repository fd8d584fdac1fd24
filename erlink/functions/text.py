"""Text normalisation as Column functions; Arrow UDFs only where Spark SQL has no Unicode normal forms or case folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erlink.functions.constants import STOPWORDS, SUFFIX_CLASSES


def text_key(c: Column) -> Column:
    """Strings as keys: null becomes ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def country_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def clean_chars(c: Column) -> Column:
    """Letters, numbers, marks and white space stay, all else becomes a space; runs of white space become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\p{M}\s]", " "), r"(?U)\s+", " "))


_DROP = re.compile(r"\s+")


def _tidy(s: str) -> str:
    kept = (ch if ch.isspace() or ch.isalnum() or unicodedata.category(ch).startswith("M") else " " for ch in s)
    return _DROP.sub(" ", "".join(kept)).strip()


def normalized(s: str | None) -> str:
    """Compatibility form, case-folded, control and format characters deleted, cleaned."""
    if s and s.isascii() and s.isprintable():
        return _tidy(s.lower())
    folded = unicodedata.normalize("NFKC", s or "").casefold()
    return _tidy("".join(ch for ch in folded if not unicodedata.category(ch).startswith("C")))


def folded(s: str | None) -> str:
    """Decomposed, case-folded, non-spacing marks deleted, cleaned."""
    decomposed = unicodedata.normalize("NFKD", s or "").casefold()
    return _tidy("".join(ch for ch in decomposed if unicodedata.category(ch) != "Mn"))


# Unicode blocks of nine Indic scripts share one layout, so one table by place in the block serves all.
_BLOCK_STARTS = [0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00]
# fixed values: ITRANS by place in the block
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n nn p ph b bh m y r R l L zh v sh Sh s h".split()))
_VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
_SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
_OTHERS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM"} | {0x66 + d: str(d) for d in range(10)}


def _place(ch: str) -> int | None:
    cp = ord(ch)
    start = cp & ~0x7F
    return cp - start if start in _BLOCK_STARTS else None


def _romanized_token(token: str) -> str:
    if all(_place(ch) is None for ch in token):
        return token
    out: list[str] = []
    open_vowel = False  # a consonant carries an "a" unless a sign or virama follows
    for ch in token:
        p = _place(ch)
        if p in _SIGNS or p == 0x4D:
            out.append(_SIGNS.get(p, ""))
            open_vowel = False
            continue
        if open_vowel:
            out.append("a")
        open_vowel = p in _CONSONANTS
        out.append(ch if p is None else _CONSONANTS.get(p) or _VOWELS.get(p) or _OTHERS.get(p, " "))
    if open_vowel:
        out.append("a")
    return " ".join("".join(x if x.isascii() else " " for x in "".join(out)).split())


def romanized(s: str | None) -> str:
    return " ".join(t for t in map(_romanized_token, normalized(s).split()) if t)


@F.pandas_udf(T.StringType())
def normalize_name(s: pd.Series) -> pd.Series:
    return s.map(normalized)


@F.pandas_udf(T.StringType())
def fold_name(s: pd.Series) -> pd.Series:
    return s.map(folded)


@F.pandas_udf(T.StringType())
def romanize(s: pd.Series) -> pd.Series:
    return s.map(romanized)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("norm", "fold", "roman")]))
def name_forms(s: pd.Series) -> pd.DataFrame:
    """Normal, folded and romanised form in one crossing to Python; each distinct name is worked on once."""
    seen = {x: (n := normalized(x), folded(n), romanized(x)) for x in s.unique()}
    return pd.DataFrame([seen[x] for x in s], columns=["norm", "fold", "roman"])


def script_of(c: Column) -> Column:
    """none, latin, indic or mixed, by the letters of a raw name; letters of any other script make it mixed."""
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]", "")
    latin, indic = letters.rlike(r"[\x{0000}-\x{024F}]"), letters.rlike(r"[\x{0900}-\x{0D7F}]")
    other = letters.rlike(r"[^\x{0000}-\x{024F}\x{0900}-\x{0D7F}]")
    return F.when(letters == "", "none").when(other | (latin & indic), "mixed").when(latin, "latin").otherwise("indic")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_tokens(norm: Column) -> Column:
    """Tokens without stopwords and single characters, order and repeats kept."""
    return F.filter(F.split(norm, " "), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def idf_tokens(norm: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(norm)))


def _suffix_words() -> str:
    return "|".join(SUFFIX_CLASSES)


def suffix_class(fold: Column) -> Column:
    """Class of the last token where it is a legal suffix, else ''."""
    last = F.regexp_extract(fold, f"(?:^| )({_suffix_words()})$", 1)
    classes = F.create_map(*[F.lit(x) for kv in SUFFIX_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(classes, last), F.lit(""))


def strip_suffix(fold: Column) -> Column:
    """The name without its trailing legal suffixes; may be empty."""
    return F.regexp_replace(fold, f"(?:^| )(?:{_suffix_words()})(?: (?:{_suffix_words()}))*$", "")


def bench_norm(c: Column) -> Column:
    """Lower case, letters, numbers and underscores; marks are dropped with punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def entity_text(name_raw: Column, name_norm: Column, addr_raw: Column, addr_norm: Column, field: str) -> Column:
    """Passage text of a field (name, addr or entity) for an embedding model."""
    pick = lambda raw, norm: F.coalesce(F.nullif(raw, F.lit("")), norm, F.lit(""))
    name, addr = pick(name_raw, name_norm), pick(addr_raw, addr_norm)
    return F.concat(F.lit("passage: "), {"name": name, "addr": addr, "entity": F.concat(name, F.lit(" | "), addr)}[field])
