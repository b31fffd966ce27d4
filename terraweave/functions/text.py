"""Text functions as Columns: identifiers, clean-up and derived attribute values."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Language codes of ISO 639-1.
ISO_LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik in io is it iu iw ja ji jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mo mr ms "
    "mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr "
    "ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()


def uuid_v3(name: Column) -> Column:
    """The name-based (MD5) UUID of a string, version 3 without a namespace."""
    h = F.md5(F.encode(name, "UTF-8"))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-3"), cut(14, 3), F.lit("-"), F.lower(F.hex(nibble)), cut(18, 3), F.lit("-"), cut(21, 12))


def has_value(v: Column) -> Column:
    """Present, not empty and without the word ``Null``: only such values become triples."""
    return v.isNotNull() & (v != "") & ~v.contains("Null")


def is_language(v: Column) -> Column:
    return v.isin(ISO_LANGUAGES)


def without_illegal(v: Column) -> Column:
    """Double quotes become single ones; backslashes, bars and control breaks become spaces."""
    return F.regexp_replace(F.regexp_replace(v, '"', "'"), r"[\\|\t\n\r]", " ")


def without_delimiter(v: Column) -> Column:
    return F.coalesce(F.replace(v, F.lit("|"), F.lit(";")), F.lit(""))


def clean_url(v: Column, strict: bool = False) -> Column:
    """Slashes forward, characters that no URL holds removed, a scheme in front. ``strict`` also
    drops white space inside."""
    url = F.regexp_replace(v, r"\\+", "/")
    url = F.regexp_replace(url, r"[^A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]" if strict else r"[^A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=% ]", "")
    return F.when(F.rlike(url, F.lit(r"^\w+://")), url).otherwise(F.concat(F.lit("http://"), url))


def concatenate(a: Column, b: Column) -> Column:
    return F.trim(F.concat(a, F.lit("  "), b))


def phone(number: Column, country: Column) -> Column:
    """Digits and plus signs in international form: one leading zero is the country's, up to four
    are a plus. Null where nothing is left."""
    digits = F.regexp_replace(number, r"[^+0-9]", "")
    local = F.substring(digits, 1, 1) == "0"
    national = local & (F.substring(digits, 2, 1) != "0")
    full = F.when(national, F.concat(F.lit("+"), country, F.substr(digits, F.lit(2)))).otherwise(digits)
    full = F.regexp_replace(full, r"^0{1,4}", "+")
    return F.when((digits == "") | local & (F.length(digits) < 2), F.lit(None)).otherwise(F.nullif(full, F.lit("")))


def standard_date(v: Column, pattern: str) -> Column:
    """A number such as 20200131 or 20200131093000 read by ``pattern``; null if it does not fit."""
    plain = F.regexp_replace(v, r"\.0*$", "")
    return F.date_format(F.try_to_timestamp(plain, F.lit(pattern)), "yyyy-MM-dd HH:mm:ss.SSS")


def language_suffix(name: Column, base: int) -> Column:
    """What follows the first ``base`` characters of an attribute's name; null if nothing does."""
    return F.nullif(F.substr(name, F.lit(base + 1)), F.lit(""))


_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
_CYRILLIC = dict(
    zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e z z i j k l m n o p r s t u f h c c s s ʺ y ʹ e u a i i e g".split())
)


_LATIN = _GREEK | _CYRILLIC


def _latin_of(c: str) -> str:
    low = c.lower()
    if low in _LATIN:
        out = _LATIN[low]
        return out if c == low else out.capitalize()
    return c


_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(1 << 16)
def _latin_run(run: str) -> str:
    return "".join(_latin_of(c) for c in unicodedata.normalize("NFD", run) if unicodedata.category(c) != "Mn")


def to_latin(text: str | None) -> str | None:
    """Letters in Latin script without accents, Latin ones that are no accented letter as they are; scripts other than Greek and Cyrillic stay.
    Marks are never reordered across a letter of ASCII, so what stands between those is put in Latin letters by itself, equal runs once."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", _NOT_ASCII.sub(lambda m: _latin_run(m[0]), text))


@F.pandas_udf(T.StringType())
def _transliterated(v: pd.Series) -> pd.Series:
    return v.map(to_latin)


def transliterate(v: Column) -> Column:
    """ASCII values never leave the JVM's side of the condition's result."""
    return F.when(F.rlike(v, F.lit(r"^\p{ASCII}*$")), v).otherwise(_transliterated(v))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    half = sum(x != y for x, y in zip(first, second)) // 2
    score = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + prefix * 0.1 * (1 - score) if score > 0.7 else score


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two strings."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")
