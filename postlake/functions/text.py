"""Column functions that bring the text of postings to comparable forms. Null counts as empty."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions import rules



def _class(codes: list[int]) -> str:
    """A pattern's class of characters, as ranges."""
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return _ranges(ranges)


def _ranges(ranges: list[list[int]]) -> str:
    """A class of ranges in which each half stands behind a test of its whole span: a character is tested against few ranges, not against all."""
    if len(ranges) <= 4:
        return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    half = len(ranges) // 2
    return f"[\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}&&[{_ranges(ranges[:half])}{_ranges(ranges[half:])}]]"


def _decomposed() -> tuple[dict[str, str], dict[str, str], str]:
    """From the Unicode tables: characters that decompose to one character, to several or beyond the BMP, and marks.

    Syllables of Hangul are left out: they decompose by arithmetic, see `_syllable`.
    """
    one, more, marks = {}, {}, []
    for k in range(0x80, 0x30000):
        if 0xAC00 <= k < 0xE000:
            continue
        c = chr(k)
        if unicodedata.combining(c):
            marks.append(k)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c:
            (one if len(plain) == 1 and k < 0x10000 and ord(plain) < 0x10000 else more)[c] = plain
    return one, more, _class(marks)


_ONE, _MORE, _MARKS = _decomposed()
_MORE_CLASS = _class([ord(c) for c in _MORE])
_ENTITIES = {k.removesuffix(";"): v for k, v in html.entities.html5.items() if k.endswith(";")}
_BREAK = "\x1f"
#: Characters that are neither of a word, in any script, nor white space.
NO_WORD = r"[^\p{L}\p{N}_\s]"


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value, as two literals, so that plans stay small."""
    both = [F.split(F.lit(_BREAK.join(x)), _BREAK) for x in (table.keys(), table.values())]
    return F.try_element_at(F.map_from_arrays(*both), key)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _syllable(x: Column) -> Column:
    """A syllable of Hangul as its leading consonant, vowel and, where it has one, trailing consonant."""
    at = F.ascii(x) - 0xAC00
    jamo = lambda first, n, k: F.substring(F.lit("".join(chr(first + j) for j in range(n))), k.cast("int") + 1, F.lit(1))
    tail = F.when(at % 28 == 0, "").otherwise(jamo(0x11A7, 28, at % 28))
    return F.concat(jamo(0x1100, 19, F.floor(at / 588)), jamo(0x1161, 21, F.floor(at % 588 / 28)), tail)


_HANGUL = r"[\x{AC00}-\x{D7A3}]"


def _plain(c: Column) -> Column:
    """A text that isn't ASCII in its compatible decomposition without combining marks."""

    def apart(text: Column) -> Column:
        one = lambda x: F.when(x.rlike(_HANGUL), _syllable(x)).otherwise(F.coalesce(_lookup(_MORE, x), x))
        return F.array_join(F.transform(F.split(text, ""), one), "")

    # what isn't in the table of single characters is rare, and only then a text is taken apart
    rare = f"[{_MORE_CLASS}{_HANGUL}]"
    split = let(F.translate(c, "".join(_ONE), "".join(_ONE.values())), lambda text: F.when(text.rlike(rare), apart(text)).otherwise(text))
    return F.regexp_replace(split, _MARKS, "")


def strip_accents(c: Column) -> Column:
    """Text in its compatible decomposition without combining marks."""
    return let(_text(c), lambda text: F.when(text.rlike(r"[^\x00-\x7F]"), _plain(text)).otherwise(text))


def normalize_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(c), r"(?U)[\s\x1C-\x1F]+", " ")))


def normalize_url(c: Column) -> Column:
    """Lower case, without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(c))), "[?#].*$", ""), "/+$", "")


def normalize_company(c: Column) -> Column:
    base = strip_accents(normalize_text(c))
    bare = reduce(lambda x, word: F.regexp_replace(x, rf"(?U)\b{word}\b", ""), rules.COMPANY_SUFFIXES, base)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, NO_WORD, ""), r"\s+", " "))


def _title_words(c: Column) -> Column:
    base = reduce(lambda x, r: F.regexp_replace(x, "(?U)" + r[0], r[1]), rules.TITLE_SYNONYMS, strip_accents(normalize_text(c)))
    words = F.split(F.regexp_replace(base, NO_WORD, " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(rules.TITLE_STOP_WORDS))


def normalize_title(c: Column) -> Column:
    return F.array_join(_title_words(c), " ")


def title_key(c: Column) -> Column:
    return F.array_join(F.array_sort(_title_words(c)), " ")


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words, as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def anchors(pattern: str) -> list[str]:
    """For each alternative of a pattern, the longest run of letters that all its matches hold."""
    found = []
    for branch in re.split(r"\|(?=\\b)", pattern):
        bare = re.sub(r"\\.|\([^)]*\)\??|\[[^]]*\]", " ", re.sub(r"[a-z][?*]", " ", re.sub(r"\\[a-zA-Z]", " ", branch)))
        found.append(max(re.findall("[a-z]+", bare), key=len))
    return found


def says(low: Column, pattern: str) -> Column:
    """Whether a text in lower case matches; the pattern, which is slow, is tried only where its longest words occur."""
    return any_of(low, anchors(pattern)) & low.rlike("(?U)" + pattern)


def normalize_location(c: Column) -> Column:
    def place(loc: Column) -> Column:
        short = reduce(lambda x, s: F.regexp_replace(x, rf"(?U)\b({s[0]}|{s[1]})\b", s[1]), rules.STATES, loc)
        return (
            F.when(any_of(loc, rules.REMOTE_WORDS), "remoto")
            .when(any_of(loc, rules.HYBRID_WORDS), "hibrido")
            .otherwise(F.trim(F.regexp_replace(short, NO_WORD, "")))
        )

    return let(strip_accents(normalize_text(c)), place)


def dedup_key(title: Column, company: Column, location: Column) -> Column:
    return F.concat_ws("|", title_key(title), normalize_company(company), normalize_location(location))


def hash_of(key: Column, url: Column, external_id: Column) -> Column:
    """SHA-256 of the external id, else of the canonical URL, else of the dedup key."""
    base = F.when(_text(external_id) != "", F.concat(F.lit("ext:"), external_id)).when(_text(url) != "", F.concat(F.lit("url:"), normalize_url(url))).otherwise(key)
    return F.sha2(base, 256)


def content_hash(title: Column, company: Column, location: Column, url: Column, external_id: Column) -> Column:
    return hash_of(dedup_key(title, company, location), url, external_id)


def _any_branch(low: Column, pattern: str) -> Column:
    """Whether a text in lower case matches: words are searched as they are, other branches as patterns where their longest run of letters occurs."""
    bare = lambda b: max(re.findall("[a-z]+", re.sub(r"\\.|\[[^]]*\]", " ", b)), key=len)
    return reduce(lambda x, y: x | y, [F.contains(low, F.lit(b)) if b.isalpha() else F.contains(low, F.lit(bare(b))) & low.rlike("(?U)" + b) for b in pattern.split("|")])


def infer_seniority(title: Column, description: Column) -> Column:
    """The first level, in the rules' order, that title or first 500 characters of the description name."""
    text = F.lower(strip_accents(F.concat_ws(" ", _text(title), F.substring(_text(description), 1, 500))))
    return let(text, lambda x: F.coalesce(*[F.when(_any_branch(x, p), level) for level, p in rules.SENIORITY], F.lit("")))


def city_part(c: Column, separators: str = "[,/-]") -> Column:
    return F.trim(F.element_at(F.split(_text(c), separators), 1))


def unescape_html(c: Column) -> Column:
    """Text with HTML's named and numbered entities, closed by a semicolon, as characters; unknown ones stay."""
    text = _text(c)

    def one(x: Column) -> Column:
        name, rest = F.regexp_extract(x, "^&(#?[A-Za-z0-9]+);", 1), F.regexp_replace(x, "^&#?[A-Za-z0-9]+;", "")
        base = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7))
        code = base.cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.when(F.startswith(name, F.lit("#")), number).when(name != "", _lookup(_ENTITIES, name))
        return F.when(found.isNotNull(), F.concat(found, rest)).otherwise(x)

    return F.when(text.rlike("&#?[A-Za-z0-9]+;"), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def clean_html(c: Column, limit: int = 2000) -> Column:
    """Text of HTML: entities as characters, tags as spaces, collapsed white space, at most ``limit`` characters.

    Entities are read before tags are dropped and once more after it, as feeds escape whole fragments.
    """
    text = unescape_html(F.regexp_replace(unescape_html(c), "<[^>]+>", " "))
    return F.substring(F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " ")), 1, limit)


def parse_salary(c: Column) -> Column:
    """struct(low, high) of amounts like `R$ 1.234,56 - R$ 2.000,00`; one amount is both; none gives nulls."""
    amounts = F.transform(
        F.regexp_extract_all(_text(c), F.lit(r"R\$\s*([\d.]+(?:,\d{1,2})?)"), 1),
        lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"),
    )
    return F.struct(F.get(amounts, 0).alias("low"), F.coalesce(F.get(amounts, 1), F.get(amounts, 0)).alias("high"))


def escape_html(c: Column) -> Column:
    """Text that is safe within HTML and its attributes."""
    signs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), signs, _text(c))


def truncate(c: Column, longest: int = 4000) -> Column:
    """Text of at most ``longest`` characters, of which the last ones tell where something is cut off."""
    return let(_text(c), lambda x: F.when(F.length(x) <= longest, x).otherwise(F.concat(F.substring(x, 1, longest - 15), F.lit("... [truncado]"))))
