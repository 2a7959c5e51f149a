"""Column expressions on text: accents, tokens, set similarity, slugs. All run inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters U+00C0-U+024F that decompose into an ASCII letter and marks, with that letter.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_PAIRS = [(a, b) for a, b in _PAIRS if b.isascii()]
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)

# Function words left out by the tokenizer.
STOP_WORDS = (
    "a o as os de do da dos das em no na nos nas para por com sem e ou um uma uns umas que se ao aos "
    "the of and for to in on is are this that que sua seu suas seus quando onde como mais menos muito "
    "pelo pela esse essa esta este isso isto nao não ja já"
).split()


def strip_diacritics(c: Column) -> Column:
    """The text without accents: precomposed letters and combining marks U+0300-U+036F. NULL stays NULL."""
    ascii_only = lambda x: F.octet_length(x) == F.char_length(x)
    bare = lambda x: F.when(ascii_only(x), x).otherwise(F.regexp_replace(x, "[\\u0300-\\u036f]", ""))
    # the translated text as a member of an array: named in each branch, it would be worked out for each
    return F.when(ascii_only(c), c).otherwise(F.get(F.transform(F.array(F.translate(c, ACCENTED, PLAIN)), bare), F.lit(0)))


def tokens(c: Column, least: int = 3, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case ASCII words of at least ``least`` characters, in order, without stop words. NULL gives an empty array."""
    words = F.regexp_extract_all(strip_diacritics(F.lower(c)), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))
    return F.coalesce(F.filter(words, lambda w: ~w.isin(list(stop))), F.array().cast("array<string>"))


def token_set(c: Column, **kw) -> Column:
    return F.array_distinct(tokens(c, **kw))


def overlap_count(a: Column, b: Column) -> Column:
    """Distinct elements that both arrays hold."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either array is empty or NULL."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), overlap_count(a, b) / both).otherwise(F.lit(0.0))


def slug(c: Column, most: int = 60, default: str = "item") -> Column:
    """Lower case, accents off, other characters to one dash, ``most`` characters; ``default`` if nothing is left."""
    s = F.regexp_replace(strip_diacritics(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most)
    return F.when(s == "", F.lit(default)).otherwise(s)


def pull_url(ref: Column, host: str = "https://github.com/") -> Column:
    """The address of a pull request from ``folders#number``; NULL stays NULL, and what has no number gives NULL."""
    return F.when(ref.rlike(r"^[^#\s]+#\d+$"), F.concat(F.lit(host), F.replace(ref, F.lit("#"), F.lit("/pull/"))))


def percent(share: Column, digits: int = 1) -> Column:
    """A share as text, "12.5%"; NULL stays NULL."""
    return F.concat(F.format_number(100 * share, digits), F.lit("%"))


def ends_alike(a: Column, b: Column) -> Column:
    """Whether one of two paths is the other or ends with it after a slash."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def short_hash(c: Column) -> Column:
    """First 8 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 8)


def deletions(c: Column) -> Column:
    """The text and every text that leaves out one character of it: two texts one edit apart share one."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
