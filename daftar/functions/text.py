"""Text expressions: cleaning, hashing, noise tests, titles.  All ``Column -> Column``.

The rules come from a JavaScript application, so whitespace and word boundaries
follow ECMAScript: whitespace is the Unicode set below and ``\\b`` is ASCII-only,
while Java's ``\\s`` is ASCII and its ``\\b`` Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters removed by an ECMAScript trim.
JS_SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set inside and as a regex character class (Java and RE2).
WS_IN = r"\s\x0B\x{FEFF}\p{Z}"
WS = f"[{WS_IN}]"
# The same set for Java alone, faster there: other scripts' letters are passed over by one comparison.
_SPACES_IN = r"\x09-\x0D\x20\xA0[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
# ASCII word boundary for Java regexes.
_W = "[A-Za-z0-9_]"
ASCII_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# Latin letters plus the Arabic block.
LETTERS_IN = r"a-zA-Z\x{0600}-\x{06FF}"

# Thresholds of the text rules.
LOW_TEXT = 40
MIN_CONTENT = 50
TITLE_MIN, TITLE_MAX = 8, 120
SEGMENT_TITLE_BELOW = 80


def let(value: Column, body) -> Column:
    """``body`` of a value computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(JS_SPACES))


def collapse_spaces(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, WS + "+", " "))


def wash_text(c: Column) -> Column:
    """Drop NUL characters and trim."""
    return js_trim(F.replace(c, F.lit("\0"), F.lit("")))


def clean_text(c: Column) -> Column:
    """Collapse blanks, keep at most one empty line, trim."""
    c = F.regexp_replace(c, "\t[ \t]*| [ \t]+", " ")  # a single blank stays as it is
    return js_trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def normalize_content(c: Column) -> Column:
    return clean_text(F.replace(c, F.lit("\r"), F.lit("")))


def content_hash(c: Column) -> Column:
    return F.md5(normalize_content(c))


def repeated_noise(c: Column) -> Column:
    """One character eight times running, or six symbols in a row."""
    # a-z and the blank first: most characters are told by them.
    return c.rlike(r"(.)\1{7}") | c.rlike(rf"[^a-z\x20\p{{L}}\p{{N}}{_SPACES_IN}]{{6}}")


def broken_spacing(c: Column) -> Column:
    """Three single letters spaced apart, Latin or Arabic."""
    # Looks back only where a letter is followed by a space.
    gap = f"[{_SPACES_IN}]"
    latin = rf"[a-zA-Z]{gap}(?<!{_W}[a-zA-Z]{gap}){gap}*[a-zA-Z]{gap}+[a-zA-Z](?!{_W})"
    ar = r"[\x{0600}-\x{06FF}]"
    return c.rlike(latin) | c.rlike(f"{ar}{WS}+{ar}{WS}+{ar}")


def letter_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{LETTERS_IN}]+", ""))


def alpha_density(c: Column) -> Column:
    """Share of letters in the trimmed length; null for blank text."""
    n = F.length(js_trim(c))
    return F.when(n > 0, letter_count(c) / n)


def generated_content(original: Column, repaired: Column) -> Column:
    """Did a repair invent text?  More than 35 % unseen words and 20 % growth."""

    def words(c):
        parts = F.split(F.lower(normalize_content(c)), WS + "+")
        return F.filter(parts, lambda t: F.length(t) > 2)

    # Both word lists become fields of one value, so that each is made once and
    # not again for every word compared.
    both = F.struct(words(original).alias("seen"), words(repaired).alias("tokens"))

    def drift(v):
        n = F.size(v["tokens"])
        unseen = F.size(F.filter(v["tokens"], lambda t: ~F.array_contains(v["seen"], t)))
        return F.when(n > 0, unseen / n).otherwise(F.lit(0.0))

    grew = F.length(repaired) > F.length(original) * 1.2
    return grew & (let(both, drift) > 0.35)


# Leading words that mark a segment.
SEGMENT_WORDS = [
    ("definition", "definition|définition|تعريف"),
    ("example", "example|exemple|مثال"),
    ("exercise", "exercise|exercice|تمرين"),
]


def segment_type(c: Column, script_aware: bool = False) -> Column:
    """title / definition / example / exercise / paragraph.

    ``script_aware`` lets an Arabic marker be followed by a space, which the
    ASCII word boundary of the plain rule never allows.
    """
    edge = rf"(?![\p{{L}}\p{{N}}_])" if script_aware else ASCII_B
    out = F.when(F.length(c) < SEGMENT_TITLE_BELOW, "title")
    for name, words in SEGMENT_WORDS:
        out = out.when(c.rlike(f"(?iu)^(?:{words}){edge}"), name)
    return out.otherwise("paragraph")


def poor_title(c: Column, script_aware: bool = False) -> Column:
    """A title with no Latin letter (or no letter at all when script-aware)."""
    return ~c.rlike(r"\p{L}" if script_aware else "[A-Za-z_]")


def detect_title(c: Column, fallback: Column, script_aware: bool = False) -> Column:
    line = js_trim(F.substring_index(c, "\n", 1))
    n = F.length(line)
    ok = (
        (n >= TITLE_MIN)
        & (n <= TITLE_MAX)
        & line.rlike(f"[{LETTERS_IN}]")
        & ~poor_title(line, script_aware)
    )
    return F.when(ok, line).otherwise(fallback)


def clamp_score(c: Column) -> Column:
    """Into 0..1 at three decimals; NaN, infinity and null become 0."""
    c = c.cast("double")
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(c, 3)))).otherwise(0.0)


def to_boolean_filter(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s == "true", True).when(s == "false", False)


def safe_filename(c: Column) -> Column:
    """URL-decoded base name with unusual characters replaced by ``_``."""
    name = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    base = F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1)
    return F.regexp_replace(base, rf"[^A-Za-z0-9_.\-{WS_IN}\x{{0600}}-\x{{06FF}}]", "_")


def url_hash(c: Column, compat: bool = False) -> Column:
    """Stable key of a URL.  ``compat`` gives the colliding 32-char base64 prefix."""
    if compat:
        return F.left(F.base64(F.encode(c, "UTF-8")), F.lit(32))
    return F.md5(c)
