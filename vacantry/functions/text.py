"""Text building blocks as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_EDGE_BEFORE = r"(?<![\p{L}\p{N}])"
WORD_EDGE_AFTER = r"(?![\p{L}\p{N}])"
TERM_EDGE_BEFORE = r"(?<![\w+#.])"
TERM_EDGE_AFTER = r"(?![\w+#])"


def blank_to_null(c: Column) -> Column:
    """NULL for a value that is empty once trimmed, else the value untouched."""
    return F.when(F.length(F.trim(c)) > 0, c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def first_non_blank(*cols: Column) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_phrase(c: Column) -> Column:
    """Comparison form of a phrase: lower case, single spaces, never NULL."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def escape(term: str) -> str:
    """Quote a literal for a Java pattern; inner whitespace stays flexible."""
    return r"\s+".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p) for p in term.split())


def longest_first(terms: Iterable[str]) -> list[str]:
    return sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t))


def any_phrase(terms: Iterable[str], before: str = WORD_EDGE_BEFORE,
               after: str = WORD_EDGE_AFTER) -> str:
    """One case-insensitive pattern that finds any of the phrases; group 1 is the hit."""
    alternatives = "|".join(escape(t) for t in longest_first(terms))
    return f"(?iU){before}({alternatives}){after}" if alternatives else r"(?!x)x"


def every_phrase_at(terms: Iterable[str]) -> str:
    """Zero-width pattern: at each start position, group 1 is the longest phrase there.

    Unlike a consuming alternation it also reports a long phrase that starts inside a
    shorter earlier one.
    """
    alternatives = "|".join(escape(t) for t in longest_first(terms))
    if not alternatives:
        return r"(?!x)(x)"
    return f"(?iU){WORD_EDGE_BEFORE}(?=({alternatives}){WORD_EDGE_AFTER})"


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    return F.coalesce(c, F.lit("")).rlike(any_phrase(terms))


def literal_map(pairs: dict) -> Column:
    """Small driver-side dictionary as a map literal."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _accent_table() -> tuple[str, str]:
    """Latin letters whose decomposition starts with an ASCII letter, and that letter."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        parts = unicodedata.normalize("NFKD", chr(cp))
        base = [p for p in parts if not unicodedata.combining(p)]
        if len(base) == 1 and base[0].isascii() and base[0] != chr(cp):
            src.append(chr(cp))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


# combining marks have no counterpart, so translate drops them
_MARKS = "".join(chr(cp) for cp in range(0x0300, 0x0370))


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents (composed or combining)."""
    return F.translate(c, _ACCENTED + _MARKS, _PLAIN)


def strip_html(c: Column) -> Column:
    """Visible text of a fragment: script and style dropped, four entities decoded."""
    out = F.regexp_replace(c, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, text in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.regexp_replace(out, "(?i)" + entity, text)
    return blank_to_null(squeeze(out))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numeric_entities(c: Column, pattern: str, base: int, prefix: str) -> Column:
    def char_of(digits: Column) -> Column:
        number = F.conv(digits, base, 10).cast("bigint")
        ok = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    decoded = F.aggregate(
        found, c,
        lambda acc, d: F.coalesce(
            F.replace(acc, F.concat(F.lit(prefix), d, F.lit(";")), char_of(d)), acc),
    )
    return F.when(c.rlike(pattern), decoded).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Named entities in order, then decimal and hexadecimal ones."""
    for entity, text in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "'"), ("&apos;", "'"), ("&pound;", "£"), ("&euro;", "€"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(text))

    def numeric(t: Column) -> Column:
        decimal = once(_numeric_entities(t, r"&#(\d{1,8});", 10, "&#"),
                       lambda u: _numeric_entities(u, r"&#x([0-9a-fA-F]{1,8});", 16, "&#x"))
        return F.when(F.contains(t, F.lit("&#")), decimal).otherwise(t)

    return once(c, numeric)


_BLOCK = "h[1-6]|p|div|li|ul|ol|br|tr|td|th|table|section|article|header|footer|aside|nav|main"


def html_to_text(c: Column) -> Column:
    """Readable page text; the end of a block becomes a line break."""
    out = F.coalesce(c, F.lit(""))
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(out, rf"(?i)</(?:{_BLOCK})>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = decode_entities(out)
    out = F.regexp_replace(out, r"[ \t\r\f\u000B]+", " ")
    out = F.regexp_replace(out, r"\n\s+", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def html_to_pay_text(c: Column) -> Column:
    """Page text for the pay rules: blocks break lines on both ends, rates spelled out."""
    out = F.coalesce(c, F.lit(""))
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{_BLOCK})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, text in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "'"), ("&pound;", "£"), ("&euro;", "€"), ("&dollar;", "$"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(text))
    for short, period in (
        ("year", "year"), ("yr", "year"), ("annum", "annum"), ("month", "month"), ("mo", "month"),
        ("week", "week"), ("wk", "week"), ("hour", "hour"), ("hr", "hour"),
    ):
        out = F.regexp_replace(out, rf"(?i)(\d)\s*/\s*{short}\b", f"$1 per {period}")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def text_lines(c: Column) -> Column:
    """Non-empty lines, whitespace squeezed, consecutive repeats dropped."""
    lines = F.filter(F.transform(F.split(c, r"\n+"), squeeze), lambda x: x != "")
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    pairs = F.zip_with(lines, before, lambda cur, prev: F.struct(cur.alias("cur"), prev.alias("prev")))
    kept = F.filter(pairs, lambda p: p["cur"].isNotNull() & ~p["cur"].eqNullSafe(p["prev"]))
    return F.transform(kept, lambda p: p["cur"])


def title_case(c: Column) -> Column:
    """First letter of each word upper-cased, the rest left alone."""
    words = F.split(c, " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                              w.substr(F.lit(2), F.length(w)))), " ")


def slug(c: Column, size: int = 32) -> Column:
    """Lower-case words joined by dashes, at most ``size`` characters."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, size)


def sentences(c: Column) -> Column:
    """Requirement sentences: break after .!?; plus space, or at a newline."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?;])\s+|\n")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
                    lambda s: s != "")


def clauses(c: Column) -> Column:
    """Language sentences: newlines end sentences and spaced dashes split too."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\n+", ". ")
    parts = F.split(flat, r"(?<=[.!?;])\s+|\s+[-–—]\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def half_up(c: Column) -> Column:
    """Round half toward +infinity, as a long."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def cut(c: Column, size: int | None) -> Column:
    """The first ``size`` characters; all of them without a size."""
    return c if size is None else F.substring(c, 1, size)


def first_items(items: Column, size: int | None) -> Column:
    """The first ``size`` items of an array; all of them without a size."""
    return items if size is None else F.slice(items, 1, size)
