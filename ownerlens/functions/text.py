"""String expressions: Column in, Column out, nothing leaves the JVM."""
from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark.sql import Column, functions as F

from ownerlens import vocab as V

# ---------------------------------------------------------------- primitives


def quote_regex(term: str) -> str:
    """Escape a literal for both Java and RE2 patterns."""
    return re.sub(r"([.\\+*?\[^\]$(){}=!<>|:#/-])", r"\\\1", term)


def any_of(terms: Iterable[str]) -> str:
    """An alternation grouped by first letter, so a position is ruled out by one
    comparison per letter; longest term first within a letter, so the most
    specific one is reported."""
    groups: dict[str, list[str]] = {}
    for term in sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t)):
        groups.setdefault(term[0], []).append(quote_regex(term[1:]))
    return "(?:" + "|".join(f"{quote_regex(k)}(?:{'|'.join(v)})" for k, v in groups.items()) + ")"


# A word boundary that is Unicode on every Java version and cheap to test.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def whole_words(terms: Iterable[str], plural: bool = False) -> str:
    """Whole-word alternation; the terms start and end with word characters.

    Places whose character starts no term are ruled out before anything before them is looked at.
    """
    terms = list(terms)
    first = "".join(sorted({quote_regex(t[0]) for t in terms}))
    return f"(?=[{first}])" + WORD_START + any_of(terms) + ("s?" if plural else "") + WORD_END


def has_word(text: Column, terms: Iterable[str], plural: bool = False) -> Column:
    """True when any term occurs as a whole word: the pattern is tried only on texts that hold one of the terms at all."""
    terms = list(terms)
    return has_any(text, terms) & F.rlike(text, F.lit(whole_words(terms, plural)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` by name.

    Keeps expressions that use an intermediate many times small enough to
    compile, also inside filters, where Spark would inline the intermediate.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any literal occurs as a substring (no regex engine involved)."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def count_substring(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal.

    ``replace`` is many times slower than ``contains``, so only texts that hold the literal meet it.
    """
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return F.when(~F.contains(text, F.lit(term)), 0).otherwise((gone / F.lit(len(term.encode()))).cast("int"))


def count_substrings(text: Column, terms: Iterable[str]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + count_substring(text, term)
    return total


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def non_empty(col: Column) -> Column:
    """NULL and the empty string both become NULL."""
    return F.nullif(col, F.lit(""))


def squeeze(col: Column) -> Column:
    """Collapse every run of Unicode white space to one space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


#: Unicode white space.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(col: Column) -> Column:
    """Without Unicode white space at either end; only strings that have some there are trimmed."""
    white = F.lit(WHITE_SPACE)
    return F.when(F.contains(white, F.left(col, F.lit(1))) | F.contains(white, F.right(col, F.lit(1))), F.trim(col, white)).otherwise(col)


def _tie_points(ties_up: bool) -> list[float]:
    """Smallest fractions that print as the next tenth.

    A printed tenth is decided by the exact binary value; Java's formatter goes
    by the shortest decimal instead and differs on values such as 45.05.
    """
    points = []
    for k in range(10):
        x = (2 * k + 1) / 20
        while float(f"{x:.1f}") < (k + 1) / 10 - 0.05 and not (ties_up and x in (0.25, 0.75)):
            x = math.nextafter(x, 1.0)
        points.append(x)
    return points


def fixed1(value: Column, ties_up: bool = False) -> Column:
    """A number with one decimal, rounded from its exact binary value."""
    size = F.abs(value)
    whole = F.floor(size)

    def text(parts: Column) -> Column:
        tenth = F.lit(0)
        for point in _tie_points(ties_up):
            tenth = tenth + F.when(parts["frac"] >= point, 1).otherwise(0)
        digits = parts["whole"] * 10 + tenth
        sign = F.when((value < 0) & (digits > 0), "-").otherwise("")
        return F.concat(sign, F.floor(digits / 10).cast("string"), F.lit("."), (digits % 10).cast("string"))

    return F.when(value.isNotNull(), let(F.struct(whole.alias("whole"), (size - whole).alias("frac")), text))


# ---------------------------------------------------------------- titles


def normalise_title(col: Column) -> Column:
    return F.lower(squeeze(col))


def is_navigation_stub(title: Column, source: Column) -> Column:
    """A feed entry that is site chrome: empty, a label, or only its publisher's name."""

    def verdict(pair: Column) -> Column:
        t, s = pair["t"], pair["s"]
        rest = t
        for sep in reversed(V.TITLE_SEPARATORS):
            tail = F.concat(F.lit(sep), s)
            rest = F.when(
                F.endswith(t, tail), F.trim(F.left(t, F.length(t) - F.length(tail)))
            ).otherwise(rest)
        return let(F.struct(t.alias("t"), s.alias("s"), rest.alias("rest")), _stub_verdict)

    return let(F.struct(normalise_title(title).alias("t"), normalise_title(source).alias("s")), verdict)


def _stub_verdict(row: Column) -> Column:
    t, s, rest = row["t"], row["s"], row["rest"]
    lead = F.concat(s, F.lit(" "))
    bare = F.when(F.startswith(rest, lead), F.substring(rest, F.length(lead) + 1, F.length(rest)))
    with_source = (s != "") & (
        (rest == s)
        | (t == s)
        | rest.isin(V.NAVIGATION_TITLES)
        | F.coalesce(bare.isin(V.NAVIGATION_TITLES), F.lit(False))
    )
    return (t == "") | t.isin(V.NAVIGATION_TITLES) | with_source


def title_key(title: Column) -> Column:
    """Display de-duplication key: publisher suffix, punctuation and case removed."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+[-–—|]\s+[^-–—|]{2,40}$", "")
    t = F.regexp_replace(F.lower(t), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(t, r" +", " "))


def title_text(title: Column) -> Column:
    """The form titles are compared in for fuzzy de-duplication."""
    return F.lower(strip(F.coalesce(title, F.lit(""))))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)))


# ---------------------------------------------------------------- names


def _accent_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition starts with an ASCII letter."""
    src, dst = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold_accents(col: Column) -> Column:
    return F.regexp_replace(F.translate(col, _ACCENTED, _PLAIN), r"[̀-ͯ]", "")


def name_key(col: Column) -> Column:
    return F.lower(squeeze(col))


def slugify(col: Column) -> Column:
    s = F.regexp_replace(fold_accents(name_key(col)), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def matches_slug(name: Column, slug: Column) -> Column:
    return (slugify(name) != "") & (slugify(name) == F.coalesce(slug, F.lit("")))


def node_id(col: Column) -> Column:
    return F.left(F.md5(F.lower(F.trim(F.coalesce(col, F.lit(""))))), F.lit(12))


def is_publication_or_furniture(name: Column) -> Column:
    n = normalise_title(name)
    return (n == "") | n.isin(V.PAGE_FURNITURE) | has_any(n, V.OUTLET_MARKERS)


def organisation_type(name: Column, words: Iterable[str] = tuple(V.AGENCY_WORDS)) -> Column:
    return F.when(has_any(F.lower(name), words), "agency").otherwise("company")


def strip_job_titles(name: Column) -> Column:
    """A person's name without job titles; NULL when two characters or fewer remain."""
    out = name
    for title in V.JOB_TITLES:
        out = F.regexp_replace(out, rf"(?iU)\b{title}\b\s*", "")
    out = F.trim(out)
    return F.when(F.length(out) > 2, out)


def job_titles(text: Column) -> Column:
    """Titles mentioned in the text, in list order."""
    return let(F.lower(text), job_titles_in)


def job_titles_in(low: Column) -> Column:
    """:func:`job_titles` over text that is lower-case already."""

    def mentioned(title: str) -> Column:
        name = title.lower()
        return F.contains(low, F.lit(name)) & F.rlike(low, F.lit(whole_words([name], plural=True)))

    return F.array_compact(F.array(*[F.when(mentioned(t), t) for t in V.JOB_TITLES]))


# ---------------------------------------------------------------- page text


def clean_summary(text: Column) -> Column:
    """Feed truncation marks become an ellipsis; character references are decoded."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iU)\s*\[\+\d+\s*chars?\]\s*$", "…")
    return strip(decode_entities(t))


_REFERENCE = r"&(?:#[xX]?[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _named_references() -> Column:
    """Every named character reference of HTML5 and what it stands for, folded to one literal."""
    names = {n[:-1]: text for n, text in html5.items() if n.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def decode_entities(text: Column) -> Column:
    """Named and decimal/hex character references; each is decoded once."""
    parts = F.split(text, f"(?={_REFERENCE})")

    def one(piece: Column) -> Column:
        hexa = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});", 1)
        deci = F.regexp_extract(piece, r"^&#([0-9]{1,6});", 1)
        name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("bigint")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(F.coalesce(valid, F.lit(False)), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.when(name != "", F.try_element_at(_named_references(), name)).otherwise(char)
        return F.when(char.isNotNull(), F.concat(char, F.regexp_replace(piece, f"^{_REFERENCE}", ""))).otherwise(piece)

    decoded = F.array_join(F.transform(parts, one), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _drop_elements(html: Column, names: Iterable[str]) -> Column:
    pattern = "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in names)
    return F.regexp_replace(html, rf"(?is)<!--.*?-->|{pattern}", "")


def clean_html(html: Column) -> Column:
    """Visible text, one phrase per line."""
    raw = F.coalesce(html, F.lit(""))
    bare = F.regexp_replace(_drop_elements(raw, ("script", "style")), r"(?s)<!?/?[a-zA-Z][^>]*>", "")
    t = F.when(F.contains(raw, F.lit("<")), bare).otherwise(raw)
    t = let(t, lambda x: F.when(F.contains(x, F.lit("&")), decode_entities(x)).otherwise(x))

    def broken(x: Column) -> Column:
        """Line ends and pairs of spaces as line feeds; an empty phrase more or less does not matter."""
        x = F.when(F.contains(x, F.lit("  ")), F.replace(x, F.lit("  "), F.lit("\n"))).otherwise(x)
        return let(x, lambda y: F.when(F.contains(y, F.lit("\r")), F.replace(y, F.lit("\r"), F.lit("\n"))).otherwise(y))

    phrases = F.split(let(t, broken), "\n")
    return F.array_join(F.filter(F.transform(phrases, strip), lambda p: p != ""), "\n")


def article_body(html: Column, min_chars: int = 40) -> Column:
    """Paragraph text of a page, each paragraph once.

    A new ``<p`` closes the one before it, as HTML5 has it, so the body grows
    linearly with the page even when paragraphs are never closed.
    """
    t = _drop_elements(
        F.coalesce(html, F.lit("")), ("script", "style", "nav", "header", "footer", "aside", "form")
    )
    chunks = F.split(t, r"(?i)<p(?=[\s>/])")

    def paragraph(chunk: Column) -> Column:
        inner = F.split(F.regexp_replace(chunk, r"(?is)^[^>]*>|</(?:p|article|body|html)\s*>.*$", ""), r"(?s)<[^>]*>")
        nodes = F.filter(F.transform(inner, lambda n: strip(decode_entities(n))), lambda n: n != "")
        return F.array_join(nodes, " ")

    paragraphs = F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), paragraph)
    return F.array_join(F.filter(paragraphs, lambda p: F.length(p) > min_chars), "\n")


def body_verdict(body: Column, low: int = 400, high: int = 60000) -> Column:
    n = F.length(F.coalesce(body, F.lit("")))
    return F.when(n < low, "too_short").when(n > high, "too_long").otherwise("ok")


# ---------------------------------------------------------------- model output


def csv_guard(col: Column) -> Column:
    """A spreadsheet must not evaluate an exported value as a formula."""
    s = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(F.rlike(s, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), s)).otherwise(s)


def json_block(raw: Column) -> Column:
    """The JSON object inside a free-text reply: a fenced block, else the outermost braces."""
    t = strip(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    unfenced = strip(F.replace(F.replace(t, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    t = F.when(F.contains(t, F.lit("```")), F.coalesce(non_empty(fenced), unfenced)).otherwise(t)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    t = F.when(F.startswith(t, F.lit("{")), t).otherwise(F.coalesce(non_empty(braces), t))
    return non_empty(t)


def whole_id(col: Column) -> Column:
    """Integer ids that may have come back as float text; 0 for anything else."""
    d = F.trim(col.cast("string")).try_cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9.0e18)
    return F.coalesce(F.when(whole, d.cast("bigint")), F.lit(0).cast("bigint"))
