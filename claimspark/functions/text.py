"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The documented sentence rule, used wherever sentences are counted. A mark, with what closes after it, ends a sentence
#: where white space follows, a CJK mark anywhere. The period of an initial doesn't, nor that of a number or
#: of an ellipsis before a small letter: such periods are held as HELD while the text is cut at CUT.
HELD, CUT = "\x1e", "\x1f"
#: Each pattern begins with the sign that is rarest and only looks at what stands around, so that one pass holds all.
NO_END = (r"()\.(?=\s)(?<=(?<![\p{L}\p{N}])\p{L}\.)", r"(\p{N}(?<![\p{L}\p{N}.]\p{N})\p{N}*)\.(?=\s+\p{Ll})", r"()\.(?=\s+\p{Ll})(?<=\.\.\.)")
END = (r"([.!?][.!?\"')\]}»”’]*)(\s)", r"([。！？；])()")
#: Escapes in their order; the ampersand comes first so that later escapes stay whole.
HTML_ESCAPES = (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>"), ("$", "&#36;"))


def url_domain(url: Column) -> Column:
    """Network location, port kept, every `www.` removed; a URL without a scheme gets one first."""
    full = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.replace(F.regexp_extract(full, "^[^:/?#]+://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def is_pdf(url: Column) -> Column:
    """Whether the URL's path ends in .pdf."""
    return F.lower(F.regexp_extract(url, "^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)).endswith(".pdf")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def strip_markup(text: Column) -> Column:
    """Answer text without citation elements, statement tags and reserved tokens."""
    bare = F.regexp_replace(text, r"(?s)<cite>.*?</cite>", "")
    bare = F.regexp_replace(bare, r"</?statement>", "")
    return F.trim(F.regexp_replace(bare, r"<\|[^|<>]*\|>", " "))


def html_escape(text: Column) -> Column:
    for raw, safe in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def claim_of_query(query: Column) -> Column:
    return F.regexp_extract(query, r"(?s)\n\nClaim: (.+)", 1)


def _held(text: Column, pattern: Column) -> Column:
    """The periods between group 2 and group 3 of the pattern, held; twice, since neighbours share their white space."""
    for _ in range(2):
        text = F.regexp_replace(text, pattern, F.lit(f"$1$2{HELD}$3"))
    return text


def _pieces(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def cut(text: Column, abbreviation: Column | None = None, starter: Column | None = None, pairs: Column | None = None) -> Column:
    """The text with CUT wherever a sentence ends.

    Patterns learned by `operators.boundaries` may say more: abbreviations whose period ends no sentence, starters
    before which it does, and pairs that belong together all the same.
    """
    out = F.coalesce(text, F.lit(""))
    if abbreviation is not None:
        out = F.regexp_replace(_held(out, abbreviation), starter, F.lit(".$1$2$3"))
        out = F.aggregate(pairs, out, lambda t, p: _held(t, p))
    for pattern in NO_END:
        out = F.regexp_replace(out, pattern, f"$1{HELD}")
    for pattern in END:
        out = F.regexp_replace(out, pattern, f"$1{CUT}$2")
    return F.replace(out, F.lit(HELD), F.lit("."))


def sentences(text: Column, abbreviation: Column | None = None, starter: Column | None = None, pairs: Column | None = None) -> Column:
    """array<string>: the stripped sentences of `cut`, blanks dropped; a text of one sentence is cut at empty lines, but for learned patterns."""
    found = _pieces(cut(text, abbreviation, starter, pairs), CUT)
    if abbreviation is not None:
        return found
    whole = F.coalesce(text, F.lit(""))
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) == 1, _pieces(whole, "\n\n")).otherwise(x)), F.lit(0))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once, however often it is used or filtered by: plans would copy the expression."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def tokens(text: Column) -> Column:
    """The documented token rule: maximal runs of characters other than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def truncate_middle(items: Column, most: int) -> Column:
    """The first and the last half of an array that is longer than `most`."""
    half = most // 2
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, half), F.slice(items, -half, half))).otherwise(items)


def numbered(items: Column, style: str = "bracket", first: int = 0) -> Column:
    """`[i] item` or `i. item`, a line each."""
    mark = (lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] "))) if style == "bracket" else (lambda i: F.concat(i.cast("string"), F.lit(". ")))
    return F.array_join(F.transform(items, lambda x, i: F.concat(mark(i + first), x)), "\n")


def render(template: str, **columns: Column) -> Column:
    """A template with {name} replaced by columns; columns may contain braces."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find(f"{{{n}}}") for n in columns if f"{{{n}}}" in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = next(n for n in columns if rest.startswith(f"{{{n}}}", at))
        out += [F.lit(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out) if out else F.lit("")


def search_suffix(query: Column, blocked: tuple[str, ...], filetype: str | None = None) -> Column:
    """The query with an exclusion for each blocked site and, for PDF searches, the file type."""
    parts = [query, *(F.lit(f" -site:{b}") for b in blocked)]
    return F.concat(*parts, *([F.lit(f" filetype:{filetype}")] if filetype else []))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has: the offline stand-in for entailment."""
    mine = F.array_distinct(a)
    return F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, b)).cast("double") / F.size(mine))
