"""Source text: comments and strings taken out over whole files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string ends at its quote, if an even number of backslashes stands before it.
_END = r"(?<!\\)(?:\\\\){0,20}"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/|/\*[\s\S]*"
_SHORT = "|".join(rf"{q}[^\n]*?{_END}{q}|{q}[^\n]*" for q in "\"'")
_TEMPLATE = rf"`[\s\S]*?{_END}`|`[\s\S]*"
#: Every character belongs to one token: a comment, a string, a run of code, or a slash.
TOKEN = rf"{_LINE}|{_BLOCK}|{_SHORT}|{_TEMPLATE}|[^/\"'`]+|/"


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def masked(content: Column, comments: bool = True) -> Column:
    """Text of the same length and lines, with blanks for comments (nothing, if not `comments`) and for what stands between quotes (the quotes stay).

    Comments and templates may reach over many lines, strings end with their line, what isn't closed reaches to the end. Literals of
    regular expressions and code within templates are not told apart."""

    def token(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        closed = (F.length(t) > 1) & (F.substring(t, -1, 1) == quote)
        inside = _blank(F.substr(t, F.lit(2), F.length(t) - F.when(closed, 2).otherwise(1)))
        string = F.concat(quote, inside, F.when(closed, quote).otherwise(""))
        return F.when(t.rlike(r"^/[/*]"), _blank(t) if comments else F.regexp_replace(t, r"[^\n]", "")).when(quote.isin('"', "'", "`"), string).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(TOKEN), 0), token), "")


def line_at(content: Column, p: Column) -> Column:
    """The line, from 1, of the p-th code point."""
    before = F.substr(content, F.lit(1), p - 1)
    return (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("long")


def without_generics(text: Column) -> Column:
    """A declaration without <...>, down to six levels of nesting."""
    for _ in range(6):
        text = F.regexp_replace(text, "<[^<>]*>", "")
    return text
