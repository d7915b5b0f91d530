"""HTML to Markdown as built-in string expressions.

Every regular expression is a pass over the whole text, so rules share passes
where they can, patterns start with one plain character, literal replacements
use ``replace``, and white space is handled line by line, which stays linear on
long blank runs. A tag ends before the next "<", and what is read of it is never
given back, so unfinished tags cost no more than their length.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .result import bind, converted
from .structure import is_nested, nested_markdown

_BLANKS = " \t\r\f"
_REST = r"(?:[ \t\r\n\f/][^<>]*+)?"

# Comments, scripts and styles; one left open runs to the end of the page, as it
# does in a browser. Also "<h>", "<hl>" and "<hb>", which are no HTML tags, so
# that the marks set below cannot be mistaken.
_INVISIBLE = (
    r"<(?is:!--.*?(?:-->|\z)"
    rf"|script{_REST}>.*?(?:</script>|\z)"
    rf"|style{_REST}>.*?(?:</style>|\z)"
    r"|h[lb]?>)"
)
_HEAD_OPEN = rf"<(?is:head{_REST}>.*\z)"
_HEAD_CLOSE = "(?i)</head>"
# The whole link is seen to be complete before its address is looked for.
_LINK = (
    r"<(?is:a(?=\s[^<>]*+>[^<]*+</a>)"
    r'[^<>]*?\shref="([^"<>]*+)"[^<>]*+>([^<]*+)</a>)'
)
_BOLD = r"<(?i:b|strong)>([^<]*+)</(?i:b|strong)>"
# What starts a line, marked by what it was: "<hN>" a heading, "<hl>" a list item,
# "<hb>" a line break, "<h>>" a block (or the end of a heading).
_STRUCTURE = (
    rf"<(?i:(?:h([1-6])|(l)i|(b)r){_REST}>"
    r"|(?:/?(?:p|div|ul|ol|nav|article|section|header|footer|main|aside|blockquote|pre"
    rf"|table|tr)|/h[1-6]){_REST}(>))"
)
_MARK = "\n<h$1$2$3$4>"
# "a < b" is no tag: a tag starts with a letter, "/", "!" or "?".
_TAG = r"<[a-zA-Z/!?][^<>]*+>"

# Entities replaced; the ampersand comes last, so that "&amp;lt;"
# ends as "&lt;".
ENTITIES = {
    "&nbsp;": "\u00a0",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}
# More names of characters, replaced where a page holds any of them.
MORE_ENTITIES = {
    "&apos;": "'",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&laquo;": "«",
    "&raquo;": "»",
    "&hellip;": "…",
    "&bull;": "•",
    "&euro;": "€",
    "&reg;": "®",
    "&trade;": "™",
    "&times;": "×",
}
_MORE = "&(?:#|" + "|".join(name[1:] for name in MORE_ENTITIES) + ")"


def _value(tag: Column, attribute: str) -> Column:
    """An attribute of a tag's text, in either kind of quotes or none; empty without it."""
    pattern = rf"""(?is)\s{attribute}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _around(text: Column, opening: str, one) -> Column:
    """The text cut before each opening tag, ``one`` of each piece but the first."""

    def put_together(pieces):
        return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(one(x))), "")

    return bind(F.split(text, opening, -1), put_together)


def _where(text: Column, pattern: str, change) -> Column:
    """The text changed if it has the pattern; most pages are only looked through."""
    return bind(text, lambda t: F.when(t.rlike(pattern), change(t)).otherwise(t))


def _images(text: Column) -> Column:
    def one(piece):
        tag, rest = F.regexp_extract(piece, r"\A([^<>]*+)>", 1), F.regexp_replace(piece, r"\A[^<>]*+>", "")
        shown = F.concat(F.lit("!["), _value(tag, "alt"), F.lit("]("), _value(tag, "src"), F.lit(")"), rest)
        return F.when(piece.rlike(r"\A[^<>]*+>"), shown).otherwise(F.concat(F.lit("<img"), piece))

    return _where(text, r"(?i)<img[\s/]", lambda t: _around(t, r"(?i)<img(?=[\s/])", one))


def _links(text: Column) -> Column:
    """Links that the quick pattern leaves: other quotes, tags inside."""

    def one(piece):
        tag = F.regexp_extract(piece, r"\A([^<>]*+)>", 1)
        parts = F.split(F.regexp_replace(piece, r"\A[^<>]*+>", ""), r"(?i)</a\s*+>", 2)
        # Bold text in a link is still to come.
        inner = F.regexp_replace(F.get(parts, F.lit(0)), r"<(?!(?i:/?(?:b|strong)>))[a-zA-Z/!?][^<>]*+>", "")
        shown = F.btrim(F.regexp_replace(inner, r"[ \t\r\n\f]+", " "))
        link = F.concat(F.lit("["), shown, F.lit("]("), _value(tag, "href"), F.lit(")"), F.get(parts, F.lit(1)))
        complete = (tag != "") & tag.rlike(r"(?is)\shref\s*+=") & (F.size(parts) == 2)
        return F.when(complete, link).otherwise(F.concat(F.lit("<a"), piece))

    return _where(text, r"(?i)<a\s[^<>]*\bhref", lambda t: _around(t, r"(?i)<a(?=\s)", one))


def _numbered(text: Column) -> Column:
    """Entities given by the number of a character; others stay as they are."""
    number = r"\A(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?+"

    def one(piece):
        return bind(code_of(piece), lambda code: character_of(code, piece))

    def code_of(piece):
        sixteen, ten = F.regexp_extract(piece, number, 1), F.regexp_extract(piece, number, 2)
        return F.when(sixteen != "", F.conv(sixteen, 16, 10)).otherwise(ten).try_cast("int")

    def character_of(code, piece):
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.when(known, F.concat(character, F.regexp_replace(piece, number, ""))).otherwise(F.concat(F.lit("&#"), piece))

    return _around(text, "&#", one)


def _more_entities(text: Column) -> Column:
    def replaced(text):
        for entity, character in MORE_ENTITIES.items():
            text = _literal(text, entity, character)
        return _numbered(text)

    return _where(text, _MORE, replaced)


def _literal(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _entities(text: Column) -> Column:
    text = _more_entities(text)
    for entity, character in ENTITIES.items():
        text = _literal(text, entity, character)
    return text


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)))


def _paragraphs(text: Column) -> Column:
    """Lines trimmed, blank lines after a blank line left out."""

    def join(lines):
        kept = F.filter(lines, lambda line, i: (line != "") | ((i > 0) & (F.get(lines, i - 1) != "")))
        return F.array_join(kept, "\n")

    return F.btrim(bind(_lines(text), join), F.lit("\n"))


def _headless(text: Column) -> Column:
    """Without what stands from a head's tag to its end; a head left open stays."""

    def cut(pieces):
        last = F.size(pieces) - 1
        return F.array_join(
            F.transform(pieces, lambda x, i: F.when(i < last, F.regexp_replace(x, _HEAD_OPEN, "")).otherwise(x)), ""
        )

    return bind(F.split(text, _HEAD_CLOSE, -1), cut)


def html_is_closed(text: Column) -> Column:
    """True when the page ends with its closing tag, i.e. was not cut off."""
    end = F.lower(F.right(F.rtrim(text, F.lit(_BLANKS + "\n")), F.lit(7)))
    # Most pages need no look at their blanks.
    return F.when(F.endswith(text, F.lit("</html>")), True).otherwise(end == "</html>")


def _inline(text: Column) -> Column:
    """Images, links and bold text as Markdown, but for what is preformatted."""

    def one(piece):
        linked = _links(F.regexp_replace(_images(piece), _LINK, "[$2]($1)"))
        return F.when(piece.rlike(r"(?i)\A<pre[\s/>]"), piece).otherwise(F.regexp_replace(linked, _BOLD, "**$1**"))

    return F.array_join(F.transform(F.split(text, r"(?i)(?=</?pre[\s/>])", -1), one), "")


def _flat_markdown(text: Column) -> Column:
    """A page whose tags only say where lines begin."""
    text = F.regexp_replace(text, _STRUCTURE, _MARK)
    text = _literal(text, "<h>>", "\n")
    for level in range(1, 7):
        text = _literal(text, f"<h{level}>", "\n" + "#" * level + " ")
    text = _literal(_literal(text, "<hl>", "* "), "<hL>", "* ")
    text = F.regexp_replace(text, _TAG, "")
    return _paragraphs(_entities(text))


def html_body_to_markdown(text: Column) -> Column:
    """The Markdown text alone.

    Pages with nested or numbered lists, tables, quotations or preformatted text
    are folded token by token; for all others patterns are enough.
    """
    text = _inline(_headless(F.regexp_replace(text, _INVISIBLE, "")))
    return bind(text, lambda t: F.when(is_nested(t), _entities(nested_markdown(t))).otherwise(_flat_markdown(t)))


def html_columns(text: Column):
    """The pair ``(markdown, error)`` of a page."""
    return html_body_to_markdown(text), F.when(text.isNull(), "html error: no text")


def tagless_columns(text: Column):
    """The visible words, one line per tag: what a cut-off page falls back to."""
    plain = F.regexp_replace(text, _INVISIBLE, "")
    plain = F.regexp_replace(plain, _TAG, "\n")
    words = F.filter(_lines(_entities(plain)), lambda line: line != "")
    return F.array_join(words, "\n"), F.when(text.isNull(), "text error: no text")


def html_to_markdown(text: Column) -> Column:
    """``struct(markdown, error)`` of a page."""
    return converted(*html_columns(text))


def strip_tags(text: Column) -> Column:
    """``struct(markdown, error)`` of the simpler converter."""
    return converted(*tagless_columns(text))
