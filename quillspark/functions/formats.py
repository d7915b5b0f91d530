"""CSV, JSON, XML and plain text to Markdown as column expressions.

``X_columns`` gives the pair ``(markdown, error)``; the Markdown counts only
where the error is null. ``X_to_markdown`` is the same as one struct.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .result import bind, converted

_STRICT_JSON = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_bad",
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedControlChars": "false",
}


def without_mark(text: Column) -> Column:
    """Without the byte order mark that some programs put in front."""
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def decode_text(content: Column) -> Column:
    """``struct(text, error)`` of file bytes that should hold UTF-8."""
    text = without_mark(content.cast("string"))
    valid = F.is_valid_utf8(text)
    error = F.when(content.isNull(), "text error: no content").when(
        ~valid, "text error: not valid UTF-8"
    )
    return F.struct(F.when(valid, text).alias("text"), error.alias("error"))


def text_columns(text: Column):
    """Plain text is its own Markdown unless its bytes are not UTF-8."""
    error = F.when(text.isNull(), "text error: no text").when(
        ~F.is_valid_utf8(text), "text error: not valid UTF-8"
    )
    return text, error


def json_columns(text: Column):
    """JSON text is kept as it is when it is one valid value.

    The parser stops after the first complete value. Reading the text once as
    the only item of an array and once as the only field of an object leaves no
    room for anything behind it.
    """
    item = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT_JSON)
    field = F.from_json(
        F.concat(F.lit('{"a":'), text, F.lit("}")), "a string, _bad string", _STRICT_JSON
    )
    valid = (F.size(item) == 1) & field["_bad"].isNull()
    error = F.when(text.isNull(), "json error: no text").when(
        ~F.coalesce(valid, F.lit(False)), "json error: not valid JSON"
    )
    return text, error


# Java patterns: what may stand around the root element, its end tag with what
# follows, and a document that is one empty element. Possessive and atomic
# groups never back up, so each is linear in the text.
_XML_MISC = r"(?:\s++|(?><!--.*?-->)|(?><\?.*?\?>))*+"
_XML_END = rf"(?s)</[^<>]+>({_XML_MISC})\z"
_XML_EMPTY = (
    rf"(?s)\A{_XML_MISC}(?:<!DOCTYPE[^<>\[]*+>)?{_XML_MISC}"
    rf"""<[^\s<>!?/]++(?:[^<>"'/]++|"[^"<]*+"|'[^'<]*+'|/(?!>))*+/>{_XML_MISC}\z"""
)

# A document type with its own declarations, and references to entities that it
# may declare; those of XML itself stay.
_XML_TYPE = rf"""(?s)\A({_XML_MISC})<!DOCTYPE(?:[^\[<>"']++|"[^"]*+"|'[^']*+')*+(?:\[[^\]]*+\]\s*+)?>"""
_XML_REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z_:][\w:.\-]*+;"


def _undeclared(text: Column) -> Column:
    """What is left to check: the parser reads neither types nor declared entities."""
    bare = F.regexp_replace(text, _XML_TYPE, "$1")
    return F.when(F.contains(text, F.lit("<!ENTITY")), F.regexp_replace(bare, _XML_REFERENCE, "")).otherwise(bare)


def _xml_flaw(text: Column) -> Column:
    """Null when the text starts with a complete element."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return F.from_xml(text, "_bad string", options)["_bad"]


def xml_columns(text: Column):
    """XML text is kept as it is when it is one well-formed document.

    The parser stops at the end of the first element. That this is the whole
    document shows when the text without its last end tag no longer parses.
    """
    text = without_mark(text)
    read = F.when(F.contains(text, F.lit("<!DOCTYPE")), _undeclared(text)).otherwise(text)
    rest = F.regexp_replace(read, _XML_END, "$1")
    whole = read.rlike(_XML_EMPTY) | (read.rlike(_XML_END) & _xml_flaw(rest).isNotNull())
    error = F.when(text.isNull(), "xml error: no text").when(
        _xml_flaw(read).isNotNull() | ~whole, "xml error: not well-formed"
    )
    return text, error


def _table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _csv_lines(pieces: Column) -> Column:
    """Encoded lines of a file split at its quotes: bare, quoted, bare, ...

    Bare commas become the mark ``"s``, bare line ends ``"n``, doubled quotes
    ``"q``, and ``"e`` opens a quoted piece; no piece holds a quote of its own,
    so the marks cannot occur in the data. Line ends in quotes become ``<br>``.
    """

    def ends(piece, mark):
        for end in ("\r\n", "\r", "\n"):
            piece = F.replace(piece, F.lit(end), F.lit(mark))
        return piece

    def encode(last):
        def one(piece, i):
            doubled = (piece == "") & (i > 0) & (i < last)
            return (
                F.when(i % 2 == 1, F.concat(F.lit('"e'), ends(piece, "<br>")))
                .when(doubled, '"q')
                .otherwise(F.replace(ends(piece, '"n'), F.lit(","), F.lit('"s')))
            )

        return F.array_join(F.transform(pieces, one), "")

    lines = F.split(bind(F.size(pieces) - 1, encode), '"n')
    return F.filter(lines, lambda line: F.trim(line) != "")


def _csv_cells(line: Column) -> Column:
    """Cells of an encoded line."""

    def decode(cell):
        for mark, value in (('"e', ""), ('"q', '"'), ("|", "\\|")):
            cell = F.replace(cell, F.lit(mark), F.lit(value))
        return cell

    return F.transform(F.split(line, '"s'), decode)


def _stray_quote(pieces: Column) -> Column:
    """True when a quote stands inside an unquoted cell."""

    def found(last):
        def stray(piece, i):
            before, after = F.right(piece, F.lit(1)), F.left(piece, F.lit(1))
            opens = (i < last) & ~before.isin(",", "\n", "\r")
            closes = (i > 0) & ~after.isin(",", "\n", "\r")
            return (i % 2 == 0) & (piece != "") & (opens | closes)

        return F.array_contains(F.transform(pieces, stray), True)

    return bind(F.size(pieces) - 1, found)


def _csv_width(lines: Column) -> Column:
    return F.size(F.split(F.get(lines, F.lit(0)), '"s'))


def _csv_table(lines: Column) -> Column:
    def table(width):
        def row(line):
            return bind(
                _csv_cells(line),
                lambda cells: _table_row(
                    F.slice(
                        F.concat(
                            cells,
                            F.array_repeat(
                                F.lit(""), F.greatest(width - F.size(cells), F.lit(0))
                            ),
                        ),
                        F.lit(1),
                        width,
                    )
                ),
            )

        rule = F.array(_table_row(F.array_repeat(F.lit("---"), width)))
        return bind(
            F.transform(lines, row),
            lambda rows: F.array_join(
                F.concat(F.slice(rows, 1, 1), rule, F.slice(rows, F.lit(2), F.size(rows))), "\n"
            ),
        )

    return bind(_csv_width(lines), table)


# One field from its first character to its end: quoted, with what follows the closing quote, or
# plain. Possessive, so linear; each match begins where the one before ends.
_CSV_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CSV_END = r"(?:,|\r\n|\r|\n|\z)"
_CSV_FIELD = rf'{_CSV_QUOTED}(?:"[^,\r\n]*+)?{_CSV_END}|[^,\r\n]*+{_CSV_END}'


def _csv_fields(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CSV_FIELD), F.lit(0))


def _loose_lines(text: Column) -> Column:
    """Encoded lines of a file in which quotes stand inside plain fields or before their end.

    As programs read it: a quote that does not begin a field is a character, and
    what follows a closing quote belongs to the field.
    """

    def one(field):
        inner = F.regexp_extract(field, r'\A"([^"]*+(?:""[^"]*+)*+)"', 1)
        after = F.regexp_extract(field, rf'\A{_CSV_QUOTED}"([^,\r\n]*+)', 1)
        for end in ("\r\n", "\r", "\n"):
            inner = F.replace(inner, F.lit(end), F.lit("<br>"))
        quoted = F.concat(F.lit('"e'), F.replace(inner, F.lit('""'), F.lit('"q')), F.replace(after, F.lit('"'), F.lit('"q')))
        plain = F.replace(F.regexp_replace(field, rf"{_CSV_END}\z", ""), F.lit('"'), F.lit('"q'))
        body = F.when(F.startswith(field, F.lit('"')), quoted).otherwise(plain)
        return F.concat(body, F.when(F.endswith(field, F.lit(",")), '"s').otherwise('"n'))

    return F.filter(F.split(F.array_join(F.transform(_csv_fields(text), one), ""), '"n'), lambda line: F.trim(line) != "")


def _loose_open(text: Column) -> Column:
    """True when a quoted field of such a file is never closed."""
    return F.exists(_csv_fields(text), lambda field: field.rlike(rf"\A{_CSV_QUOTED}\z"))


def csv_columns(text: Column):
    """A CSV file as one Markdown table, without leaving its row.

    The first line is the header and sets the width: short rows are padded,
    long rows are cut. Blank lines are skipped, ``|`` in a cell is escaped. Lines
    end with LF, CR LF or CR; those in a quoted field are written as ``<br>``. A
    quote inside a plain field is a character of it, and what follows a closing
    quote belongs to the field; such files take a way of their own. A quoted field
    that is never closed is an error rather than a guess.
    """
    text = without_mark(text)
    pieces = F.split(text, '"', -1)
    lines = lambda p: F.when(_stray_quote(p), _loose_lines(text)).otherwise(_csv_lines(p))

    def problem(p):
        unclosed = F.when(_stray_quote(p), _loose_open(text)).otherwise(F.size(p) % 2 == 0)
        return F.when(unclosed, "csv error: quoted field without end").when(F.size(lines(p)) == 0, "csv error: empty file")

    error = F.when(text.isNull(), "csv error: no text").otherwise(bind(pieces, problem))
    return bind(bind(pieces, lines), _csv_table), error


def text_to_markdown(text: Column) -> Column:
    return converted(*text_columns(text))


def json_to_markdown(text: Column) -> Column:
    return converted(*json_columns(text))


def xml_to_markdown(text: Column) -> Column:
    return converted(*xml_columns(text))


def csv_to_markdown(text: Column) -> Column:
    return converted(*csv_columns(text))
