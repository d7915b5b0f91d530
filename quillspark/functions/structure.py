"""Nested HTML: lists, tables, quotations and preformatted text, folded with a stack.

A page is cut into tokens, a block tag with the text behind it, and folded from
left to right. The state holds the open lists (-1 for bullets, else the next
number), the depth of quotations and tables, the place in a table's row and what
the item or cell at hand needs; each token adds one string. Tokens are folded in
runs, so that no growing array is copied for every token, and the work stays
near linear in the page.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .result import bind

_BLOCKS = (
    "ul|ol|li|table|caption|tr|td|th|pre|blockquote|h[1-6]|p|div|nav|article|section|header|footer|main|aside|br|hr"
)
_TOKEN = rf"(?=<(?i:/?(?:{_BLOCKS}))[\s/>])"
_TAG = r"<[a-zA-Z/!?][^<>]*+>"
# Pages whose tags say more than where lines begin: an item that holds a list, lists in numbers, and the like.
_NESTED = (
    r"(?i)<(?:ol|table|pre|blockquote|hr)[\s/>]"
    r"|<ul(?:\s[^<>]*+)?>\s*+<ul[\s/>]"
    r"|<li(?:\s[^<>]*+)?>(?:[^<]++|<(?!/?(?:li|ul|ol)[\s/>]))*+<ul[\s/>]"
)
# Tags that are told apart, by their place here from 1. Kinds that are asked for together stand together.
_KINDS = "ul ol /ul /ol li /li table tr /tr /table td th /td /th caption pre /pre blockquote /blockquote br hr h1 h2 h3 h4 h5 h6".split()
_NO_TAG = len(_KINDS) + 1
# All others that begin a token come behind these, so that names in lower case are found at once.
_OTHERS = "p div nav article section header footer main aside".split()
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLACES = ",".join([*_KINDS, "-", *_OTHERS, *[f"/{x}" for x in [*_OTHERS, "h1", "h2", "h3", "h4", "h5", "h6"]]])
RUN = 128  # tokens of one run
INDENT = "    "
# Lists and quotations open at once that are told apart; deeper ones are shown like the deepest of these.
DEEP = 32
_BLANKS = " \t\r\n\f"
# A line of preformatted text that is blank; no tag or text of a page can leave it behind.
_KEPT = "<h>"


def is_nested(text: Column) -> Column:
    return text.rlike(_NESTED)


def _repeat(what, n):
    return F.repeat(F.lit(what), n)


def _flat(text):
    """One line: white space as a browser shows it."""
    return F.btrim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def _kind(token, first, last=None):
    """Whether a token's tag is ``first``, or one from that to ``last``."""
    low, high = _KINDS.index(first) + 1, _KINDS.index(last or first) + 1
    return token["kind"].between(low, high) if last else token["kind"] == low


def _tokens(text: Column) -> Column:
    place = lambda name: F.find_in_set(name, F.lit(_PLACES))

    def one(token):
        name = F.regexp_extract(token, r"\A<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)
        return bind(name, lambda name: bind(place(name), lambda known: bind(F.regexp_replace(token, r"\A<[^<>]*+>", ""), lambda rest: parts(token, name, known, rest))))

    def parts(token, name, known, rest):
        start = F.regexp_extract(token, r"""(?is)\A<ol\s[^<>]*?start\s*=\s*["']?([0-9]{1,8})""", 1)
        # Most tags have no text behind them.
        kind = F.when(known > 0, known).when(name == "", _NO_TAG).otherwise(place(F.translate(name, _UPPER, _UPPER.lower())))
        body = F.when(F.contains(rest, F.lit("<")), F.regexp_replace(rest, _TAG, "")).otherwise(rest)
        flat = F.when(rest == "", rest).otherwise(_flat(body))
        number = bind(start, lambda start: F.when(start != "", start.cast("int")).otherwise(1))
        return F.struct(kind.alias("kind"), F.when((known == _KINDS.index("ol") + 1) | ((known == 0) & (F.length(name) == 2)), number).otherwise(1).alias("start"), body.alias("body"), flat.alias("flat"))

    return F.transform(F.split(text, _TOKEN, -1), one)


_STATE = {"lists": "array<int>", "deeper": "int", "quote": "int", "pre": "boolean", "table": "int", "row": "int", "col": "int", "width": "int", "open": "boolean", "fresh": "boolean"}


def _facts(s, token):
    """What several results of a step depend on, each worked out once."""
    quote = F.when(_kind(token, "blockquote"), s["quote"] + 1).when(_kind(token, "/blockquote"), F.greatest(s["quote"] - 1, F.lit(0))).otherwise(s["quote"])
    # Only the outermost table has rows. A row ends with its tag or where the next begins, and so does a cell.
    outer = s["table"] == 1
    ends_row = outer & _kind(token, "tr", "/table") & (s["col"] > 0)
    return F.struct(
        quote.alias("quote"),
        F.when(quote > 0, _repeat("> ", F.least(quote, F.lit(DEEP)))).otherwise("").alias("mark"),
        ends_row.alias("ends_row"),
        (s["open"] & outer & (ends_row | _kind(token, "td", "/th"))).alias("ends_cell"),
    )


def _last(lists):
    """The innermost list, -1 outside of any."""
    return F.when(F.size(lists) > 0, F.element_at(lists, -1)).otherwise(-1)


def _after(s, token, f):
    """The state after a token: what its kind can change, the rest as it is."""
    empty = token["flat"] == ""

    def state(**changed):
        return F.struct(*[(changed[n].cast(kind) if n in changed else s[n]).alias(n) for n, kind in _STATE.items()])

    # An item counts its list up; items outside of any list have bullets.
    depth = F.size(s["lists"])
    below = F.slice(s["lists"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
    opens, closes = _kind(token, "ul", "ol"), _kind(token, "/ul", "/ol")
    full, deeper = depth >= DEEP, s["deeper"] > 0
    top = _last(s["lists"])
    lists = (
        F.when((opens & full) | (closes & deeper), s["lists"])
        .when(_kind(token, "ul"), F.concat(s["lists"], F.array(F.lit(-1))))
        .when(_kind(token, "ol"), F.concat(s["lists"], F.array(token["start"])))
        .when(closes, below)
        .when(top >= 0, F.concat(below, F.array(top + 1)))
        .otherwise(s["lists"])
    )
    in_list = state(
        lists=lists,
        deeper=s["deeper"] + F.when(opens & full, 1).when(closes & deeper, -1).otherwise(0),
        fresh=empty & (s["fresh"] | _kind(token, "li")),
    )
    begins_cell = (s["table"] == 1) & _kind(token, "td", "th")
    opens_table = _kind(token, "table") & ~s["pre"]
    in_table = state(
        table=s["table"] + F.when(opens_table, 1).when(_kind(token, "/table") & (s["table"] > 0) & ~s["pre"], -1).otherwise(0),
        row=F.when(opens_table & (s["table"] == 0), 0).when(f["ends_row"], s["row"] + 1).otherwise(s["row"]),
        col=F.when(f["ends_row"], 0).when(begins_cell, s["col"] + 1).otherwise(s["col"]),
        width=F.when(f["ends_row"] & (s["row"] == 0), s["col"]).otherwise(s["width"]),
        open=begins_cell | (s["open"] & ~f["ends_cell"]),
        fresh=empty & s["fresh"],
    )
    in_pre = F.when(_kind(token, "pre") & (s["table"] == 0), True).otherwise(s["pre"] & ~_kind(token, "/pre"))
    return (
        F.when(_kind(token, "ul", "li") & ~s["pre"] & (s["table"] == 0), in_list)
        .when(_kind(token, "table", "caption"), in_table)
        .when(_kind(token, "pre", "/blockquote"), state(quote=f["quote"], pre=in_pre, fresh=empty & s["fresh"]))
        .otherwise(state(fresh=empty & (s["fresh"] | _kind(token, "li"))))
    )


def _text(s, token, f):
    """The text a token adds."""
    body, flat = token["body"], token["flat"]
    is_in = lambda *names: _kind(token, *names)
    closes, said = is_in("/ul", "/ol"), flat != ""
    line = F.concat(F.lit("\n"), f["mark"])
    blank_line = F.when(f["quote"] > 0, F.concat(F.lit("\n"), F.rtrim(f["mark"]), line)).otherwise("\n\n")
    lines = lambda text, one: F.replace(F.array_join(F.transform(F.split(text, "\n", -1), one), "\n"), F.lit("\n"), line)
    paragraph = lines(F.btrim(body, F.lit(_BLANKS)), lambda x: F.btrim(x, F.lit(_BLANKS)))
    depth, no_tag = F.size(s["lists"]), token["kind"] == _NO_TAG
    in_list = depth > 0

    # Text between the rows and cells of a table is shown in no cell.
    begins_cell = (s["table"] == 1) & is_in("td", "th")
    rule = F.concat(line, F.lit("|"), _repeat(" --- |", s["col"]))
    row_end = F.when(~f["ends_row"], "").when(s["row"] == 0, rule).otherwise(_repeat(" |", F.greatest(s["width"] - s["col"], F.lit(0))))
    cell = F.when(said, F.concat(F.lit(" "), F.replace(flat, F.lit("|"), F.lit("\\|")))).otherwise("")
    in_table = F.concat(
        F.when(f["ends_cell"], " |").otherwise(""), row_end,
        F.when(begins_cell, F.concat(F.when(s["col"] == 0, F.concat(line, F.lit("|"))).otherwise(""), cell))
        .when(is_in("/table") & (s["table"] == 1), F.concat(blank_line, flat))
        .when(is_in("caption") & (s["row"] == 0) & ~s["open"], F.concat(flat, blank_line))
        .when(s["open"] & ~f["ends_cell"], cell).otherwise(""),
    )

    # Preformatted text keeps its lines; blank ones are marked until the end.
    raw = F.when(is_in("pre"), F.regexp_replace(body, r"\A\r?\n", "")).otherwise(body)
    kept = lines(F.replace(raw, F.lit("\r\n"), F.lit("\n")), lambda x: F.when(F.btrim(x, F.lit(_BLANKS)) == "", _KEPT).otherwise(x))

    top = _last(s["lists"])
    sign = F.when(top >= 0, F.concat(top.cast("string"), F.lit(". "))).otherwise("* ")
    # Behind a closing tag, text belongs to the list around.
    inner = F.greatest(depth - F.when(closes, 1).otherwise(0), F.lit(0))
    inside = F.concat(_repeat(INDENT, inner), flat)
    return (
        F.when(s["pre"] & ~is_in("/pre"), F.concat(F.when(is_in("br"), line).otherwise(""), kept))
        .when(s["pre"], F.concat(line, F.lit("```"), blank_line, paragraph))
        .when(s["table"] > 0, in_table)
        .when(is_in("table"), F.concat(blank_line, F.when(said, F.concat(paragraph, blank_line)).otherwise("")))
        .when(is_in("pre"), F.concat(blank_line, F.lit("```"), line, kept))
        .when(is_in("li"), F.concat(line, _repeat(INDENT, F.greatest(depth - 1, F.lit(0))), sign, flat))
        .when(is_in("ul", "ol"), F.concat(F.when(in_list, "").otherwise(blank_line), F.when(said, F.concat(line, inside)).otherwise("")))
        .when(closes, F.concat(F.when(inner > 0, "").otherwise(blank_line), F.when(~said, "").when(inner > 0, F.concat(blank_line, inside)).otherwise(paragraph)))
        .when(is_in("h1", "h6") & ~in_list, F.concat(blank_line, _repeat("#", token["kind"] - _KINDS.index("hr") - 1), F.lit(" "), flat))
        .when(is_in("hr"), F.concat(blank_line, F.lit("---"), blank_line, paragraph))
        .when(in_list & ~said, "")
        .when(in_list & (s["fresh"] | no_tag | is_in("/li")), F.concat(F.when(s["fresh"], "").otherwise(" "), flat))
        .when(in_list & is_in("br"), F.concat(line, inside))
        .when(in_list, F.concat(blank_line, inside))
        .when(is_in("br"), F.concat(line, paragraph))
        .when(no_tag, F.concat(f["mark"], paragraph))
        .otherwise(F.concat(blank_line, paragraph))
    )


def _fold(tokens):
    def step(s, token):
        return bind(_facts(s["state"], token), lambda f: F.struct(_after(s["state"], token, f).alias("state"), F.concat(s["out"], _text(s["state"], token, f)).alias("out")))

    def run(s, number):
        part = F.slice(tokens, number * RUN + 1, F.lit(RUN))
        begin = F.struct(s["state"].alias("state"), F.lit("").alias("out"))
        return F.aggregate(part, begin, step, lambda done: F.struct(done["state"].alias("state"), F.concat(s["out"], F.array(done["out"])).alias("out")))

    zero = {"lists": F.array(), "pre": F.lit(False), "open": F.lit(False), "fresh": F.lit(False)}
    state = F.struct(*[zero.get(n, F.lit(0)).cast(kind).alias(n) for n, kind in _STATE.items()])
    start = F.struct(state.alias("state"), F.array().cast("array<string>").alias("out"))
    runs = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / RUN).cast("int"))
    return F.array_join(F.aggregate(runs, start, run, lambda s: s["out"]), "")


def nested_markdown(text: Column) -> Column:
    """Lines of a nested page whose inline tags are already Markdown; entities are left."""
    folded = bind(_tokens(text), _fold)

    def join(lines):
        empty = lambda x: x.rlike(r"\A[> ]*\z")
        kept = F.filter(lines, lambda x, i: ~empty(x) | ((i > 0) & ~empty(F.get(lines, i - 1))))
        return F.array_join(F.transform(kept, lambda x: F.rtrim(x, F.lit(_BLANKS))), "\n")

    joined = bind(F.split(folded, "\n", -1), join)
    return F.replace(F.regexp_replace(joined, r"\A[\n> ]*\n|(?:\n[> ]*)+\z", ""), F.lit(_KEPT), F.lit(""))
