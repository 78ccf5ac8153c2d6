"""HTML as SQL expressions: tokens, attributes, an element tree, and visible text.

Functions take and return SQL text, since most of this runs inside array lambdas
(``transform(tokens, t -> ...)``) and one SQL text is one call to the engine.

A page is one row, so all of this is row-local: tokens by one regular expression,
the tree by folding over the tokens with a stack of open tags, no shuffle.
Tree rules: an end tag closes the nearest open tag of its name and everything
opened after it, an end tag without open partner is ignored, start tags close
nothing, and what is still open at the end of the page ends there.
"""

from __future__ import annotations

from html.entities import html5

from sitefold.functions.text import literal, literals, normalize_space_sql

# Elements that never have content.
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
)

# Elements whose content is not markup.
RAW_TAGS = ("script", "style")

# Named entities: the HTML 5 set of the standard library; names without their semicolon.
ENTITIES = {name.rstrip(";"): text for name, text in html5.items()}

# Numeric references 128 to 159 are read as windows-1252, where that has a character.
WINDOWS_1252 = {
    code: bytes([code]).decode("cp1252")
    for code in range(128, 160)
    if bytes([code]).decode("cp1252", "ignore")
}

_TAG_REST = r"""[^\s/>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>))|[^=>])*+>"""
_COMMENT = r"<!--[\s\S]*?-->"
_RAW = r"<(?:script|style)(?=[\s/>])" + _TAG_REST
# Up to the first end tag of the name, or to the end; text without tags is taken in one step.
_SCRIPT = r"<script(?=[\s/>])" + _TAG_REST + r"(?:[^<]++|<(?!/script\s*+>))*+(?:</script\s*+>)?+"
_STYLE = r"<style(?=[\s/>])" + _TAG_REST + r"(?:[^<]++|<(?!/style\s*+>))*+(?:</style\s*+>)?+"
_OPEN = r"<[a-z]" + _TAG_REST
_CLOSE = r"</[a-z][^>]*+>"
_OTHER = r"<[!?/][^>]*+>"
_TEXT = r"(?:[^<]++|<(?![a-z/!?]))++"
# Names alone come first, as most tags are; the bracket that all but text begin with is read once.
_BARE = r"<(?!script|style)[a-z][a-z0-9]*+>"
_TAGGED = "<(?:" + "|".join(p[1:] for p in (_BARE, _COMMENT, _SCRIPT, _STYLE, _OPEN, _CLOSE, _OTHER)) + ")"
_TOKEN = "(?i)" + "|".join((_TAGGED, _TEXT, "<"))
# The bracket that all three begin with stands first, so other text is passed over quickly.
_SCRIPT_ONLY = "(?i)<(?:" + "|".join(p[1:] for p in (_COMMENT, _SCRIPT, _STYLE)) + ")"
_START_TAGS = "(?i)" + "|".join((_COMMENT, _SCRIPT, _STYLE, _OPEN))

_VALUE = r"""\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_NAME = r"""([^\s/=>"'][^\s/=>]*+)"""
_ATTRIBUTE = _NAME + "(?:" + _VALUE + ")?+"
_QUOTED = r"""^"([\s\S]*)"\z|^'([\s\S]*)'\z"""
_QUOTED_VALUE = r"""=\s*(?:"[^"]*"|'[^']*')"""
_OPEN_VALUE_AT_END = r"""=\s*[^\s"'>][^\s>]*/>\z"""

# End tags of the innermost fold, and such chunks in a run.
_FOLD_CHUNK = 64
_FOLD_RUN = 64

# Up to so many different tags of a page are looked up for each token.
_FEW_TAGS = 32


def unescape(text: str) -> str:
    """Decode numeric and named entities in one pass; unknown ones stay as they are.

    ``text`` is written several times, so it should be a plain name.
    """
    number = (
        "try_cast(if(p rlike '(?i)^&#x', conv(regexp_extract(p, '(?i)^&#x([0-9a-f]+)', 1), 16, 10),"
        " regexp_extract(p, '([0-9]+)', 1)) AS INT)"
    )
    windows = ", ".join(f"{code}, {literal(char)}" for code, char in WINDOWS_1252.items())
    point = (
        f"if({number} BETWEEN 128 AND 159 AND map({windows})[{number}] IS NOT NULL,"
        f" map({windows})[{number}], if({number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343,"
        f" decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32'), '\\uFFFD'))"
    )
    names = ", ".join(f"'{name}', {literal(char)}" for name, char in ENTITIES.items())
    named = f"try_element_at(map({names}), regexp_extract(p, '^&([a-zA-Z0-9]+)', 1))"
    parts = literal(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?|&[a-zA-Z][a-zA-Z0-9]*+;?|&|[^&]++")
    return (
        f"if(contains({text}, '&'), array_join(transform(regexp_extract_all({text}, {parts}, 0),"
        f" p -> CASE WHEN startswith(p, '&#') THEN {point}"
        f" WHEN startswith(p, '&') THEN coalesce({named}, p) ELSE p END), ''), {text})"
    )


def _all_matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, {group})"


def tokens(html: str) -> str:
    """ARRAY<STRING>: comments, whole scripts and styles, tags and text runs in order."""
    return _all_matches(html, _TOKEN)


def scripts(html: str) -> str:
    """ARRAY<STRING> of whole script elements; those inside comments do not count."""
    # The second letter tells them from styles and comments.
    return f"filter({_all_matches(html, _SCRIPT_ONLY)}, t -> substr(t, 3, 1) IN ('c', 'C'))"


def start_tags(html: str) -> str:
    """ARRAY<STRING> of the start tags of a page; scripts and comments do not count."""
    other = literal(r"(?i)^<(?!(?:script|style)[\s/>]|!)")
    return f"filter({_all_matches(html, _START_TAGS)}, t -> t rlike {other})"


def script_body(script: str, start: str = "") -> str:
    """Text of a whole script; ``start``: an open tag that many have, written just so."""
    body = f"regexp_replace({script}, {literal('(?i)^' + _RAW)}, '')"
    if start:
        body = f"if(startswith({script}, {literal(start)}), substr({script}, {len(start) + 1}), {body})"
    inner = f"regexp_replace(x, {literal(r'(?i)</script\s*>\z')}, '')"
    return _let(body, "x", f"if(endswith(x, '</script>'), left(x, length(x) - 9), {inner})")


def open_tag(element: str) -> str:
    """Start tag of a whole script or style element."""
    return f"regexp_extract({element}, {literal('(?i)^' + _RAW)}, 0)"


def tag_name(token: str) -> str:
    return f"lower(regexp_extract({token}, {literal(r'^</?([a-zA-Z][^\s/>]*)')}, 1))"


def _unquote(value: str) -> str:
    return f"regexp_replace({value}, {literal(_QUOTED)}, '$1$2')"


def attributes(tag: str) -> str:
    """ARRAY<STRUCT<k, v>> of a start tag; names lower case, values decoded."""
    body = f"regexp_replace({tag}, {literal(r'^<[a-zA-Z][^\s/>]*|>\z')}, '')"
    names = f"transform({_all_matches(body, _ATTRIBUTE, 1)}, k -> lower(k))"
    values = f"transform({_all_matches(body, _ATTRIBUTE, 2)}, v -> {_unquote('v')})"
    decoded = f"transform({values}, v -> {unescape('v')})"
    found = f"zip_with({names}, {decoded}, (k, v) -> named_struct('k', k, 'v', v))"
    # Most tags of a page are names alone.
    bare = literal(r"^<[a-zA-Z][^\s/>]*>\z")
    return f"if({tag} rlike {bare}, CAST(array() AS ARRAY<STRUCT<k: STRING, v: STRING>>), {found})"


def raw_attribute(tag: str, name: str) -> str:
    """Value of ``name`` as written in a start tag, of equal names the last; '' without one."""
    # One match per attribute, so the depth of a match does not grow with their number.
    own = literal(rf"(?i)^{name}\s*+=")
    some = literal(rf"(?i){name}\s*+=")
    last = f"try_element_at(filter({_all_matches('w', _ATTRIBUTE)}, a -> a rlike {own}), -1)"
    value = f"regexp_replace(coalesce({last}, ''), {literal(r'^[^=]*+=?\s*+')}, '')"
    # The one-item array names the tag, which may be a long expression.
    read = f"if(w rlike {some}, {value}, '')"
    return f"coalesce(get(transform(array({tag}), w -> {_unquote(read)}), 0), '')"


def attribute_list(tags: str, name: str) -> str:
    """Decoded value of ``name`` for each start tag of an array."""
    return f"transform(transform({tags}, t -> {raw_attribute('t', name)}), v -> {unescape('v')})"


def class_list(value: str) -> str:
    """ARRAY<STRING> of a class attribute."""
    return f"filter(split({value}, {literal(r'\s+')}), c -> c <> '')"


def tags(toks: str) -> str:
    """ARRAY<STRUCT<pos, kind, tag>> of all tag tokens.

    ``kind`` is 1 for a tag that opens, -1 for one that closes, 0 for an element
    without content. A closing slash counts unless it ends an unquoted value.
    """
    void, raw = literals(VOID_TAGS), literals(RAW_TAGS)
    named = (
        f"filter(transform({toks}, (t, i) -> if(startswith(t, '<'), named_struct('pos', i, 'token', t,"
        f" 'tag', {tag_name('t')}), NULL)), x -> x IS NOT NULL AND x.tag <> '')"
    )
    self_closed = (
        "endswith(x.token, '/>') AND NOT regexp_replace(x.token, "
        f"{literal(_QUOTED_VALUE)}, '') rlike {literal(_OPEN_VALUE_AT_END)}"
    )
    kind = (
        f"CASE WHEN startswith(x.token, '</') THEN if(x.tag IN ({void}), NULL, -1)"
        f" WHEN x.tag IN ({void}) OR x.tag IN ({raw}) OR ({self_closed}) THEN 0 ELSE 1 END"
    )
    return (
        f"filter(transform({named}, x -> named_struct('pos', x.pos, 'kind', {kind},"
        " 'tag', x.tag)), x -> x.kind IS NOT NULL)"
    )


_RANGE = "STRUCT<low: INT, n: INT, end: INT>"


def _none(of: str) -> str:
    return f"CAST(array() AS ARRAY<{of}>)"


def _ended(opened: str, end: str) -> str:
    """ARRAY<BIGINT>: places of start tags, each with the token that ends it in the low half."""
    return f"transform({opened}, o -> shiftleft(CAST(o AS BIGINT), 32) + {end})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _nearest(codes: str, code: str) -> str:
    """1-based place of the last ``code`` in an array, 0 without one."""
    return (
        f"if(array_contains({codes}, {code}),"
        f" size({codes}) - CAST(array_position(reverse({codes}), {code}) AS INT) + 1, 0)"
    )


def _step(top: str, **changed: str) -> str:
    """State of the innermost fold: that of ``s`` but for the named fields.

    ``n``: start tags seen; ``base``: how many of the tags that were open before the chunk still
    are; ``own``, ``codes``: places and names of tags opened since; ``tops``: the tag left open
    last after each end tag; ``ends``: elements that ended; ``cuts``: ranges of earlier tags that
    ended; ``gone``: names not open before the chunk (any more).
    """
    changed = {"n": "x.n", "own": "g.own", "codes": "g.codes", **changed, "tops": f"concat(s.tops, array({top}))"}
    names = ("n", "base", "own", "codes", "tops", "ends", "cuts", "gone")
    return "named_struct(" + ", ".join(f"'{k}', {changed.get(k, f's.{k}')}" for k in names) + ")"


def _fold_end() -> str:
    """Next state ``s`` after end tag ``x``; ``a.stack``, ``a.codes``: the tags open before the chunk."""
    grown = (
        "if(x.n > s.n, named_struct('own', concat(s.own, sequence(s.n, x.n - 1)),"
        " 'codes', concat(s.codes, slice(codes, s.n + 1, x.n - s.n))),"
        " named_struct('own', s.own, 'codes', s.codes))"
    )
    top = "get(a.stack, s.base - 1)"
    own_closed = _let(
        _nearest("g.codes", "x.code"), "place",
        _step(
            f"coalesce(get(g.own, place - 2), {top}, -1)",
            own="slice(g.own, 1, place - 1)", codes="slice(g.codes, 1, place - 1)",
            ends=f"concat(s.ends, {_ended('slice(g.own, place, size(g.own))', 'x.pos')})",
        ),
    )
    # Mostly the tag on top; a search costs no more than it ends, or happens once for a name.
    on_top = "get(a.codes, s.base - 1) = x.code"
    earlier = f"if({on_top}, s.base, {_nearest('slice(a.codes, 1, s.base)', 'x.code')})"
    cut = "array(named_struct('low', low, 'n', s.base - low + 1, 'end', x.pos))"
    all_closed = _step(
        "coalesce(get(a.stack, low - 2), -1)",
        base="low - 1", own=_none("INT"), codes=_none("INT"),
        ends=f"concat(s.ends, {_ended('g.own', 'x.pos')})", cuts=f"concat(s.cuts, {cut})",
    )
    same = f"coalesce(try_element_at(g.own, -1), {top}, -1)"
    ignored = _step(same, gone="concat(s.gone, array(x.code))")
    earlier_closed = _let(earlier, "low", f"if(low > 0, {all_closed}, {ignored})")
    step = (
        f"CASE WHEN array_contains(g.codes, x.code) THEN {own_closed}"
        f" WHEN s.base = 0 OR array_contains(s.gone, x.code) THEN {_step(same)}"
        f" ELSE {earlier_closed} END"
    )
    return _let(grown, "g", step)


def _folded(starts: str, start: str, zero: str, one: str, end: str = "") -> str:
    """Open tags, tops and ended elements after a run of chunks; ``one`` is what a chunk gives.

    ``zero`` has the fields ``n``, ``stack`` and ``codes``. With ``end`` all tags end there at last.
    """
    first = (
        f"named_struct('n', {zero}.n, 'stack', {zero}.stack, 'codes', {zero}.codes,"
        f" 'tops', {_none('ARRAY<INT>')}, 'ends', {_none('ARRAY<BIGINT>')})"
    )
    rest = f"if(size(codes) > z.n, sequence(z.n, size(codes) - 1), {_none('INT')})"
    last = f", {_ended('z.stack', end)}, {_ended(rest, end)}" if end else ""
    return (
        f"aggregate({starts}, {first}, (a, {start}) -> {one},"
        " z -> named_struct('n', z.n, 'stack', z.stack, 'codes', z.codes, 'tops', flatten(z.tops),"
        f" 'ends', concat(flatten(z.ends){last})))"
    )


def _fold_ends(page_end: str) -> str:
    """``tops`` of the end tags ``closes``, and ``ends`` of all start tags, of which ``codes`` has the names.

    An aggregate copies its whole state, value by value, at every step, so no state may grow with
    the page and all of it is numbers. The fold is nested: chunks of end tags, runs of chunks, runs
    of runs; the innermost state holds what was opened and ended in its chunk, and looks at the tags
    open before without holding them. Start tags cost no step: an end tag takes in those since the
    one before. Work is linear in the tags, and a chunk adds one copy of the tags open at its start.
    """
    wide = _FOLD_CHUNK * _FOLD_RUN
    # Where many tags are open, chunks are longer, as each copies them.
    most = f"least({_FOLD_CHUNK * 16}, sqrt(3 * size(a.stack)))"
    width = f"CAST(greatest({_FOLD_CHUNK}, {most}) AS INT)"
    zero = (
        f"named_struct('n', a.n, 'base', size(a.stack), 'own', {_none('INT')}, 'codes', {_none('INT')},"
        f" 'tops', {_none('INT')}, 'ends', {_none('BIGINT')}, 'cuts', {_none(_RANGE)},"
        f" 'gone', {_none('INT')})"
    )
    cuts = f"flatten(transform(r.cuts, x -> {_ended('slice(a.stack, x.low, x.n)', 'x.end')}))"
    chunk = (
        f"aggregate(slice(run, start, width), {zero}, (s, x) -> {_fold_end()},"
        " r -> named_struct('n', r.n, 'stack', concat(slice(a.stack, 1, r.base), r.own),"
        " 'codes', concat(slice(a.codes, 1, r.base), r.codes),"
        f" 'tops', concat(a.tops, array(r.tops)), 'ends', concat(a.ends, array(concat(r.ends, {cuts})))))"
    )

    def starts(tokens: str, step: int | str) -> str:
        return f"if(size({tokens}) > 0, sequence(1, size({tokens}), {step}), {_none('INT')})"

    # A run is cut out once, so that its chunks slice a short array.
    inner = _let(
        f"slice(closes, first, {wide})", "run",
        _let(width, "width", _folded(starts("run", "width"), "start", "a", chunk)),
    )
    joined = _let(
        inner, "done",
        "named_struct('n', done.n, 'stack', done.stack, 'codes', done.codes,"
        " 'tops', concat(a.tops, array(done.tops)), 'ends', concat(a.ends, array(done.ends)))",
    )
    nothing = f"named_struct('n', 0, 'stack', {_none('INT')}, 'codes', {_none('INT')})"
    return _folded(starts("closes", wide), "first", nothing, joined, page_end)


# A tag as one number: its token in the high half, below it 4 * name + kind. Kinds: 0 without
# content, 1 opens, 3 closes; 2 closes an element that is marked as without content.
_LOW = "4294967295"
_HIGH = "-4294967296"
_DEAD = "(-9223372036854775807 - 1)"


def _token(tag: str) -> str:
    return f"CAST(shiftright({tag}, 32) AS INT)"


def _low(tag: str) -> str:
    return f"({tag} & {_LOW})"


def _kind(tag: str) -> str:
    return f"({tag} & 3)"


def _at(token: str, low: str) -> str:
    return f"(shiftleft(CAST({token} AS BIGINT), 32) + {low})"


def _numbers(read: str, names: str) -> str:
    """ARRAY<BIGINT> of tags as numbers, without end tags of a name that no start tag has."""
    opened = f"array_distinct(transform(filter({read}, t -> t.kind = 1), t -> t.tag))"
    low = f"(4 * (array_position({names}, t.tag) - 1) + {_kind('t.kind')})"
    live = f"filter({read}, t -> t.kind <> -1 OR array_contains(opened, t.tag))"
    return _let(opened, "opened", f"transform({live}, t -> {_at('t.pos', low)})")


def _names(read: str) -> str:
    return f"array_distinct(transform({read}, t -> t.tag))"


def tag_steps(toks: str) -> dict[str, str]:
    """Steps to ``_names`` and ``_numbers``, the tags of a page as numbers.

    A page with few different tags has them read once each, not once for every token.
    """
    seen = f"filter(array_distinct({toks}), t -> startswith(t, '<'))"
    few = f"size(_seen) <= {_FEW_TAGS}"
    # The number of no tag comes first, for tokens that are not found.
    number = "get(lows, CAST(array_position(live, t) AS INT))"
    found = f"filter(transform({toks}, (t, i) -> if(startswith(t, '<'), {_at('i', number)}, {_DEAD})), x -> x >= 0)"
    found = _let(f"transform(_read_numbers, x -> get(_seen, {_token('x')}))", "live", found)
    found = _let(f"flatten(array(array({_DEAD}), transform(_read_numbers, x -> {_low('x')})))", "lows", found)
    return {
        "_seen": seen,
        "_read": tags(f"if({few}, _seen, {toks})"),
        "_names": _names("_read"),
        "_read_numbers": _numbers("_read", "_names"),
        "_numbers": f"if({few}, {found}, _read_numbers)",
    }


def _tops() -> str:
    """Start token of the tag open last after each tag of ``_placed``; -1 at the top."""
    after = (
        "concat(array(coalesce(get(starts, get(_page.tops, k)), -1)),"
        " slice(starts, c.n + 1, coalesce(get(_closes, k + 1).n, size(starts)) - c.n))"
    )
    first = "slice(starts, 1, coalesce(get(_closes, 0).n, size(starts)))"
    found = f"flatten(array({first}, flatten(transform(_closes, (c, k) -> {after}))))"
    return _let(f"transform(_opens, x -> {_token('x')})", "starts", found)


def _parents() -> str:
    """Parents of the elements, in document order.

    All elements from a tag to the next one that opens or closes have the tag open between as parent.
    """
    listed = f"filter(_marked, x -> {_kind('x')} <> 2)"
    rank = f"if((x & 1) = 1, {_at('i', _kind('x'))}, -1L)"
    ranks = f"filter(transform(listed, (x, i) -> {rank}), x -> x >= 0)"
    following = "get(ranks, i + 1)"
    n = (
        f"coalesce({_token(following)} - if({_kind(following)} = 3, 1, 0), size(listed) - 1)"
        f" - {_token('x')}"
    )
    before = f"coalesce({_token('get(ranks, 0)')} + if({_kind('get(ranks, 0)')} = 1, 1, 0), size(listed))"
    runs = f"flatten(transform(ranks, (x, i) -> array_repeat(get(tops, i), {n})))"
    found = f"flatten(array(array_repeat(-1, {before}), {runs}))"
    return _let(listed, "listed", _let(ranks, "ranks", _let(_tops(), "tops", found)))


def span_steps(page_end: str) -> dict[str, str]:
    """Steps from ``_numbers`` to ``_elements``, ``_ends`` and ``_parents``, one value an element.

    Work is by arrays of numbers: a pass over them costs a fraction of one over structs. An end tag
    that follows its start tag at once ends that element, which then needs no place among the open tags.
    """
    after, before = "get(given, i + 1)", "get(given, i - 1)"
    # Kind 1 with 3 next, of one name: 0 and 2.
    paired = (
        f"CASE {_kind('x')} WHEN 1 THEN if({_low(after)} = {_low('x')} + 2, x - 1, x)"
        f" WHEN 3 THEN if({_low(before)} = {_low('x')} - 2, x - 1, x) ELSE x END"
    )
    following = "get(given, i + 1)"
    end = f"if({_kind(following)} = 2, shiftright({following}, 32), shiftright(x, 32))"
    short = f"if({_kind('x')} = 0, (x & {_HIGH}) + {end}, -1L)"
    shorts = _let("_marked", "given", f"filter(transform(given, (x, i) -> {short}), x -> x >= 0)")
    close = f"named_struct('j', i, 'pos', {_token('x')}, 'code', CAST(shiftright({_low('x')}, 2) AS INT))"
    closing = f"filter(transform(_placed, (x, i) -> if({_kind('x')} = 3, {close}, NULL)), x -> x IS NOT NULL)"
    closes = f"transform({closing}, (t, i) -> named_struct('n', t.j - i, 'pos', t.pos, 'code', t.code))"
    codes = f"transform(_opens, x -> CAST(shiftright({_low('x')}, 2) AS INT))"
    page = _let("_closes", "closes", _let(codes, "codes", _fold_ends(page_end)))
    ended = _let("_opens", "given", f"transform(_page.ends, x -> (get(given, {_token('x')}) & {_HIGH}) + {_low('x')})")
    return {
        # A name for an array that is looked into spares reading its column each time.
        "_marked": _let("_numbers", "given", f"transform(given, (x, i) -> {paired})"),
        "_placed": "filter(_marked, x -> (x & 1) = 1)",
        "_opens": f"filter(_placed, x -> {_kind('x')} = 1)",
        "_closes": closes,
        "_page": page,
        # Each element has one end, so the sorted ends stand in its place.
        "_ends": f"sort_array(flatten(array({ended}, {shorts})))",
        "_parents": _parents(),
        "_elements": f"filter(_marked, x -> {_kind('x')} < 2)",
    }


def _tag_of(element: str) -> str:
    return f"get(_names, CAST(shiftright({_low(element)}, 2) AS INT))"


def row_steps(toks: str) -> dict[str, str]:
    """Steps after those of ``span_steps`` to ``_tag`` and ``_token``, one value an element."""
    return {
        "_tag": f"transform(_elements, x -> {_tag_of('x')})",
        "_token": f"transform(_elements, x -> get({toks}, {_token('x')}))",
    }


def span_rows() -> str:
    """Rows of the elements after the steps, in document order, for ``span_columns``."""
    return "inline(arrays_zip(_elements, _ends, _parents, _tag, _token)) AS (_element, _end, _parent, _tag, _token)"


def span_columns(pos: str, end: str, parent: str) -> list[str]:
    """Columns of a row with the names given, and ``tag``; their values are those of ``span``."""
    return [
        f"{_token('_element')} AS {pos}", f"CAST({_low('_end')} AS INT) AS {end}", f"_parent AS {parent}", "_tag AS tag"
    ]


def span() -> str:
    """ARRAY<STRUCT<pos, end, parent, tag>> of all elements, in document order, after the steps.

    ``pos`` is the token of the start tag, ``end`` the token that closes it and ``parent`` the
    start of the surrounding element (-1 at the top).
    """
    struct = (
        f"'pos', {_token('x')}, 'end', CAST({_low('get(_ends, i)')} AS INT),"
        f" 'parent', get(_parents, i), 'tag', {_tag_of('x')}"
    )
    return f"transform(_elements, (x, i) -> named_struct({struct}))"


def spans(tag_tokens: str, page_end: str) -> str:
    """``span`` of tags that were read before, in one expression."""
    steps = {"_names": _names(tag_tokens), "_numbers": _numbers(tag_tokens, "_names"), **span_steps(page_end)}
    found = span()
    for name, value in reversed(steps.items()):
        found = _let(value, name, found)
    return found


def text_runs(toks: str) -> str:
    """ARRAY<STRING> as long as the tokens: decoded text, null where a token is none."""
    is_text = f"NOT startswith(t, '<') OR t rlike {literal('^<(?![a-zA-Z/!?])')}"
    return f"transform({toks}, t -> if({is_text}, {unescape('t')}, NULL))"


def text_between(runs: str, pos: str, end: str) -> str:
    """Visible text of an element: its text runs joined by a blank, normalised."""
    inner = f"slice({runs}, {pos} + 2, greatest({end} - {pos} - 1, 0))"
    return normalize_space_sql(f"array_join({inner}, ' ')")
