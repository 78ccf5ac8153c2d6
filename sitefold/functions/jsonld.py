"""JSON-LD over VARIANT as SQL expressions: documents, members, text forms, walk.

Functions take and return SQL text, as in ``markup``.

Spark's VARIANT sorts object keys, so keys get their place in the source text as
a prefix before parsing. Members then come in source order, and a key written
twice keeps both members, of which the last one counts.
"""

from __future__ import annotations

from sitefold.functions.text import literal, normalize_space_sql, to_int_sql

# Fixed value: the only script type that holds JSON-LD.
JSONLD_TYPE = "application/ld+json"

# The engine's variant holds texts up to about twice this size; keys get longer on the way.
SIZE_LIMIT = 32 * 1024 * 1024

_PLACE_DIGITS = 9
_STRING = r'"(?:[^"\\]|\\[\s\S])*+"'
# Numbers that JSON texts may hold beside the standard's, and their text forms.
_OTHER_NUMBERS = (("-Infinity", "-inf"), ("Infinity", "inf"), ("NaN", "nan"))
# A key with its colon, another string, text without quotes, a lone quote.
_JSON_PARTS = _STRING + r"\s*+:|" + _STRING + r'|[^"]++|"'
# A key with its colon, all text and strings up to the next key, a lone quote.
_JSON_KEYS = _STRING + r'\s*+:|(?:[^"]++|' + _STRING + r'(?!\s*+:))++|"'
# What is left out to see the brackets of a text alone, and brackets nested at most one and two deep.
_NO_BRACKETS = _STRING + r'|[^\[\]{}"]++'
_FLAT_SHAPE = r"^(?:\{\}|\[\])*+\z"
_LIST_SHAPE = r"^(?:[\[{](?:\{\}|\[\])*+[\]}])*+\z"
_PLACE_PREFIX = r'(?<=[{,])"\d{%d} ' % _PLACE_DIGITS
_VARIANTS = "ARRAY<VARIANT>"
_OBJECT = "MAP<STRING, VARIANT>"
_ENTRIES = "ARRAY<STRUCT<k: STRING, v: VARIANT>>"
_NODES = f"ARRAY<STRUCT<path: ARRAY<INT>, object: {_OBJECT}, list: {_VARIANTS}>>"


def parse_items(raw: str) -> str:
    """ARRAY<VARIANT> with the value of a JSON text; other than one item if it is bad.

    NaN and the infinities are read as strings of their text forms, since every value ends as text.
    """
    plain, guards = "p", []
    for number, text in _OTHER_NUMBERS:
        pattern = literal(rf"(?<![\w.+-]){number}(?![\w.+-])")
        plain = f"regexp_replace({plain}, {pattern}, '\"{text}\"')"
        guards.append(f"contains({raw}, '{number}')")
    other = f"if(startswith(p, '\"'), p, {plain})"

    def numbered(parts: str, other: str) -> str:
        return (
            f"array_join(transform(regexp_extract_all({raw}, {literal(parts)}, 0), (p, i) ->"
            " if(startswith(p, '\"') AND endswith(p, ':'),"
            f" concat('\"', lpad(CAST(i AS STRING), {_PLACE_DIGITS}, '0'), ' ', substr(p, 2)), {other})), '')"
        )

    # Only texts with such a number need each string apart.
    text = f"if({' OR '.join(guards)}, {numbered(_JSON_PARTS, other)}, {numbered(_JSON_KEYS, 'p')})"
    return f"try_cast(try_parse_json(concat('[', {text}, ']')) AS {_VARIANTS})"


def _kind(value: str) -> str:
    return f"schema_of_variant({value})"


def is_object(value: str) -> str:
    """By cast, which looks one level deep; the schema of a value is built over all of it."""
    return f"(try_cast({value} AS {_OBJECT}) IS NOT NULL)"


def is_array(value: str) -> str:
    return f"(try_cast({value} AS {_VARIANTS}) IS NOT NULL)"


def items(value: str) -> str:
    """Items of a JSON array; no items for any other value."""
    return f"coalesce(try_cast({value} AS {_VARIANTS}), CAST(array() AS {_VARIANTS}))"


def members(value: str) -> str:
    """ARRAY<STRUCT<k, v>> of an object in source order; empty for any other value."""
    return members_of(f"try_cast({value} AS {_OBJECT})")


def members_of(fields: str) -> str:
    """The same of a MAP of keys with their place; empty for null."""
    entries = (
        f"transform(map_entries({fields}), e -> named_struct("
        f"'k', substr(e.key, {_PLACE_DIGITS + 2}), 'v', e.value))"
    )
    return f"coalesce({entries}, CAST(array() AS {_ENTRIES}))"


def member(entries: str, key: str) -> str:
    """VARIANT under ``key``, of equal keys the last; SQL null when it is missing."""
    return f"try_element_at(filter({entries}, e -> e.k = {literal(key)}), -1).v"


def _float_text(text: str) -> str:
    """Shortest decimal text of a float: 14999.0, 0.0001, 1e-05, 1e+16."""
    size = f"abs(try_cast({text} AS DOUBLE))"
    exponent = f"try_cast(substring_index({text}, 'E', -1) AS INT)"
    plain = (
        f"regexp_replace(CAST(try_cast({text} AS DECIMAL(38, 20)) AS STRING),"
        f" {literal(r'(?<!\.)0+\z')}, '')"
    )
    scientific = (
        f"concat(regexp_replace(substring_index({text}, 'E', 1), {literal(r'\.0\z')}, ''),"
        f" if({exponent} < 0, 'e-', 'e+'), lpad(CAST(abs({exponent}) AS STRING),"
        f" greatest(2, length(CAST(abs({exponent}) AS STRING))), '0'))"
    )
    return (
        f"CASE WHEN contains({text}, 'E') THEN"
        f" if({size} >= 1e-4 AND {size} < 1e16, {plain}, {scientific})"
        f" WHEN contains({text}, '.') THEN {text} ELSE concat({text}, '.0') END"
    )


def text_of(value: str) -> str:
    """Text form of a JSON value: missing '', null 'None', True/False, 14999.0.

    Nested values print as JSON, keys without their place prefix. ``value`` is
    written several times, so it should be a plain name.
    """
    text, kind = f"try_cast({value} AS STRING)", _kind(value)
    whole = literal(r"^-?\d{20,}\z")
    return (
        f"CASE WHEN {value} IS NULL THEN '' WHEN {kind} = 'STRING' THEN {text}"
        f" WHEN {kind} = 'VOID' THEN 'None' WHEN {kind} = 'BOOLEAN' THEN initcap({text})"
        f" WHEN {kind} = 'DOUBLE' OR (startswith({kind}, 'DECIMAL') AND NOT {text} rlike {whole})"
        f" THEN {_float_text(text)}"
        f" WHEN {is_object(value)} OR {is_array(value)}"
        f" THEN regexp_replace({text}, {literal(_PLACE_PREFIX)}, '\"') ELSE {text} END"
    )


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _last(entries: str, keys: str, key: str) -> str:
    """``member`` of plain names, where ``keys`` holds the keys of the entries in reverse."""
    return f"get({entries}, size({entries}) - CAST(array_position({keys}, {literal(key)}) AS INT)).v"


def _type_name(value: str) -> str:
    return f"if({_kind(value)} = 'STRING', try_cast({value} AS STRING), NULL)"


def is_type(entries: str, name: str) -> str:
    """@type is exactly the string ``name``."""
    return f"coalesce({_type_name(member(entries, '@type'))} = {literal(name)}, false)"


def has_type(entries: str, name: str) -> str:
    """@type is ``name`` or a list holding it."""
    whole = f"{_type_name('y')} = {literal(name)}"
    listed = f"exists({items('y')}, t -> {_type_name('t')} = {literal(name)})"
    own = f"coalesce({whole}, false) OR coalesce({listed}, false)"
    return _let(_last(entries, f"reverse({entries}.k)", "@type"), "y", f"y IS NOT NULL AND ({own})")


def nesting(raw: str) -> str:
    """Depth of the deepest bracket of a JSON text."""
    runs = f"regexp_extract_all(b, {literal(r'[\[{]+|[\]}]+')}, 0)"
    now = "s.now + if(startswith(r, '{') OR startswith(r, '['), length(r), -length(r))"
    depth = (
        f"aggregate({runs}, named_struct('now', 0, 'top', 0), (s, r) -> named_struct("
        f"'now', {now}, 'top', greatest(s.top, {now})), s -> s.top)"
    )
    # Most texts are one object or a list of flat ones, which a pattern tells faster than a fold.
    for levels, shape in ((2, _LIST_SHAPE), (1, _FLAT_SHAPE)):
        depth = f"if(b rlike {literal(shape)}, {levels}, {depth})"
    return _let(f"regexp_replace({raw}, {literal(_NO_BRACKETS)}, '')", "b", depth)


def all_objects(documents: str, depth: str) -> str:
    """All objects in the documents: ARRAY<STRUCT<path, object, list>>, ``list`` null.

    ``path`` sorts in document order. Works level by level down to ``depth``, the
    nesting the texts really have, so nothing is cut off and the values of the deepest
    level, which hold no other, are not looked at. Each value is cast once, as
    an object and as a list, which both look one level deep.
    """

    def read(values: str, path: str) -> str:
        """Objects and lists among the values; the place ``c.i`` of one ends its path."""
        cast = (
            f"named_struct('i', i, 'object', try_cast(v AS {_OBJECT}), 'list', try_cast(v AS {_VARIANTS}))"
        )
        nodes = f"filter(transform({values}, (v, i) -> {cast}), c -> c.object IS NOT NULL OR c.list IS NOT NULL)"
        node = f"named_struct('path', {path}, 'object', c.object, 'list', c.list)"
        return f"transform({nodes}, c -> {node})"

    values = "coalesce(map_values(x.object), x.list)"
    children = f"flatten(transform(s.open, x -> {read(values, 'concat(x.path, array(c.i))')}))"
    none = f"CAST(array() AS {_NODES})"
    return (
        f"aggregate(sequence(greatest({depth}, 1), 1), named_struct("
        f"'open', CAST({read(documents, 'array(c.i)')} AS {_NODES}), 'found', {none}),"
        f" (s, below) -> named_struct('open', if(below > 1, CAST({children} AS {_NODES}), {none}),"
        " 'found', concat(s.found, filter(s.open, c -> c.object IS NOT NULL))), s -> s.found)"
    )


def review_parts(n: str) -> str:
    """STRUCT of the values of a Review node (``path``, ``es``) its columns come from."""

    def own(key: str) -> str:
        return _last(f"{n}.es", "ks", key)

    def inner(value: str, key: str) -> str:
        # Most objects lack most members: nothing is read of those.
        return _let(value, "o", f"if(o IS NULL, NULL, {member(members('o'), key)})")

    fields = {
        "path": f"{n}.path",
        "rating": inner(own("reviewRating"), "ratingValue"),
        "title": own("name"),
        "review_text": own("reviewBody"),
        "author": own("author"),
        "author_name": inner(own("author"), "name"),
        "review_date": own("datePublished"),
        "variant": own("sku"),
        "helpful_count": inner(own("interactionStatistic"), "userInteractionCount"),
    }
    found = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return _let(f"reverse({n}.es.k)", "ks", found)


def review_fields(p: str) -> dict[str, str]:
    """The seven review columns from ``review_parts``."""

    def given(name: str, value: str, other: str = "''") -> str:
        """A missing value needs no pattern."""
        return f"if({p}.{name} IS NULL, {other}, {value})"

    def text(name: str) -> str:
        return given(name, normalize_space_sql(text_of(f"{p}.{name}")))

    def number(name: str) -> str:
        return given(name, to_int_sql(text_of(f"{p}.{name}")), "NULL")

    reviewer = f"if({is_object(f'{p}.author')}, {text_of(f'{p}.author_name')}, {text_of(f'{p}.author')})"
    return {
        "rating": number("rating"),
        "title": text("title"),
        "review_text": text("review_text"),
        "reviewer": given("author", normalize_space_sql(reviewer)),
        "review_date": text("review_date"),
        "variant": text("variant"),
        "helpful_count": number("helpful_count"),
    }
