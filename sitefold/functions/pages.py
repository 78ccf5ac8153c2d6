"""Elements and selectors of a page as SQL expressions (SQL text, as in ``markup``)."""

from __future__ import annotations

from collections.abc import Sequence

from sitefold.functions import jsonld as J
from sitefold.functions import markup as M
from sitefold.functions.text import first_nonblank_sql, literal, strip_sql

_ELEMENT_FIELDS = ("pos", "end", "parent", "tag", "classes", "prev_tag", "prev_classes")


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def fields_of(name: str, fields: Sequence[str]) -> dict[str, str]:
    return {f: f"{name}.{f}" for f in fields}


def jsonld_texts(html: str) -> str:
    """ARRAY<STRING> of the non-blank JSON-LD script texts of a page."""
    kind = M.raw_attribute(M.open_tag("s"), "type")
    # The type may be written with an entity for its plus sign.
    plain = f"replace(replace({kind}, '&#43;', '+'), '&plus;', '+')"
    # Written plainly most of the time, which no pattern need tell.
    start = f'<script type="{J.JSONLD_TYPE}">'
    chosen = f"filter({M.scripts(html)}, s -> startswith(s, {literal(start)}) OR {plain} = '{J.JSONLD_TYPE}')"
    bare = " AND ".join(f"({f}(b, '{o}') OR {f}(b, '{c}'))" for f, o, c in (("startswith", "{", "["), ("endswith", "}", "]")))
    stripped = f"get(transform(array({M.script_body('s', start)}), b -> if({bare}, b, {strip_sql('b')})), 0)"
    texts = f"transform({chosen}, s -> {stripped})"
    none = "CAST(array() AS ARRAY<STRING>)"
    likely = f"contains({html}, 'ld+') OR contains({html}, 'ld&')"
    return f"if({likely}, filter({texts}, t -> t <> ''), {none})"


def selector_names(*selectors: Sequence) -> str:
    """Pattern that a page or start tag holds when a selector may match in it."""
    words = {c for s in selectors for c in s[1]} | {"<" + s[0] for s in selectors if not s[1]}
    return "(?i)" + "|".join(r"\Q" + w + r"\E" for w in sorted(words))


def elements_by_parent(toks: str, spans: str, wanted: str) -> str:
    """Elements with their classes, siblings next to each other.

    Classes are read only from start tags that hold the pattern ``wanted``.
    """
    token = f"get({toks}, e.pos)"
    classes = M.class_list(M.raw_attribute(token, "class"))
    none = "CAST(array() AS ARRAY<STRING>)"
    fields = struct(
        parent="e.parent", pos="e.pos", end="e.end", tag="e.tag",
        classes=f"if({token} rlike {literal(wanted)}, {classes}, {none})",
    )
    return f"sort_array(transform({spans}, e -> {fields}))"


def elements_in_order(by_parent: str) -> str:
    """Elements in document order, each with the tag and classes of the sibling before."""
    before = f"get({by_parent}, i - 1)"
    near = f"(i > 0 AND {before}.parent = e.parent)"
    fields = struct(
        pos="e.pos", end="e.end", parent="e.parent", tag="e.tag", classes="e.classes",
        prev_tag=f"if({near}, {before}.tag, NULL)",
        prev_classes=f"if({near}, {before}.classes, NULL)",
    )
    return f"sort_array(transform({by_parent}, (e, i) -> {fields}))"


def with_text(elements: str, runs: str) -> str:
    """The same elements with their visible text."""
    text = M.text_between(runs, "e.pos", "e.end")
    return f"transform({elements}, e -> {struct(**fields_of('e', _ELEMENT_FIELDS), text=text)})"


def matches(element: str, selector: Sequence) -> str:
    """Element fits ``(tag, classes)`` or ``(tag, classes, "+", next_tag)``."""
    tag, classes = selector[0], selector[1]
    if len(selector) > 2:
        hits = [f"{element}.tag = '{selector[3]}'", f"{element}.prev_tag = '{tag}'"]
        found = f"{element}.prev_classes"
    else:
        hits, found = [f"{element}.tag = '{tag}'"], f"{element}.classes"
    hits += [f"array_contains({found}, '{c}')" for c in classes]
    return "coalesce(" + " AND ".join(hits) + ", false)"


def matches_any(element: str, selectors: Sequence) -> str:
    return "(" + " OR ".join(matches(element, s) for s in selectors) + ")"


def first_in_order(elements: str, selectors: Sequence) -> str:
    """Text of the first element in document order that any selector matches, else ''."""
    return f"coalesce(get(filter({elements}, e -> {matches_any('e', selectors)}), 0).text, '')"


def first_by_selector(elements: str, selectors: Sequence) -> str:
    """Text by selector order: of each selector only its first element counts."""
    return first_nonblank_sql(
        *[f"get(filter({elements}, e -> {matches('e', s)}), 0).text" for s in selectors]
    )
