"""Page operators: JSON-LD documents, reviews, products, links and elements.

Input pages carry ``html``; any other column rides along. Each operator adds
columns row by row and drops ``html`` before anything can shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold import settings as S
from sitefold.functions import jsonld as J
from sitefold.functions import markup as M
from sitefold.functions import pages as P
from sitefold.functions import text as X
from sitefold.functions.classify import classify_product, is_product_link
from sitefold.functions.urls import (
    canonical_product_url,
    extract_product_id,
    resolve_parts,
    surrogate_id,
    url_parts,
)

REVIEW_FIELDS = (
    "rating", "title", "review_text", "reviewer", "review_date", "variant", "helpful_count",
)
_REVIEWS = (
    "ARRAY<STRUCT<rating: INT, title: STRING, review_text: STRING, reviewer: STRING,"
    " review_date: STRING, variant: STRING, helpful_count: INT>>"
)
_NO_REVIEWS = f"CAST(array() AS {_REVIEWS})"


def _keep(df: DataFrame, *dropped: str) -> list[str]:
    return [c for c in df.columns if c not in dropped and not c.startswith("_")]


def staged(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns computed exactly once per row.

    The one-row generator keeps the optimizer from inlining a step into the next one;
    nested array functions would otherwise be evaluated many times over.
    """
    return df.selectExpr("*", f"inline(array({P.struct(**columns)}))")


def nested(result: str, **steps: str) -> str:
    """``result`` over steps that each may use those before, in one expression.

    The one-item arrays name a step as ``staged`` does, but no row is copied between them. For
    short steps only: the analyzer needs some rounds for every level.
    """
    for name, step in reversed(steps.items()):
        result = f"get(transform(array({step}), {name} -> {result}), 0)"
    return result


# --- JSON-LD ----------------------------------------------------------------------


def jsonld_documents(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD script that parses: ``script_no``, ``document`` (JSON text)."""
    texts = f"posexplode({P.jsonld_texts('html')}) AS (script_no, document)"
    found = pages.selectExpr(*_keep(pages, "html"), texts)
    return found.filter(f"size({J.parse_items('document')}) = 1")


def _with_texts(df: DataFrame, likely: str) -> DataFrame:
    """Adds ``_texts``, the JSON-LD texts that may hold the word."""
    # The word may be spelled with \\u escapes; no other text can hold it.
    has_word = f"contains(t, '{likely}') OR contains(t, {X.literal('\\u')})"
    return staged(df, _texts=f"filter({P.jsonld_texts('html')}, t -> {has_word})")


def _documents(texts: str) -> str:
    """The values of the texts that parse."""
    items = f"transform({texts}, t -> {J.parse_items('t')})"
    return f"transform(filter({items}, x -> size(x) = 1), x -> get(x, 0))"


def _with_json_reviews(df: DataFrame) -> DataFrame:
    """Adds ``_json``: reviews of the JSON-LD documents in document order.

    Each step has one use, so they are one expression and no row is copied between them.
    """
    df = _with_texts(df, "Review")
    depth = f"array_max(transform(_texts, t -> {J.nesting('t')}))"
    nodes = J.all_objects(_documents("_texts"), f"coalesce({depth}, 1)")
    entries = P.struct(path="n.path", es=J.members_of("n.object"))
    found = f"filter(transform({nodes}, n -> {entries}), n -> {J.has_type('n.es', 'Review')})"
    values = f"transform({found}, n -> {J.review_parts('n')})"
    rows = f"sort_array(transform({values}, p -> {P.struct(path='p.path', **J.review_fields('p'))}))"
    return staged(df, _json=f"if(size(_texts) > 0, {_reviews(rows)}, {_NO_REVIEWS})")


def _reviews(rows: str) -> str:
    """Rows cut down to the review fields; no rows for null."""
    fields = P.struct(**P.fields_of("r", REVIEW_FIELDS))
    return f"coalesce(CAST(transform({rows}, r -> {fields}) AS {_REVIEWS}), {_NO_REVIEWS})"


# --- HTML reviews -----------------------------------------------------------------

_REVIEW_PARTS = (
    S.REVIEW_RATING + S.REVIEW_TITLE + S.REVIEW_TEXT + S.REVIEW_AUTHOR + S.REVIEW_DATE
)


def _with_marks(df: DataFrame, when: str, selectors: tuple) -> DataFrame:
    """Adds ``_marks``: elements the selectors match, with text; null unless ``when``."""
    names = P.selector_names(*selectors)
    df = staged(
        df, _toks=f"if({when} AND html rlike {X.literal(names)}, {M.tokens('html')}, NULL)"
    )
    df = staged(df, _tags=M.tags("_toks"))
    df = staged(df, _spans=M.spans("_tags", "size(_toks)"))
    level = P.elements_by_parent("_toks", "_spans", names)
    hits = f"filter({P.elements_in_order('_level')}, e -> {P.matches_any('e', selectors)})"
    df = staged(df, _hits=nested(hits, _level=level))
    df = staged(df, _runs=f"if(size(_hits) > 0, {M.text_runs('_toks')}, NULL)")
    return staged(df, _marks=P.with_text("_hits", "_runs"))


def _block_parts(b: str) -> str:
    """What the selectors find inside a review block."""
    inner, blob = f"{b}.inner", f"{b}.blob"
    return P.struct(
        pos=f"{b}.pos",
        blob=blob,
        rating=P.first_by_selector(inner, S.REVIEW_RATING),
        title=P.first_by_selector(inner, S.REVIEW_TITLE),
        text=X.first_nonblank_sql(P.first_by_selector(inner, S.REVIEW_TEXT), blob),
        reviewer=P.first_by_selector(inner, S.REVIEW_AUTHOR),
        date=X.first_nonblank_sql(
            P.first_by_selector(inner, S.REVIEW_DATE), X.date_in_text_sql(blob)
        ),
    )


def _block_review(p: str) -> str:
    """Review of a block; what no selector found is read from its text."""
    blob = f"{p}.blob"
    guess_date = f"{p}.date = '' AND {p}.reviewer = ''"
    return P.struct(
        pos=f"{p}.pos",
        rating=f"coalesce({X.to_int_sql(f'{p}.rating')}, {X.rating_in_text_sql(blob)})",
        title=f"{p}.title",
        review_text=f"{p}.text",
        reviewer=X.first_nonblank_sql(f"{p}.reviewer", X.name_before_date_sql(blob)),
        review_date=f"if({guess_date}, {X.date_after_name_sql(blob)}, {p}.date)",
        variant=X.variant_in_text_sql(blob),
        helpful_count=X.helpful_in_text_sql(blob),
    )


def _is_review_block(text: str) -> str:
    words = " OR ".join(f"contains(lower({text}), '{w}')" for w in S.REVIEW_BLOCK_WORDS)
    return f"length({text}) >= {S.REVIEW_BLOCK_MIN_CHARS} AND ({words})"


def _with_html_reviews(df: DataFrame, when: str) -> DataFrame:
    """Adds ``_html``: reviews of the markup blocks, first of equal keys per page."""
    has_block = f"html rlike {X.literal(P.selector_names(*S.REVIEW_BLOCKS))}"
    df = _with_marks(df, f"{when} AND {has_block}", S.REVIEW_BLOCKS + _REVIEW_PARTS)
    is_block = f"{P.matches_any('e', S.REVIEW_BLOCKS)} AND {_is_review_block('e.text')}"
    block = P.struct(
        pos="b.pos", blob="b.text", inner="filter(_marks, e -> e.pos > b.pos AND e.pos < b.end)"
    )
    blocks = f"transform(filter(_marks, e -> {is_block}), b -> {block})"
    parts = f"transform({blocks}, b -> {_block_parts('b')})"
    placed = P.fields_of("r", ("pos",) + REVIEW_FIELDS)
    key = X.in_page_review_key_sql("r.reviewer", "r.review_date", "r.title", "r.review_text")
    # Equal keys stand next to each other after the sort, the first in the page first.
    rows = f"transform({parts}, p -> {_block_review('p')})"
    keyed = f"sort_array(transform({rows}, r -> {P.struct(key=key, **placed)}))"
    firsts = "filter(_keyed, (r, i) -> i = 0 OR get(_keyed, i - 1).key <> r.key)"
    ordered = f"sort_array(transform({firsts}, r -> {P.struct(**placed)}))"
    df = staged(df, _keyed=keyed)
    return staged(df, _html=_reviews(ordered))


def _explode_reviews(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    rows = df.selectExpr(*keep, f"posexplode({column}) AS (pos, _r)")
    return rows.selectExpr(*keep, "pos", "_r.*")


def jsonld_reviews(pages: DataFrame) -> DataFrame:
    """One row per Review object in JSON-LD, ``pos`` in document order."""
    return _explode_reviews(_with_json_reviews(pages), _keep(pages, "html"), "_json")


def html_reviews(pages: DataFrame) -> DataFrame:
    """One row per review read from markup, ``pos`` in document order."""
    return _explode_reviews(_with_html_reviews(pages, "true"), _keep(pages, "html"), "_html")


def review_lists(pages: DataFrame) -> DataFrame:
    """One row per page with ``reviews``: JSON-LD rows if any, else markup rows."""
    df = _with_html_reviews(_with_json_reviews(pages), "size(_json) = 0")
    chosen = "if(size(_json) > 0, _json, _html) AS reviews"
    return df.selectExpr(*_keep(pages, "html"), chosen)


def explode_reviews(lists: DataFrame) -> DataFrame:
    """Rows of ``review_lists`` with ``pos``."""
    return _explode_reviews(lists, _keep(lists, "reviews"), "reviews")


def page_reviews(pages: DataFrame) -> DataFrame:
    return explode_reviews(review_lists(pages))


# --- products ---------------------------------------------------------------------

_PAGE_TITLE = (("title", ()),)
_JSON_FIELDS = ("title", "category", "price", "currency", "rating", "review_count")


def _with_json_product(df: DataFrame) -> DataFrame:
    """Adds ``_json``: text fields of the first top-level Product object, or blanks."""
    df = _with_texts(df, "Product")
    df = staged(df, _docs=_documents("_texts"))
    tops = f"if({J.is_array('d')}, {J.items('d')}, array(d))"
    df = staged(df, _tops=f"flatten(transform(_docs, d -> {tops}))")
    df = staged(df, _nodes=f"transform(_tops, d -> {J.members('d')})")
    df = staged(df, _es=f"get(filter(_nodes, es -> {J.is_type('es', 'Product')}), 0)")
    offers, stars = (J.members(J.member("_es", k)) for k in ("offers", "aggregateRating"))
    df = staged(
        df,
        _v_title=J.member("_es", "name"),
        _v_category=J.member("_es", "category"),
        _v_price=J.member(offers, "price"),
        _v_currency=J.member(offers, "priceCurrency"),
        _v_rating=J.member(stars, "ratingValue"),
        _v_review_count=J.member(stars, "reviewCount"),
    )
    texts = {f: X.normalize_space_sql(J.text_of(f"_v_{f}")) for f in _JSON_FIELDS}
    return staged(df, _json=P.struct(**texts))


def canonical_href(html: str) -> str:
    """href of the first canonical link of a page, as written; '' when there is none."""
    rel = f"split({M.raw_attribute('t', 'rel')}, {X.literal(r'\s+')})"
    is_link = f"t rlike {X.literal(r'(?i)^<link[\s/]')} AND array_contains({rel}, 'canonical')"
    first = f"get(filter({M.start_tags(html)}, t -> {is_link}), 0)"
    href = f"coalesce({M.raw_attribute(first, 'href')}, '')"
    return f"if(contains({html}, 'canonical'), {href}, '')"


def products(pages: DataFrame, source_url: str = "request_url") -> DataFrame:
    """One row per page: the ten product columns and ``is_mobile``."""
    keep = [c for c in _keep(pages, "html") if c not in S.PRODUCT_COLUMNS]
    df = _with_json_product(pages)
    blank = "(_json.title = '' OR _json.rating = '' OR _json.review_count = '')"
    df = _with_marks(
        df, blank, S.PRODUCT_TITLE + S.PRODUCT_RATING + S.PRODUCT_REVIEW_COUNT + _PAGE_TITLE
    )
    df = staged(df, _href=canonical_href("html"))
    df = staged(df, _href_text=M.unescape("_href"))
    html, shown = F.col("html"), _shown_texts()
    url = F.when(
        F.col("_href_text") != "", canonical_product_url(F.col("_href_text"))
    ).otherwise(F.col(source_url))
    df = df.select(
        *keep,
        url.alias("product_url"),
        F.expr(X.first_nonblank_sql("_json.title", *shown["title"])).alias("title"),
        F.expr("_json.price").alias("price"),
        F.expr("_json.currency").alias("currency"),
        F.expr(X.first_nonblank_sql("_json.rating", *shown["rating"])).alias("rating"),
        F.col("_json.review_count").alias("_json_count"),
        F.expr(shown["review_count"][0]).alias("_count_text"),
        X.first_nonblank(F.col("_json.category"), X.first_match(html, "category")).alias("category"),
        X.first_match(html, "superCategory").alias("super_category"),
        X.first_match(html, "subCategory").alias("sub_category"),
        X.first_match(html, "productId").alias("_page_id"),
    )
    named = ("title", "category", "super_category", "sub_category")
    return df.select(
        *keep,
        F.coalesce(
            X.blank_to_null(extract_product_id(F.col("product_url"))),
            X.blank_to_null(F.col("_page_id")),
            surrogate_id(F.col("product_url")),
        ).alias("product_id"),
        "product_url",
        *("title", "price", "currency", "rating"),
        X.first_nonblank(F.col("_json_count"), X.count_in_text(F.col("_count_text"))).alias(
            "review_count"
        ),
        *("category", "super_category", "sub_category"),
        classify_product(*[F.col(c) for c in named]).alias("is_mobile"),
    )


def _shown_texts() -> dict[str, list[str]]:
    """Texts that the markup shows, by column, in order of preference."""
    return {
        "title": [P.first_in_order("_marks", s) for s in (S.PRODUCT_TITLE, _PAGE_TITLE)],
        "rating": [P.first_in_order("_marks", S.PRODUCT_RATING)],
        "review_count": [P.first_in_order("_marks", S.PRODUCT_REVIEW_COUNT)],
    }


# --- links ------------------------------------------------------------------------


def page_hrefs(pages: DataFrame, marker: str = S.PRODUCT_PATH_MARKER) -> DataFrame:
    """One row per page with ``hrefs``: distinct link texts that hold the marker."""
    anchors = f"filter({M.start_tags('html')}, t -> t rlike {X.literal(r'(?i)^<a[\s/]')})"
    # An entity may hide the marker, so pages with numeric entities are read too.
    likely = f"contains(html, {X.literal(marker)}) OR contains(html, '&#')"
    df = staged(pages, _anchors=f"if({likely}, {anchors}, CAST(array() AS ARRAY<STRING>))")
    df = staged(df, _hrefs=M.attribute_list("_anchors", "href"))
    marked = f"filter(_hrefs, h -> contains(h, {X.literal(marker)}))"
    trimmed = f"transform({marked}, h -> {X.normalize_space_sql('h')})"
    return df.selectExpr(*_keep(pages, "html"), f"array_distinct({trimmed}) AS hrefs")


def resolve_links(
    hrefs: DataFrame,
    domain: str,
    marker: str = S.PRODUCT_PATH_MARKER,
    exact_domain: bool = False,
    base_url: str = "final_url",
) -> DataFrame:
    """One row per page and product link on the site, canonical, as ``link``.

    Row by row in generated code; two link texts of a page may lead to one link.
    """
    keep = _keep(hrefs, "hrefs")
    rows = hrefs.withColumn("_base", url_parts(F.col(base_url))).select(
        *keep, "_base", F.explode("hrefs").alias("_href")
    )
    rows = rows.withColumn("_parts", url_parts(F.col("_href")))
    full = resolve_parts(F.col("_base"), F.col("_parts"), F.col("_href"))
    # One-item explodes, see ``staged``: a filter on the link must not repeat its making.
    rows = rows.select(*keep, F.explode(F.array(full)).alias("_full"))
    link = canonical_product_url(F.col("_full"))
    rows = rows.select(*keep, F.explode(F.array(link)).alias("link"))
    return rows.filter(is_product_link(F.col("link"), domain, marker, exact_domain))


def product_links(
    pages: DataFrame, domain: str, marker: str = S.PRODUCT_PATH_MARKER, **options
) -> DataFrame:
    """Distinct product links of each page; their order is that of the text."""
    return resolve_links(page_hrefs(pages, marker), domain, marker, **options).distinct()


# --- elements ---------------------------------------------------------------------


_CLASS = "coalesce(attrs['class'], '')"


def _with_spans(df: DataFrame) -> DataFrame:
    """Adds what ``M.span`` reads, from ``_toks``; a step for each value, as large pages have large ones."""
    for name, step in {**M.tag_steps("_toks"), **M.span_steps("size(_toks)")}.items():
        df = staged(df, **{name: step})
    return df


def elements(pages: DataFrame) -> DataFrame:
    """One row per HTML element: ``node_id``, ``end_id``, ``parent_id``, tag, attributes.

    ``x`` lies inside ``b`` iff ``x.node_id > b.node_id AND x.node_id < b.end_id``.
    """
    keep = _keep(pages, "html")
    df = _with_spans(staged(pages, _toks=M.tokens("html")))
    for name, step in M.row_steps("_toks").items():
        df = staged(df, **{name: step})
    columns = ("node_id", "end_id", "parent_id", "tag")
    rows = df.selectExpr(*keep, M.span_rows()).selectExpr(*keep, *M.span_columns(*columns[:3]), "_token")
    # A script or style is one token with its content; only its start tag has attributes.
    start = f"if(tag IN ({X.literals(M.RAW_TAGS)}), {M.open_tag('_token')}, _token)"
    # No generator here: who asks for no attributes does not have them read.
    names = "transform(_read, a -> a.k)"
    last = f"filter(_read, (a, i) -> NOT array_contains(slice({names}, i + 2, size(_read)), a.k))"
    attrs = nested(f"map_from_entries({last})", _start=start, _read=M.attributes("_start"))
    rows = rows.selectExpr(*keep, *columns, f"{attrs} AS attrs")
    return rows.selectExpr(
        *keep, *columns, f"{M.class_list(_CLASS)} AS classes", "attrs"
    )
