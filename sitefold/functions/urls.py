"""URL expressions: split, query strings, canonical forms, ids, link resolution.

The splitting rules are lenient: any text splits into scheme, host, path, query
and fragment, and nothing raises.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitefold.functions.text import blank_to_null, find, let, strip

# Query keys and key prefixes that only track visits. Keys are
# compared in lower case, so the mixed-case entries never match.
TRACKING_KEYS = ("iid", "ppt", "ppn", "ssid", "qH", "requestId", "suggestionId", "fm")
TRACKING_PREFIXES = ("otracker", "as")

# Query keys a review page URL keeps.
REVIEW_URL_KEYS = ("pid", "lid", "marketplace", "page")

# Fixed value: id given to products whose URL holds none.
UNKNOWN_ID = "UNKNOWN"

# Schemes whose URLs have a host part, ``;params`` and relative links.
WEB_SCHEMES = ("", "http", "https", "ftp", "sftp")

# No query key twice, lower-case scheme, plain host and path, plain keys with values that need no escape.
_CANONICAL = (
    r"^(?!.*[?&](KEYS)=.*&\1=)https?://[A-Za-z0-9.:-]++(?:/[A-Za-z0-9._~/-]*+)?+"
    r"(?:\?(?:KEYS)=[A-Za-z0-9._-]++(?:&(?:KEYS)=[A-Za-z0-9._-]++)*+)?+\z"
)
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_HOST = r"(?://[^/?#]*)?"


def _clean(url: Column) -> Column:
    """Drop control characters in front, and tabs and line ends anywhere."""
    return F.regexp_replace(url, F.lit(r"^[\x00-\x20]+|[\t\r\n]"), F.lit(""))


def _with_scheme(url: Column) -> Column:
    return F.when(scheme_of(url) == "", F.concat(F.lit("https://"), url)).otherwise(url)


def scheme_of(url: Column) -> Column:
    return F.lower(find(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host_of(url: Column) -> Column:
    """Host with user and port, as written."""
    return find(url, _SCHEME + r"//([^/?#]*)", 1)


def full_path_of(url: Column) -> Column:
    """Path with a possible ``;params`` tail."""
    return find(url, _SCHEME + _HOST + r"([^?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path without ``;params`` of its last segment."""
    whole = full_path_of(url)
    return F.when(
        url.contains(";") & scheme_of(url).isin(*WEB_SCHEMES),
        F.regexp_replace(whole, F.lit(r";[^/]*\z"), F.lit("")),
    ).otherwise(whole)


def query_of(url: Column) -> Column:
    return find(url, _SCHEME + _HOST + r"[^?#]*\?([^#]*)", 1)


def join_url(scheme: Column, host: Column, path: Column, query: Column | None = None) -> Column:
    """Put URL parts together again. Each part is worked out once."""
    parts = F.struct(
        scheme.alias("scheme"),
        host.alias("host"),
        path.alias("path"),
        (F.lit("") if query is None else query).alias("query"),
    )
    return let(parts, lambda p: _joined(p["scheme"], p["host"], p["path"], p["query"]))


def _joined(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(
        path
    )
    hostless_root = scheme.isin(*WEB_SCHEMES[1:]) & ((path == "") | path.startswith("/"))
    body = (
        F.when(host != "", F.concat(F.lit("//"), host, rooted))
        .when(path.startswith("//") | hostless_root, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    head = F.when(scheme == "", body).otherwise(F.concat(scheme, F.lit(":"), body))
    return F.when(query != "", F.concat(head, F.lit("?"), query)).otherwise(head)


# --- query strings: ordered ARRAY<STRUCT<k, v>> -----------------------------------

_PAIRS = "array<struct<k:string,v:string>>"


def _decode(text: Column) -> Column:
    """``text`` is written several times, so it should be cheap. Most texts hold no escape."""
    decoded = F.url_decode(F.regexp_replace(text, F.lit("%(?![0-9A-Fa-f]{2})"), F.lit("%25")))
    return F.when(text.contains("%") | text.contains("+"), decoded).otherwise(text)


def _encode(text: Column) -> Column:
    """``text`` is written several times, so it should be cheap. Most texts need no escape."""
    encoded = F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~"))
    escaped = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.when(text.rlike(r"^[A-Za-z0-9._-]*+\z"), text).otherwise(escaped)


def parse_query(query: Column) -> Column:
    """Pairs in order; pairs without '=' or value go, the first value of a key wins."""
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=[^&]"))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.substr(p, F.instr(p, F.lit("=")) + 1)).alias("v"),
        ),
    )
    return let(
        pairs,
        lambda ps: F.filter(
            ps,
            lambda p, i: F.array_position(ps["k"], p["k"]) == i + 1,
        ),
    )


def encode_query(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def query_value(pairs: Column, key: str) -> Column:
    """Value of ``key`` or null."""
    return F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"]


def set_query_values(pairs: Column, **values: Column) -> Column:
    """Replace keys in place, or append them; null values change nothing."""

    def put(ps: Column) -> Column:
        def replaced(p: Column) -> Column:
            value = p["v"]
            for key, new in values.items():
                value = F.when((p["k"] == key) & new.isNotNull(), new).otherwise(value)
            return F.struct(p["k"].alias("k"), value.alias("v"))

        appended = [
            F.when(
                new.isNotNull() & ~F.array_contains(ps["k"], key),
                F.array(F.struct(F.lit(key).alias("k"), new.alias("v"))),
            ).otherwise(F.array().cast(_PAIRS))
            for key, new in values.items()
        ]
        return F.concat(F.transform(ps, replaced), *appended)

    return let(pairs, put)


def _query_id(url: Column) -> Column:
    """The decoded ``pid`` value, or null; URLs without 'pid', or with a plain one in front, skip the parse."""
    query = query_of(url)
    return let(
        query,
        lambda q: F.coalesce(
            blank_to_null(find(q, r"^pid=([A-Za-z0-9._-]++)(?:&|\z)", 1)),
            F.when(q.rlike("p|%"), query_value(parse_query(q), "pid")),
        ),
    )


# --- canonical forms --------------------------------------------------------------


def canonicalize_url(
    url: Column,
    tracking_keys: Iterable[str] = TRACKING_KEYS,
    tracking_prefixes: Iterable[str] = TRACKING_PREFIXES,
) -> Column:
    """Product URL without tracking keys, params and fragment; host case stays."""
    keys, prefixes = list(tracking_keys), tuple(tracking_prefixes)
    # One pattern tells URLs that are canonical as they stand, if they have no other query key.
    own = "|".join(k for k in REVIEW_URL_KEYS if k not in keys and not k.startswith(prefixes)) or r"(?!)"
    canonical = _CANONICAL.replace("KEYS", own)

    def kept(pair: Column) -> Column:
        low = F.lower(pair["k"])
        drop = low.isin(*keys) if keys else F.lit(False)
        for p in prefixes:
            drop = drop | low.startswith(p)
        return ~drop

    def build(u: Column) -> Column:
        query = query_of(u)
        cleaned = F.when(query == "", F.lit("")).otherwise(
            encode_query(F.filter(parse_query(query), kept))
        )
        return join_url(scheme_of(u), host_of(u), path_of(u), cleaned)

    return F.when(url.rlike(canonical), url).otherwise(let(_with_scheme(_clean(strip(url))), build))


def canonical_product_url(url: Column) -> Column:
    """https, lower-case host, no '/hi/' locale, no closing '/', no query."""

    def build(u: Column) -> Column:
        path = F.regexp_replace(path_of(u), F.lit("^/hi/"), F.lit("/"))
        path = F.when(path == "", F.lit("/")).otherwise(
            F.regexp_replace(path, F.lit(r"(?<!^)/+\z|^/{2,}\z"), F.lit(""))
        )
        return join_url(F.lit("https"), F.lower(host_of(u)), path)

    return let(_clean(strip(url)), build)


def _path_code(path: Column) -> Column:
    """First code in a path, or null."""
    return let(find(path, r"(?U)\b([A-Z0-9]{10,20})\b", 1), blank_to_null)


def extract_pid(url: Column) -> Column:
    """Review-side id: ``pid`` value, else a code in the path, else UNKNOWN."""
    u = _clean(url)
    return F.coalesce(_query_id(u), _path_code(path_of(u)), F.lit(UNKNOWN_ID))


def _id_in_path(url: Column, path: Column) -> Column:
    segment = find(path, r"/p/([^/?#]+)", 1)
    code = find(url, r"(?U)\b([A-Z0-9]{10,20})\b", 1)
    return F.coalesce(blank_to_null(segment), code)


def extract_product_id(url: Column) -> Column:
    """Catalog-side id: ``pid`` value, else segment after /p/, else a code, else ''."""
    u = _clean(url)
    return F.coalesce(_query_id(u), _id_in_path(url, path_of(u)))


def canonical_product_id(url: Column) -> Column:
    """The same for a canonical product URL, which has neither query nor params."""
    return _id_in_path(url, full_path_of(url))


def surrogate_id(url: Column) -> Column:
    """Id of last resort: 20 hex digits of the URL's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 20)


def to_review_url(url: Column, page: Column) -> Column:
    """URL of review page ``page`` of a product.

    Only four query keys stay, none of them a tracking key, so the query is read
    once from the URL as given. A ``pid`` it holds stays, else the code in the path is put there.
    """

    def build(u: Column) -> Column:
        path = path_of(u)
        review_path = F.when(
            ~path.contains("/product-reviews/"),
            F.regexp_replace(path, F.lit(r"^((?:(?!/p/)[\s\S])*+)/p/"), F.lit("$1/product-reviews/")),
        ).otherwise(path)
        query = let(parse_query(query_of(u)), lambda pairs: query_text(pairs, path))
        return join_url(scheme_of(u), host_of(u), review_path, query)

    def query_text(pairs: Column, path: Column) -> Column:
        # The code is looked for only where no pid is given.
        code = F.when(~F.array_contains(pairs["k"], "pid"), _path_code(path))
        kept = F.filter(pairs, lambda p: p["k"].isin(*REVIEW_URL_KEYS))
        values = F.struct(code.alias("pid"), page.cast("string").alias("page"))
        return let(values, lambda v: encode_query(set_query_values(kept, pid=v["pid"], page=v["page"])))

    return let(_with_scheme(_clean(strip(url))), build)


def with_page_param(url: Column, page: Column) -> Column:
    """Search URL for result page ``page``."""

    def build(u: Column) -> Column:
        scheme = F.coalesce(blank_to_null(scheme_of(u)), F.lit("https"))
        pairs = set_query_values(parse_query(query_of(u)), page=page.cast("string"))
        return join_url(scheme, host_of(u), path_of(u), encode_query(pairs))

    return let(_clean(url), build)


# --- links ------------------------------------------------------------------------


def _merge_paths(base: Column, path: Column) -> Column:
    """Path of a relative link, dot segments resolved."""
    folder = F.regexp_replace(base, F.lit(r"[^/]+\z"), F.lit(""))
    relative = let(
        F.split(F.concat(F.when(base == "", F.lit("/")).otherwise(folder), path), "/"),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (i == F.size(s) - 1) | (x != "")),
    )
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda out, s: F.when(s == ".", out)
        .when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
        .otherwise(F.concat(out, F.array(s))),
    )
    closing = F.when(path.rlike(r"(^|/)\.{1,2}\z"), F.array(F.lit(""))).otherwise(empty)
    merged = F.array_join(F.concat(kept, closing), "/")
    return F.when(merged == "", F.lit("/")).otherwise(merged)


def url_parts(url: Column) -> Column:
    """STRUCT<scheme, host, path, params, query> of a cleaned URL."""
    return let(
        _clean(url),
        lambda u: F.struct(
            scheme_of(u).alias("scheme"),
            host_of(u).alias("host"),
            path_of(u).alias("path"),
            find(full_path_of(u), r"(;[^/]*)\z", 1).alias("params"),
            query_of(u).alias("query"),
            find(u, r"(#.+)", 1).alias("fragment"),
        ),
    )


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute URL of a link found on page ``base``."""
    both = F.struct(url_parts(base).alias("b"), url_parts(href).alias("h"))
    return F.when(href == "", base).when(base == "", href).otherwise(
        let(both, lambda x: resolve_parts(x["b"], x["h"], href))
    )


def resolve_parts(b: Column, h: Column, href: Column) -> Column:
    """The same from split URLs, so a page splits its own URL only once."""

    def build(t: Column) -> Column:
        joined = join_url(t["scheme"], t["host"], t["path"], t["query"])
        other_kind = (t["scheme"] != b["scheme"]) | ~t["scheme"].isin(*WEB_SCHEMES)
        return F.when(other_kind, _clean(href)).otherwise(F.concat(joined, h["fragment"]))

    here = (h["path"] == "") & (h["params"] == "") & (h["host"] == "")
    path = (
        F.when(h["host"] != "", F.concat(h["path"], h["params"]))
        .when(here, F.concat(b["path"], b["params"]))
        .otherwise(F.concat(_merge_paths(b["path"], h["path"]), h["params"]))
    )
    target = F.struct(
        F.coalesce(blank_to_null(h["scheme"]), b["scheme"]).alias("scheme"),
        F.coalesce(blank_to_null(h["host"]), b["host"]).alias("host"),
        path.alias("path"),
        F.when(here & (h["query"] == ""), b["query"]).otherwise(h["query"]).alias("query"),
    )
    return let(target, build)
