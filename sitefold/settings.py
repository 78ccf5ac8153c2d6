"""Word lists, selectors and checked options."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: word lists of the classifiers, matched as substrings -----------

MOBILE_CATEGORY_HINTS = ("mobile", "mobiles", "smartphone", "smart phone", "handset")

EXCLUDE_CATEGORY_HINTS = (
    "mobileprotection", "mobile accessory", "case", "cover", "charger", "cable",
    "earphone", "headphone", "watch", "smartwatch",
)

EXCLUDE_TITLE_HINTS = (
    "back cover", "cover for", "phone case", "tempered glass", "screen guard", "charger",
    "charging cable", "usb cable", "adapter", "earbuds", "neckband", "headphone",
    "smartwatch", "watch strap", "mobile skin", "holder", "tripod",
)

URL_INCLUDE_HINTS = (
    "iphone", "samsung", "galaxy", "motorola", "moto", "vivo", "oppo", "realme", "xiaomi",
    "redmi", "poco", "oneplus", "infinix", "tecno", "iqoo", "nokia", "lava", "itel",
    "honor", "nothing", "pixel", "mobile", "smartphone", "5g",
)

URL_EXCLUDE_HINTS = (
    "back-cover", "mobile-cover", "cover-", "case-", "tempered", "screen-guard", "charger",
    "cable", "adapter", "earphone", "earbud", "headphone", "neckband", "smartwatch",
    "watch", "tripod", "power-bank", "holder", "skin",
)

PHONE_BRAND_HINTS = (
    "iphone", "samsung", "motorola", "moto", "vivo", "oppo", "realme", "xiaomi", "redmi",
    "poco", "oneplus", "infinix", "tecno", "iqoo", "nokia", "lava", "itel", "honor",
    "nothing", "pixel", "hmd",
)

PHONE_TITLE_WORDS = ("smartphone", "mobile phone")
PHONE_FEATURE_WORDS = ("5g", " gb", "ram", "mobile", "smartphone", "iphone", "pixel")

# --- Fixed values: texts of a bot-check page and of a review block ----------------

CHALLENGE_TEXTS = ("recaptcha", "are you a human")
REVIEW_BLOCK_WORDS = ("buyer", "read more", "rating")
REVIEW_BLOCK_MIN_CHARS = 60

# --- Fixed values: HTTP status rules of landed pages ------------------------------

STATUS_OK = 200
STATUS_BLOCKED = 403
STATUS_GONE = 404
STATUS_UNAVAILABLE = (429, 503)
FIRST_ERROR_STATUS = 400

# --- Fixed values: product pages carry this in their path -------------------------

PRODUCT_PATH_MARKER = "/p/"

# --- Fixed values: selectors as (tag, classes); "+" names the element before ------

REVIEW_BLOCKS = (
    ("div", ("col", "EPCmJX")), ("div", ("_1AtVbE",)), ("div", ("_27M-vq",)),
    ("div", ("_16PBlm",)),
)
REVIEW_RATING = (
    ("div", ("XQDdHH",)), ("div", ("_3LWZlK",)), ("div", ("_3LWZlK", "_1BLPMq")),
    ("span", ("XQDdHH",)),
)
REVIEW_TITLE = (
    ("p", ("z9E0IG",)), ("p", ("_2-N8zT",)), ("p", ("_2xg6Ul",)), ("div", ("_6K-7Co",)),
)
REVIEW_TEXT = (
    ("div", ("ZmyHeo",)), ("div", ("t-ZTKy",)), ("div", ("_11pzQk",)),
    ("div", ("_6K-7Co",)),
)
REVIEW_AUTHOR = (("p", ("_2sc7ZR",)), ("span", ("_2sc7ZR",)), ("p", ("_2V5EHH",)))
REVIEW_DATE = (
    ("p", ("_2mcZGG",)), ("p", ("_2NsDsF",)), ("span", ("_2sc7ZR",), "+", "span"),
)
PRODUCT_TITLE = (("span", ("VU-ZEz",)), ("span", ("B_NuCI",)), ("h1", ()))
PRODUCT_RATING = (("div", ("XQDdHH",)), ("div", ("_3LWZlK",)))
PRODUCT_REVIEW_COUNT = (("span", ("Wphh3N",)), ("span", ("_2_R_DZ",)))

# --- Fixed values: columns of the two result tables, in file order ----------------

REVIEW_COLUMNS = (
    "product_id", "product_url", "review_page", "review_id_hash", "rating", "title",
    "review_text", "reviewer", "review_date", "variant", "helpful_count", "scraped_at",
)
PRODUCT_COLUMNS = (
    "product_id", "product_url", "title", "price", "currency", "rating", "review_count",
    "category", "super_category", "sub_category",
)
CATALOG_COLUMNS = PRODUCT_COLUMNS + ("source_sitemap", "sitemap_lastmod", "scraped_at")

REVIEW_FORMATS = ("csv", "jsonl", "both")
DISCOVERY_MODES = ("auto", "search", "sitemap", "seed")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ReviewOptions:
    """Limits and switches of the review job; a limit of None is no limit."""

    max_pages: int | None = None
    seen_stop_threshold: int = 2
    max_empty_pages: int = 1
    fmt: str = "both"
    fail_fast: bool = False

    def __post_init__(self) -> None:
        for name in ("max_pages", "seen_stop_threshold", "max_empty_pages"):
            value = getattr(self, name)
            _require(value is None or value > 0, f"{name} must be greater than 0")
        _require(self.fmt in REVIEW_FORMATS, f"fmt must be one of {REVIEW_FORMATS}")


@dataclass(frozen=True)
class CatalogOptions:
    """Limits and switches of the catalog job; ``domain`` is part of a link's host.

    A limit of None (or ``max_shards`` 0) is no limit.
    """

    domain: str
    discovery_mode: str = "auto"
    search_pages: int | None = None
    seed_max_depth: int | None = None
    max_products: int | None = None
    max_candidates: int | None = None
    max_shards: int | None = None
    loose_url_filter: bool = False
    include_accessories: bool = False
    exact_domain: bool = False
    include_hints: tuple[str, ...] = URL_INCLUDE_HINTS
    exclude_hints: tuple[str, ...] = URL_EXCLUDE_HINTS

    def __post_init__(self) -> None:
        for name in ("max_products", "max_candidates", "search_pages"):
            value = getattr(self, name)
            _require(value is None or value > 0, f"{name} must be greater than 0")
        for name in ("max_shards", "seed_max_depth"):
            value = getattr(self, name)
            _require(value is None or value >= 0, f"{name} must not be negative")
        _require(
            self.discovery_mode in DISCOVERY_MODES,
            f"discovery_mode must be one of {DISCOVERY_MODES}",
        )

    def check_search_urls(self, given: bool) -> None:
        _require(
            given or self.discovery_mode != "search",
            "discovery_mode 'search' needs search pages",
        )
