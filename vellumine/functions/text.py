"""Scalar text functions as columns. Only Unicode normalisation needs Python; all else is built in.

Empty and null are the same to callers: these functions return an empty string where there is nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions import patterns as P

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Text) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def first_of(*columns: Text) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


@cache
def _normal(form: str):
    make: Callable[[str], str] = (lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()) if form == "ascii" else (lambda s: unicodedata.normalize(form, s))

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v if v.isascii() else make(v) for v in values.to_pylist()], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())


def normal_form(c: Text, form: str = "NFC") -> Column:
    """Unicode normal form NFC, NFKC or NFKD, or ``ascii`` (NFKD without what isn't ASCII)."""
    return _normal(form)(col(c))


def normalize_space(c: Text) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def normalize_citation(c: Text) -> Column:
    """NFC, collapsed and lower case: how citations and contexts are compared."""
    return F.lower(normalize_space(normal_form(c, "NFC")))


def ref_key(c: Text) -> Column:
    return F.regexp_replace(F.lower(F.trim(normal_form(text(c), "NFKC"))), r"(?U)\s+", " ")


def ascii_key(c: Text) -> Column:
    """Folded to ASCII; the letter đ has no decomposition and disappears."""
    return F.lower(normalize_space(normal_form(text(c), "ascii")))


def search_key(c: Text) -> Column:
    """Folded to ASCII with đ as d, for keyword search."""
    return normalize_space(F.lower(normal_form(F.translate(text(c), "đĐ", "dD"), "ascii")))


def contains_keyword(c: Text, keyword: Text) -> Column:
    key = search_key(keyword)
    return (key != "") & F.contains(search_key(c), key)


def slug(title: Text, number: Text | None = None) -> Column:
    raw = text(title) if number is None else F.when(text(number) != "", F.concat(text(number), F.lit("-"), text(title))).otherwise(text(title))
    folded = F.lower(normal_form(F.translate(raw, "đĐ", "dD"), "ascii"))
    return first_of(F.substring(F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-")), 1, 140), F.lit(P.DEFAULT_SLUG))


def doc_number(c: Text) -> Column:
    return F.upper(F.regexp_replace(text(c), r"(?U)\s+", ""))


def api_date(c: Text) -> Column:
    """ISO dates as dd/mm/yyyy, anything else collapsed."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?s).*"
    return F.when(text(c).rlike(iso), F.regexp_replace(text(c), iso, "$3/$2/$1")).otherwise(normalize_space(c))


def day(c: Text) -> Column:
    """dd/mm/yyyy text as a date, null if it is none; order by this, not by the text."""
    return F.try_to_date(col(c), "dd/MM/yyyy")


def found(c: Text, pattern: str, group: int = 1) -> Column:
    """A group of the first match, regardless of case; empty if there is none."""
    return F.coalesce(F.regexp_extract(text(c), f"(?iuU){pattern}", group), F.lit(""))


_DATE = r"(\d{1,2}/\d{1,2}/\d{4})"


def metadata_from_text(c: Text) -> Column:
    """Dates and number that a page's text names, as a struct."""
    either = lambda a, b: first_of(found(c, rf"(?:{a}\s*:?\s*{_DATE}|{b}\s*:?\s*{_DATE})", 1), found(c, rf"(?:{a}\s*:?\s*{_DATE}|{b}\s*:?\s*{_DATE})", 2))
    return F.struct(
        either("Ngày ban hành", "Ban hành").alias("ngay_ban_hanh"),
        either("Ngày hiệu lực", "Hiệu lực").alias("ngay_hieu_luc"),
        found(c, rf"Ngày hết hiệu lực\s*:?\s*{_DATE}").alias("ngay_het_hieu_luc"),
        found(c, r"\b(?:Bộ luật|Luật|Nghị định|Thông tư)\s+(?:số\s+)?([^,\s]+/\d{4}/[A-ZĐ0-9-]+|Không số)").alias("so_ky_hieu"),
    )


def detail_metadata(c: Text) -> Column:
    """The values after a detail page's labels (later labels win), over ``metadata_from_text``."""
    collapsed, out = normalize_space(c), {}
    base = metadata_from_text(collapsed)
    for label, key in P.DETAIL_LABELS.items():
        value = F.regexp_extract(collapsed, rf"(?U){label}\s*:?\s*([^|]+?)(?=\s+[A-ZĐÂĂÊÔƠƯ][^:]+:|$)", 1)
        out[key] = first_of(normalize_space(value), out.get(key, base[key] if key in ("ngay_ban_hanh", "ngay_hieu_luc", "ngay_het_hieu_luc", "so_ky_hieu") else F.lit("")))
    return F.struct(*[v.alias(k) for k, v in out.items()])


def infer_status(c: Text, statuses: tuple[str, ...] = P.STATUSES) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(text(c)), F.lit(s.lower())), F.lit(s)) for s in statuses], F.lit(""))


def infer_type(c: Text, types: tuple[str, ...] = P.DOCUMENT_TYPES) -> Column:
    """The longest type that stands between blanks."""
    return F.coalesce(*[F.when(normalize_space(c).rlike(rf"(?iuU)(^|\s){t}(\s|$)"), F.lit(t)) for t in sorted(types, key=len, reverse=True)], F.lit(""))


def infer_title(c: Text, types: tuple[str, ...] = P.DOCUMENT_TYPES) -> Column:
    return first_of(*[normalize_space(F.regexp_extract(text(c), rf"(?U){t}\s+.+?(?=\s+Trạng thái|\s+Ngày ban hành|$)", 0)) for t in types])


def item_id(url: Text) -> Column:
    return F.coalesce(F.regexp_extract(text(url), r"[?&]ItemID=([^&#]+)", 1), F.lit(""))


def detail_url(url: Text) -> Column:
    """Of a detail page's address only the item stays; other addresses stay as they are."""
    head = F.regexp_replace(F.regexp_extract(text(url), r"^[^?#]*", 0), "vbpq-thuoctinh\\.aspx", "vbpq-toanvan.aspx")
    return F.when(item_id(url) != "", F.concat(head, F.lit("?ItemID="), item_id(url), F.regexp_extract(text(url), "#.*$", 0))).otherwise(text(url))


def id_from_url(url: Text) -> Column:
    path = F.regexp_replace(F.regexp_extract(text(url), r"^(?:[a-zA-Z][\w+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(item_id(url) != "", item_id(url))
        .when(F.contains(last, F.lit("--")), F.element_at(F.split(last, "--"), -1))
        .when(last.rlike(r"^(?:[0-9a-fA-F-]{16,}|\d+)$"), last)
        .otherwise("")
    )


def public_url(document_id: Text, title: Text, category: str = "trung-uong") -> Column:
    return F.concat(F.lit(f"{P.PUBLIC_URL}{category}/"), slug(title), F.lit("--"), text(document_id))


def dedupe_key(number: Text, title: Text) -> Column:
    return F.lower(normalize_space(F.concat(text(number), F.lit("|"), text(title))))


def source_display(c: Text) -> Column:
    """A path's last part."""
    value = F.trim(text(c))
    return F.when(value == "", F.lit(P.DEFAULT_SOURCE)).otherwise(first_of(F.element_at(F.split(F.replace(value, F.lit("\\"), F.lit("/")), "/"), -1), value))


def number_from_source(c: Text) -> Column:
    """The document number that a file's name spells: up to four code words before the title begins."""
    stem = F.lower(F.regexp_replace(source_display(c), r"(?<=.)\.[^.]*$", ""))
    shape = r"^(\d{1,4})-(\d{4})-([a-z0-9-]+)"
    words = F.split(F.regexp_extract(stem, shape, 3), "-")
    stops = F.transform(words, lambda w, i: (i > 0) & w.isin(*P.STEM_STOPS))
    first = F.coalesce(F.nullif(F.array_position(stops, F.lit(True)).cast("int"), F.lit(0)) - 1, F.size(words))
    code = F.upper(F.array_join(F.slice(words, F.lit(1), F.least(first, F.lit(4))), "-"))
    return F.when(stem.rlike(shape), F.concat_ws("/", F.regexp_extract(stem, shape, 1), F.regexp_extract(stem, shape, 2), code)).otherwise("")


def heading_number(c: Text) -> Column:
    return found(c, r"\b(?:Điều|Dieu|Khoản|Khoan)\s+(\d+[a-z]?)\b")


def compact(c: Text, size: int = 1200) -> Column:
    """At most ``size`` characters, cut at a blank unless that loses over half."""
    whole = normalize_space(c)
    head = F.substring(whole, 1, size)
    blank = F.lit(size) - F.instr(F.reverse(head), " ")  # of the last blank
    at = F.when((F.instr(head, " ") == 0) | (blank < size // 2), F.lit(size)).otherwise(blank)
    return F.when(F.length(whole) <= size, whole).otherwise(F.concat(F.rtrim(F.substring(whole, F.lit(1), at)), F.lit("...")))


def quoted_replacement(c: Text) -> Column:
    """What stands between the first and the last quotation mark, at most 5000 characters."""
    return F.substring(F.regexp_replace(F.regexp_extract(text(c), "(?s)[\"“](.+)[\"”]", 1), r"(?U)^\s+|\s+$", ""), 1, 5000)


def source_span(source: Text, evidence: Text) -> Column:
    """``Lx-Ly``: the lines of the evidence's first occurrence, empty if it doesn't occur."""
    at = F.position(text(evidence), text(source))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    first = lines(F.substring(text(source), F.lit(1), at - 1)) + 1
    return F.when((text(evidence) == "") | (at == 0), F.lit("")).otherwise(F.concat(F.lit("L"), first, F.lit("-L"), first + lines(text(evidence))))


def operation(c: Text) -> Column:
    """What an amendment's words do: repeal, replace, supplement or amend."""
    low = F.lower(text(c))
    has = lambda s: F.contains(low, F.lit(s))
    return (
        F.when(has("bãi bỏ") | has("hết hiệu lực"), F.lit("repeal")).when(has("thay thế"), F.lit("replace"))
        .when(has("bổ sung") & ~has("sửa đổi"), F.lit("supplement")).otherwise(F.lit("amend"))
    )


#: The relation of an operation.
RELATION_OF = {"amend": "AMENDS", "supplement": "SUPPLEMENTS", "repeal": "REPEALS", "replace": "REPLACES"}


def relation_of(op: Text) -> Column:
    low = F.lower(text(op))
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in RELATION_OF.items()], F.lit("AMENDS"))


def relation_type(c: Text) -> Column:
    return relation_of(operation(c))


def article_number(c: Text) -> Column:
    """The leading number of an article's number, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text(c), r"^(\d+)", 1).try_cast("int"), F.lit(0))


def article_exceeds(number: Text, largest: Column) -> Column:
    n = article_number(number)
    return (n > 0) & (largest > 0) & (n > largest)


def is_generic_law(c: Text) -> Column:
    key = ascii_key(c)
    out = F.lit(False)
    for g in P.GENERIC_LAWS:
        out = out | F.contains(key, F.lit(g))
    return out


def looks_legal(c: Text) -> Column:
    value = normalize_space(c)
    out = F.lit(False)
    for m in P.LEGAL_MARKERS:
        out = out | F.contains(value, F.lit(m))
    return (F.length(value) >= 50) & out


def strip_comment_lines(c: Text) -> Column:
    return F.btrim(F.regexp_replace(text(c), P.COMMENT_LINE, ""), F.lit(" \t\n\r\x0b\x0c"))


def strip_preamble(c: Text) -> Column:
    """From the first legal heading on; all of it if there is none."""
    body = F.regexp_extract(text(c), f"(?sU)({P.LEGAL_HEADER}.*)", 1)
    return F.btrim(F.when(body != "", body).otherwise(text(c)), F.lit(" \t\n\r\x0b\x0c"))


def strip_markdown(c: Text) -> Column:
    """Without comments and heading marks."""
    return F.regexp_replace(F.regexp_replace(text(c), "(?s)<!--.*?-->", ""), r"(?m)^#{1,6}\s+", "")


LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def lines(c: Text) -> Column:
    return F.split(text(c), LINE_END)


def relevant_lines(c: Text) -> Column:
    """Collapsed lines of eight characters or more."""
    return F.filter(F.transform(lines(c), normalize_space), lambda x: F.length(x) >= 8)


def strip_code_fence(c: Text) -> Column:
    body = F.regexp_replace(F.btrim(text(c), F.lit(" \t\n\r")), r"^```[^\n]*\n?", "")
    fenced = F.btrim(F.regexp_replace(body, r"\n?```[^\n]*$", ""), F.lit(" \t\n\r"))
    return F.when(F.startswith(F.btrim(text(c), F.lit(" \t\n\r")), F.lit("```")), fenced).otherwise(F.btrim(text(c), F.lit(" \t\n\r")))


def string_list(c: Text) -> Column:
    """A JSON list of strings, else the text as the only one."""
    return F.coalesce(F.from_json(text(c), "array<string>"), F.array(text(c)))


def table_width(rows: Text) -> Column:
    return F.coalesce(F.array_max(F.transform(col(rows), F.size)), F.lit(0))


def padded(rows: Text) -> Column:
    """Rows of a table, all as long as the longest."""
    width = table_width(rows)
    return F.transform(col(rows), lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
