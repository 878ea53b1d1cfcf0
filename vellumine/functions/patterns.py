"""Fixed values of the legal text grammar: patterns, names, word lists and answers. Results depend on them as they stand."""

from __future__ import annotations

import re

# Patterns of headings.
CHAPTER = re.compile(r"^Chương\s+[IVXLCDM]+\b.*", re.I)
SECTION = re.compile(r"^Mục\s+\d+[a-zA-Z]?\b.*", re.I)
ARTICLE = re.compile(r"^Điều\s+\d+[a-zA-Z]?\.\s+.*", re.I)
CLAUSE_NUMBER = re.compile(r"^(\d{1,3})\.(?:\s+(.+)|\s*)$")
CLAUSE_WORD = re.compile(r"^Khoản\s+(\d{1,3})(?:\.\s*(.*)|\s*)$", re.I)
RULE_LINE = re.compile(r"^-{3,}$")
ARTICLE_HEADING = re.compile(r"^###\s+Điều\s+([\w]+)\.?\s*(.*)$", re.I)
CLAUSE_HEADING = re.compile(r"^####\s+Khoản\s+([\w]+)\.?\s*(.*)$", re.I)
LEGACY_UNIT = re.compile(r"^(?P<num>(?:[IVXLCDM]+|\d+|[a-zA-Z]))[\.)]\s+.+")
LEGAL_HEADER = r"(?ium)^#{1,6}\s+(?:Chương|Mục|Điều|Khoản)\b"
COMMENT_LINE = r"(?m)^\s*<!--.*?-->\s*$"

# Patterns of citations.
NUMBER = r"[0-9]{1,4}/[0-9]{4}/[A-ZĐ][A-Z0-9Đ/-]*"
KIND_AND_NUMBER = r"(?:Bộ luật|Luật|Nghị định|Thông tư|Quyết định)?\s*(?:số\s*)?"
DOC_NUMBER = re.compile(rf"\b{KIND_AND_NUMBER}({NUMBER})", re.I)
NAMED_LAW = re.compile(r"\b((?:Bộ luật|Luật)\s+[A-ZÀ-Ỹ][^.;,\n()]{2,120}?)(?=(?:\s+ngày|\s+năm|[.;,\n)]|$))", re.I)
BASED_ON = re.compile(r"^\s*Căn cứ\s+(.+)", re.I)
UNIT = r"(?:(?:điểm)\s+([a-zđ])\s+)?(?:(?:khoản)\s+(\d+[a-z]?)\s+)?Điều\s+"
ARTICLE_REF = re.compile(UNIT + r"(\d+[a-z]?)", re.I)
THIS_ARTICLE_REF = re.compile(UNIT + "này", re.I)
POINT_REF = re.compile(r"điểm\s+([a-zđ])\s+khoản\s+(\d+[a-z]?)\s+Điều\s+(\d+[a-z]?)", re.I)
AMENDMENT = re.compile(
    r"(?P<op>Sửa đổi,\s*bổ sung|Sửa đổi|Bổ sung|Bãi bỏ|Thay thế|Hết hiệu lực)"
    r"\s+(?P<target>[^:\n.]{0,180}?Điều\s+\d+[a-z]?|[^:\n.]{0,180}?khoản\s+\d+[a-z]?\s+Điều\s+\d+[a-z]?|[^:\n.]{0,180}?điểm\s+[a-zđ]\s+khoản\s+\d+[a-z]?\s+Điều\s+\d+[a-z]?|Điều\s+\d+[a-z]?)",
    re.I,
)
SUPPLEMENT_INTO = re.compile(r"(?P<op>Bổ sung)\s+khoản\s+(?P<clause>\d+[a-z]?)\s+vào\s+Điều\s+(?P<article>\d+[a-z]?)", re.I)
GUIDE_HINT = re.compile(r"\b(hướng dẫn|quy định chi tiết|thi hành)\b", re.I)
AMENDMENT_WORDS = r"(?:Sửa đổi|Bổ sung|Bãi bỏ|Thay thế|Hết hiệu lực)"
AMENDMENT_HINT = re.compile(r"\b(sửa đổi|bổ sung|bãi bỏ|thay thế|hết hiệu lực)\b", re.I)
THIS_DOCUMENT = re.compile(r"\b(văn bản này|thông tư này|nghị định này|luật này|bộ luật này|điều này|khoản này)\b", re.I)
AMENDED_BEFORE = re.compile(r"\b(sửa đổi|bổ sung|thay thế|bãi bỏ|vào)\b", re.I)
LINE_LEAD = re.compile(r"^[\s\"“”'.,;:-]+")
ANCHOR_NUMBER = rf"{KIND_AND_NUMBER}(?P<doc_number>{NUMBER})"
ANCHOR_UNIT = r"(?:(?:khoản)\s+(?P<clause>\d+[a-z]?)\s+)?Điều\s+(?P<article>\d+[a-z]?)"
ANCHOR_GAP = r"(?P<between>[^.;\n]{0,160}?)"
CITED_CLAUSE = re.compile(r"\bKhoản\s+\d+[a-z]?\s+Điều\s+\d+[a-z]?\b", re.I)
CITED_ARTICLE = re.compile(r"\bĐiều\s+\d+[a-z]?\b", re.I)
CITED_DOCUMENT = re.compile(rf"\b(?:Bộ luật|Luật|Nghị định|Thông tư|Quyết định)\s+(?:số\s*)?{NUMBER}", re.I)

# Relations, statuses, types and lists.
RELATIONS = ("AMENDS", "BASED_ON", "CITES", "DETAILS", "GUIDES", "REFERS_TO", "REPEALS", "REPLACES", "SUPPLEMENTS")
GENERIC_LAWS = ("phap luat", "phap luat viet nam", "luat viet nam", "luat quoc te", "luat nuoc so tai", "luat cua nuoc so tai")
DOCUMENT_TYPES = ("Bộ luật", "Luật", "Nghị định", "Thông tư")
STATUSES = ("Còn hiệu lực", "Hết hiệu lực một phần")
STEM_STOPS = ("bo", "luat", "nghi", "dinh", "thong", "tu", "quyet", "huong", "dan", "quy", "chi", "tiet")
LEGAL_MARKERS = ("Điều", "Chương", "Căn cứ", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM")
UNANSWERABLE = "Không trả lời được"
NO_ANSWER = "Xin lỗi, dựa trên dữ liệu luật pháp tôi đang có, tôi không tìm thấy quy định cụ thể về vấn đề bạn đang hỏi."
DETAIL_LABELS = {
    "Số hiệu": "so_ky_hieu", "Số ký hiệu": "so_ky_hieu", "Loại văn bản": "document_type", "Cơ quan ban hành": "co_quan_ban_hanh", "Người ký": "nguoi_ky",
    "Ngày ban hành": "ngay_ban_hanh", "Ngày có hiệu lực": "ngay_hieu_luc", "Ngày hiệu lực": "ngay_hieu_luc", "Ngày hết hiệu lực": "ngay_het_hieu_luc", "Tình trạng hiệu lực": "status",
}
DOCUMENT_KEYS = (
    "document_id", "source_url", "title", "document_type", "status", "doc_number", "issuing_agency", "issue_date", "effective_date", "expiry_date", "crawled_at", "updated_at",
    "markdown_path", "content_sha256",
)
CHUNK_SIZE, CHUNK_OVERLAP, SEPARATORS = 1000, 200, ("\n\n", "\n", ".", " ", "")
DEFAULT_SOURCE, GRAPH_SOURCE, DEFAULT_SLUG = "Tai lieu noi bo", "Neo4j graph", "vbpl-document"
PUBLIC_URL = "https://vbpl.vn/van-ban/"
