"""The grammar of legal citations in one text: plain functions, used by Arrow functions over many texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from vellumine.functions import patterns as P

OPENING, CLOSING = ('"', "“", "‘"), ('"', "”", "’")


def quote_edge_in_source(line: str) -> str:
    """How a stripped line of a source text opens or closes a quotation; punctuation may follow the closing mark."""
    opens, closes = line.startswith(OPENING), line.rstrip(".,;:").endswith(CLOSING)
    if opens:
        return "single" if len(line) > 1 and (closes or any(c in line[1:] for c in CLOSING)) else "open"
    return "close" if closes else "none"


def quote_edge_in_markdown(line: str) -> str:
    """The same for a stripped line of normalised Markdown, where only first and last characters count."""
    opens, closes = line.startswith(OPENING), line.endswith(CLOSING)
    if opens:
        return "single" if closes and len(line) > 1 else "open"
    return "close" if closes else "none"


def is_heading(line: str) -> bool:
    return any(p.match(line) for p in (P.CHAPTER, P.SECTION, P.ARTICLE, P.CLAUSE_NUMBER, P.CLAUSE_WORD))


def number(value: str | None) -> str:
    return re.sub(r"\s+", "", value or "").upper()


def space(value: str | None) -> str:
    return re.sub(r"\s+", " ", value or "").strip()


def leading_int(value: str | None) -> int:
    m = re.match(r"\d+", value or "")
    return int(m[0]) if m else 0


def numbers(text: str | None) -> Iterator[str]:
    return (number(m[1]) for m in P.DOC_NUMBER.finditer(text or ""))


def other_number(text: str | None, own: str) -> str:
    """The first document number in the text that isn't the document's own."""
    own = number(own)
    return next((n for n in numbers(text) if n and n != own), "")


def named_laws(text: str) -> list[str]:
    """Laws called by name, without those whose name holds a number."""
    names = (space(m[1]).strip(" ,.;") for m in P.NAMED_LAW.finditer(text))
    return list(dict.fromkeys(n for n in names if not P.DOC_NUMBER.search(n)))


def target_hint(title: str, own: str) -> tuple[str, str]:
    """What an article's title says it is about: another document's number, else a law's name."""
    n = other_number(title, own)
    return (n, "") if n else ("", next(iter(named_laws(title)), ""))


def line_refs(line: str) -> list[tuple[str, str]]:
    """(number, name) of the documents that a line mentions."""
    return list(dict.fromkeys([*((n, "") for n in numbers(line)), *(("", law) for law in named_laws(line))]))


def evidence(text: str, a: int, b: int) -> str:
    return space(text[max(0, a - 80) : b + 120])[:500]


@lru_cache(1024)
def _amends(line: str) -> bool:
    lead = P.LINE_LEAD.sub("", line)
    return bool(P.SUPPLEMENT_INTO.match(lead) or P.AMENDMENT.match(lead))


def in_amendment(text: str, a: int, b: int) -> bool:
    """Whether the line around a mention is itself an amendment."""
    end = text.find("\n", b)
    return _amends(text[text.rfind("\n", 0, a) + 1 : len(text) if end < 0 else end].strip())


# Scope, confidence and reason of each way to resolve a reference.
EXTERNAL = ("external_document", 0.92, "A document number appears in the same local phrase as the article/clause reference.")
INHERITED = ("external_document", 0.88, "The reference is in an amendment target phrase and inherits the target document from the parent context.")
MARKED = ("same_document", 0.9, "The local phrase uses a current-document marker such as 'Thông tư này' or 'Nghị định này'.")
BEYOND = ("ambiguous_external", 0.45, "The referenced article number exceeds the source document's max article number, so it is not resolved to the current document.")
PLAIN = ("same_document", 0.8, "No nearby external document marker was found and the article number fits the source document.")
THIS_ARTICLE = ("same_document", 0.95, "The reference uses 'Điều này', so it resolves to the current article.")
NAMED = ("external_document", 0.75, "Named legal document mention detected in the source clause.")
FROM_PARENT = "Target document is inherited from the article/document amendment context."
FROM_NEAREST = "Target document is resolved from the nearest external document number."


def resolve(text: str, a: int, b: int, article: str, own: str, hint: str, largest: int) -> tuple[tuple, str]:
    """The way a reference resolves and the number of the document it points to."""
    near = next((number(m[1]) for part in (text[b : b + 180], text[max(0, a - 120) : a]) if (m := P.DOC_NUMBER.search(part))), "")
    if near:
        return EXTERNAL, near
    if hint and P.AMENDED_BEFORE.search(text[max(0, a - 80) : a]):
        return INHERITED, hint
    if P.THIS_DOCUMENT.search(text[max(0, a - 120) : b + 180]):
        return MARKED, own
    if largest and leading_int(article) > largest:
        return BEYOND, ""
    return PLAIN, own


def references(text: str, own: str, article: str, hint: str, largest: int) -> list[dict]:
    """All mentions of units and laws in a clause, with their offsets (0 for laws)."""
    out = []

    def add(at: int, raw: str, kind: str, way: tuple, target: str, unit: tuple[str, str, str] = ("", "", ""), law: str = "", why: str = "") -> None:
        scope, confidence, reason = way
        out.append({
            "at": at, "raw_text": raw, "ref_type": kind, "scope": scope, "target_document_number": target, "target_article_no": unit[0], "target_clause_no": unit[1],
            "target_point": unit[2].lower(), "target_title_hint": law, "confidence": confidence, "evidence_text": why, "resolution_reason": reason,
        })

    for pattern in (P.ARTICLE_REF, P.THIS_ARTICLE_REF):
        for m in pattern.finditer(text):
            if in_amendment(text, m.start(), m.end()):
                continue
            point, clause = m[1] or "", m[2] or ""
            this = pattern is P.THIS_ARTICLE_REF
            to = article if this else m[3]
            way, target = (THIS_ARTICLE, own) if this else resolve(text, m.start(), m.end(), to, own, hint, largest)
            add(m.start(), m[0], "point" if point else "clause" if clause else "article", way, target, (to, clause, point), why=evidence(text, m.start(), m.end()))
    for law in named_laws(text):
        add(0, law, "external_document", NAMED, "", law=law, why=law)
    return out


def target_unit(text: str) -> tuple[str, str, str]:
    """(point, clause, article) that an amendment aims at."""
    m = P.POINT_REF.search(text) or P.ARTICLE_REF.search(text)
    return ((m[1] or "").lower(), m[2] or "", m[3] or "") if m else ("", "", "")


def amendments(text: str, own: str, hint: str, title: str) -> list[dict]:
    """The amendments that a clause's lines begin with."""
    out = []
    for line in text.splitlines():
        lead = P.LINE_LEAD.sub("", line.strip())
        into = P.SUPPLEMENT_INTO.match(lead)
        m = into or P.AMENDMENT.match(lead)
        if not m:
            continue
        point, clause, article = ("", into["clause"], into["article"]) if into else target_unit(m["target"])
        out.append({
            "raw_text": m[0], "operation_text": "bổ sung" if into else m["op"].lower(), "target_article_no": article, "target_clause_no": clause, "target_point": point,
            "resolution_reason": FROM_PARENT if into or hint else FROM_NEAREST,
        })
    target = (hint or other_number(title, own) or other_number(text, own)) if out else ""
    return [x | {"target_document_number": target} for x in out]


def relations(lines: list[str], own: str) -> list[dict]:
    """(kind of hint, line, number, name) of documents mentioned in collapsed lines beside a relation's words."""
    out = []
    for line in lines:
        if P.BASED_ON.match(line):
            kinds = ["based_on"]
        else:
            kinds = [k for k, p in (("amendment", P.AMENDMENT_HINT), ("guide", P.GUIDE_HINT)) if p.search(line)]
        if kinds:
            refs = [r for r in line_refs(line) if r[0] != own]
            out += [{"hint": k, "raw_text": line, "target_document_number": n, "target_title_hint": t} for k in kinds for n, t in refs]
    return out


_UNIT_THEN_NUMBER = re.compile(P.ANCHOR_UNIT + P.ANCHOR_GAP + P.ANCHOR_NUMBER, re.I)
_NUMBER_THEN_UNIT = re.compile(P.ANCHOR_NUMBER + P.ANCHOR_GAP + P.ANCHOR_UNIT, re.I)
_NUMBER_ALONE = re.compile(P.ANCHOR_NUMBER, re.I)


def anchors(query: str | None) -> list[dict]:
    """The documents and units that a question names, in order, each once."""
    query = query or ""
    spans = [(m.start(), m.end(), m) for p in (_UNIT_THEN_NUMBER, _NUMBER_THEN_UNIT) for m in p.finditer(query)]
    alone = [(m.start(), m.end(), m) for m in _NUMBER_ALONE.finditer(query)]
    spans += [s for s in alone if not any(a <= s[0] and s[1] <= b for a, b, _ in spans)]
    out: dict[tuple, dict] = {}
    for _, _, m in sorted(spans, key=lambda s: s[0]):
        g = m.groupdict()
        key = (number(g["doc_number"]), (g.get("article") or "").lower(), (g.get("clause") or "").lower())
        out.setdefault(key, dict(zip(("raw_text", "doc_number", "article_no", "clause_no"), (space(m[0]), *key), strict=True)))
    return list(out.values())


def citations(text: str | None) -> list[str]:
    """The units and documents that an answer cites, in order; equal ones (Unicode form, letter case and blanks aside) once."""
    text = text or ""
    taken = [(m.start(), m.end(), m[0]) for p in (P.CITED_CLAUSE, P.CITED_DOCUMENT) for m in p.finditer(text)]
    bare = [(m.start(), m.end(), m[0]) for m in P.CITED_ARTICLE.finditer(text)]
    every = taken + [s for s in bare if not any(a <= s[0] and s[1] <= b for a, b, _ in taken)]
    out: dict[str, str] = {}
    for _, _, raw in sorted(every, key=lambda s: s[0]):
        out.setdefault(unicodedata.normalize("NFC", space(raw)).lower(), space(raw))
    return list(out.values())
