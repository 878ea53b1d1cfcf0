"""A client of the paged document service, for the driver: category ids, search pages and details as JSON.

It fetches one page at a time and writes each before the next, so it holds no more than a page; parsing is done by Spark
over what was written.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from vellumine.functions import patterns as P

# The service's address, its paths, and its ids of document types and statuses, used where it doesn't tell them.
BASE = "https://vbpl-bientap-gateway.moj.gov.vn/api"
SEARCH, DETAIL, CATEGORIES = "/qtdc/public/doc/all", "/qtdc/public/doc", "/qtdc/public/doc/combobox"
TYPE_GROUP, STATUS_GROUP = "LoaiVanBan", "TrangThaiHieuLuc"
TYPE_IDS = {
    "Bộ luật": "404b68a7-8e71-4ee5-a6c0-07e59f35f824", "Luật": "11025e19-2dd6-4165-85ad-ab6241186a1a",
    "Nghị định": "0d08b84c-7de7-4800-8760-2a68265e7890", "Thông tư": "178c63a9-73ff-4fd4-9d91-18d690520090",
}
STATUS_IDS = {"Còn hiệu lực": "1419f6be-4a15-44a7-97ac-ea042770a514", "Hết hiệu lực một phần": "9c20e89d-e048-4f3a-b6c2-df87fe0b1ada"}
PAGE_SIZE = 100


def over_http(base: str = BASE, timeout: float = 30.0) -> Callable[[str, dict | None, dict | None], dict]:
    """A function (path, query, body) -> JSON; with a body it posts."""

    def ask(path: str, query: dict | None = None, body: dict | None = None) -> dict:
        url = base + path + ("?" + urllib.parse.urlencode(query) if query else "")
        data = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(url, data, {"Accept": "application/json", "Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)

    return ask


@dataclass
class Client:
    """``ask`` does the requests; ``pause`` is slept between two of them."""

    ask: Callable[..., dict] = field(default_factory=over_http)
    pause: float = 0.5
    wait: Callable[[float], None] = time.sleep

    def ids(self, group: str, names: tuple[str, ...], fallback: dict[str, str]) -> list[str]:
        """The service's ids of categories; the known ones where it names none of them or doesn't answer."""
        try:
            body = self.ask(CATEGORIES, {"groupCode": group, "includeInactive": "true"}, None)
            items = (body.get("data") or body).get("items") or []
            said = {" ".join((i.get("name") or "").split()): i.get("id") for i in items}
        except (OSError, ValueError):
            said = {}
        return [said[n] for n in names if said.get(n)] or [fallback[n] for n in names if n in fallback]

    def pages(self, keyword: str, scope: str = "title", types: tuple[str, ...] = P.DOCUMENT_TYPES, statuses: tuple[str, ...] = P.STATUSES) -> Callable[[int], dict]:
        """A function of a page's number for ``registry.api_pages``."""
        fixed = {
            "pageSize": PAGE_SIZE, "sortBy": "issueDate", "sortDirection": "desc", "groupVbpl": True, "agencyLevel": "TRUNG_UONG",
            "docType": self.ids(TYPE_GROUP, types, TYPE_IDS), "effStatus": self.ids(STATUS_GROUP, statuses, STATUS_IDS),
        }
        words = {"keyword": keyword, "documentName": keyword, "optionDoc": "title", "matchMode": "all_words"} if scope == "title" else {"keywordQuickSearch": keyword}

        def fetch(page: int) -> dict:
            if page > 1:
                self.wait(self.pause)
            return self.ask(SEARCH, None, {k: v for k, v in (fixed | words | {"pageNumber": page}).items() if v})

        return fetch

    def details(self, ids: Iterator[str]) -> Iterator[dict]:
        """One page of a single item a document, and none for those that fail: the registry then notes the error."""
        for i in ids:
            try:
                body = self.ask(f"{DETAIL}/{urllib.parse.quote(i)}", None, None)
            except (OSError, ValueError):
                continue
            item = body.get("data") or body
            yield {"items": [item | {"id": item.get("id") or i}], "total": 1}
            self.wait(self.pause)
