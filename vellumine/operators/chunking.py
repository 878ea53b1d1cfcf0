"""From Markdown to legal units and chunks.

Headings are normalised once per document; the structure parser then yields articles and clauses, and clause texts are
split into overlapping chunks. Quotation state and running headings make these per-document scans, so they are Arrow
functions over whole texts; everything around them is built in. Line numbers count from the whole file.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions import patterns as P
from vellumine.functions import text as X
from vellumine.operators import grammar as G

ARTICLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "document_id", "article_no", "title", "unit_type", "structural_path")]
    + [T.StructField(n, T.IntegerType()) for n in ("source_start_line", "source_end_line")]
    + [T.StructField("extraction_method", T.StringType())]
)
CLAUSE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "document_id", "article_no", "clause_no", "text", "title", "chunk_id", "markdown_path")]
    + [T.StructField("occurrence", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("unit_type", "structural_path")]
    + [T.StructField(n, T.IntegerType()) for n in ("source_start_line", "source_end_line")]
    + [T.StructField("extraction_method", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("quote_state", T.StringType())]
    + [T.StructField("contains_quoted_replacement", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("target_document_number_hint", "target_title_hint", "unit_source")]
)


ROWS = 64  # of a batch that are Python values at a time
PARTS = 256  # rows that Python takes in and gives out at a time where results are long


def arrow(kind: T.DataType):
    """Decorator: a function of one row's Python values as an Arrow scalar function; few rows at a time are Python values."""
    inner = T_to_arrow(kind)

    def wrap(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(*columns: pa.Array) -> pa.Array:
            parts = [pa.array([f(*row) for row in zip(*[c.slice(i, ROWS).to_pylist() for c in columns], strict=True)], inner) for i in range(0, len(columns[0]), ROWS)]
            return pa.concat_arrays(parts) if parts else pa.array([], inner)

        source = f"def call({', '.join(names)}): return run({', '.join(names)})"
        space = {"run": run}
        exec(source, space)  # noqa: S102 - Spark reads the arguments from the signature
        space["call"].__annotations__ = dict.fromkeys((*names, "return"), pa.Array)
        return F.arrow_udf(space["call"], kind)

    return wrap


def with_parts(rows: DataFrame, given: dict[str, T.DataType], inputs: tuple[str, ...], f: Callable[..., tuple]) -> DataFrame:
    """``rows`` with the columns ``given``, which ``f`` makes of the values of ``inputs``. Python passes them on ``PARTS`` rows at a
    time, so that it never holds the results of a whole batch."""
    rows = rows.drop(*given)
    kinds = {n: T_to_arrow(k) for n, k in given.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PARTS):
                part = b.slice(i, PARTS)
                made = [f(*row) for row in zip(*[part.column(c).to_pylist() for c in inputs], strict=True)]
                more = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *kinds])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in given.items())]))


def T_to_arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type of a Spark type, for the few types used here."""
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, T_to_arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(T_to_arrow(kind.elementType))
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind.simpleString()]


def digest(value: str) -> str:
    return hashlib.sha1(value.encode()).hexdigest()


def normalize(text: str | None) -> str:
    """Legal headings as Markdown headings: chapters #, sections ##, articles ###, clauses ####; quotations stay as they are."""
    rows = [re.sub(r"^\s*#+\s*", "", x).replace("**", "").rstrip() for x in (text or "").splitlines()]
    out: list[str] = []
    inside, quoted, skip = False, False, -1  # an article, a quotation, the line up to which a chapter's title was taken
    for n, row in enumerate(rows):
        if n <= skip:
            continue
        bare = row.strip()
        edge = G.quote_edge_in_source(bare)
        if not bare:
            out.append(row)
        elif quoted:
            out.append(row)
            quoted = not (edge in ("close", "single") or bare in {'"', "“", "”", "‘", "’"})
        elif edge == "open":
            out.append(row)
            quoted = True
        elif P.CHAPTER.match(bare):
            title_at = next((k for k in range(n + 1, len(rows)) if rows[k].strip()), None)
            title = rows[title_at].strip() if title_at is not None else ""
            if title and not G.is_heading(title) and not P.RULE_LINE.match(title):
                out.append(f"# {bare} - {title}")
                skip = title_at
            else:
                out.append(f"# {bare}")
            inside = False
        elif P.SECTION.match(bare):
            out.append(f"## {bare}")
            inside = False
        elif P.ARTICLE.match(bare):
            out.append(f"### {bare}")
            inside = True
        elif inside and (m := P.CLAUSE_WORD.match(bare) or P.CLAUSE_NUMBER.match(bare)):
            out += [f"#### Khoản {m[1]}", *([m[2]] if m[2] else [])]
        else:
            out.append(row)
    return "\n".join(out)


@dataclass
class Open:
    """A clause that is being read."""

    no: str
    title: str
    start: int
    lines: list[str] = field(default_factory=list)
    quoted: bool = False


def structure(text: str, document_id: str, number: str, title: str, path: str) -> dict:
    """Articles and clauses of a normalised text, by headings or, without any, by enumeration marks."""
    articles: dict[str, dict] = {}
    clauses: list[dict] = []
    seen: dict[tuple[str, str], int] = {}
    rows = text.splitlines()
    article, hint, clause, quoted = "", ("", ""), None, False

    def close(end: int) -> None:
        body = "\n".join(x.rstrip() for x in clause.lines).strip() if clause and article else ""
        if not body:
            return
        n = seen[article, clause.no] = seen.get((article, clause.no), 0) + 1
        clauses.append(_clause(
            document_id, article, clause.no, n, body, clause.title, path, clause.start, end, "article_intro" if clause.no == "0" else "clause",
            f"article:{article}/clause:{clause.no}", 1.0, clause.quoted, hint,
        ))

    for n, row in enumerate(rows, 1):
        line = row.strip()
        edge = G.quote_edge_in_markdown(line)
        if clause and edge in ("open", "single"):
            clause.quoted = True
        quoted = quoted or edge == "open"
        heading = None if quoted else P.ARTICLE_HEADING.match(line)
        if heading:
            close(n - 1)
            article, name = heading[1], heading[2].strip()
            hint = G.target_hint(name, number)
            key = f"{document_id}:a{article}"
            articles.setdefault(key, {
                "id": key, "document_id": document_id, "article_no": article, "title": name, "unit_type": "article", "structural_path": f"article:{article}",
                "source_start_line": n, "source_end_line": n, "extraction_method": "rule",
            })
            clause = Open("0", "Article heading", n, [name]) if P.AMENDMENT_HINT.search(name) else None
            continue
        heading = P.CLAUSE_HEADING.match(line) if article and not quoted else None
        if heading:
            close(n - 1)
            clause = Open(heading[1], heading[2].strip(), n)
            continue
        if article and not clause and line:
            clause = Open("0", "Article intro", n)
        if clause:
            clause.lines.append(row)
        if edge == "close":
            quoted = False
    close(len(rows))
    if not articles and not clauses:
        return _unheaded(rows, document_id, title, path)
    return {"articles": list(articles.values()), "clauses": clauses}


def _clause(document_id, article, no, occurrence, body, title, path, start, end, unit_type, place, confidence, quoted, hint) -> dict:
    key = f"{document_id}:a{article}:c{no}" + (f":o{occurrence}" if occurrence > 1 else "")
    return {
        "id": key, "document_id": document_id, "article_no": article, "clause_no": no, "text": body, "title": title, "chunk_id": digest(key), "markdown_path": path,
        "occurrence": occurrence, "unit_type": unit_type, "structural_path": place, "source_start_line": start, "source_end_line": end, "extraction_method": "rule",
        "confidence": confidence, "quote_state": "inside_quote" if quoted else "outside_quote", "contains_quoted_replacement": quoted,
        "target_document_number_hint": hint[0], "target_title_hint": hint[1], "unit_source": "main_text",
    }


def _unheaded(rows: list[str], document_id: str, title: str, path: str) -> dict:
    """Units of a text without headings: they begin at marks like ``IV.``, ``3)`` or ``a)``."""
    if not any(r.strip() for r in rows):
        return {"articles": [], "clauses": []}
    article, clauses = "legacy-1", []
    cuts = [n for n, r in enumerate(rows) if n and P.LEGACY_UNIT.match(r.strip())]
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        body = "\n".join(r.rstrip() for r in rows[a:b] if r.strip()).strip()
        if not body:
            continue
        m = P.LEGACY_UNIT.match(rows[a].strip()) if a else None
        no = m["num"] if m else "1"
        start = a + 1 if m else 1 + next(k for k in range(a, b) if rows[k].strip())
        clauses.append(_clause(document_id, article, no, len(clauses) + 1, body, f"Legacy unit {no}", path, start, b, "legacy_clause", f"legacy:1/unit:{no}", 0.7, False, ("", "")))
    whole = {
        "id": f"{document_id}:a{article}", "document_id": document_id, "article_no": article, "title": title or "Legacy legal units", "unit_type": "legacy_document",
        "structural_path": "legacy:1", "source_start_line": 1, "source_end_line": len(rows), "extraction_method": "rule",
    }
    return {"articles": [whole], "clauses": clauses}


def split(text: str | None, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP, separators: tuple[str, ...] = P.SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters that overlap by up to ``overlap``, cut at the coarsest separator that helps."""
    text = text or ""
    k = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark, finer = separators[k], separators[k + 1 :] if separators[k] else ()
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in (head, *(mark + t for t in tail)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []
    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        out += _windows(run, size, overlap)
        run = []
        out += split(p, size, overlap, finer) if finer else [p]
    return out + _windows(run, size, overlap)


def _windows(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Consecutive pieces joined up to ``size``; each window begins with the last pieces of the one before."""
    out: list[str] = []
    window: deque[str] = deque()
    n = 0
    for p in pieces:
        if n + len(p) > size and window:
            out.append("".join(window).strip())
            while n > overlap or (n and n + len(p) > size):
                n -= len(window.popleft())
        window.append(p)
        n += len(p)
    return [w for w in [*out, "".join(window).strip()] if w]


HEADERS = (("####", "Khoan"), ("###", "Dieu"), ("##", "Muc"), ("#", "Chuong"))


def by_headers(text: str | None, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> list[dict]:
    """Chunks of the text under each heading, with the headings above it."""
    sections: list[tuple[dict, list[str]]] = [({}, [])]
    above: dict[str, str] = {}
    fence = ""
    for row in (text or "").split("\n"):
        line = "".join(c for c in row.strip() if c.isprintable())
        if fence:
            fence = "" if line.startswith(fence) else fence
        elif line.startswith(("```", "~~~")):
            fence = line[:3] if line.count(line[:3]) == 1 else ""
        else:
            name = next((n for m, n in HEADERS if line == m or line.startswith(m + " ")), None)
            if name:
                order = [n for _, n in reversed(HEADERS)]
                above = {n: above[n] for n in order[: order.index(name)] if n in above} | {name: line.lstrip("#").strip()}
                sections.append((dict(above), []))
                continue
        if line or sections[-1][1]:
            sections[-1][1].append(line)
    out = []
    for names, rows in sections:
        for part in split("\n".join(r for r in rows if r), size, overlap):
            out.append({**dict.fromkeys((n for _, n in HEADERS), ""), **names, "content": part})
    return out


SECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("Chuong", "Muc", "Dieu", "Khoan", "content")])


def split_text(c: X.Text, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP):
    """The recursive splitter as a column of arrays."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    return arrow(T.ArrayType(T.StringType()))(lambda text: split(text, size, overlap))(X.col(c))


def split_headers(c: X.Text, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP):
    return arrow(T.ArrayType(SECTION))(lambda text: by_headers(text, size, overlap))(X.col(c))


def document_key():
    """The id of a document: its own, else its address, path or title's digest."""
    return X.first_of("document_id", "source_url", "markdown_path", F.sha1(X.first_of("title", F.lit("document"))))


def parsed(documents: DataFrame) -> DataFrame:
    """``documents`` (content and document columns) with ``normalized``, ``articles`` and ``clauses``; parsed once for all uses."""
    have = set(documents.columns)
    documents = documents.select(*documents.columns, *[F.lit("").alias(k) for k in P.DOCUMENT_KEYS if k not in have])
    number = X.doc_number(F.col("doc_number"))
    out = documents.withColumn("document_id", document_key()).withColumn("doc_number", number)

    def parse(content: str | None, *own: str | None) -> tuple:
        text = normalize(content)
        units = structure(text, *(x or "" for x in own))
        return text, units["articles"], units["clauses"]

    kinds = {"normalized": T.StringType(), "articles": T.ArrayType(ARTICLE), "clauses": T.ArrayType(CLAUSE)}
    return with_parts(out, kinds, ("content", "document_id", "doc_number", "title", "markdown_path"), parse)


def articles(documents: DataFrame) -> DataFrame:
    return documents.select(F.inline("articles"))


def clauses(documents: DataFrame) -> DataFrame:
    return documents.select(F.inline("clauses"))


def chunks(documents: DataFrame, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk of parsed documents: unit chunks, header chunks where units have no text, plain chunks without headings."""
    meta = [F.col(k) for k in P.DOCUMENT_KEYS]
    body = X.strip_preamble(X.strip_comment_lines("normalized"))
    has_header = F.col("normalized").rlike(P.LEGAL_HEADER)
    unit = F.transform("clauses", lambda c: F.struct(
        c["text"].alias("text"), c["id"].alias("clause_id"), c["article_no"].alias("article_no"), c["clause_no"].alias("clause_no"), c["unit_type"].alias("unit_type"),
        c["structural_path"].alias("structural_path"), c["source_start_line"].alias("source_start_line"), c["source_end_line"].alias("source_end_line"),
        c["contains_quoted_replacement"].alias("contains_quoted_replacement"), c["target_document_number_hint"].alias("target_document_number_hint"),
    ))
    base = documents.select(*meta, "clauses", "normalized", has_header.alias("has_header"), (F.size("clauses") > 0).alias("has_units"))
    units = base.filter("has_header AND has_units").select(*meta, F.posexplode(unit).alias("unit_pos", "u"))
    names = [f for f in ("clause_id", "article_no", "clause_no", "unit_type", "structural_path", "source_start_line", "source_end_line", "contains_quoted_replacement", "target_document_number_hint")]
    short = F.length("u.text") < size  # one piece as it stands: the parser leaves no blanks around a unit's text
    long = units.filter(~short).withColumn("parts", split_text("u.text", size, overlap)).withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("u.text")))
    units = units.filter(short).withColumn("parts", F.array("u.text")).unionByName(long)
    units = units.select(*meta, "unit_pos", *[F.col(f"u.{n}").alias(n) for n in names], F.posexplode("parts").alias("chunk_part", "content"))
    none = {"source_start_line": "int", "source_end_line": "int", "contains_quoted_replacement": "boolean"}
    empty = [F.lit(None if n in none else "").cast(none.get(n, "string")).alias(n) for n in names]
    headed = base.filter("has_header AND NOT has_units").withColumn("parts", split_headers(body, size, overlap))
    tag = F.array_join(F.filter(F.array("s.Chuong", "s.Muc", "s.Dieu", "s.Khoan"), lambda x: x != ""), " | ")
    headed = headed.select(*meta, F.posexplode("parts").alias("unit_pos", "s")).select(
        *meta, "unit_pos", *empty, F.lit(0).alias("chunk_part"), F.when(tag != "", F.concat(F.lit("["), tag, F.lit("]\n"), F.col("s.content"))).otherwise(F.col("s.content")).alias("content")
    )
    plain = base.filter("NOT has_header").withColumn("parts", split_text(body, size, overlap))
    plain = plain.select(*meta, F.posexplode("parts").alias("unit_pos", "content")).select(*meta, "unit_pos", *empty, F.lit(0).alias("chunk_part"), "content")
    every = units.unionByName(headed).unionByName(plain)
    return numbered(every)


def numbered(every: DataFrame) -> DataFrame:
    """Chunks with their index in the document and their id."""
    from pyspark.sql import Window

    at = Window.partitionBy("document_id").orderBy("unit_pos", "chunk_part")
    index = F.row_number().over(at) - 1
    key = F.when(F.col("clause_id") != "", F.concat_ws(":", "clause_id", F.col("chunk_part").cast("string"))).otherwise(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")))
    name = F.when(F.col("clause_id") != "", F.concat(F.lit("chunk-"), F.sha1(key))).otherwise(F.sha1(key))
    source = F.when(X.text("markdown_path") == "", F.lit("")).otherwise(X.source_display("markdown_path"))
    return every.withColumn("chunk_index", index).drop("unit_pos").withColumn("chunk_id", name).withColumn("unit_id", F.col("clause_id")).withColumn("source", source)
