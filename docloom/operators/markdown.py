"""Markdown as rows: blocks, sections with their heading path, and token-bounded chunks.

A document is one row, so all of this happens where the row is: lines are read once by a small scanner in Arrow batches,
and nothing is shuffled. Outermost blocks are told apart as CommonMark with tables does: ATX and setext headings, fenced and
indented code, HTML, quotes and lists with lazy lines, loose lists, tables; rules part blocks and are none. Finer points
(fences within list items, HTML that ends before an empty line) are not followed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.text import estimate_tokens, forced_windows, strip

SOFT, HARD = 1148, 1400
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:\s|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*$")
_RULE = re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_LIST = re.compile(r" {0,3}(?:([-*+])|[0-9]{1,9}([.)]))(?:\s|$)")
_QUOTE = re.compile(r" {0,3}>")
_DELIMITER = re.compile(r" {0,3}(?=.*\|)\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r" {0,3}<(?:[!?]|/?[A-Za-z])")
_MANY = re.compile(r"\n{3,}")
_STARTS = frozenset("#`~=-*_+>|<0123456789 \t")
# Where a text that has to be cut is cut best, and how much of the mark stays to the left.
CUTS = (("\n\n# ", 3), ("\n# ", 2), ("\n## ", 3), ("\n### ", 4), ("\n#### ", 5), ("\n##### ", 6), ("\n###### ", 7), ("\n\n", 0), ("\n", 0))


def normal(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return (_MANY.sub("\n\n", text) if "\n\n\n" in text else text).strip()


def tokens(text: str) -> int:
    return -(-len(" ".join(text.split())) // 4)


def scan(lines: list[str]) -> list[dict]:
    """The outermost blocks of lines: kind, level of headings, first and last line (from 1).

    open_ is the block that the line before belongs to, None after an empty line; loose is the list or indented code that
    may go on behind empty lines; fence is the mark that an open fence waits for.
    """
    found: list[dict] = []
    open_ = loose = fence = None
    for no, line in enumerate(lines, 1):
        if fence:
            found[-1]["last"] = no
            mark = line.strip()
            if set(mark) == {fence[0]} and len(mark) >= len(fence) and len(line) - len(line.lstrip(" ")) <= 3:
                fence = None
            continue
        if not line.strip():
            open_ = None
            continue
        indent = 4 if line[0] == "\t" else len(line) - len(line.lstrip(" "))
        going = open_ or loose
        kind = level = mark = None
        same = False
        if line[0] not in _STARTS and "|" not in line:
            kind = "text"
        elif hit := _FENCE.match(line):
            fence, kind = hit.group(1), "code_fence"
        elif open_ and open_["kind"] == "html_block":
            kind, same = "html_block", True
        elif going and going["kind"] == "list" and indent >= 2:
            kind, same, open_ = "list", True, going
        elif hit := _HEADING.match(line):
            kind, level = "heading", len(hit.group(1))
        elif open_ and open_["kind"] == "paragraph" and (hit := _UNDERLINE.match(line)):
            open_.update(kind="heading", level=1 if hit.group(1)[0] == "=" else 2, last=no, underlined=True)
            open_ = loose = None
            continue
        elif _RULE.match(line):
            open_ = loose = None
            continue
        elif hit := _LIST.match(line):
            kind, mark = "list", hit.group(1) or hit.group(2)
            same = bool(going) and going["kind"] == "list" and going["mark"] == mark
            open_ = going if same else open_
        elif _QUOTE.match(line):
            kind, same = "blockquote", bool(open_) and open_["kind"] == "blockquote"
        elif indent >= 4:
            if open_ and open_["kind"] in ("paragraph", "list", "blockquote", "table"):
                kind, same = open_["kind"], True
            else:
                kind, same = "code_block", bool(going) and going["kind"] == "code_block"
                open_ = going if same else open_
        elif "|" in line and no < len(lines) and _DELIMITER.match(lines[no]) and not (open_ and open_["kind"] in ("list", "blockquote", "table")):
            kind = "table"
        elif _HTML.match(line) and not (open_ and open_["kind"] in ("paragraph", "table")):
            kind = "html_block"
        else:
            kind = "text"
        if kind == "text":
            same = bool(open_) and open_["kind"] in ("paragraph", "list", "blockquote", "table", "html_block")
            kind = open_["kind"] if same else "paragraph"
        if same:
            open_["last"] = no
        else:
            open_ = {"kind": kind, "level": level, "first": no, "last": no, "mark": mark, "underlined": False}
            found.append(open_)
        loose = open_ if kind in ("list", "code_block") else None
        if kind in ("heading", "code_fence"):
            open_ = None
    return found


def _title(text: str, underlined: bool) -> str:
    if underlined:
        return text.rpartition("\n")[0].strip()
    return re.sub(r"(?:^|\s)#+\s*$", "", re.sub(r"^\s*#{1,6}", "", text)).strip()


def read_blocks(text: str) -> list[dict]:
    """The blocks of a text with their own texts, section (0 before the first heading) and heading path.

    A heading of level n keeps the first n - 1 entries of the path above it, whatever their levels: h1, h3, h3 gives a
    path of three.
    """
    lines = normal(text).split("\n")
    out: list[dict] = []
    path: list[str] = []
    section = 0
    for b in scan(lines):
        body = normal("\n".join(lines[b["first"] - 1 : b["last"]]))
        if b["kind"] == "heading":
            title = _title(body, b["underlined"])
            path = path[: b["level"] - 1] + [title] * bool(title)
            section += 1
        out.append({"block_no": len(out) + 1, "kind": b["kind"], "first_line": b["first"], "last_line": b["last"], "level": b["level"], "section_no": section, "header_path": path, "text": body})
    return out


def read_sections(text: str) -> list[dict]:
    """Blocks from one heading to the next, joined by empty lines. A document's last section is a preamble if it has no path."""
    out: list[dict] = []
    for b in read_blocks(text):
        if not out or out[-1]["section_no"] != b["section_no"]:
            out.append({"section_no": b["section_no"], "kind": "heading_section", "header_path": b["header_path"], "blocks": []})
        out[-1]["blocks"].append(b["text"])
    for s in out:
        s["n_blocks"], s["text"] = len(s["blocks"]), "\n\n".join(s["blocks"])
    if out and not out[-1]["header_path"]:
        out[-1]["kind"] = "preamble"
    return out


def forced_parts(text: str, hard: int) -> list[str]:
    """Parts within hard tokens: cut at the best mark in the second half of 4 x hard characters, else there."""
    room, parts, rest = 4 * hard, [], normal(text)
    while rest:
        if tokens(rest) <= hard:
            parts.append(rest)
            break
        window = rest[:room]
        cut = next((at + keep for mark, keep in CUTS if (at := window.rfind(mark)) >= max(1, len(window) // 2)), room) if len(rest) > room else len(rest)
        parts.append(normal(rest[:cut]))
        rest = rest[cut:].lstrip()
    return [p for p in parts if p]


def packed(units: list[str], hard: int) -> list[str]:
    """Units joined by empty lines, each run as long as it stays within the limit."""
    done: list[str] = []
    for unit in units:
        joined = f"{done[-1]}\n\n{unit}" if done else unit
        if done and tokens(joined) <= hard:
            done[-1] = joined
        else:
            done.append(unit)
    return done


def read_chunks(text: str, soft: int, hard: int) -> list[dict]:
    """Sections within soft tokens whole, others packed block by block; blocks over the limit are cut first."""
    out: list[dict] = []
    for n, s in enumerate(read_sections(text), 1):
        size = tokens(s["text"])
        parts = [s["text"]] if size <= soft else packed([u for b in s["blocks"] for u in (forced_parts(b, hard) if tokens(b) > hard else [b])], hard)
        for k, part in enumerate(parts, 1):
            out.append({"chunk_no": len(out) + 1, "section_no": n, "section_kind": s["kind"], "block_count": s["n_blocks"], "part": k, "parts": len(parts), "header_path": s["header_path"], "token_estimate": size if size <= soft else tokens(part), "text": part})
    return out


_BLOCK = "block_no long, kind string, first_line long, last_line long, level int, section_no long, header_path array<string>, text string"
_SECTION = "section_no long, kind string, header_path array<string>, n_blocks long, text string"
_CHUNK = "chunk_no int, section_no int, section_kind string, block_count int, part int, parts int, header_path array<string>, token_estimate long, text string"


def _each(documents: DataFrame, key: str | list[str], text: str, read: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """The rows that read gives for each document, beside its key columns. Null and empty texts give none."""
    keys = [key] if isinstance(key, str) else key
    out = T.StructType([documents.schema[k] for k in keys] + T._parse_datatype_string(schema).fields)
    names = [f.name for f in out.fields[len(keys) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                owner: list[int] = []
                columns: list[list] = [[] for _ in names]
                for i, body in enumerate(part.column(len(keys)).to_pylist()):
                    for row in read(body) if body else ():
                        owner.append(i)
                        for c, name in zip(columns, names):
                            c.append(row[name])
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(k).take(at) for k in range(len(keys))] + [pa.array(c, arrow.field(n).type) for c, n in zip(columns, names)], schema=arrow)

    return documents.select(*keys, text).mapInArrow(run, out)


def blocks(documents: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, kind, first_line, last_line, level, section_no, header_path, text): the outermost blocks of each document."""
    return _each(documents, key, text, read_blocks, _BLOCK)


def sections(documents: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, kind, header_path, n_blocks, text): blocks from one heading to the next, joined by empty lines."""
    return _each(documents, key, text, read_sections, _SECTION)


def chunks(documents: DataFrame, key: str | list[str] = "doc_id", text: str = "text", soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """(key, chunk_id, chunk_no, section_no, section_kind, block_count, part, parts, header_path, token_estimate, text):
    sections as chunks within hard tokens, numbered from 1."""
    soft = max(1, min(soft, hard))
    rows = _each(documents, key, text, lambda t: read_chunks(t, soft, hard), _CHUNK)
    keys = [key] if isinstance(key, str) else key
    return rows.select(*keys, F.format_string("chunk#%06d", "chunk_no").alias("chunk_id"), *[c for c in rows.columns if c not in keys])


def expand_oversized(rows: DataFrame, limit: int = HARD) -> DataFrame:
    """Chunks (chunk_id, text, and others) within limit tokens: those over it as windows of twice as many characters, in the
    order of the text, with ids #partNN; split_from, split_index: the chunk they come from and their place in it, else null.

    Null texts stay as they are.
    """
    over = F.coalesce(estimate_tokens(F.col("text")) > limit, F.lit(False))
    windows = F.when(over, forced_windows(F.col("text"), 2 * limit)).otherwise(F.array(F.col("text")))
    each = rows.withColumn("__over", over).select("*", F.posexplode(windows).alias("__at", "__part"))
    part = F.concat("chunk_id", F.format_string("#part%02d", F.col("__at") + 1))
    new = {"split_from": F.when(F.col("__over"), F.col("chunk_id")), "split_index": F.when(F.col("__over"), F.col("__at") + 1), "chunk_id": F.when(F.col("__over"), part).otherwise(F.col("chunk_id")), "text": F.col("__part")}
    return each.withColumns(new).drop("__over", "__at", "__part")


def whole_markdown(rows: DataFrame, key: str = "version_pk") -> DataFrame:
    """(key, markdown): the non-blank texts of rows (key, ordinal, text) joined by rules, in order. One document fits a cell."""
    kept = rows.where(strip(F.coalesce("text", F.lit(""))) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return kept.groupBy(key).agg(F.array_join(ordered, "\n\n---\n\n").alias("markdown"))
