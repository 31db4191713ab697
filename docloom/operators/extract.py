"""From rows of slides, pages, word-processor blocks and recognised documents to chunks and assets. Binary parsing stays outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.identity import object_of_version_pk, unescape_part
from docloom.functions.names import ENDINGS, safe_filename, source_folder
from docloom.operators import markdown as md
from docloom.operators import pages as pg
from docloom.operators.running import numbered
from docloom.operators.text import estimate_tokens, image_urls, normalize_text, rewrite_links, strip

SAFE, MOST = 1400, 2048
# Style names that make a paragraph an item of a list.
BULLETS, NUMBERS = ("list bullet",), ("list number",)
# What a recognised document's manifest names as its engine.
ENGINE = "PaddleOCR-VL-1.5"
CHUNK = ["version_pk", "chunk_id", "chunk_type", "doc_type", "text", "token_estimate", "page_no", "page_first", "page_last", "slide_no", "section_path", "metadata"]


def _strings(**values: Column) -> Column:
    """A map of strings without the null ones."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _row(**values: Column) -> list[Column]:
    kinds = {"token_estimate": "long", "page_no": "int", "page_first": "int", "page_last": "int", "slide_no": "int", "section_path": "array<string>", "metadata": "map<string,string>"}
    return [values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in CHUNK]


# ---------------------------------------------------------------- slides

def slide_chunks(slides: DataFrame, safe: int = SAFE) -> DataFrame:
    """Chunks of slides (version_pk, slide_no, text, notes, images): text and notes together, cut within safe tokens.

    A slide that is cut has chunks -01, -02 and on; one without text has none. images: number of pictures on the slide.
    """
    both = F.concat_ws("\n", F.nullif(normalize_text(F.col("text")), F.lit("")), F.nullif(normalize_text(F.col("notes")), F.lit("")))
    has_notes = strip(F.coalesce("notes", F.lit(""))) != ""
    rows = slides.where("slide_no is not null").select("version_pk", "slide_no", F.coalesce("images", F.lit(0)).alias("images"), has_notes.alias("has_notes"), both.alias("text"))
    cut = md.chunks(rows, ["version_pk", "slide_no", "images", "has_notes"], soft=safe, hard=safe)
    # a slide is one row: how many chunks it gives is known where they are made, in the last section's number and part
    total = cut.groupBy("version_pk", "slide_no").agg(F.max("chunk_no").alias("n"))
    cut = cut.join(total, ["version_pk", "slide_no"])
    number = F.format_string("chunk#%06d", "slide_no")
    name = F.when(F.col("n") > 1, F.concat(number, F.format_string("-%02d", "chunk_no"))).otherwise(number)
    meta = _strings(source_format=F.lit("python-pptx"), image_count=F.col("images"), has_notes=F.col("has_notes"), section_index=F.col("section_no"), chunk_index=F.col("chunk_no"), section_kind=F.col("section_kind"))
    path = F.array(F.concat(F.lit("slide-"), F.col("slide_no").cast("string")))
    return cut.select(*_row(version_pk=F.col("version_pk"), chunk_id=name, chunk_type=F.lit("slide_text_chunk"), doc_type=F.lit("pptx"), text=F.col("text"), token_estimate=F.col("token_estimate"), slide_no=F.col("slide_no"), section_path=path, metadata=meta))


def slide_assets(pictures: DataFrame) -> DataFrame:
    """Assets of pictures (version_pk, slide_no, shape_no, mime_type, filename, uri), numbered through a version by slide and shape."""
    rows = numbered(pictures, ["version_pk"], ["slide_no", "shape_no"], "n", "slide-pictures")
    meta = _strings(source_format=F.lit("python-pptx"), filename=F.col("filename"))
    return rows.select("version_pk", F.format_string("asset#%06d", "n").alias("asset_id"), F.lit("slide_image_chunk").alias("chunk_type"), "mime_type", "uri", "slide_no", meta.alias("metadata"))


# ---------------------------------------------------------------- pages

def page_chunks(pages: DataFrame, safe: int = SAFE, part: int = pg.PART) -> DataFrame:
    """Chunks of text pages (version_pk, page, rn, text) as pages.text_pages gives them: one a page, then windows over short
    neighbours, then windows over parts, numbered on through the version."""
    meta = lambda **more: _strings(source_format=F.lit("pdf"), **more)
    own = normalize_text(F.col("text"))
    word = lambda c: F.col(c).cast("string")
    one = pages.select("version_pk", F.lit(0).alias("kind"), F.col("rn").cast("long").alias("at"), F.col("page").alias("first"), F.col("page").alias("last"), own.alias("text"))
    short = pg.short_windows(pages.withColumn("text", own), safe).select("version_pk", F.lit(1).alias("kind"), F.col("rn").cast("long").alias("at"), "first", "last", "text")
    parts = pg.part_windows(pages.withColumn("text", own), safe, part).select("version_pk", F.lit(2).alias("kind"), F.col("part").cast("long").alias("at"), "first", "last", "text")
    rows = numbered(one.unionByName(short).unionByName(parts), ["version_pk"], ["kind", "at"], "n", "page-chunks")
    single = F.col("kind") == 0
    path = F.when(single, F.concat(F.lit("page-"), word("first"))).otherwise(F.concat(F.lit("pages-"), word("first"), F.lit("-"), word("last")))
    reason = F.when(F.col("kind") == 1, "short_adjacent_pages").when(F.col("kind") == 2, "page_part_window")
    return rows.select(
        *_row(version_pk=F.col("version_pk"), chunk_id=F.format_string("chunk#%06d", "n"), chunk_type=F.when(single, "page_text_chunk").otherwise("window_pdf_chunk"), doc_type=F.lit("pdf"), text=F.col("text"),
              token_estimate=estimate_tokens(F.col("text")), page_no=F.when(single, F.col("first")), page_first=F.col("first"), page_last=F.col("last"), section_path=F.array(path), metadata=meta(window_reason=reason))
    )


def visual_pages(chunks: DataFrame) -> DataFrame:
    """(version_pk, pages, visual): how many pages a version has, and which of them are blank, in order."""
    page = F.coalesce("page_no", "page_span.first", "ordinal")
    rows = chunks.where("chunk_type = 'page_text_chunk'").groupBy("version_pk", page.alias("page")).agg(F.max(strip(F.coalesce("text", F.lit(""))) != "").alias("has"))
    return rows.groupBy("version_pk").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list(F.when(~F.col("has"), F.col("page")))).alias("visual"))


# ---------------------------------------------------------------- word processor

def _run(r: Column) -> Column:
    """A run of text with its emphasis or link."""
    plain = F.replace(F.replace(r["text"], F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`"))
    bold, italic = F.coalesce(r["bold"], F.lit(False)), F.coalesce(r["italic"], F.lit(False))
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    link = F.when(strip(F.coalesce(r["href"], F.lit(""))) != "", F.concat(F.lit("["), normalize_text(r["text"]), F.lit("]("), strip(r["href"]), F.lit(")")))
    shown = F.coalesce(link, F.concat(mark, plain, mark))
    return F.when(F.coalesce(r["text"], F.lit("")) == "", "").otherwise(shown)


def _table(rows: Column) -> Column:
    """A table as lines, its first row as the head; rows padded to the widest, rows without any text left out."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    width = F.array_max(F.transform(kept, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(kept, lambda r: line(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(kept) > 0, F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, 1_000_000_000)), "\n"))


def docx_markdown(blocks: DataFrame) -> DataFrame:
    """(version_pk, markdown) of blocks (version_pk, block_no, style, numbered, level, runs, cells), in their order.

    runs: array<struct<text, bold, italic, href>> of a paragraph; cells: array<array<string>> of a table, else null. Styles
    Title and Heading 1-6 make headings; list styles and numbered paragraphs make items, two spaces in for each level.
    Blocks without text are left out. One document is one row and has to fit a cell.
    """
    style = F.lower(F.trim(F.coalesce("style", F.lit(""))))
    text = normalize_text(F.array_join(F.transform(F.coalesce("runs", F.array().cast("array<struct<text:string,bold:boolean,italic:boolean,href:string>>")), _run), ""))
    depth = F.when(style == "title", 1).when(F.rlike(style, F.lit(r"^heading\s*[0-9]+$")), F.least(F.lit(6), F.greatest(F.lit(1), F.regexp_extract(style, "([0-9]+)$", 1).cast("int"))))
    starts = lambda words: F.coalesce(*[F.when(F.startswith(style, F.lit(w)), True) for w in words], F.lit(False))
    item = F.when(starts(BULLETS), "-").when(starts(NUMBERS) | F.coalesce("numbered", F.lit(False)), "1.")
    indent = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.coalesce("level", F.lit(0))))
    shown = F.when(depth.isNotNull(), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), text)).when(item.isNotNull(), F.concat(indent, item, F.lit(" "), text)).otherwise(text)
    line = F.when(F.col("cells").isNotNull(), _table(F.col("cells"))).when(text != "", shown)
    rows = blocks.select("version_pk", "block_no", line.alias("line")).where("line is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line"))), lambda x: x["line"])
    return rows.groupBy("version_pk").agg(normalize_text(F.array_join(ordered, "\n")).alias("markdown"))


# ---------------------------------------------------------------- recognised documents

def _source_path(version_pk: Column, ending: str) -> Column:
    """Name of the source with another ending: the last step of its key."""
    key = unescape_part(F.get(F.split(version_pk, "#"), F.lit(2)))
    stem = F.regexp_replace(F.regexp_extract(key, "([^/]*)/*$", 1), r"(.)\.[^.]+$", "$1")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit(ending))


def local_images(documents: DataFrame) -> DataFrame:
    """documents (version_pk, markdown, ...) with images, array<struct<url, asset_id, relative_path>>, each address once in order
    of appearance, and the markdown's links to them rewritten."""
    endings = F.create_map(*[F.lit(x) for x in dict.fromkeys(e for e in ENDINGS.values()) for x in (x, x)])
    name = lambda u: F.regexp_extract(F.regexp_extract(u, r"^[^?#]*", 0), "([^/]*)/*$", 1)
    suffix = lambda u: F.lower(F.regexp_extract(name(u), r"^.+(\.[^.]+)$", 1))
    number = lambda i: F.format_string("asset#%06d", i + 1)
    ends = lambda u: F.coalesce(F.try_element_at(endings, suffix(u)), F.nullif(suffix(u), F.lit("")), F.lit(".bin"))
    made = F.transform(image_urls(F.col("markdown")), lambda u, i: F.struct(u.alias("url"), number(i).alias("asset_id"), F.concat(F.lit("assets/"), safe_filename(number(i)), ends(u)).alias("relative_path")))
    rows = documents.withColumn("images", made)
    links = F.map_from_arrays(F.transform("images", lambda x: x["url"]), F.transform("images", lambda x: x["relative_path"]))
    return rows.withColumn("markdown", F.when(F.size("images") > 0, normalize_text(rewrite_links(F.col("markdown"), links))).otherwise(normalize_text(F.col("markdown"))))


def ocr_chunks(documents: DataFrame, soft: int = SAFE, hard: int = MOST) -> DataFrame:
    """Chunks of recognised documents (version_pk, markdown), their links already local."""
    cut = md.chunks(documents, "version_pk", "markdown", soft, hard)
    meta = _strings(source_format=F.lit("paddleocr_async"), layout_index=F.col("chunk_no"), section_index=F.col("section_no"), section_kind=F.col("section_kind"))
    return cut.select(*_row(version_pk=F.col("version_pk"), chunk_id=F.col("chunk_id"), chunk_type=F.lit("section_text_chunk"), doc_type=F.lit("pdf"), text=F.col("text"), token_estimate=F.col("token_estimate"), section_path=F.col("header_path"), metadata=meta))


_ASSET = ["version_pk", "asset_id", "chunk_type", "mime_type", "relative_path", "source_field", "source_url", "payload"]


def ocr_assets(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Assets (version_pk, asset_id, chunk_type, mime_type, relative_path, source_field, source_url, payload) of recognised
    documents (version_pk, lines, markdown, images): the raw lines (an array of JSON texts, null if there are none), a picture
    for each image, a section for each chunk, and the whole Markdown. payload is null for what has to be fetched."""

    def asset(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in _ASSET])

    v = F.col("version_pk")
    raw = asset(documents.where("lines is not null"), version_pk=v, asset_id=F.lit("ocr#raw-jsonl"), chunk_type=F.lit("ocr_json_chunk"), mime_type=F.lit("application/x-ndjson"),
                relative_path=_source_path(v, ".json"), source_field=F.lit("json_lines"), payload=F.array_join("lines", "\n"))
    image = documents.select("version_pk", F.explode("images").alias("i"))
    mimes = F.create_map(*[F.lit(x) for mime, e in ENDINGS.items() for x in (e, mime) if mime not in ("application/jsonl",)])
    kind = F.coalesce(F.try_element_at(mimes, F.regexp_extract("i.relative_path", r"(\.[^.]+)$", 1)), F.lit("application/octet-stream"))
    pictures = asset(image, version_pk=v, asset_id=F.col("i.asset_id"), chunk_type=F.lit("page_image_chunk"), mime_type=kind, relative_path=F.col("i.relative_path"), source_field=F.lit("markdown.images"), source_url=F.col("i.url"))
    number = F.col("metadata")["layout_index"].cast("int")
    parts = asset(chunks, version_pk=v, asset_id=F.format_string("ocr#markdown-section-%06d", number), chunk_type=F.lit("document_markdown_chunk"), mime_type=F.lit("text/markdown"),
                  relative_path=F.format_string("sections/section-%06d.md", number), source_field=F.lit("markdown.text"), payload=F.col("text"))
    whole = asset(documents.where("markdown <> ''"), version_pk=v, asset_id=F.lit("ocr#markdown"), chunk_type=F.lit("document_markdown_chunk"), mime_type=F.lit("text/markdown"),
                  relative_path=_source_path(v, ".md"), source_field=F.lit("markdownUrl"), payload=F.col("markdown"))
    return raw.unionByName(pictures).unionByName(parts).unionByName(whole)


def ocr_manifests(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(version_pk, doc_type, source_format, metadata): the manifest of each recognised document with its counters."""
    n = chunks.groupBy("version_pk").agg(F.count("*").alias("n"))
    rows = documents.select("version_pk", "lines", (F.col("markdown") != "").alias("has"), F.size("images").alias("images")).join(n, "version_pk", "left")
    parts, whole = F.coalesce("n", F.lit(0)), F.coalesce("has", F.lit(False)).cast("int")
    meta = _strings(source_format=F.lit("paddleocr_async"), page_count=F.coalesce(F.size("lines"), F.lit(0)), page_image_asset_count=F.col("images"), raw_json_asset_count=F.col("lines").isNotNull().cast("int"),
                    layout_markdown_asset_count=parts, document_markdown_asset_count=whole, markdown_asset_count=parts + whole, ocr_engine=F.lit(ENGINE))
    return rows.select("version_pk", F.lit("pdf").alias("doc_type"), F.lit("paddleocr_async").alias("source_format"), meta.alias("metadata"))


def asset_root(version_pk: Column, prefix: str = "") -> Column:
    """The folder in which a version's manifest and assets are kept."""
    key = unescape_part(F.get(F.split(version_pk, "#"), F.lit(2)))
    return F.concat(F.lit(prefix), source_folder(key, object_of_version_pk(version_pk)))


