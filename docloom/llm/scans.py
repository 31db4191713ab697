"""Repair of text from scanned pages.

Three decisions are learnt with averaged perceptrons, all on text of the corpus itself: which lines at the edge of a page
are furniture (features of place, shape and repetition), which characters of a word are misread and how (each is kept,
replaced or deleted, or one is inserted), and which marks at a line's end only break a word (join).

Words are decided once for the whole corpus, not page by page: all words of chunks that were not scanned, however many, are
the lexicon, a table; every other word of the pages meets the known words that one or two edits lead to by joins. The
words met most often, known and unknown (COMMON of each), go to the tasks as a broadcast; pages with any other word ask for
it, and are finished after a join with the answers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.io import materialize, parallelism
from docloom.llm.perceptron import AveragedPerceptron

PAGE = "page_text_chunk"
#: Pages (about) whose broken lines train the joins; words of each kind that train the editor, at most; both chosen by a hash.
SAMPLE_PAGES, TRAIN = 4000, 3000
#: How often a word must occur in text that was not scanned to be a known one; non-blank lines that are a page's edge.
LEAST_COUNT, EDGE = 3, 3
#: Known words, and decided unknown ones, in one broadcast: the most frequent. The others are looked up by a join.
COMMON = 200_000
#: Bits that tell which words can't be known ones (a power of two): with more words they tell less, and never too much.
FILTER = 1 << 24
_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9]+")
_LETTER = "[A-Za-zÀ-ɏ]"
_LETTERS = re.compile(_LETTER)
_COMPOUND = re.compile(r"[a-zß-ɏ]+-[a-zß-ɏ]+")
# Marks that may stand where a word is broken at a line's end (hyphens, not sign, soft hyphen).
MARKS = "-‐‑¬­"
_BROKEN = re.compile(rf"([A-Za-zÀ-ɏ0-9]+)([{MARKS}])\s*$")
_MARKS = frozenset(MARKS)
_BEGIN = re.compile(r"^\s*([A-Za-zÀ-ɏ0-9]+)")
_SENTENCE_END = (".", "!", "?", "。", "！", "？", ":", ";", "）", "”", '"')
# Characters that scanning confuses, folded into one so that two readings of a line look alike.
_FOLD = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("fi", "h"), ("li", "h"))
_FOLD_ONE = str.maketrans("10i5tceb6g9", "lollsfcchq" + "q")


# ---------------------------------------------------------------- words

def _broken(line: str) -> re.Match | None:
    """The last word of a line and the mark behind it, if it ends in one."""
    return _BROKEN.search(line) if line.rstrip()[-1:] in _MARKS else None


def line_ends(lines: list[str], following: str | None = None) -> Iterator[tuple[int, re.Match, re.Match | None]]:
    """Lines (by place) that end in a mark that may break a word, with the beginning of the next one that is not blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    for k, i in enumerate(full):
        if hit := _broken(lines[i]):
            after = lines[full[k + 1]] if k + 1 < len(full) else following
            yield i, hit, _BEGIN.match(after) if after else None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with how often they occur in clean text, on pages, and in parts there, broken at a line's end."""
    clean: Counter = Counter()
    page: Counter = Counter()
    broken: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(clean.keys() | page.keys() | broken.keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (clean, page, broken))], names=["word", "clean", "page", "broken"])
        for c in (clean, page, broken):
            c.clear()
        return out

    for b in batches:
        for kind, text in zip(b.column("chunk_type").to_pylist(), b.column("text").to_pylist()):
            low = text.lower()
            if kind != PAGE:
                clean.update(_WORD.findall(low))
                clean.update(_COMPOUND.findall(low))
                continue
            page.update(_WORD.findall(low))
            for _, hit, nxt in line_ends(low.split("\n")):
                a, z = hit.group(1), nxt.group(1) if nxt else ""
                page[a] -= 1
                broken[a] += 1
                if z:
                    page[z] -= 1
                    broken.update((z, a + z, f"{a}-{z}"))
        if len(clean) + len(page) + len(broken) > 500_000:
            yield rows()
    yield rows()


def word_table(chunks: DataFrame, spark: SparkSession) -> DataFrame:
    """(word, clean, page, broken, known): all words of chunks with their counts. Known are those that occur LEAST_COUNT times in
    text that was not scanned; where there is no such text, those of the pages that are too frequent to be chance misreadings."""
    texts = chunks.where(F.col("text").isNotNull()).select(F.coalesce("chunk_type", F.lit("")).alias("chunk_type"), "text")
    parts = texts.coalesce(4 * parallelism(spark)).mapInArrow(_count_words, "word string, clean long, page long, broken long")
    counts = materialize(parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean", "page", "broken")]), "scan-words")
    any_clean = counts.where(F.col("clean") >= LEAST_COUNT).limit(1).count() > 0
    known = F.col("clean") >= LEAST_COUNT if any_clean else (F.col("page") >= 20) & ~F.col("word").rlike("[0-9]")
    return counts.withColumn("known", known)


# ---------------------------------------------------------------- edits of words

def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each start of a word, its ways to leave out one or two characters that leave something."""
    for b in batches:
        names = [n for n in b.schema.names if n != "start"]
        owner, mask, at, piece = [], [], [], []
        for k, w in enumerate(b.column("start").to_pylist()):
            for n in (1, 2):
                for i in range(len(w) - n + 1):
                    if len(w) > n:
                        owner.append(k)
                        mask.append(w[:i] + "*" + w[i + n :])
                        at.append(i)
                        piece.append(w[i : i + n])
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(n).take(take) for n in names), b.column("start").take(take), pa.array(mask, pa.string()), pa.array(at, pa.int32()), pa.array(piece, pa.string())], names=[*names, "start", "mask", "at", "piece"])


def near_words(starts: DataFrame, known: DataFrame) -> DataFrame:
    """starts (start, ...) with each known word (word, clean) that one edit leads to: at, piece, put, to, count. An edit puts
    one or two characters in place of one or two, not two for two, and changes no character that it could leave."""
    extra = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in starts.schema.fields if f.name != "start")
    left = starts.select(*[c for c in starts.columns if c != "start"], "start").mapInArrow(_masks, f"{extra}{', ' if extra else ''}start string, mask string, at int, piece string")
    right = known.select("clean", F.col("word").alias("start")).mapInArrow(_masks, "clean long, start string, mask string, at int, piece string")
    right = right.select("mask", F.col("piece").alias("put"), F.col("start").alias("to"), F.col("clean").alias("count"))
    met = left.join(right, "mask").drop("mask")
    two = (F.length("put") == 2) & (F.length("piece") == 2)
    return met.where((F.col("put") != F.col("piece")) & ~two & ~F.contains("piece", F.col("put")) & (~F.contains("put", F.col("piece")) | F.col("piece").rlike("^[0-9]+$")))


def _ops(piece: str, put: str) -> list[tuple[str, str, str]]:
    """What happens to each character: keep, replace, delete or insert."""
    out = [("keep" if a == b else "replace", a, b) for a, b in zip(piece, put)]
    return out + [("delete", a, "") for a in piece[len(put) :]] + [("insert", "", b) for b in put[len(piece) :]]


def _keep(word: str, clean: int) -> list[tuple[str, str]]:
    """(feature, label) of leaving a word as it is. clean: how often it occurs in text that was not scanned."""
    size, digit = min(len(word), 8), any(c.isdigit() for c in word)
    f = ["bias", f"digit={digit}", f"size={size}", f"digit={digit},size={size}", f"clean={min(clean, LEAST_COUNT)}"]
    return [(x, "keep") for x in f]


def _edit(start: str, at: int, piece: str, put: str, count: int) -> list[tuple[str, str]]:
    """(feature, label) of an edit, character by character."""
    change = f"{piece}>{put}"
    left, right = start[at - 1 : at] if at else "^", start[at + len(piece) : at + len(piece) + 1] or "$"
    out = []
    for k, (op, a, b) in enumerate(_ops(piece, put)):
        f = [f"{a}>{b}", change, f"{left}[{change}", f"{change}]{right}"] if op != "keep" else [f"{a} in {change}"]
        if k == 0:
            f += ["bias", f"count={count.bit_length() // 2}", f"size={min(len(start), 8)}", f"digit={any(c.isdigit() for c in piece)}"]
        out += [(x, op) for x in f]
    return out


def _distinct_edits(near: list[dict]) -> list[dict]:
    """The edits of a word in a fixed order, the shortest one to each target."""
    best: dict[str, dict] = {}
    for c in sorted(near, key=lambda c: (len(c["piece"]) + len(c["put"]), c["at"], c["put"])):
        best.setdefault(c["to"], c)
    return sorted(best.values(), key=lambda c: c["to"])


def fit_editor(words: DataFrame) -> tuple[AveragedPerceptron, list[tuple[str, str]], DataFrame]:
    """The perceptron of the editor, the confusions (piece, put) it may use, and the edits of all unknown words.

    Unknown words of the pages that one edit leads from to a single known word are taken as its misreadings; confusions are
    those seen often enough over all pages. The perceptron learns from TRAIN words of each kind: misread ones, unknown ones
    that no such edit leads from, and known ones.
    """
    letters = F.col("word").rlike(_LETTER) & ~F.contains("word", F.lit("-")) & (F.length("word") > 1)
    unknown = words.where(~F.col("known") & (F.col("page") + F.col("broken") > 0) & letters)
    known = words.where("known")
    near = materialize(near_words(unknown.select(F.col("word").alias("start"), F.col("clean").alias("own"), "page", "broken"), known), "scan-near")
    sound = (F.length("start").between(4, 25)) & (F.length("to").between(4, 24)) & F.col("to").rlike(r"^\p{L}+$") & (F.col("count") >= 2 * LEAST_COUNT) & (F.col("page") > 0)
    single = near.where(sound).groupBy("start").agg(F.count_distinct("to").alias("ways"), F.min(F.struct(F.length("piece") + F.length("put"), "at", "piece", "put", "to")).alias("e"), F.max("page").alias("page")).where("ways = 1")
    single = materialize(single.select("start", "e.piece", "e.put", "e.to", "page"), "scan-pairs")
    pairs = single.count()
    often = single.groupBy("piece", "put").agg(F.sum(F.least("page", F.lit(5))).alias("n")).where(F.col("n") >= max(3, pairs // 1000))
    # pieces of one or two characters, seen often: a small table whatever the pages
    edits = sorted((r.piece, r.put) for r in often.collect())

    spec = F.broadcast(words.sparkSession.createDataFrame(edits, "piece string, put string"))
    near_known = near_words(_some(known.where(F.length("word") > 3).select(F.col("word").alias("start"), F.col("clean").alias("own"))), known)
    examples = []
    listed = F.collect_list(F.struct("at", "piece", "put", "to", "count")).alias("near")
    targets = single.select("start", F.col("to").alias("right"))
    # shorter unknown words are mostly fragments, of which nothing can be learnt about leaving words
    lists = near.where((F.col("page") > 0) & (F.length("start") > 3)).join(spec, ["piece", "put"]).groupBy("start", "own").agg(listed).join(targets, "start", "left")
    doubtful = near.where(sound).select("start").distinct().withColumn("doubt", F.lit(True))
    unclear = F.col("right").isNull() & F.col("doubt").isNotNull()
    plain = near_known.join(spec, ["piece", "put"]).groupBy("start", "own").agg(listed).select("start", "own", "near", F.lit(None).cast("string").alias("right"), F.lit("known").alias("kind"))
    lists = lists.join(doubtful, "start", "left").where(~unclear).select("start", "own", "near", "right", F.when(F.col("right").isNull(), "other").otherwise("misread").alias("kind"))
    every = materialize(lists.unionByName(plain), "scan-train")
    for kind in ("misread", "other", "known"):
        for r in sorted(_some(every.where(F.col("kind") == kind)).collect(), key=lambda r: r.start):
            options = _distinct_edits([x.asDict() for x in r.near])
            keys = [_keep(r.start, r.own)] + [_edit(r.start, c["at"], c["piece"], c["put"], c["count"]) for c in options]
            at = next((k for k, c in enumerate(options, 1) if c["to"] == r.right), 0)
            if len(keys) > 1:
                examples.append(([{"keys": k} for k in keys], at))
    model = AveragedPerceptron()
    model.train(examples, epochs=4)
    return model, edits, near


def _some(rows: DataFrame, bound: int = TRAIN) -> DataFrame:
    """About bound rows (start, ...) at most, chosen by a hash of start."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(F.lit(5), "start"), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def _choose(shared):
    """The word that each unknown word should read: the best of its edits, if it beats leaving the word as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        model = AveragedPerceptron()
        model.weights = weights
        for b in batches:
            out = []
            for word, own, near in zip(*(b.column(c).to_pylist() for c in ("word", "own", "near"))):
                best, top = None, model.sum(_keep(word, own))
                for c in sorted(near, key=lambda c: (c["to"], c["half"] or "", c["at"], c["put"])):
                    score = model.sum(_edit(c["half"] or word, c["at"], c["piece"], c["put"], c["count"]))
                    if c["half"]:
                        score = min(score, model.sum(_edit(word, c["at1"], c["piece1"], c["put1"], c["count"])))
                    if score > top:
                        best, top = c["to"], score
                out.append(best)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(out, pa.string())], names=["word", "fix"])

    return run


def _probes(word: str) -> tuple[int, int]:
    raw = word.encode()
    return zlib.crc32(raw) & (FILTER - 1), zlib.crc32(raw, 0x9E3779B9) & (FILTER - 1)


def word_filter(known: DataFrame) -> bytes:
    """FILTER bits, of which each known word sets two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for b in batches:
            bits[[i for w in b.column("word").to_pylist() for i in _probes(w)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(FILTER // 8, np.uint8)
    for r in known.select("word").coalesce(min(8, parallelism(known.sparkSession))).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _applied(word: str, by: dict[str, list[str]]) -> Iterator[tuple[int, str, str, str]]:
    """(at, piece, put, to): what each confusion makes of a word at each place."""
    for n in (1, 2):
        for i in range(len(word) - n + 1):
            for put in by.get(word[i : i + n], ()):
                yield i, word[i : i + n], put, word[:i] + put + word[i + n :]


def _twice(edits: list[tuple[str, str]], shared):
    """Words that two confusions lead to, one after the other, unless the filter tells that they are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        by: dict[str, list[str]] = {}
        for piece, put in edits:
            by.setdefault(piece, []).append(put)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for word, own in zip(b.column("word").to_pylist(), b.column("own").to_pylist()):
                for one in _applied(word, by):
                    if len(one[3]) > 4:
                        for two in _applied(one[3], by):
                            if all(bits[i >> 3] >> (i & 7) & 1 for i in _probes(two[3])):
                                for c, v in zip(cols, (word, own, *one, *two)):
                                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "own", "at1", "piece1", "put1", "half", "at", "piece", "put", "to"])

    return run


def decided_words(spark: SparkSession, unknown: DataFrame, near: DataFrame, known: DataFrame, possible, model: AveragedPerceptron, edits: list[tuple[str, str]]) -> DataFrame:
    """(word, fix): what unknown words (word, clean) should read; null for those that stay. near: their single edits (start, ...).
    Words that no single edit repairs may take two; possible: broadcast filter of the known words."""
    spec = spark.createDataFrame(edits, "piece string, put string")
    shared = spark.sparkContext.broadcast(model.weights)
    one = near.join(F.broadcast(spec), ["piece", "put"])
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("half", "string"), ("at1", "int"), ("piece1", "string"), ("put1", "string"))]
    first = one.select(F.col("start").alias("word"), "own", F.struct("at", "piece", "put", "to", "count", *nothing).alias("c")).groupBy("word", "own").agg(F.collect_list("c").alias("near"))
    fixed = materialize(first.mapInArrow(_choose(shared), "word string, fix string").where("fix is not null"), "scan-fixed")
    rest = unknown.where(~F.contains("word", F.lit("-")) & F.col("word").rlike(_LETTER)).join(fixed, "word", "left_anti").where(F.length("word") > 4).select("word", F.col("clean").alias("own"))
    two = rest.mapInArrow(_twice(edits, possible), "word string, own long, at1 int, piece1 string, put1 string, half string, at int, piece string, put string, to string")
    two = two.join(known.select(F.col("word").alias("to"), F.col("clean").alias("count")), "to")
    second = two.select("word", "own", F.struct("at", "piece", "put", "to", "count", "half", "at1", "piece1", "put1").alias("c")).groupBy("word", "own").agg(F.collect_list("c").alias("near"))
    more = second.mapInArrow(_choose(shared), "word string, fix string").where("fix is not null")
    every = fixed.unionByName(more)
    return unknown.select("word").join(every, "word", "left")


# ---------------------------------------------------------------- furniture

def fold_line(line: str) -> str:
    """A line with its numbers as one digit, without spaces and what scanning confuses, for comparing running lines."""
    s = re.sub(r"(?<![a-zß-ɏ])[0-9lo]*[0-9][0-9lo]*(?![a-zß-ɏ])", "0", line.lower())
    s = re.sub(r"[\s|]+", "", s)
    for a, b in _FOLD:
        s = s.replace(a, b)
    return s.translate(_FOLD_ONE)


#: A number, of which some digits may be misread as letters.
_N = r"(?=[0-9lIoO]*[0-9])[0-9lIoO]{1,5}"
_NUMBER = re.compile(rf"^[\s\[\](){{}}\-–—·|/]*(?:{_N}|[ivxlcdmIVXLCDM1]{{1,8}})[\s\[\](){{}}\-–—·|/]*$")
_OF = re.compile(rf"^\s*\S{{0,12}}\s*[0-9lIoO]{{1,5}}\s*(?:/|of|von|de|sur|\|)\s*{_N}\s*\S{{0,4}}\s*$")
_PAGED = re.compile(rf"^\s*(?:[^\W\d_]{{1,8}}|\S{{1,4}})\s*{_N}\s*\S{{0,3}}\s*$")
_CODED = re.compile(r"^\s*[A-Z]\S{1,5}\.?\s+[0-9lIoO]+\.[0-9lIoO]+\s*/\s*\S+\s*$")
_SPACED = re.compile(r"^\s*(?:\S\s+){3,}\S\s*$")
_TITLED = re.compile(rf"^\s*{_N}\s{{2,}}\S.*$|^.*\S\s{{2,}}{_N}\s*$|^.*\S \| \S.*\| *{_N}\s*$")


def _shape(line: str) -> str:
    for name, pattern in (("number", _NUMBER), ("of", _OF), ("coded", _CODED), ("spaced", _SPACED), ("titled", _TITLED), ("paged", _PAGED)):
        if pattern.match(line):
            return name
    words = line.split()
    if _LETTERS.search(line):
        if line.upper() == line:
            return "upper"
        if len(words) <= 6 and (words[0][:1].isupper() or words[0][:1].isdigit() and words[0][1:2].islower()):
            return "capital"
        return "text"
    return "ideographs" if len(line.strip()) <= 12 else "text"


def _has_room(line: str, following: str, width: int) -> str:
    """Whether the next line's first word would have fitted on this line: running text breaks only where it does not."""
    if not following:
        return "none"
    word = following.split(None, 1)[0]
    need = len(word) + 1 if _LETTERS.match(word) or word[:1].isdigit() else 2
    return "room" if len(line.rstrip()) + need < width else "full"


def line_shape(line: str, top: int, bottom: int, blank_before: bool, blank_after: bool, width: int, room: str, pages: int, versions: int) -> str:
    """The classes of all features of an edge line, as one string; there are few thousand of them however many lines."""
    s = line.rstrip()
    ratio = min(4, int(5 * len(s) / max(1, width)))
    end = "stop" if s.endswith(_SENTENCE_END) else "mark" if s[-1:] in MARKS + ",、，" else "open"
    first = s.lstrip()[:1]
    begin = "lower" if first.islower() else "upper" if first.isupper() else "upper" if re.match(r"[0-9][a-zß-ɏ]", s.lstrip()) else "digit" if first.isdigit() else "other"
    size = "1" if pages <= 1 else "2" if pages == 2 else "3"
    spread = "1" if versions <= 1 else "2" if versions < 5 else "5" if versions < 30 else "30"
    # ideographs are not parted: a dozen characters are as good as a word
    words = max(len(line.split()), len(s) // 12)
    return "|".join((room, "few" if words <= 4 else "many", str(min(top, EDGE)), str(min(bottom, EDGE)), str(int(blank_before)), str(int(blank_after)), str(ratio), _shape(line), end, begin, size, spread))


def _shape_features(shape: str) -> list[str]:
    room, words, top, bottom, before, after, ratio, form, end, begin, size, spread = shape.split("|")
    return [
        f"room={room}", f"room={room},form={form}", f"room={room},size{size}", f"words={words},form={form}", f"room={room},top{top},form={form}", f"words={words},room={room}",
        "bias", f"top{top}", f"bottom{bottom}", f"before{before}", f"after{after}", f"ratio{ratio}", f"form={form}", f"end={end}", f"begin={begin}",
        f"size{size}", f"spread{spread}", f"form={form},top{top}", f"form={form},bottom{bottom}", f"form={form},size{size}", f"form={form},spread{spread}",
        f"end={end},begin={begin}", f"form={form},ratio{ratio}", f"form={form},end={end}", f"size{size},spread{spread}",
    ]


def furniture_shapes(counts: dict[str, int]) -> set[str]:
    """The line shapes that are furniture: a perceptron trained on the shapes whose case is clear, by how often they occur, in a
    fixed order.

    Clear furniture are numbers at the very edge, and lines with room left that run through several pages; clear text are
    lines of words that were broken for want of room, end a sentence, begin small, or close a page.
    """
    yes, no = "furniture", "text"
    examples = []
    for shape, n in sorted(counts.items()):
        room, words, top, bottom, _, _, _, form, end, begin, size, spread = shape.split("|")
        worded = form in ("text", "capital", "ideographs")
        at_edge = top in "01" or bottom in "01"
        if at_edge and (form in ("number", "of", "coded", "spaced", "titled") or (form == "paged" and size in "23")):
            right = 0
        elif top in "01" and room == "room" and end == "open" and words == "few" and (size in "23" or spread in ("5", "30")) and begin != "lower" and form != "text":
            right = 0
        elif worded and (room == "full" or end != "open" or begin == "lower" or words == "many" or (room == "none" and size == "1")):
            right = 1
        else:
            continue
        f = _shape_features(shape)
        examples += [([{"label": yes, "features": f}, {"label": no, "features": f}], right)] * (1 + min(9, n.bit_length() // 2))
    model = AveragedPerceptron()
    model.train(examples, epochs=6)
    return {s for s in counts if model.best(_shape_features(s), (no, yes)) == yes}


_EDGES = "version_pk string, chunk_id string, place long, line_no int, line string, folded string, top int, bottom int, before boolean, after boolean, width int, room string, body boolean, new boolean"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("version_pk", pa.string()), ("chunk_id", pa.string()), ("place", pa.int64()), ("line_no", pa.int32()), ("line", pa.string()), ("folded", pa.string()),
                        ("top", pa.int32()), ("bottom", pa.int32()), ("before", pa.bool_()), ("after", pa.bool_()), ("width", pa.int32()), ("room", pa.string()), ("body", pa.bool_()), ("new", pa.bool_())])
    for b in batches:
        cols: list[list] = [[] for _ in schema]
        for version, chunk, place, text in zip(*(b.column(c).to_pylist() for c in ("version_pk", "chunk_id", "place", "text"))):
            lines = text.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            width = max((len(lines[i].rstrip()) for i in full), default=0)
            seen: set[str] = set()
            for k, i in enumerate(full):
                top, bottom = k, len(full) - 1 - k
                if top > EDGE and bottom > EDGE:
                    continue
                line, body = lines[i], top >= EDGE and bottom >= EDGE
                folded = fold_line(line)
                row = (version, chunk, place, i + 1, line, folded, top, bottom, i == 0 or not lines[i - 1].strip(),
                       i + 1 == len(lines) or not lines[i + 1].strip(), width, _has_room(line, lines[full[k + 1]] if bottom else "", width), body, not body and folded not in seen)
                if not body:
                    seen.add(folded)
                for c, v in zip(cols, row):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("line", "top", "bottom", "before", "after", "width", "room", "pages", "versions")]
        shape = [line_shape(*x) for x in zip(*cols)]
        keep = [b.column(c) for c in ("version_pk", "chunk_id", "place", "line_no", "line", "top", "bottom", "body")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(shape, pa.string())], names=["version_pk", "chunk_id", "place", "line_no", "line", "top", "bottom", "body", "shape"])


def scanned_pages(chunks: DataFrame) -> DataFrame:
    """(version_pk, chunk_id, place, text): the page chunks; place orders a version's pages (page_no, else page_span, else ordinal)."""
    place = F.coalesce("page_no", "page_span.first", "ordinal", F.lit(0)).cast("long")
    return chunks.where((F.col("chunk_type") == PAGE) & F.col("text").isNotNull()).select("version_pk", "chunk_id", place.alias("place"), "text")


def single_pages(pages: DataFrame) -> DataFrame:
    """Each page (version_pk, chunk_id) once; of several texts that have its key always the same one."""
    return pages.groupBy("version_pk", "chunk_id").agg(F.min(F.struct("place", "text")).alias("p")).select("version_pk", "chunk_id", "p.place", "p.text")


def page_edges(pages: DataFrame) -> DataFrame:
    """For pages that are there once, (version_pk, chunk_id, place, furniture, first, last): furniture lines, first and last line of text."""
    form = ["form", "form2"]  # 128 bits of the folded line, which is shuffled several times
    rows = pages.mapInArrow(_edges, _EDGES).withColumns({"form": F.xxhash64("folded"), "form2": F.xxhash64(F.lit(1), "folded")}).drop("folded")
    rows = materialize(rows, "scan-edges")
    here = rows.where("not body").groupBy("version_pk", *form).agg(F.sum(F.col("new").cast("long")).alias("pages"))
    everywhere = here.groupBy(*form).agg(F.count("*").alias("versions"))
    # page numbers fold alike everywhere: what a line's folded form has in all is joined to one row a version, then by version
    seen = materialize(here.join(everywhere, form), "scan-folded")
    counted = rows.drop("new").join(seen, ["version_pk", *form], "left").drop(*form)
    counted = counted.withColumns({"pages": F.coalesce("pages", F.lit(0)), "versions": F.coalesce("versions", F.lit(0))})
    shaped = materialize(counted.mapInArrow(_shapes, "version_pk string, chunk_id string, place long, line_no int, line string, top int, bottom int, body boolean, shape string"), "scan-shapes")
    counts = {r.shape: r["count"] for r in shaped.where("not body").groupBy("shape").count().collect()}
    # shapes are classes: a few thousand, however many lines
    names = rows.sparkSession.createDataFrame([(x, True) for x in sorted(furniture_shapes(counts))], "shape string, hit boolean")
    marked = shaped.join(F.broadcast(names), "shape", "left").withColumn("furniture", ~F.col("body") & F.col("hit").isNotNull())
    text = ~F.col("furniture")
    return marked.groupBy("version_pk", "chunk_id").agg(
        F.max("place").alias("place"),
        F.sort_array(F.collect_list(F.when(F.col("furniture"), F.col("line_no")))).alias("furniture"),
        F.min(F.when(text, F.struct("line_no", "line"))).getField("line").alias("first"),
        F.max(F.when(text, F.struct("line_no", "line"))).getField("line").alias("last"),
    )


# ---------------------------------------------------------------- pages

class Editor:
    """What is known and decided about words, for the repair of a page; what it is asked and cannot tell is in asks."""

    def __init__(self, known: set[str], fixes: dict[str, str | None], model: AveragedPerceptron | None = None):
        self.known, self.fixes, self.model = known, fixes, model or AveragedPerceptron()
        self.answers: dict[str, str | None] = {}
        self.asks: set[str] = set()

    def _fix(self, word: str) -> str | None:
        """What a word should read: itself for known ones, null for unknown ones that stay."""
        if word in self.known:
            return word
        if word in self.fixes:
            return self.fixes[word]
        if word in self.answers:
            return self.answers[word]
        self.asks.add(word)
        return None

    def knows(self, word: str) -> bool:
        return self._fix(word) == word

    def repair(self, word: str) -> str:
        if len(word) < 2 or not _LETTERS.search(word):
            return word
        return self._fix(word) or word

    def joins(self, first: str, mark: str, second: str) -> bool:
        """Whether a mark between two parts only breaks a word."""
        f = self.join_features(first.lower(), mark, second)
        return self.model.score(f, "join") >= self.model.score(f, "part")

    def join_features(self, first: str, mark: str, second: str) -> list[str]:
        low = second.lower()
        joined, compound = self._fix(first + low) is not None, bool(low) and self.knows(f"{first}-{low}")
        kind = "hyphen" if mark in "-‐‑" else "other"
        f, s = self.knows(first), bool(low) and self.knows(low)
        return ["join", f"mark={mark}", f"joined={joined},compound={compound},{kind}", f"first={f},second={s},{kind}", f"second={'none' if not low else 'lower' if second[0].islower() else 'other'},{kind}",
                f"joined={joined},first={f},second={s}"]


def fit_joins(texts: list[str], editor: Editor) -> AveragedPerceptron:
    """The perceptron of line ends, from sample pages: marks that only break words, and parts whose whole alone is a word, are joins."""
    examples = []
    for text in texts:
        for _, hit, nxt in line_ends(text.split("\n")):
            if not nxt:
                continue
            first, mark, second = hit.group(1).lower(), hit.group(2), nxt.group(1)
            joined, compound = editor._fix(first + second.lower()) is not None, editor.knows(f"{first}-{second.lower()}")
            if mark in "¬­" or (joined and not compound):
                right = 0
            elif compound and not joined:
                right = 1
            else:
                continue
            f = editor.join_features(first, mark, second)
            examples.append(([{"label": "join", "features": f}, {"label": "part", "features": f}], right))
    model = AveragedPerceptron()
    model.train(examples, epochs=4)
    return model


def _recase(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def _split_at(whole: str, fixed: str) -> int:
    """Where two spellings first differ."""
    i = 0
    while i < min(len(whole), len(fixed)) and whole[i] == fixed[i]:
        i += 1
    return i


def repair_page(editor: Editor, text: str, furniture: list[int], previous: str | None, following: str | None) -> tuple[list[tuple[int, str]], str, bool, bool]:
    """(cases, text, goes_on, continues): noise by line, the page's paragraphs, whether its last word ends on the next page
    or its first began on the one before. previous and following: last line before and first line after the page's own."""
    lines = text.split("\n")
    off = set(furniture)
    cases: list[tuple[int, str]] = [(i, "furniture") for i in sorted(off)]
    body = [i for i, x in enumerate(lines, 1) if i not in off and x.strip()]
    bad: set[int] = set()
    fixed: dict[int, str] = {}
    prior = _broken(previous) if previous else None
    goes_on = continues = False
    glue: set[int] = set()
    for k, i in enumerate(body):
        line = lines[i - 1]
        hit = _broken(line)
        nxt_line = lines[body[k + 1] - 1] if k + 1 < len(body) else following
        nxt = _BEGIN.match(nxt_line) if nxt_line else None
        joined = bool(hit) and editor.joins(hit.group(1), hit.group(2), nxt.group(1) if nxt else "")
        head = _BEGIN.match(line) if prior else None
        if joined:
            cases.append((i, "hyphen"))
            glue.add(i)
            if nxt:
                whole = (hit.group(1) + nxt.group(1)).lower()
                whole_fixed = editor.repair(whole)
                if whole_fixed != whole and _split_at(whole, whole_fixed) < len(hit.group(1)):
                    bad.add(i)
        if head and editor.joins(prior.group(1), prior.group(2), head.group(1)):
            whole = (prior.group(1) + head.group(1)).lower()
            fix = editor.repair(whole)
            if fix != whole and _split_at(whole, fix) >= len(prior.group(1)):
                bad.add(i)
            if k == 0:
                continues = True
        skip_first = head.end(1) if head and prior else -1
        last = hit.start(1) if joined else len(line) + 1
        out, at = [], 0
        if _LETTERS.search(line):
            for m in _WORD.finditer(line):
                if m.start() >= last or m.end() == skip_first:
                    continue
                word = m.group()
                low = word.lower()
                new = editor.repair(low)
                if new != low:
                    bad.add(i)
                    out.append(line[at : m.start()] + _recase(word, new))
                    at = m.end()
        fixed[i] = "".join(out) + line[at:]
        if joined and k + 1 == len(body):
            goes_on = True
        prior = hit if hit else None
    cases += [(i, "misread") for i in sorted(bad)]
    return cases, _paragraphs(editor, lines, body, fixed, glue), goes_on, continues


def _paragraphs(editor: Editor, lines: list[str], body: list[int], fixed: dict[int, str], glue: set[int]) -> str:
    """Lines put together: words broken at line ends are joined, lines within a paragraph run on, empty lines part paragraphs."""
    out: list[str] = []
    for k, i in enumerate(body):
        line = fixed[i].strip()
        if i in glue:
            line = _BROKEN.sub(r"\1", line)
        if not out:
            out.append(line)
            continue
        before = body[k - 1]
        part = any(not lines[j - 1].strip() for j in range(before + 1, i))
        tail = out[-1]
        if before in glue:
            a, b = re.search(r"[A-Za-zÀ-ɏ0-9]+$", tail), _BEGIN.match(line)
            if a and b:
                whole = a.group() + b.group(1)
                new = editor.repair(whole.lower())
                whole = whole if new == whole.lower() else _recase(whole, new)
                out[-1] = tail[: a.start()] + whole + line[b.end() :]
                continue
            out[-1] = tail + line
        elif part:
            out.append(line)
        elif tail[-1:] > "　" and line[:1] > "　" or tail[-1:] in MARKS:
            out[-1] = tail + line
        else:
            out[-1] = f"{tail} {line}"
    return "\n\n".join(out)


_REPAIRED = "version_pk string, chunk_id string, place long, cases array<struct<line_no: int, kind: string>>, text string, goes_on boolean, continues boolean, asks array<string>, page struct<text: string, furniture: array<int>, previous: string, following: string>"
_PAGE_KIND = pa.struct([("text", pa.string()), ("furniture", pa.list_(pa.int32())), ("previous", pa.string()), ("following", pa.string())])


def _repair(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fixes, weights = shared.value
        model = AveragedPerceptron()
        model.weights = weights
        editor = Editor(known, fixes, model)
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            cases, texts, on, off, asks, left = [], [], [], [], [], []
            for text, furniture, previous, following, answers in zip(*(b.column(c).to_pylist() for c in ("text", "furniture", "previous", "following", "answers"))):
                editor.answers, editor.asks = {a["word"]: a["fix"] for a in answers or ()}, set()
                c, t, g, h = repair_page(editor, text, furniture or [], previous, following)
                cases.append([{"line_no": n, "kind": k} for n, k in c])
                texts.append(t)
                on.append(g)
                off.append(h)
                asks.append(sorted(editor.asks))
                left.append({"text": text, "furniture": furniture, "previous": previous, "following": following} if editor.asks else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("version_pk"), b.column("chunk_id"), b.column("place"), pa.array(cases, kind), pa.array(texts, pa.string()), pa.array(on), pa.array(off), pa.array(asks, pa.list_(pa.string())), pa.array(left, _PAGE_KIND)],
                names=["version_pk", "chunk_id", "place", "cases", "text", "goes_on", "continues", "asks", "page"],
            )

    return run


def sample_pages(pages: DataFrame, bound: int = SAMPLE_PAGES) -> list[str]:
    """About bound pages, at most twice as many, chosen by a hash of their key."""
    n = max(1, pages.count())
    draw = F.pmod(F.xxhash64(F.lit(5), "version_pk", "chunk_id"), F.lit(1_000_000)) / 1_000_000
    return [r.text for r in pages.where(draw < min(1.0, bound / n)).select("text").limit(2 * bound).collect()]


def repaired_pages(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """One row a scanned page: its noise by line, its text as paragraphs, and whether its ends are parts of words.

    Null texts are left out, empty ones have no lines; exact duplicates of a page come out once. Pages of a version follow
    each other by place; a page without a neighbour at the next place ends where it ends.
    """
    pages = scanned_pages(chunks)
    words = word_table(chunks, spark)
    known = words.where("known")
    model, edits, near = fit_editor(words)
    unknown = words.where(~F.col("known") & (F.col("page") + F.col("broken") > 0))
    possible = spark.sparkContext.broadcast(word_filter(known))
    decided = materialize(decided_words(spark, unknown, near, known, possible, model, edits), "scan-decided")

    top = known.orderBy(F.desc("clean"), F.desc("page"), "word").limit(COMMON).select("word").toArrow()
    often = unknown.select("word", (F.col("page") + F.col("broken")).alias("n")).orderBy(F.desc("n"), "word").limit(COMMON)
    fixes = decided.join(often, "word", "left_semi").toArrow()
    editor = Editor(set(top.column("word").to_pylist()), dict(zip(fixes.column("word").to_pylist(), fixes.column("fix").to_pylist())))
    editor.model = fit_joins(sample_pages(pages), editor)
    shared = spark.sparkContext.broadcast((editor.known, editor.fixes, editor.model.weights))

    once = single_pages(pages)
    edges = materialize(page_edges(once), "scan-pages")
    after = edges.groupBy("version_pk", (F.col("place") - 1).alias("place")).agg(F.min("first").alias("following"))
    before = edges.groupBy("version_pk", (F.col("place") + 1).alias("place")).agg(F.max("last").alias("previous"))
    around = edges.join(after, ["version_pk", "place"], "left").join(before, ["version_pk", "place"], "left").select("version_pk", "chunk_id", "furniture", "previous", "following")
    rows = once.join(around, ["version_pk", "chunk_id"], "left").select("version_pk", "chunk_id", "place", "text", "furniture", "previous", "following")
    answer = "array<struct<word: string, fix: string>>"
    done = materialize(rows.withColumn("answers", F.lit(None).cast(answer)).mapInArrow(_repair(shared), _REPAIRED), "scan-repaired")

    # pages with words that the broadcast does not tell: few, and all of them finished with the answers
    asked = materialize(done.where(F.size("asks") > 0).select("version_pk", "chunk_id", F.explode("asks").alias("word")), "scan-asked")
    wanted = asked.select("word").distinct()
    told = words.join(wanted, "word", "left_semi").where("known").select("word", F.col("word").alias("fix")).unionByName(decided.join(wanted, "word", "left_semi"))
    told = materialize(told, "scan-told")
    fresh = wanted.join(told, "word", "left_anti").withColumn("clean", F.lit(0).cast("long"))
    letters = fresh.where(F.col("word").rlike(_LETTER) & ~F.contains("word", F.lit("-")) & (F.length("word") > 1))
    close = materialize(near_words(letters.select(F.col("word").alias("start"), F.col("clean").alias("own")), known), "scan-near")
    told = told.unionByName(decided_words(spark, fresh, close, known, possible, model, edits))
    answers = asked.join(told, "word").groupBy("version_pk", "chunk_id").agg(F.collect_list(F.struct("word", "fix")).alias("answers"))
    open_ = done.where(F.size("asks") > 0).select("version_pk", "chunk_id", "place", "page.*").join(answers, ["version_pk", "chunk_id"])
    late = open_.select("version_pk", "chunk_id", "place", "text", "furniture", "previous", "following", "answers").mapInArrow(_repair(shared), _REPAIRED)
    late = materialize(late, "scan-late")
    return done.where(F.size("asks") == 0).unionByName(late).drop("asks", "page")


def page_noise(repaired: DataFrame) -> DataFrame:
    """(version_pk, chunk_id, line_no, kind) of the noise found."""
    return repaired.select("version_pk", "chunk_id", F.explode("cases").alias("c")).select("version_pk", "chunk_id", "c.line_no", "c.kind").distinct()


def paragraphs(repaired: DataFrame, block: int = 256) -> DataFrame:
    """(version_pk, paragraph_no, first_page, text): the paragraphs of each version in page order.

    A paragraph that a page break cuts, by the end of its last line or within a word, is put together again. Numbers are
    prefix sums in two levels (blocks of pages, then pages), so a version of very many pages needs no single task.
    """
    parts = F.split("text", "\n\n")
    rows = repaired.where("text <> ''").select("version_pk", "place", "continues", "goes_on", parts.alias("parts"), F.floor(F.col("place") / block).alias("block"))
    ends = rows.select("version_pk", (F.col("place") + 1).alias("place"), F.element_at("parts", -1).alias("tail"), "goes_on")
    ends = ends.groupBy("version_pk", "place").agg(F.max(F.struct("tail", "goes_on")).alias("e"))
    joined = rows.join(ends, ["version_pk", "place"], "left")
    closed = F.rlike(F.col("e.tail"), F.lit(r"[.!?。！？:：;)）\"”]\s*$"))
    opens = F.coalesce(~closed, F.lit(False))
    counted = joined.withColumn("new", F.size("parts") - opens.cast("int")).withColumn("glued", F.coalesce(F.col("e.goes_on"), F.lit(False)))
    sums = counted.groupBy("version_pk", "block").agg(F.sum("new").alias("s"))
    early = Window.partitionBy("version_pk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("version_pk", "block", F.coalesce(F.sum("s").over(early), F.lit(0)).alias("base"))
    inside = Window.partitionBy("version_pk", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("within", F.coalesce(F.sum("new").over(inside), F.lit(0))).join(base, ["version_pk", "block"])
    start = F.col("base") + F.col("within") - opens.cast("int") + 1
    each = numbered.select("version_pk", "place", start.alias("start"), "glued", F.posexplode("parts").alias("k", "part"))
    piece = F.struct("place", "k", "part", ((F.col("k") == 0) & F.col("glued")).alias("glued"))
    whole = each.groupBy("version_pk", (F.col("start") + F.col("k")).alias("paragraph_no")).agg(F.min("place").alias("first_page"), F.array_sort(F.collect_list(piece)).alias("ps"))
    cjk: Column = lambda a: F.rlike(a, F.lit(r"[　-鿿＀-￯]$"))
    text = F.aggregate("ps", F.lit(""), lambda s, p: F.when((s == "") | p["glued"] | cjk(s), F.concat(s, p["part"])).otherwise(F.concat(s, F.lit(" "), p["part"])))
    return whole.select("version_pk", F.col("paragraph_no").cast("int").alias("paragraph_no"), "first_page", text.alias("text"))
