"""The text operators on small fixtures: brute force, round trips, held-out accuracy, and their edges."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.io import materialize
from docloom.llm import arrays, languages, leaks, levels, mixture, pieces, scans
from docloom.llm.perceptron import AveragedPerceptron

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, tokens int, score double, grade int, item string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None, "k", 1, 0.5, 3, "x") for i, t, lang, src in rows], DOCS)


# ------------------------------------------------------------ arrays

def test_tokens_are_words_and_single_ideographs():
    texts = ["Ab-c 12,x", None, "", "中文A b。", "ÄÖ\x00q", "𠀀𠀁"]
    t = arrays.tokenize(texts)
    got = [[] for _ in texts]
    for s, e, k in zip(t.start, t.end, t.text):
        got[k].append("".join(map(chr, t.points[s:e])))
    assert got == [["Ab", "c", "12", "x"], [], [], ["中", "文", "A", "b"], ["ÄÖ", "q"], ["𠀀", "𠀁"]]
    same = arrays.tokenize(["word other", "x WORD", "ｗｏｒｄ"])
    assert same.hash[0] == same.hash[3] == same.hash[4] != same.hash[1]


def test_sentences_end_at_stops_but_not_at_abbreviations():
    t = arrays.tokenize(["See e.g. v1.0 and no. 4. Then go! 好。行\n\nnew block\n- item"])
    first = arrays.sentence_starts(t)
    begins = ["".join(map(chr, t.points[s:e])) for s, e, f in zip(t.start, t.end, first) if f]
    assert begins == ["See", "Then", "好", "行", "new", "item"]


def test_perceptron_learns_a_rule():
    rng = random.Random(0)
    model = AveragedPerceptron()
    make = lambda x: [{"label": k, "features": [f"x{x % 7}", "bias"]} for k in ("a", "b")]
    model.train([(make(x), int(x % 7 > 3)) for x in (rng.randint(0, 99) for _ in range(300))])
    assert all(model.best([f"x{i}", "bias"], ("a", "b")) == ("b" if i > 3 else "a") for i in range(7))


# ------------------------------------------------------------ problem 1

CHUNK = "version_pk string, ordinal int, chunk_id string, chunk_type string, text string, page_no int, page_span struct<first:int,last:int>, line_no int, furniture int, metadata map<string,string>"
CLEAN = "The primary scheduler delivers the manual checksum before the weekly review and the regional archive restores another document for the long-lived manifest near the hall"


def scan_chunks(spark):
    rng = random.Random(1)
    words = CLEAN.split()
    rows = []
    for i in range(40):
        rows.append((f"m{i}", 1, "c1", "section_text_chunk", ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(8)), None, None, 0, 0, None))
    confuse = [("m", "rn"), ("d", "cl"), ("l", "1"), ("e", "c"), ("h", "b")]
    truth = set()
    for v in range(30):
        for p in range(1, 5):
            lines, width = [], 48
            lines.append("Archive Handbook")
            line = ""
            for k in range(70):
                w = rng.choice(words)
                bad = rng.random() < 0.03 and len(w) > 5
                if bad:
                    a, b = rng.choice(confuse)
                    bad = a in w[1:]
                    w = w[0] + w[1:].replace(a, b, 1) if bad else w
                if len(line) + 1 + len(w) > width:
                    room = width - len(line) - 2
                    if not bad and room >= 3 and len(w) - room >= 3 and "-" not in w:
                        truth.add((f"v{v}", f"p{p}", len(lines) + 1, "hyphen"))
                        lines.append(f"{line} {w[:room]}¬")
                        line = w[room:]
                        continue
                    lines.append(line)
                    line = w
                else:
                    line = f"{line} {w}".strip()
                if bad:
                    truth.add((f"v{v}", f"p{p}", len(lines) + 1, "misread"))
            lines.append(line + ".")
            lines += ["", f"Page {p}"]
            truth |= {(f"v{v}", f"p{p}", 1, "furniture"), (f"v{v}", f"p{p}", len(lines), "furniture")}
            rows.append((f"v{v}", p, f"p{p}", scans.PAGE, "\n".join(lines), p if p != 2 else None, (2, 2) if p == 2 else None, 0, 0, None))
    return rows, truth


def test_noise_of_scans_is_found_and_repaired(spark):
    rows, truth = scan_chunks(spark)
    edges = [("e", 1, "x1", scans.PAGE, None, 1, None, 0, 0, None), ("e", 2, "x2", scans.PAGE, "", None, None, 0, 0, None), ("e", 3, "x3", scans.PAGE, "word " * 20_000, 3, None, 0, 0, None), (None, None, None, None, None, None, None, 0, 0, None)]
    repaired = materialize(scans.repaired_pages(spark, spark.createDataFrame(rows + rows[:50] + edges, CHUNK)), "t")
    got = {(r.version_pk, r.chunk_id, r.line_no, r.kind) for r in scans.page_noise(repaired).collect()}
    for kind in ("furniture", "hyphen", "misread"):
        a, b = {x for x in got if x[3] == kind}, {x for x in truth if x[3] == kind}
        assert len(a & b) >= 0.9 * len(b), (kind, sorted(b - a)[:5])
        assert len(a & b) >= 0.9 * len(a), (kind, sorted(a - b)[:5])
    text = {r.version_pk: r.text for r in scans.paragraphs(repaired).where("paragraph_no = 1").collect()}
    known = set(re.findall(r"\w+", CLEAN))
    found = re.findall(r"\w+", " ".join(text[f"v{v}"] for v in range(30)))
    assert sum(w in known for w in found) > 0.98 * len(found)


def test_scans_without_pages_or_clean_text(spark):
    none = spark.createDataFrame([], CHUNK)
    assert scans.page_noise(scans.repaired_pages(spark, none)).count() == 0
    only = spark.createDataFrame([("v", 1, "p", scans.PAGE, "one line\n\n3", 1, None, 0, 0, None)], CHUNK)
    assert scans.paragraphs(scans.repaired_pages(spark, only)).count() == 1


# ------------------------------------------------------------ problem 2

TEXTS = {
    "en": "The reader moves the folder to the desk before the weekly review and writes the number of the invoice",
    "de": "Der Leser legt den Ordner vor der Besprechung auf den Tisch und schreibt die Nummer der Rechnung",
    "fr": "Le lecteur pose le dossier sur la table avant la revue et note le numéro de la facture",
    "es": "El lector deja la carpeta sobre la mesa antes de la revisión y anota el número de la factura",
    "zh": "读者在评审之前把文件夹放在桌上，并写下发票的号码，然后通知值班人员。",
    "ja": "読者は会議の前に書類を机に置き、請求書の番号を書いてから担当者に知らせる。",
}


def phrases(lang, n, rng):
    if lang in ("zh", "ja"):
        parts = re.split("[，、。]", TEXTS[lang])[:-1]
        return "。".join(rng.choice(parts) for _ in range(n)) + "。"
    words = TEXTS[lang].split()
    return " ".join(rng.choice(words) for _ in range(n * 5))


def test_segments_in_another_language_are_found(spark):
    rng = random.Random(4)
    labelled = docs(spark, [(i, "\n\n".join(phrases(lang, 6, rng) for _ in range(4)), lang if i % 2 else lang.upper() + "-XX", "s") for i, lang in enumerate(list(TEXTS) * 12)])
    rows, want = [], set()
    for v in range(24):
        main = list(TEXTS)[v % 6]
        other = list(TEXTS)[(v + 1 + v // 6) % 6]
        segs = [phrases(main, 10, rng), "```\nx: 1\n```", phrases(main, 8, rng), "| a | b |\n| - | - |", phrases(other, 3, rng) if main != other else phrases(main, 3, rng), "", "7731"]
        rows.append((f"v{v}", 1, "c", "section_text_chunk", "\n\n".join(segs), None, None, 0, 0, None))
        if main != other:
            want.add((f"v{v}", "c", 5, other))
    edges = [("n", 1, "c", "x", None, None, None, 0, 0, None), ("n", 2, "d", "x", "", None, None, 0, 0, None), ("n", 3, "e", "x", "0x1f " * 50_000, None, None, 0, 0, None)]
    segments = materialize(languages.segment_languages(spark, spark.createDataFrame(rows + rows[:5] + edges, CHUNK), labelled), "t")
    main_of = {f"v{v}": list(TEXTS)[v % 6] for v in range(24)}
    jobs = spark.createDataFrame([(k, lang if i % 3 == 0 else None if i % 3 == 1 else "it") for i, (k, lang) in enumerate(main_of.items())], "version_pk string, language string")
    wrong, other = languages.wrong_labels(segments, jobs)
    got = {(r.version_pk, r.chunk_id, r.seg_no, r.lang) for r in other.collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 1
    assert {(r.version_pk, r.lang) for r in wrong.collect()} == {(k, v) for i, (k, v) in enumerate(main_of.items()) if i % 3}
    assert segments.where("(lang is null) <> (confidence is null) or confidence <= 0 or confidence > 1 or lang is null and seg_no in (1, 3, 5)").count() == 0
    assert segments.where("version_pk like 'v%' and lang is not null and seg_no in (2, 4, 6, 7)").count() == 0
    everyone = {r.version_pk: r.lang for r in languages.version_languages(segments).collect()}
    assert {k: everyone[k] for k in main_of} == main_of
    short = materialize(languages.segment_languages(spark, spark.createDataFrame([("s", 1, "c", "x", "Reader\n\n1: 2\n\nLa revue", None, None, 0, 0, None)], CHUNK), labelled), "t")
    assert [r.lang is None for r in short.orderBy("seg_no").collect()] == [False, True, False] and languages.version_languages(short).count() == 1


def test_labels_name_languages(spark):
    cases = {"en": "en", "EN_gb": "en", "zh-Hans": "zh", "deu": "de", " fra ": "fr", "jpn": "ja", "it": None, "unknown": None, "": None, None: None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", languages.label_language(F.col("x")).alias("y")).collect()} == cases


def test_no_labelled_documents_and_no_chunks(spark):
    none = docs(spark, [(1, "text", None, None)])
    chunks = spark.createDataFrame([("v", 1, "c", "x", TEXTS["en"], None, None, 0, 0, None)], CHUNK)
    assert [r.lang for r in languages.segment_languages(spark, chunks, none).collect()] == [None]
    assert languages.segment_languages(spark, chunks.limit(0), none.limit(0)).count() == 0


# ------------------------------------------------------------ problem 5

def _estimate(text):
    return -(-len(" ".join(text.split())) // 4)


PIECE = "version_pk string, chunk_id string, ordinal int, section_path array<string>, text string, token_estimate int, tokens int, item string, piece int"


def test_pieces_cover_their_text_within_the_limit(spark):
    rng = random.Random(6)
    def body(n, sep):
        return sep.join(" ".join("w%d" % rng.randint(0, 999) for _ in range(rng.randint(3, 30))) + "." for _ in range(n))
    texts = [body(600, " "), body(900, "\n\n"), "x" * 20_000, "  " + body(300, "\n") + " \n ", "好" * 9000, "short", "", None, "a " * 2801, "ab\n\n\n   c " * 3000, "  " * 9000]
    rows = [("v", f"c{i}", i, ["S"], t, 5, 1, "i", 0) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows + rows[:3], PIECE)
    over = {(r.chunk_id, r.tokens) for r in pieces.oversized(chunks).collect()}
    assert over == {(f"c{i}", _estimate(t)) for i, t in enumerate(texts) if t and _estimate(t) > 1400}
    got = pieces.split_chunks(chunks).orderBy("chunk_id", "piece_no").collect()
    assert all(r.token_estimate <= 1400 and r.token_estimate == _estimate(r.text) and r.section_path == ["S"] for r in got)
    spans = pieces.pieces(pieces.text_ranges(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts) if t], "item string, text string")), 1400, 50).collect()
    for i, whole in enumerate(texts):
        mine = sorted((r for r in spans if r.item == str(i)), key=lambda r: r.piece_no)
        assert [r.piece_no for r in mine] == list(range(1, len(mine) + 1))
        if whole:
            assert mine[0].first == 0 and mine[-1].last == len(whole)
            assert all(b.first <= a.last < b.last and a.last - b.first <= 200 for a, b in zip(mine, mine[1:]))
            assert all(whole[r.first : r.last].strip().endswith(r.text[-500:]) and r.text in whole for r in mine)
    natural = [r for r in got if r.chunk_id == "c1"][:-1]
    assert all(r.text.endswith(".") for r in natural)


def test_files_are_read_by_ranges(spark, tmp_path):
    text = "".join(f"Zeile {i} mit Umlaut ä und 好.\n" + ("\n" if i % 9 == 0 else "") for i in range(4000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    ranges = pieces.file_ranges(spark, str(tmp_path), size=1001).collect()
    mine = sorted((r for r in ranges if r.item.endswith("a.txt")), key=lambda r: r.no)
    assert "".join(r.text for r in mine) == text and len(mine) > 100
    got = pieces.file_pieces(spark, str(tmp_path), size=5003, limit=300, overlap=20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pieces.pieces(pieces.file_ranges(spark, str(tmp_path), size=997), limit=300, overlap=20).collect()))
    own = sorted((r for r in got if r.item.endswith("a.txt")), key=lambda r: r.piece_no)
    assert all(_estimate(r.text) <= 300 for r in own)
    whole, at = " ".join(text.split()), 0
    for r in own:
        part = " ".join(r.text.split())
        found = whole.find(part, max(0, at - 100))
        assert 0 <= found <= at + 1
        at = found + len(part)
    assert at == len(whole)


# ------------------------------------------------------------ problem 6

ITEM = "item_id long, suite string, lang string, passage string, question string, answer string, doc_id long, text string"


def test_leaks_are_found_by_sentence_and_question(spark):
    rng = random.Random(8)
    nouns, verbs = ["manifest", "queue", "archive", "profile", "drawing", "parser", "bucket"], ["rejects", "restores", "compares", "measures"]
    def sentence(name, n):
        return f"At the {name} depot, the {rng.choice(nouns)} {rng.choice(verbs)} another {rng.choice(nouns)} from batch {n} in the staging account after {n + 7} pallets, while the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}."
    items, planted, rows = [], set(), []
    for i in range(30):
        p = [sentence(f"Name{i}x{k}", 100 + 13 * i + k) for k in range(3)]
        q = f"Which change did the Name{i} depot record once the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}, and how many pages were counted on line {400 + i}?"
        items.append((i, "s", "en", " ".join(p), q, "answer", 0, "t"))
        s = p[1]
        ways = [s, s.replace("the staging", "a\nstaging"), s.upper(), s.replace(",", "").replace(".", ""), f"**{q}**", '{"t": "' + s + '\\n"}']
        for w, text in enumerate(ways):
            d = 1000 + i * 10 + w
            planted.add((d, i))
            filler = [sentence(f"Other{rng.randint(0, 999)}", rng.randint(5000, 9000)) for _ in range(5)]
            rows.append((d, " ".join(filler[:2]) + "\n\n" + text + "\n\n" + " ".join(filler[2:]), "en", "s"))
    rows += [(i, " ".join(sentence(f"Else{rng.randint(0, 9999)}", rng.randint(2000, 4000)) for _ in range(8)), "en", "s") for i in range(300)]
    rows += [(9001, None, None, None), (9002, "", "en", None), (None, "text", "en", None), (9003, "word " * 60_000, "en", "s"), (9004, "the answer", "en", "s")]
    items += [(90, "s", None, None, None, None, 0, "t"), (91, "s", "en", "", "?", "", 0, "t"), (None, "s", "en", "x y z w", "q", "", 0, "t")]
    got = {tuple(r) for r in leaks.leaked_items(spark, docs(spark, rows + rows[:4]), spark.createDataFrame(items, ITEM)).collect()}
    assert len(got & planted) >= 0.97 * len(planted), sorted(planted - got)[:5]
    assert len(got - planted) <= 0.02 * len(planted), sorted(got - planted)[:9]
    assert leaks.leaked_items(spark, docs(spark, rows[:3]), spark.createDataFrame([], ITEM)).count() == 0
    assert leaks.leaked_items(spark, docs(spark, []), spark.createDataFrame(items, ITEM)).count() == 0


def test_common_subsequences():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 70))] for _ in range(2))
        bits = {}
        for i, x in enumerate(a):
            bits[x] = bits.get(x, 0) | 1 << i
        assert leaks.common_length(bits, len(a), b) == slow(a, b)


# ------------------------------------------------------------ problem 7

def test_sources_get_their_shares(spark):
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "好的"]) for _ in range(n))
    rows = [(i, text(rng.randint(5, 60)), "en", ["Big-One", "big_one ", "BIG one"][i % 3]) for i in range(3000)]
    rows += [(10_000 + i, text(20), "en", "small") for i in range(40)] + [(20_000 + i, text(30), "en", "mid") for i in range(500)]
    rows += [(1, None, "en", "small"), (2, "", "en", "small"), (3, "x", "en", None), (None, "alpha beta", "en", "mid"), (7, "x y", "en", "stranger"), (8, "word " * 30_000, "en", "big-one")]
    targets = spark.createDataFrame([("big one", 0.5, 1), ("Small", 0.1, 3), ("mid", 0.3, 2), ("absent", 0.1, 5), ("none", None, None)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mixture(docs(spark, rows), targets)
    r = {x.source: x for x in report.collect()}
    uses = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("epoch").alias("e")).collect()
    caps = {"big one": 1, "Small": 3, "mid": 2}
    assert all(u.n <= caps[u.source] and u.n == u.e for u in uses)
    assert r["absent"].tokens == 0 and r["none"].tokens == 0
    for s, share in (("big one", 0.5), ("Small", 0.1), ("mid", 0.3)):
        assert abs(r[s].share - share / 0.9) < 0.02, (s, r[s])
    assert r["Small"].tokens == 3 * r["Small"].available_tokens or r["mid"].tokens >= 0.97 * 2 * r["mid"].available_tokens or r["big one"].tokens > 0.9 * r["big one"].available_tokens
    again = mixture.mixture(docs(spark, list(reversed(rows))).repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixed.collect()), key=str)
    exact, _ = mixture.mixture(docs(spark, rows), targets, total=1000)
    sums = {x.source: x.t for x in exact.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert 400 < sums["big one"] <= 500 and 250 < sums["mid"] <= 300
    over, _ = mixture.mixture(docs(spark, rows), targets, total=10**9)
    assert over.where("source = 'Small'").groupBy("doc_id").count().where("count <> 3").count() == 0


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mixture(docs(spark, []), targets)
    assert mixed.count() == 0 and [r.tokens for r in report.collect()] == [0]
    mixed, report = mixture.mixture(docs(spark, [(1, "x", "en", "a")]), targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


# ------------------------------------------------------------ problem 8

GRADES = "doc_id long, grader string, grade int, text string, score double"


def test_levels_follow_the_graded_examples(spark):
    rng = random.Random(11)
    pool = {1: "the cat sat on a mat and ate", 2: "the operator restores another manifest before the weekly review", 3: "notwithstanding jurisdictional stipulations the institutional methodology substantiates interoperability"}
    def text(g):
        return " ".join(" ".join(rng.choice(pool[g].split()) for _ in range(5 * g * g)) + "." for _ in range(40 // g))
    rows = [(i, text(1 + i % 3), "en" if i % 5 else None, "s") for i in range(600)]
    edges = [(9001, None, None, None), (9002, "", "en", "s"), (9003, "!!! ???", "en", "s"), (9004, "notwithstanding " * 30_000, "en", "s"), (None, "the cat", "en", "s")]
    grades = [(i, "g1", 1 + i % 3 if rng.random() > 0.1 else 2, "t", 0.0) for i in range(150)] + [(1, "g2", None, "t", 0.0), (None, "g", 2, "t", 0.0), (77777, "g", 1, "t", 0.0)]
    got = levels.reading_levels(spark, docs(spark, rows + edges + rows[:3]), spark.createDataFrame(grades, GRADES)).collect()
    by = {r.doc_id: r.grade for r in got}
    held = [i for i in range(150, 600)]
    assert np.mean([by[i] == 1 + i % 3 for i in held]) > 0.95
    assert by[9001] is None and by[9002] is None and by[9003] is None and by[9004] == 3
    assert len(got) == len(rows) + len(edges) + 3 and all(r.score is None or 1 <= r.score <= 3 for r in got)


def test_levels_settle_at_the_harmonic_solution(spark):
    """Against the linear system solved whole, on a small graph."""
    rng = random.Random(12)
    pool = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(pool[i % 30 : i % 30 + 10]) for _ in range(12)), "en", "s") for i in range(60)]
    grades = [(i, "g", 1 + i // 6 % 3, "t", 0.0) for i in range(0, 60, 6)]
    edges = materialize(levels.graph(docs(spark, rows), spark.createDataFrame(grades, GRADES), 256), "t")
    scores, known, steps = levels.settle(spark, edges, 1e-5, 256)
    got = edges.collect()
    n, d = levels._nodes(256), len(got)
    w = np.zeros((d, n))
    for k, r in enumerate(got):
        w[k, r.nodes] = r.weights
    fixed = np.array([np.nan if r.grade is None else r.grade for r in got])
    mix = np.zeros((d + n, d + n))
    mix[:d, d:], mix[d:, :d] = w, w.T
    mix /= np.maximum(mix.sum(1, keepdims=True), 1e-12)
    free = np.concatenate([np.isnan(fixed), w.sum(0) > 0])
    clamp = np.flatnonzero(~np.isnan(fixed))
    solved = np.linalg.solve(np.eye(free.sum()) - mix[np.ix_(free, free)], mix[np.ix_(free, clamp)] @ fixed[clamp])
    want = np.zeros(d + n)
    want[free] = solved
    assert known.sum() == (w.sum(0) > 0).sum() and 3 < steps < levels.MOST_STEPS
    assert np.abs(scores - want[d:])[known > 0].max() < 1e-3


def test_levels_without_grades_or_documents(spark):
    none = spark.createDataFrame([], GRADES)
    assert [r.grade for r in levels.reading_levels(spark, docs(spark, [(1, "some text", "en", "s")]), none).collect()] == [None]
    assert levels.reading_levels(spark, docs(spark, []), none).count() == 0


# ------------------------------------------------------------ queries

def test_queries_keep_their_columns(spark, sf_dir):
    from docloom.llm.queries import QUERIES

    want = {"p1_found": ["version_pk", "chunk_id", "line_no", "kind"], "p2_found": ["version_pk", "chunk_id", "seg_no", "lang"], "p5_found": ["version_pk", "chunk_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "grade"]}
    for name, columns in want.items():
        df = QUERIES[name](spark, sf_dir)
        assert df.columns == columns
        rows = df.collect()
        assert len(rows) == len(set(rows)) > 0, name


@pytest.mark.parametrize("name", ["p5_found"])
def test_matches_sql(spark, sf_dir, name):
    import duckdb

    from docloom.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    c.execute(f"create view chunks as select * from '{sf_dir}/chunks.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).collect())) == sorted(c.sql(SQL[name]).fetchall())
