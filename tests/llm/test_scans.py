"""Scanned pages at their edges: short pages."""

import random

import pyarrow as pa
import pytest
from test_llm import CHUNK, scan_chunks

from docloom.io import materialize
from docloom.llm import scans


@pytest.mark.parametrize(("n", "body"), [(3, []), (4, []), (5, []), (6, []), (7, [4]), (8, [4, 5]), (9, [4, 6])])
def test_lines_are_body_only_away_from_both_edges(n, body):
    page = pa.RecordBatch.from_pylist([{"version_pk": "v", "chunk_id": "c", "place": 1, "text": "\n".join(f"line {i}" for i in range(n))}])
    rows = next(scans._edges(iter([page]))).to_pylist()
    assert [r["line_no"] for r in rows if r["body"]] == body


def test_furniture_of_short_pages_is_found(spark):
    rows, _ = scan_chunks(spark)
    text = ["the primary scheduler delivers the manual", "checksum before the weekly review and the", "regional archive restores another document", "for the long-lived manifest near the hall."]
    for v in range(30):
        for n in (4, 5, 6):
            lines = ["Archive Handbook", *text[: n - 2], "", "Page 5"]
            rows.append((f"s{n}-{v}", 5, "p5", scans.PAGE, "\n".join(lines), 5, None, 0, 0, None))
    repaired = materialize(scans.repaired_pages(spark, spark.createDataFrame(rows, CHUNK)), "t").where("version_pk like 's%'")
    got = {(r.version_pk, r.line_no) for r in scans.page_noise(repaired).where("kind = 'furniture'").collect()}
    assert got == {(f"s{n}-{v}", i) for n in (4, 5, 6) for v in range(30) for i in (1, n + 1)}
    assert not any("Page" in r.text or "Handbook" in r.text for r in scans.paragraphs(repaired).collect())


def test_two_edits_lead_to_all_known_words_and_few_others(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("abcdehilmnorstu") for _ in range(rng.randint(5, 9))) for _ in range(3000)})
    edits = [("l", "i"), ("c", "e"), ("rn", "m"), ("m", "rn"), ("h", "b"), ("0", "o"), ("cl", "d"), ("ii", "u")]
    back = [(put, piece) for piece, put in edits]
    spoil = lambda w: next((w[:i] + b + w[i + len(a) :] for a, b in rng.sample(back, len(back)) if (i := w.find(a)) >= 0), w)
    words = sorted({spoil(spoil(w)) for w in known[::5]} | {"".join(rng.choice("abcdehilmnorstu") for _ in range(7)) for _ in range(200)})
    bits = spark.sparkContext.broadcast(scans.word_filter(spark.createDataFrame([(w,) for w in known], "word string")))
    batch = pa.RecordBatch.from_pylist([{"word": w, "own": 0} for w in words])
    rows = next(scans._twice(edits, bits)(iter([batch]))).to_pylist()
    step = lambda w: {w[:i] + b + w[i + len(a) :] for a, b in edits for i in range(len(w)) if w.startswith(a, i)}
    every = {(w, half, to) for w in words for half in step(w) if len(half) > 4 for to in step(half)}
    got, want = {(r["word"], r["half"], r["to"]) for r in rows}, {x for x in every if x[2] in set(known)}
    assert want and want <= got <= every and len(got - want) <= 0.01 * len(every)


def _shuffled(spark) -> tuple[int, int]:
    """Bytes and rows that the stages of this application have shuffled so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() for x in each), sum(x.shuffleWriteRecords() for x in each)


def test_edges_of_pages_shuffle_little(spark):
    """Pages are shuffled once, not line by line, and what lines fold into goes as a hash."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(f"v{v}", f"p{p}", p, "\n".join(" ".join(word() for _ in range(7)) for _ in range(8))) for v in range(20) for p in range(50)]
    pages = spark.createDataFrame(rows + rows[:200], "version_pk string, chunk_id string, place long, text string")
    before = _shuffled(spark)
    single = getattr(scans, "single_pages", lambda x: x)
    edges = scans.page_edges(single(pages)).collect()
    after = _shuffled(spark)
    size = sum(len(r[3]) for r in rows)
    print((after[0] - before[0]) / size, (after[1] - before[1]) / len(rows))
    assert len(edges) == len(rows)
    assert after[0] - before[0] <= 4 * size, (after[0] - before[0]) / size


def test_a_key_with_two_texts_has_one_of_them(spark):
    rows = [("v", f"p{p}", p, "\n".join(f"{t} line {i} of the page" for i in range(n))) for p in range(40) for t, n in (("alpha", 12), ("beta", 5))]
    pages = spark.createDataFrame(rows, "version_pk string, chunk_id string, place long, text string")
    for part in (pages, pages.orderBy("text"), pages.orderBy(pages.text.desc())):
        got = scans.single_pages(part.repartition(3)).collect()
        assert len(got) == 40 and all(r.text.startswith("alpha") for r in got)
