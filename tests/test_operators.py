"""Operators of the pipeline on small fixtures: values, invariants and edges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.api import Corpus
from docloom.functions import identity as ident
from docloom.io import clear_materialized
from docloom.operators import events as ev
from docloom.operators import manifests as mf
from docloom.operators import markdown as md
from docloom.operators import pages as pg
from docloom.operators import text as tx
from docloom.operators import vectors as vec
from docloom.operators.running import numbered
from docloom.sources import ocr


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_keys_are_escaped(spark):
    """Every byte but unreserved characters is written in hexadecimal, so the mark between the parts occurs in none of them."""
    from urllib.parse import quote

    parts = ["north & co", "inbox#7/a", "Ablage/Straße 5%+x.docx", "R~2#9"]
    df = spark.createDataFrame([tuple(parts)], "t string, b string, k string, v string")
    r = df.select(ident.version_pk(*(F.col(c) for c in "tbkv")).alias("pk")).withColumn("uri", ident.uri_of_version_pk(F.col("pk"))).first()
    assert r.pk == "#".join(quote(p, safe="") for p in parts)
    assert r.uri == f"s3://{parts[1]}/{quote(parts[2])}?versionId={quote(parts[3], safe='')}"
    assert one(spark, "a ~*-_.ü", ident.escape_part) == quote("a ~*-_.ü", safe="")


@pytest.mark.parametrize(("low", "high"), [("f", "10"), ("9", "A"), (None, "0"), (" ", "1"), ("0" * 40 + "2", "3"), ("F" * 32, "1" + "0" * 32)])
def test_sequencers_order_by_value(spark, low, high):
    df = spark.createDataFrame([(low, high)], "a string, b string")
    assert df.select(ident.sequencer_order(F.col("a")) < ident.sequencer_order(F.col("b"))).first()[0]


def test_equal_sequencers(spark):
    df = spark.createDataFrame([("a", "0A ")], "a string, b string")
    assert df.select(ident.sequencer_order(F.col("a")) == ident.sequencer_order(F.col("b"))).first()[0]
    assert one(spark, " ab ", ident.sequencer_norm) == "AB".zfill(32)
    assert one(spark, "", ident.sequencer_norm) is None


def _record(name="ObjectCreated:Put", key="plans%2Froof.md", **thing):
    return {"eventVersion": "2.3", "eventSource": "aws:s3", "eventName": name, "s3": {"bucket": {"name": "b"}, "object": {"key": key, "versionId": "r8", "sequencer": "001", **thing}}}


def _wrap(envelope, times):
    for _ in range(times):
        envelope = {"Records": [{"eventSource": "aws:sqs", "body": json.dumps(envelope)}]}
    return envelope


def test_envelopes(spark):
    cases = {1: {"Records": [_record()]}, 2: _wrap({"Records": [_record(name="ObjectRemoved:Delete")]}, 1), 3: {"Event": "s3:TestEvent"}, 4: _wrap({"Records": [_record()]}, 6), 5: {"x": 1},
             6: {"Records": [_record(name="ObjectRestore:Post"), _record(versionId=None)]}, 7: _wrap({"Records": [_record(key="a+b%zz.md")]}, 3)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [(8, None), (9, "not json")], "envelope_id int, payload string")
    records = ev.envelope_records(df)
    errors = {r.envelope_id: r.error for r in records.where("error is not null").collect()}
    assert errors == {4: "nested too deep", 5: "no records", 8: "no records", 9: "no records"}
    old = spark.createDataFrame([(20, json.dumps({"Records": [_record() | {"eventVersion": v}]})) for v in ("2.0", "1.9", None, "3.0", "x")], "envelope_id int, payload string")
    assert sorted(r.error for r in ev.refused_records(ev.envelope_records(old)).collect()) == ["event version"] * 4
    assert {(r.envelope_id, r.error) for r in ev.refused_records(records).collect()} == {(k, v) for k, v in errors.items()} | {(6, "no version")}
    got = {(r.envelope_id, r.operation, r.object_key, r.trace_id) for r in ev.messages(records).collect()}
    assert got == {(1, "UPSERT", "plans/roof.md", "s3://b/plans/roof.md?versionId=r8"), (2, "DELETE", "plans/roof.md", "s3://b/plans/roof.md?versionId=r8"), (7, "UPSERT", "a b%zz.md", "s3://b/a%20b%25zz.md?versionId=r8")}


def test_events_are_judged_like_a_loop(spark):
    rng = random.Random(3)
    log = [(rng.choice(["hot", "hot", "b", "c"]), f"{rng.random():.9f}", f"v{i}", f"{rng.randint(0, 200):032X}", rng.choice(["UPSERT", "DELETE"])) for i in range(400)]
    want, top, seen = {}, {}, set()
    for o, a, v, s, op in sorted(log, key=lambda r: (r[1], r[3], r[2])):
        if op == "DELETE" and o not in seen:
            want[v] = "delete_without_object"
        elif o in top and s <= top[o]:
            want[v] = "stale"
        else:
            want[v], top[o] = "accepted", s
        if op == "UPSERT":
            seen.add(o)
    judged = ev.judge_events(spark.createDataFrame(log, "object string, arrival string, version string, seq string, op string"))
    assert {r.version: r.reason for r in judged.collect()} == want
    latest = {r.object: r.seq for r in ev.latest_versions(judged).collect()}
    assert latest == top


def test_numbers_run_through_blocks(spark):
    rows = [("a", i * 7919 % 5000) for i in range(3000)] + [("b", 1), (None, 2)]
    got = numbered(spark.createDataFrame(rows, "k string, v int").repartition(4), ["k"], ["v"], "n", "t").collect()
    a = sorted((r.v, r.n) for r in got if r.k == "a")
    assert [n for _, n in a] == list(range(1, 3001)) and len(got) == 3001


MD = "# A\nintro\nmore\n\n### B\n- x\n- y\nlazy\n\n```py\n# no heading\n\ncode\n```\n### C\n> q\n\n| a | b |\n| - | - |\n\n\n\n"


def test_blocks_and_paths(spark):
    docs = spark.createDataFrame([(1, MD, 7), (2, "", 7), (3, None, 7), (4, "plain", 7), (5, "```\nopen fence\n# x", 7)], "doc_id long, text string, kind int")
    got = [(r.doc_id, r.kind, r.text) for r in md.blocks(docs).orderBy("doc_id", "block_no").collect()]
    assert [k for d, k, _ in got if d == 1] == ["heading", "paragraph", "heading", "list", "code_fence", "heading", "blockquote", "table"]
    assert got[3][2] == "- x\n- y\nlazy" and got[4][2] == "```py\n# no heading\n\ncode\n```"
    assert [k for d, k, _ in got if d == 5] == ["code_fence"] and [k for d, k, _ in got if d == 4] == ["paragraph"]
    paths = {(r.doc_id, r.section_no): (list(r.header_path), r.kind) for r in md.sections(docs).collect()}
    assert paths[1, 2] == (["A", "B"], "heading_section") and paths[1, 3][0] == ["A", "B", "C"] and paths[4, 0] == ([], "preamble")


@pytest.mark.parametrize(("text", "kinds"), [
    ("Title\n=====\nbody", ["heading1", "paragraph"]), ("Two\nlines\n---", ["heading2"]), ("a\n\n---\n\nb", ["paragraph", "paragraph"]), ("* * *\nx", ["paragraph"]),
    ("a\n\n    code\n\n    more\n\nx", ["paragraph", "code_block", "paragraph"]), ("x\n    lazy", ["paragraph"]), ("<div>\n# no\n</div>\n\n# yes", ["html_block", "heading1"]), ("x\n<b>y</b>", ["paragraph"]),
    ("- a\n\n- b\n\n  c\n\nd", ["list", "paragraph"]), ("- a\n\n1. b", ["list", "list"]), ("- a\n\n* b", ["list", "list"]), ("a | b\n--- | ---\n1 | 2\n\n| x |", ["table", "paragraph"]),
    ("~~~\n```\n~~~\n```\nx", ["code_fence", "code_fence"]), ("```a`b\nx", ["paragraph"]), ("> a\nb\n\n> c", ["blockquote", "blockquote"]), ("#no\n\n#### Yes ##", ["paragraph", "heading4"]), ("\tcode", ["paragraph"]),
])
def test_block_kinds(text, kinds):
    assert [b["kind"] + str(b["level"] or "") for b in md.read_blocks(text)] == kinds


def test_heading_paths_drop_their_marks():
    path = [b["header_path"] for b in md.read_blocks("# One #\n\nTwo\n---\n\n### \n\nx") if b["kind"] != "paragraph"]
    assert path == [["One"], ["One", "Two"], ["One", "Two"]]


def test_chunks_stay_within_the_limit_and_keep_all_text(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n))
    docs = [(i, "\n\n".join([f"## H{i}"] + [words(rng.randint(1, 400)) for _ in range(6)])) for i in range(6)] + [(99, "Plan\n" + "brick " * 1900), (100, "x" * 9000), (101, None)]
    rows = md.chunks(spark.createDataFrame(docs, "doc_id long, text string"), soft=100, hard=120)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = rows.orderBy("doc_id", "chunk_id").collect()
    assert all(r.token_estimate <= 120 for r in rows)
    for i, text in docs[:-1]:
        mine = [r for r in rows if r.doc_id == i]
        assert "".join("".join(r.text.split()) for r in mine) == "".join(text.split())
        assert [r.chunk_no for r in mine] == list(range(1, len(mine) + 1)) and all(1 <= r.part <= r.parts for r in mine)


def test_oversized_chunks_expand_in_order(spark):
    rows = spark.createDataFrame([("a", "w" * 50, 1), ("b", " ".join(str(i) for i in range(200)), 2), ("c", None, 3)], "chunk_id string, text string, n int")
    got = md.expand_oversized(rows, 40).collect()
    assert [(r.chunk_id, r.split_from, r.split_index) for r in got if r.n == 2][:2] == [("b#part01", "b", 1), ("b#part02", "b", 2)]
    assert "".join("".join(r.text.split()) for r in got if r.n == 2) == "".join(str(i) for i in range(200)) and all(len(r.text) <= 80 for r in got if r.n == 2)
    assert [(r.chunk_id, r.split_from, r.text) for r in got if r.n != 2] == [("a", None, "w" * 50), ("c", None, None)]


def test_text_expressions(spark):
    assert one(spark, "a\r\nb\n\n\n\nc \n", tx.normalize_text) == "a\nb\n\nc"
    assert [one(spark, x, tx.estimate_tokens) for x in (None, "", "  ", "abcd", "a b  c", "x" * 9)] == [0, 0, 0, 1, 2, 3]
    assert one(spark, "z" * 600, tx.preview) == "z" * 511 + "…" and one(spark, None, tx.preview) is None
    assert one(spark, 'x ![a](<u1> "t") ![b](u2) ![c](u1)', tx.image_urls) == ["u1", "u2"]
    assert one(spark, "abcdefgh  ", lambda c: tx.forced_windows(c, 3)) == ["abc", "def", "gh"]
    hosts = ["*.x.com", "y.org"]
    assert [one(spark, u, lambda c: tx.allowed_host(c, hosts)) for u in ("https://a.x.com/1", "https://x.com", "http://y.org", "https://y.org:8/q", None)] == [True, False, False, True, False]


def test_page_windows(spark):
    schema = "version_pk string, chunk_id string, chunk_type string, text string, page_no int, page_span struct<first:int,last:int>, ordinal int"
    rows = [("v", f"c{i}", "page_text_chunk", t, i if i != 3 else None, (3, 3) if i == 3 else None, i) for i, t in enumerate(["left leaf", "right leaf", " ", "back leaf", None], 1)]
    pages = pg.text_pages(spark.createDataFrame(rows + rows[:1], schema))
    assert [(r.first, r.last) for r in pg.short_windows(pages).orderBy("first").collect()] == [(1, 2), (2, 4)]
    assert [(r.first, r.last, r.pages) for r in pg.part_windows(pages, part=2).collect()] == [(1, 2, 2)]


def test_search_skips_vectors_without_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0]), (6, [2.0, 0.0])], "vec_id long, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, q array<float>")
    assert [(r.vec_id, r.distance) for r in vec.vector_topk(q, v, 3).orderBy("rank").collect()] == [(1, 0.0), (6, 0.0), (4, 0.2929)]
    assert vec.vector_topk(q.limit(0), v, 3).count() == 0 and vec.vector_topk(q, v.limit(0), 3).count() == 0
    own = spark.createDataFrame([("b", [1.0, 0.0], "t1"), ("a", [2.0, 0.0], "t1"), ("c", [1.0, 0.0], "t2"), ("d", [1.0, 0.0], None)], "vec_id string, vector array<float>, tenant string")
    asked = spark.createDataFrame([(0, [1.0, 0.0], "t1"), (1, [1.0, 0.0], None)], "qid int, q array<double>, tenant string")
    assert [(r.qid, r.vec_id) for r in vec.vector_topk(asked, own, 5, same=["tenant"]).orderBy("rank").collect()] == [(0, "a"), (0, "b")]


def test_ranks_fuse_and_are_governed(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a", 0.1), (0, 0, 2, "b", 0.2), (0, 1, 1, "b", 0.3), (0, 1, 2, "c", 0.1)], "qid int, profile_idx int, rank int, vec_id string, distance double")
    top = vec.fused_topk(vec.fuse_ranks(lists), 3)
    got = {r.vec_id: (r.place, r.hits, r.distance) for r in top.collect()}
    assert got == {"b": (1, 2, 0.2), "a": (2, 1, 0.1), "c": (3, 1, 0.1)}
    state = spark.createDataFrame([("b", True, True), ("a", False, True)], "vec_id string, is_deleted boolean, is_ready boolean")
    flagged = top.withColumn("is_latest", F.lit(True))
    assert [(r.vec_id, r.final_rank) for r in vec.govern(flagged, state).orderBy("final_rank").collect()] == [("a", 1), ("c", 2)]
    assert [r.vec_id for r in vec.govern(top.withColumn("is_latest", F.lit(False)), state).collect()] == ["a"]


def test_neighbours_ignore_gaps(spark):
    c = spark.createDataFrame([("v", "a", 1), ("v", "b", 5), ("v", "c", 9), ("w", "d", 1)], "version_pk string, chunk_id string, ordinal int")
    m = c.where("chunk_id = 'b'")
    assert sorted((r.offset, r.neighbour_id) for r in vec.neighbours(m, c, 999).collect()) == [(-1, "a"), (1, "c")]


def test_requests_and_profiles(spark):
    schema = "version_pk string, chunk_id string, doc_type string, page_no int, slide_no int, section_path array<string>, metadata map<string,string>"
    c = spark.createDataFrame([("t#b#k#v", "c1", "md", None, None, ["A", "B"], {"doc_type": "own", "empty": " "}), ("t#b#k#v", "c2", None, 3, None, [], None)], schema)
    got = {r.chunk_id: r.metadata for r in mf.requests(c).collect()}
    assert got["c1"]["doc_type"] == "own" and got["c1"]["section_path"] == "A / B" and "empty" not in got["c1"] and "page_no" not in got["c1"]
    assert got["c2"]["page_no"] == "3" and "doc_type" not in got["c2"] and got["c2"]["object_pk"] == "t#b#k"
    table = mf.profile_table(spark, [mf.Profile("p", 4), mf.Profile("q", 4, ("image",)), mf.Profile("r", 4, enabled=False)])
    assert {(r.chunk_id, r.profile_id) for r in mf.fan_out(mf.requests(c), table).collect()} == {("c1", "p"), ("c2", "p")}
    with pytest.raises(ValueError):
        mf.profile_table(spark, [mf.Profile("p", 4)] * 2)


def test_batches_are_full(spark):
    rows = spark.range(1234).selectExpr("'g' as g", "id")
    sizes = [r["count"] for r in mf.batches(rows, "g", ["id"], 500).groupBy("batch_no").count().orderBy("batch_no").collect()]
    assert sizes == [500, 500, 234]


def test_recognition_lines(spark, tmp_path):
    lines = ['{"result": {"layoutParsingResults": [{"markdown": {"text": "a"}}, {"markdown": {"text": " "}}, {"markdown": {"text": "b"}}]}}', "", '{"data": {"markdown": {"text": "c"}}}', "[1]", "broken {", '{"other": 1}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = {r.line_no: (r.markdown, r.error) for r in ocr.line_markdown(ocr.read_lines(spark, str(tmp_path))).collect()}
    assert got == {1: ("a\n\nb", None), 3: ("c", None), 4: (None, "not an object"), 5: (None, "not an object"), 6: (None, None)}
    whole = ocr.document_markdown(ocr.line_markdown(ocr.read_lines(spark, str(tmp_path)))).first()
    assert (whole.pages, whole.markdown) == (2, "a\n\nb\n\nc")


def test_a_corpus(spark, sf_dir):
    c = Corpus(spark, sf_dir, [mf.Profile("a", 64), mf.Profile("b", 32)])
    version = c.read("chunks").first().version_pk
    assert 1 <= c.excerpt(version, version.split("#")[0]).count() <= 3
    assert c.backfill(limit=5).count() == 5 and c.current().count() <= c.state().count()
    assert c.requests().select("profile_id").distinct().count() == 2
    first = c.backfill(limit=5).agg(F.max("object_pk")).first()[0]
    assert c.backfill(after=first, limit=5).agg(F.min("object_pk")).first()[0] > first
    assert clear_materialized(spark) is None


def test_forced_parts_and_packing():
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab c\n#") for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["", " \n ", "x" * 300, "a\n\n" * 80]
    for text in texts:
        parts = md.forced_parts(text, 40)
        assert all(0 < md.tokens(p) <= 40 for p in parts)
        assert "".join("".join(p.split()) for p in parts) == "".join(text.split())
    assert md.forced_parts("y" * 100 + "\n## Next\n" + "z" * 100, 40) == ["y" * 100 + "\n##", "Next\n" + "z" * 100]
    for _ in range(40):
        units = ["w" * rng.randint(1, 90) for _ in range(rng.randint(0, 12))]
        runs = md.packed(units, 30)
        assert "\n\n".join(runs) == "\n\n".join(units)
        assert all(md.tokens(r) <= 30 or "\n" not in r for r in runs)
        assert all(md.tokens(f"{a}\n\n{b.split(chr(10))[0]}") > 30 for a, b in zip(runs, runs[1:]))


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    q = v.selectExpr("vec_id as qid", "vector as q")
    once = sorted(map(tuple, vec.vector_topk(q, v, 3).collect()))
    for name, few in (("BLOCK_BYTES", 200), ("PASS_BLOCKS", 2), ("PRODUCTS", 30)):
        monkeypatch.setattr(vec, name, few)
    assert sorted(map(tuple, vec.vector_topk(q, v, 3).collect())) == once
    for i, x in rows[:5]:
        dist = sorted((round(1 - sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5, 3), j) for j, y in rows)
        assert {j for _, j in dist[:1]} <= {t[0] for t in once if t[1] == i} | {i}
