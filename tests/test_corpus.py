"""Names, plug-ins, contracts, extraction, search and sinks on small fixtures, and their edges."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import one

from docloom.api import Corpus
from docloom.functions import names as nm
from docloom.functions import plugins as pl
from docloom.operators import contracts as ct
from docloom.operators import events as ev
from docloom.operators import extract as ex
from docloom.operators import manifests as mf
from docloom.operators import search as se
from docloom.operators import sinks as sk


def test_folders_and_paths(spark):
    folder = lambda k: one(spark, k, lambda c: nm.source_folder(c, F.lit("a#b#c"))).rpartition("--")[0]
    assert folder("x/y/Ｐlan  №3 (final).PDF") == "Plan-No3-final.pdf" and folder("a/.hidden") == "hidden" and folder("///") == "document" and folder("x/..") == "document"
    assert [one(spark, p, nm.clean_path) for p in (" /a/b ", "a//b", "../a", "a/./b", "/", "", None, "a..b/c")] == ["a/b", None, None, None, None, None, None, "a..b/c"]
    got = [one(spark, u, nm.uri_parts) for u in ("s3://b/k%201/x?versionId=v%231", "s3://b/k", "http://b/k", "s3:///k", None)]
    assert got[0] == ("b", "k%201/x", "v#1") and got[1] == ("b", "k", None) and got[2:] == [None, None, None]
    assert [one(spark, m, nm.ending) for m in ("IMAGE/png ", "text/markdown; charset=x", "what/ever", None)] == [".png", ".md", ".bin", ".bin"]
    assert [one(spark, n, nm.safe_filename) for n in ("a b/ü.txt", "...", None)] == ["a-b-.txt", "asset", "asset"]


def test_times_and_flags(spark):
    rows = spark.createDataFrame([("2025-01-01T00:00:00Z", "2024-12-31T23:00:00-02:00"), ("soon", None), (None, " "), ("x", "2025-01-01")], "a string, b string")
    assert [r[0] for r in rows.select(nm.latest_time(F.col("a"), F.col("b"))).collect()] == ["2024-12-31T23:00:00-02:00", "soon", None, "2025-01-01"]
    assert [one(spark, w, nm.truthy) for w in (" YES", "y", "on", "", None)] == [True, True, False, False, False] and one(spark, "on", lambda c: nm.truthy(c, nm.TRUE_REQUEST))
    assert nm.config_flag("Off") is False and nm.config_flag(None, True) is True
    with pytest.raises(ValueError):
        nm.config_flag("maybe")


def test_plug_ins(spark):
    v = np.array([0.5, -2.0], "<f4")
    assert one(spark, base64.b64encode(v.tobytes()).decode(), pl.decoded_vector) == [0.5, -2.0]
    assert [one(spark, x, pl.decoded_vector) for x in ("no base64!", "YWI=", None)] == [None, None, None]
    embed = pl.hashing_embedder(8)
    got = spark.createDataFrame([("red door",), (" ",), (None,)], "t string").select(pl.embedded(F.col("t"), embed).alias("v")).collect()
    assert np.allclose(got[0].v, embed(["red door"])[0]) and got[1].v is None and got[2].v is None
    assert one(spark, "a b c", lambda c: pl.token_count(c, lambda texts: [len(t.split()) for t in texts])) == 3 and one(spark, "abcde", pl.token_count) == 2


def test_contracts_tell_each_fault(spark):
    m = spark.createDataFrame([("v1", "md", "markdown", {"source_format": "markdown", "section_count": "0"}), ("v2", "md", "markdown", {"source_format": "pdf"}), ("v3", "md", "markdown", None), ("v4", "pptx", "python-pptx", {"source_format": "python-pptx", "slide_count": ""})],
                              "version_pk string, doc_type string, source_format string, metadata map<string,string>")
    assert {tuple(r) for r in ct.manifest_violations(m.union(m)).collect()} == {("v2", "source_format differs"), ("v2", "unsupported format"), ("v3", "missing source_format"), ("v4", "missing slide_count"), ("v4", "missing image_asset_count")}
    assets = spark.createDataFrame([("v1", "a", {"source_format": "markdown"}, False, " "), ("v1", "b", {"source_format": "markdown"}, True, None), ("v9", "c", None, None, "s3://x")], "version_pk string, asset_id string, metadata map<string,string>, has_payload boolean, asset_uri string")
    assert {tuple(r) for r in ct.asset_violations(assets, m).collect()} == {("v1", "a", "no payload and no uri"), ("v9", "c", "no manifest"), ("v9", "c", "no metadata")}
    full = {k: "x" for k in ct.REQUEST_KEYS}
    r = spark.createDataFrame([("v", "a", "t", "text", 4, "hi", None, None, full), ("v", "b", "t", "image", 0, None, None, None, full), ("v", "c", "", "film", 4, None, None, None, {}), ("v", "d", "t", "pdf", 4, None, None, None, full)],
                              "version_pk string, chunk_id string, chunk_type string, kind string, dimension int, text string, asset_uri string, mime_type string, metadata map<string,string>")
    got = {tuple(x)[1:] for x in ct.request_violations(r.union(r.limit(1))).collect()}
    assert {("a", "duplicate chunk_id"), ("b", "dimension not positive"), ("b", "image without uri"), ("b", "image without mime_type"), ("c", "unknown kind"), ("c", "missing chunk_type"), ("c", "missing tenant_id"), ("d", "pdf without text or uri")} <= got
    assert ct.request_violations(r.limit(0)).count() == 0 and ct.chunk_violations(spark.createDataFrame([], "version_pk string, chunk_id string, metadata map<string,string>, page_span struct<first:int,last:int>"), m).count() == 0


def test_slides(spark):
    rows = spark.createDataFrame([("v", 1, "Title", "say this", 2), ("v", 2, "word " * 900, None, 0), ("v", 3, " ", None, 0), ("v", None, "x", None, 0)], "version_pk string, slide_no int, text string, notes string, images int")
    got = ex.slide_chunks(rows, 400).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got][:2] == ["chunk#000001", "chunk#000002-01"] and got[0].text == "Title\nsay this" and got[0].metadata["has_notes"] == "true" and got[0].metadata["image_count"] == "2"
    assert all(r.token_estimate <= 400 for r in got) and got[1].section_path == ["slide-2"]
    pictures = spark.createDataFrame([("v", 2, 1, "image/png", "b.png", "u2"), ("v", 1, 2, "image/png", "a.png", "u1")], "version_pk string, slide_no int, shape_no int, mime_type string, filename string, uri string")
    assert [(r.asset_id, r.uri) for r in ex.slide_assets(pictures).orderBy("asset_id").collect()] == [("asset#000001", "u1"), ("asset#000002", "u2")]


def test_recognised_documents(spark):
    d = spark.createDataFrame([("t#b#in%2Fscan.v2.pdf#1", ['{"a": 1}'], "# A\n![x](http://h/p.png?q=1)\n![y](http://h/p.png?q=1) ![z](file)\n\ntext"), ("t#b#k#2", None, " ")], "version_pk string, lines array<string>, markdown string")
    docs = ex.local_images(d)
    rows = docs.collect()
    assert rows[0].markdown == "# A\n![x](assets/asset-000001.png)\n![y](assets/asset-000001.png) ![z](assets/asset-000002.bin)\n\ntext"
    chunks = ex.ocr_chunks(docs)
    assets = {r.asset_id: r for r in ex.ocr_assets(docs, chunks).collect()}
    assert set(assets) == {"ocr#raw-jsonl", "asset#000001", "asset#000002", "ocr#markdown-section-000001", "ocr#markdown"}
    assert assets["ocr#markdown"].relative_path == "scan.v2.md" and assets["asset#000001"].mime_type == "image/png" and assets["asset#000001"].source_url == "http://h/p.png?q=1" and assets["ocr#raw-jsonl"].payload == '{"a": 1}'
    meta = {r.version_pk: r.metadata for r in ex.ocr_manifests(docs, chunks).collect()}
    assert meta["t#b#k#2"]["markdown_asset_count"] == "0" and meta["t#b#in%2Fscan.v2.pdf#1"]["page_image_asset_count"] == "2"
    assert ct.manifest_violations(ex.ocr_manifests(docs, chunks)).count() == 0
    assert ct.chunk_violations(chunks.withColumn("page_span", F.lit(None).cast("struct<first:int,last:int>")), ex.ocr_manifests(docs, chunks)).count() == 0


def test_tenants():
    assert se.resolve_tenant(" a ", None) == "a" and se.resolve_tenant(None, "b", True) == "b" and se.resolve_tenant(None, None, True, "c") == "c"
    for claim, asked, anonymous, default in (("a", "b", True, None), (None, "b", False, None), (None, None, True, "lookup"), (None, " ", True, None)):
        with pytest.raises(PermissionError):
            se.resolve_tenant(claim, asked, anonymous, default)
    with pytest.raises(ValueError):
        se.searchable(" ")


def test_search_from_end_to_end(spark, sf_dir):
    c = Corpus(spark, sf_dir, [mf.Profile("a", 16), mf.Profile("b", 8), mf.Profile("off", 8, enable_query=False)])
    embedders = {"a": pl.hashing_embedder(16), "b": pl.hashing_embedder(8), "off": pl.hashing_embedder(8)}
    vectors = c.embed(embedders)
    current = c.chunks_of_current().where("text is not null and length(text) > 200").orderBy("version_pk", "chunk_id").first()
    tenant = current.version_pk.split("#")[0]
    asked = spark.createDataFrame([(7, current.text)], "qid int, text string")
    got = c.search(asked, vectors, embedders, tenant, k=3).orderBy("rank").collect()
    assert got[0].match.text == current.text and got[0].profile_hit_count == 2 and [r.rank for r in got] == list(range(1, len(got) + 1))
    assert all(r.object_pk.split("#")[0] == tenant and not set(r.metadata) & set(se.INTERNAL) and len(r.neighbours) <= 2 for r in got)
    assert json.loads(se.answers_json(c.search(asked, vectors, embedders, tenant, k=1)).first().answer)["match"]["text"] == current.text
    assert c.search(asked, vectors, embedders, "nobody").count() == 0
    none = spark.createDataFrame([], "version_pk string, profile_id string, query_status string")
    assert c.search(asked, vectors, embedders, tenant, k=1, projection=none).count() == 1  # all are marked latest
    waiting = spark.createDataFrame([(current.version_pk, p, "PENDING") for p in "ab"], none.schema)
    assert current.version_pk not in {f"{r.object_pk}#{r.version_id}" for r in c.search(asked, vectors, embedders, tenant, k=3, projection=waiting).collect()}
    for bad in ({"k": 0}, {"k": 21}, {"neighbours": 3}, {"k": True}):
        with pytest.raises(ValueError):
            c.search(asked, vectors, embedders, tenant, **bad)
    assert c.excerpt(current.version_pk, tenant, chunk_id=current.chunk_id).count() == 1 and c.excerpt(current.version_pk, "nobody").count() == 0
    assert c.versions(current.object_pk, tenant).count() >= 1


def test_assets_stand_in_for_chunks(spark):
    hits = spark.createDataFrame([(1, 1, "v", "c1"), (1, 2, "v", "asset#1"), (1, 3, "v", "gone")], "qid int, final_rank int, version_pk string, chunk_id string")
    chunks = spark.createDataFrame([("v", "c1", "one", 1), ("v", "c2", "two", 2)], "version_pk string, chunk_id string, text string, ordinal int")
    assets = spark.createDataFrame([("v", "asset#1", "picture")], "version_pk string, asset_id string, payload string")
    got = {r.chunk_id: (r.match.source, r.match.text, [(n.offset, n.chunk_id) for n in r.neighbours]) for r in se.with_context(hits, chunks, 1, assets).collect()}
    assert got == {"c1": ("chunk", "one", [(1, "c2")]), "asset#1": ("asset", "picture", [])}


@pytest.mark.parametrize("buckets", [1, 64])
def test_sinks(spark, tmp_path, buckets):
    at = str(tmp_path / "index")
    row = lambda v, s: (f"t#b#{v[0]}#{v}", s, True)
    make = lambda *rows: spark.createDataFrame([row(*r) for r in rows], "version_pk string, sk string, is_latest boolean")
    read = lambda: {(r.version_pk[6:], r.sk): r.is_latest for r in sk.read_index(spark, at, make(("k1", "a"))).collect()}
    sk.persist_index(spark, at, make(("k1", "a"), ("k1", "b"), ("m1", "a")), buckets)
    before = sk.read_index(spark, at, make(("k1", "a"))).where("version_pk = 't#b#k#k1'").collect()
    sk.persist_index(spark, at, make(("k2", "a")), buckets)
    assert read() == {("k1", "a"): False, ("k1", "b"): False, ("k2", "a"): True, ("m1", "a"): True}
    sk.persist_index(spark, at, make(("k2", "a")), buckets)
    assert len(read()) == 4 and read()["k2", "a"]
    sk.rollback_index(spark, at, make(("k2", "a")), spark.createDataFrame(before), buckets)
    assert read() == {("k1", "a"): True, ("k1", "b"): True, ("m1", "a"): True}
    sk.delete_versions(spark, at, make(("k1", "a")).select("version_pk"), make(("k1", "a")), buckets)
    assert read() == {("m1", "a"): True}
    sk.put_vectors(spark.range(1200).selectExpr("'p' as profile_id", "id"), str(tmp_path / "vectors"), 500)
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 1200


def test_earlier_versions_wait_for_the_current_one(spark):
    index = spark.createDataFrame([("t#b#k#old",), ("t#b#k#new",), ("t#b#g#x",), ("t#b#h#old",)], "version_pk string")
    state = spark.createDataFrame([("t#b#k", "new", False), ("t#b#g", "x", True), ("t#b#h", "new", False)], "object_pk string, latest_version_id string, is_deleted boolean")
    profiles = mf.profile_table(spark, [mf.Profile("p", 4), mf.Profile("q", 4)])
    marks = spark.createDataFrame([("t#b#k#new", "p", True), ("t#b#k#new", "q", True), ("t#b#h#new", "p", True)], "version_pk string, profile_id string, done boolean")
    assert {r[0] for r in sk.previous_versions(index, state, profiles, marks).collect()} == {"t#b#k#old", "t#b#g#x"}


def test_events_without_sequencers_and_the_same_version(spark):
    log = spark.createDataFrame([("a", "1", "v1", None, "UPSERT"), ("a", "2", "v2", None, "UPSERT"), ("a", "3", "v3", "05", "UPSERT"), ("a", "4", "v4", None, "DELETE"), ("b", "1", "w", None, "DELETE")], "object string, arrival string, version string, seq string, op string")
    judged = ev.judge_events(log)
    assert {r.version: r.reason for r in judged.collect()} == {"v1": "accepted", "v2": "stale", "v3": "accepted", "v4": "stale", "w": "delete_without_object"}
    stored = spark.createDataFrame([("a", "v3")], "object string, version string")
    assert {r.version: r.reason for r in ev.same_version(judged, stored).where("object = 'a'").collect()}["v3"] == "same_version"


def test_pages_of_keys_tell_whether_there_are_more(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = lambda after, n: [(r.k, r.truncated) for r in mf.page_of(rows, "k", after, n).collect()]
    assert got(None, 2) == [("a", True), ("b", True)] and got("a", 2) == [("b", False), ("c", False)] and got("c", 2) == []
