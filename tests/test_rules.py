"""Rules on small tables written by hand, where the given tables have no such case."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import evaluation, layout, links, reading, refining, trees
from folio.plans import registry
from folio.sources import tables

LINE = "doc_id long, page int, ord int, text string, y double, height double, page_height double, margin boolean"


def test_a_margin_line_gives_the_order_but_not_the_page(spark):
    lines = spark.createDataFrame(
        [(1, 3, 0, "Intro", 9.0, 9.0, 792.0, True), (1, 3, 2, "The Intro of it", 99.0, 9.0, 792.0, False), (1, 4, 0, "Intro", 9.0, 9.0, 792.0, True)], LINE
    )
    entries = spark.createDataFrame([(1, 0, "Intro", "3", 0)], "doc_id long, entry int, title string, label string, depth int")
    labels = lines.select("doc_id", "page", F.col("page").cast("string").alias("label")).distinct()
    (found,) = trees.map_toc(entries, lines, lines.where("page = 9").select("doc_id", "page"), labels).collect()
    assert (found.page, found.ord, found.reason) == (3, 0, None)


def test_failures_of_printed_contents(spark):
    rows = [(1, 0, "1", 1, True, None), (1, 1, "x", 1, False, None), (2, 0, "1", 5, True, None), (2, 1, "2", 4, True, None), (3, 0, "90", 1, False, None), (4, 0, "1", None, False, "toc_mapping_ambiguous")]
    mapped = spark.createDataFrame(rows, "doc_id long, entry int, label string, page int, labelled boolean, reason string")
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    found = {r.doc_id: r.failure for r in trees.toc_failures(mapped, docs).collect()}
    assert found == {1: None, 2: "toc_order_invalid", 3: "toc_repair_bound_exceeded", 4: "toc_mapping_ambiguous", 5: "toc_structure_empty"}


def test_zones_follow_each_page_and_blank_pages_count(spark):
    rows = [(1, p, o, t, y, 9.0, 480.0, False) for p in (1, 2) for o, (t, y) in enumerate([("long enough to be a body line", 200.0), ("footer", 460.0)])]
    lines = spark.createDataFrame(rows, LINE)
    assert {(r.ord, r.margin) for r in layout.mark_margins(lines).collect()} == {(0, False), (1, True)}
    assert not layout.mark_margins(lines.drop("page_height")).where("margin").count()
    counts = spark.createDataFrame([(1, 4)], "doc_id long, n_pages int")
    assert not layout.mark_margins(lines, page_counts=counts).where("margin").count()


def test_rows_equal_the_plain_fold(spark):
    rng = random.Random(3)
    rows = [(1, p, s, "a", rng.choice([1.0, 2.0, 3.5, 4.0, 9.0, 10.5]), float(rng.randrange(5)), rng.choice([4.0, 8.0, 16.0])) for p in range(30) for s in range(rng.randrange(1, 20))]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, y double, x double, height double")
    items = items.selectExpr("*", "'f' AS font", "1.0D AS width", "600.0D AS page_width", "800.0D AS page_height")
    wanted = {}
    for p in range(30):
        row, first = -1, None
        for _, _, s, _, y, _, h in sorted((r for r in rows if r[1] == p), key=lambda r: (r[4], r[5], r[2])):
            if first is None or abs(first[0] - y) > max(2, min(first[1], h) * 0.25):
                row, first = row + 1, (y, h)
            wanted[p, s] = row
    assert {(r.page, r.seq): r.row for r in layout.cluster_rows(items).collect()} == wanted


def test_blank_last_pages_belong_to_the_tree(spark):
    lines = tables.lines_from_text(spark.createDataFrame([(1, "A title\n" + "text " * 30)], "doc_id long, text string"))
    counts = spark.createDataFrame([(1, 7)], "doc_id long, n_pages int")
    assert trees.build_tree(lines).agg(F.max("end")).first()[0] == 1
    assert trees.build_tree(lines, counts=counts).agg(F.max("end")).first()[0] == 7


def test_a_leaf_without_headings_fails_and_children_are_spliced(spark):
    leaves = spark.createDataFrame([(1, 0, 1, 20, 0, None), (1, 1, 20, 40, 0, None)], "doc_id long, node int, start int, end int, depth int, failure string")
    proposed = spark.createDataFrame([(1, 0, 1, 0, "one", "one", True), (1, 0, 9, 0, "two", "two", True)], "doc_id long, node int, page int, ord int, title string, anchor string, verified boolean")
    kids = trees.subdivide(leaves, proposed)
    assert {(r.node, r.child, r.child_start, r.child_end, r.failure) for r in kids.collect()} == {(0, 1, 1, 9, None), (0, 2, 9, 20, None), (1, None, None, None, "subdivision_inadequate")}
    nodes = spark.createDataFrame([(1, 0, "a", 1, 20, 0, None), (1, 1, "b", 20, 40, 0, None)], "doc_id long, node int, title string, start int, end int, depth int, parent int")
    found = [tuple(r) for r in trees.splice(nodes, kids).select("node", "title", "depth", "parent").orderBy("node").collect()]
    assert found == [(0, "a", 0, None), (1, "one", 1, 0), (2, "two", 1, 0), (3, "b", 0, None)]


def test_links_keep_a_plus_and_malformed_ones_are_told(spark):
    body = '<a href="c++/a+b.md#x+y">.</a><a href="bad%zz">.</a><a href="a%20b">.</a>'
    docs = spark.createDataFrame([("d/e.md", body)], "path string, body string")
    assert {(r.target, r.anchor) for r in links.extract_links(docs).collect()} == {("d/c++/a+b.md", "x+y"), ("d/a b", "")}
    assert [tuple(r) for r in links.malformed_links(docs).collect()] == [("d/e.md", "bad%zz")]


def test_anchors_are_unique(spark):
    body = "".join(f"<h2>{h}</h2>" for h in ("a", "a", "a-1", "A!", "b"))
    docs = spark.createDataFrame([("p", body), ("q", "<h1>a</h1>")], "path string, body string")
    found = [r.anchor for r in links.heading_anchors(docs).where("path = 'p'").orderBy("pos").collect()]
    assert found == ["a", "a-1", "a-1-1", "a-2", "b"]


def test_only_finite_numbers_count(spark):
    rows = [(v,) for v in (1.0, 2.0, 3.0, math.inf, -math.inf, math.nan, None)]
    found = evaluation.latency_distribution(spark.createDataFrame(rows, "elapsed_ms double").withColumn("g", F.lit(1)), ["g"]).first()
    assert tuple(found) == (1, 3, 1.0, 2.0, 3.0, 3.0)


def test_ranks_equal_sorted_values(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.random(), rng.expovariate(1) * 1e6, float(rng.randrange(9))])) for g in ("a", "b", None) for _ in range(700)] + [("c", 5.0), ("d", None), ("e", -1e308), ("e", 1e308)]
    found = {r.g: r for r in evaluation.latency_distribution(spark.createDataFrame(rows, "g string, elapsed_ms double"), ["g"], buckets=16).collect()}
    assert len(found) == 6
    for g, r in found.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        rank = lambda p: own[max(1, math.ceil(p * len(own))) - 1] if own else None  # noqa: B023, E731
        assert tuple(r)[1:] == (len(own), min(own, default=None), rank(0.5), rank(0.95), max(own, default=None))


def test_extractions_meet_wherever_their_pages_end(spark):
    page = "doc_id long, page int, text string"
    a = [(1, 1, "abcd efgh"), (1, 2, "ij"), (2, 1, "abc"), (2, 2, "def"), (3, 1, "abc"), (4, 1, " "), (5, 1, "same"), (None, 1, "ab")]
    b = [(1, 1, "abc"), (1, 2, "defghi"), (1, 3, "j"), (2, 1, "cab"), (2, 2, "def"), (3, 1, "abd"), (4, 1, None), (5, 1, "sa me"), (None, 1, "ba")]
    found = evaluation.compare_extraction(spark.createDataFrame(a, page), spark.createDataFrame(b, page), block=4).collect()
    wanted = {1: (True, False, True, True, "1,2,3"), 2: (True, True, True, False, ""), 3: (True, True, False, False, "1"), 4: (False, True, False, False, ""), 5: (True, True, True, True, "")}
    assert {r.doc_id: tuple(r)[1:] for r in found if r.doc_id} == wanted


def test_partitions_of_extractions_follow_their_size(spark, tmp_path):
    found = []
    for n in (2000, 8000):
        path = f"file://{tmp_path}/{n}"
        spark.range(n).selectExpr("id div 5 AS doc_id", "cast(id % 5 AS int) + 1 AS page", "sha2(cast(id AS string), 512) AS text").write.parquet(path)
        own = spark.read.parquet(path)
        compared = evaluation.compare_extraction(own, own.where("doc_id % 2 = 0 OR page < 5"), part_mb=0.01)
        plan = compared._jdf.queryExecution().executedPlan().toString()
        found.append(max(map(int, re.findall(r"hashpartitioning\(doc_id#\d+L?, page#\d+, (\d+)\)", plan))))
        assert compared.where("same_page_count").count() == n // 10 == compared.where("differing = ''").count()
    assert 4 < found[0] and 3 * found[0] < found[1]


def test_trees_of_any_depth_are_flattened(spark):
    kind, node = "struct<title string, start_index int, end_index int, summary string>", None
    for d in reversed(range(12)):
        node = {"title": f"t{d}", "start_index": d, "end_index": d, "summary": None} | ({"nodes": [node]} if node else {})
        kind = kind if d == 11 else f"struct<title string, start_index int, end_index int, summary string, nodes array<{kind}>>"
    kind = kind.replace("struct<", "struct<").replace(" string", ": string").replace(" int", ": int").replace("nodes array", "nodes: array")
    found = evaluation.flatten_tree(spark.createDataFrame([("x", [node])], f"tree_id string, nodes array<{kind}>")).orderBy("ord").collect()
    assert [(r.title, r.depth) for r in found] == [(f"t{d}", d) for d in range(12)]


@pytest.mark.parametrize(("asked", "failure"), [(8, None), (9, "page_request_too_large")])
def test_at_most_eight_pages_a_request(spark, asked, failure):
    pages = spark.createDataFrame([(1, p, "text") for p in range(1, 10)], "doc_id long, page int, text string")
    request = spark.createDataFrame([(1, 1, 0, list(range(1, asked + 1)))], "request_id long, doc_id long, offset int, pages array<int>")
    found = reading.page_slices(request, pages, spark.createDataFrame([(1, 9)], "doc_id long, n_pages int")).collect()
    assert {r.failure for r in found} == {failure}


def test_originals_have_their_digest(spark, data):
    import pathlib

    wanted = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in pathlib.Path(data).glob("*.parquet") if p.is_file()}
    found = {r.file.rsplit("/", 1)[-1]: (r.byte_length, r.sha256) for r in registry.queries()["S1_read_originals"](spark, data).collect()}
    assert found == wanted


def test_long_originals_are_digested_in_rounds(spark, tmp_path):
    """No task reads more than its part; parts may end anywhere, and names may hold what addresses can't."""
    sizes = {"a": 1, "b b%20#é": 1000, "c": 999, "d": 64 * 40, "e": 2049, "f": 10}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    found = {r.file: (r.byte_length, r.sha256) for r in tables.read_originals(spark, str(tmp_path), whole=500, part=333).collect()}
    assert found == {name: (n, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()) for name, n in sizes.items()}


@pytest.mark.parametrize("name", ["T20_oversized_leaves", "T21_subdivide", "R6_structure_required"])
def test_long_documents_give_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count()


def test_compatible_forms_are_one(spark):
    forms = ["ﬁle", "Ｆｕｌｌ　Ｗｉｄｔｈ", "ﾊﾝｶｸ", "①②", "é x", "ẛ̣", "plain", "", None, "Ⅳ.㎏"]
    import unicodedata

    df = spark.createDataFrame([(i, x) for i, x in enumerate(forms)], "i int, t string")
    found = df.select("i", text.compatible(F.col("t")).alias("n"), text.normalized_title(F.col("t")).alias("title"), text.normalized_chars(F.col("t")).alias("chars")).orderBy("i").collect()
    assert [r.n for r in found] == [None if x is None else unicodedata.normalize("NFKC", x) for x in forms]
    assert [r.title for r in found[:3]] == ["file", "fullwidth", "ハンカク"]
    assert found[1].chars == "".join(sorted("FullWidth"))
    pages = spark.createDataFrame([(1, 1, "the ｆｉｌｅ here")], "doc_id long, page int, navigation_text string")
    asked = spark.createDataFrame([(1, 1, "ﬁle")], "doc_id long, page int, anchor string")
    assert trees.verify_headings(asked, pages).first().verified
    assert "Python" not in df.select(text.normalized_title(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_items_without_y_or_height(spark):
    rows = [(1, 1, 0, None, 5.0), (1, 1, 1, None, 5.0), (1, 1, 2, 10.0, None), (1, 1, 3, 12.5, 40.0), (1, 1, 4, 30.0, 4.0), (1, 2, 0, 1.0, 4.0)]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, y double, height double").selectExpr("*", "0D AS x", "'a' AS text", "'f' AS font", "1.0D AS width", "600.0D AS page_width", "800.0D AS page_height")
    assert {(r.page, r.seq): r.row for r in layout.cluster_rows(items).collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 3, (2, 0): 0}
    assert layout.cluster_rows(items.limit(0)).count() == 0


def test_a_value_far_from_all_others_keeps_ranks_exact(spark):
    rng = random.Random(11)
    values = [rng.random() for _ in range(60_000)] + [1e300]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)] * 50_000 + [("b", 3.0)] * 40_000, "g string, elapsed_ms double").repartition(5)
    found = {r.g: r for r in evaluation.latency_distribution(df, ["g"]).collect()}
    order = sorted(values)
    assert (found["a"].median_ms, found["a"].p95_ms) == tuple(order[math.ceil(p * len(order)) - 1] for p in (0.5, 0.95))
    assert (found["b"].median_ms, found["b"].p95_ms, found["b"].max_ms) == (2.0, 3.0, 3.0)


def test_titles_are_found_in_long_documents(spark):
    titles = [f"Title {i} of the book" for i in range(500)] + ["...", "of the"]
    entries = spark.createDataFrame([(1, i, t, str(i), 0) for i, t in enumerate(titles)], "doc_id long, entry int, title string, label string, depth int")
    rows = [(1, p, 0, f"line with title {p % 700} of the book in it" if p % 3 else "nothing", 9.0, 9.0, 792.0, False) for p in range(1, 2001)]
    lines = spark.createDataFrame(rows, LINE)
    labels = lines.select("doc_id", "page", F.col("page").cast("string").alias("label"))
    found = {r.entry: (r.page, r.reason) for r in trees.map_toc(entries, lines, lines.where("page = 0").select("doc_id", "page"), labels).collect()}
    there = {i: [r[1] for r in rows if r[3] != "nothing" and f"title{i}ofthebook" in r[3].replace(" ", "")] for i in range(500)}
    wanted = {}
    for i, at in there.items():
        place = i if i in at else at[0] if len(at) == 1 else None
        wanted[i] = (place, None if place else "toc_mapping_ambiguous" if at else "toc_heading_unverified")
    assert {i: f for i, f in found.items() if i < 500} == wanted
    assert found[500] == (500, None)  # without letters it is in every line, so on the page of its label
    assert found[501] == (None, "toc_mapping_ambiguous")  # page 501 doesn't have it


def test_the_first_of_equal_bookmarks_comes_in(spark):
    marks = spark.createDataFrame([(1, 0, "Beta", 1, 2, True), (1, 1, "BETA", 1, 0, True), (1, 2, "Alpha", 1, 1, True)], "doc_id long, seq int, title string, page int, depth int, verified boolean")
    heads = spark.createDataFrame([(1, 1, 5, "alpha", 0, "layout")], "doc_id long, page int, ord int, title string, depth int, origin string")
    lines = spark.createDataFrame([(1, 1, 3, "the beta", 9.0, 9.0, 792.0, False)], LINE)
    found = {(r.title, r.ord, r.depth, r.origin) for r in trees.fuse_outlines(heads, marks, lines).collect()}
    assert found == {("Beta", 3, 2, "outline"), ("alpha", 5, 0, "outline")}


def test_a_request_fails_by_its_first_page(spark):
    pages = spark.createDataFrame([(1, 1, "abcd")], "doc_id long, page int, text string")
    request = spark.createDataFrame([(1, 1, [1, 5], 99)], "request_id long, doc_id long, pages array<int>, offset int")
    found = reading.page_slices(request, pages, spark.createDataFrame([(1, 1)], "doc_id long, n_pages int")).first()
    assert found.failure == "page_offset_out_of_bounds"


def test_a_node_beyond_the_budget_keeps_the_cursor(spark):
    nodes = spark.createDataFrame([(1, 0, "x" * 90), (1, 1, "y"), (2, 0, "z")], "doc_id long, node int, title string")
    found = {(r.doc_id, r.node, r.next_cursor) for r in reading.structure_page(nodes, most=60).collect()}
    assert found == {(1, None, 0), (2, 0, None)}


def test_messages_beyond_the_context_break_a_model_call_only(spark):
    rows = [(1, 0, "page", 0, 0, 999), (1, 1, "model", 0, 0, 10), (1, 2, "model", 0, 0, 11), (2, 0, "model", 0, 0, None)]
    calls = spark.createDataFrame(rows, "run_id long, seq int, kind string, output_chars long, elapsed_ms long, context_chars long")
    found = reading.budget_violations(calls, model_calls=9, tool_calls=9, pages=9, output_chars=9, elapsed_ms=9, context_chars=10).collect()
    assert [tuple(r) for r in found] == [(1, 2, "context_budget_exceeded")]


def test_rejected_trees_reach_nothing(spark):
    asked = spark.createDataFrame([(1, 1, 1, "fact"), (2, 2, 1, "fact")], "question_id long, doc_id long, page int, passage string")
    nodes = spark.createDataFrame([(1, 0, 1, 3), (2, 0, 1, 3)], "doc_id long, node int, start int, end int")
    pages = spark.createDataFrame([(d, 1, "a fact") for d in (1, 2)], "doc_id long, page int, text string")
    accepted = spark.createDataFrame([(1,)], "doc_id long")
    ours = evaluation.evidence_reachability(asked, nodes, pages, accepted)
    assert {(r.question_id, r.reachable) for r in ours.collect()} == {(1, True), (2, False)}
    both = evaluation.paired_reachability(ours, evaluation.evidence_reachability(asked, nodes, pages, accepted.where("doc_id > 1")))
    assert {tuple(r) for r in both.collect()} == {(1, True, False), (2, False, False)}


def test_reports_of_one_name_and_with_spaces(spark, tmp_path):
    paths = []
    for i, name in enumerate(("a/report.json", "b/report.json", "b/x y.json")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text('{"imports": [{"mode": "m", "file": "f%d"}], "questions": [], "failures": ["no"]}' % i)
        paths.append(str(path))
    assert [(r.report, r.file) for r in tables.read_reports(spark, paths).orderBy("report").collect()] == [(0, "f0"), (1, "f1"), (2, "f2")]
    assert tables.read_reports(spark, paths, "failures").count() == 3


def test_stored_pages_stay_in_their_buckets(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS doc_id", "explode(sequence(1, int(id % 3) + 1)) AS page", "'t' AS text")
    bad = spark.createDataFrame([(99, 2, "t")], "doc_id long, page int, text string")
    name = "pages_of_test"
    assert [r.doc_id for r in tables.store_pages(pages.union(bad), name, str(tmp_path / "p")).collect()] == [99]
    spark.sql(f"DROP TABLE {name}")
    table = pages.repartition(4, "doc_id").write.bucketBy(4, "doc_id").sortBy("doc_id", "page").option("path", str(tmp_path / "q"))
    table.saveAsTable(name)
    tables.store_pages(pages.union(pages.selectExpr("doc_id + 100", "page", "text")), name, str(tmp_path / "q"))
    stored = spark.table(name)
    assert stored.count() == 2 * pages.count()
    versions = spark.createDataFrame([(5, 3), (6, 3), (7, 2)], "doc_id long, page_count int").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tables.load_pages(stored, versions)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.doc_id, r.page) for r in found.collect()} == {(5, 1), (5, 2), (5, 3), (7, 1), (7, 2)}
    assert "Exchange hashpartitioning(doc_id" in plan and plan.count("Bucketed: true") >= 1
    bucket = {r.f.rsplit("_", 1)[-1] for r in stored.where("doc_id = 5").select(F.input_file_name().alias("f")).collect()}
    others = [f for f in (tmp_path / "q").glob("*.parquet") if f.name.rsplit("_", 1)[-1] not in bucket]
    assert others
    for f in others:  # files of other buckets are never opened
        f.unlink()
    assert [r.page for r in tables.load_version(stored, 5).collect()] == [1, 2, 3]
    spark.sql(f"DROP TABLE {name}")


def test_equal_headings_and_long_chains(spark):
    body = "".join("<h2>same</h2>" for _ in range(5000)) + "<h2>same-3</h2>"
    anchors = [r.anchor for r in links.heading_anchors(spark.createDataFrame([("p", body)], "path string, body string")).orderBy("pos").collect()]
    assert anchors[:3] == ["same", "same-1", "same-2"] and anchors[4999] == "same-4999" and anchors[5000] == "same-3-1"


def test_reach_along_chains_circles_and_crossings(spark):
    n = 10_000
    chain = [(i, i + 1) for i in range(n)]
    rng = random.Random(2)
    web = [(n + rng.randrange(60), n + rng.randrange(60)) for _ in range(90)]
    circle = [(20_000 + i, 20_000 + (i + 1) % 7) for i in range(7)] + [(20_000, 20_100), (20_100, 20_101)]
    edges = chain + web + circle + [(30_001, 30_002), (30_000, 30_000)]
    paths = sorted({x for e in edges for x in e})
    docs, own = spark.createDataFrame([(str(p),) for p in paths], "path string"), spark.createDataFrame([(str(a), str(b)) for a, b in edges], "path string, target string")
    found = {int(r.path) for r in links.unreachable(docs, own.repartition(4), F.col("path") == "0").collect()}
    after, seen, todo = {}, {0}, [0]
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while todo:
        for b in after.get(todo.pop(), []):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    assert found == set(paths) - seen


def test_trees_are_divided_to_the_end(spark):
    pages = spark.createDataFrame([(d, p, "words " * 5, f"head {p} words") for d in (1, 2) for p in range(1, 61)], "doc_id long, page int, text string, navigation_text string")
    nodes = spark.createDataFrame([(d, 0, "head 1", 1, 60, 0, None, "layout") for d in (1, 2)], "doc_id long, node int, title string, start int, end int, depth int, parent int, origin string")
    asked = [(1, 0, p) for p in (1, 31)] + [(1, 1, p) for p in (1, 11, 21, 31, 41, 51)] + [(2, 0, p) for p in (1, 31)] + [(2, 1, 1), (2, 1, 2)]
    proposed = spark.createDataFrame([(d, k, p, 0, f"Part {p}", f"head {p}") for d, k, p in asked], "doc_id long, depth int, page int, ord int, title string, anchor string")
    found, failures = refining.subdivide_to_end(nodes, pages, proposed)
    assert [tuple(r) for r in failures.collect()] == [(2, "subdivision_inadequate")]
    rows = [(r.node, r.title, r.start, r.end, r.depth, r.parent, r.origin, r.anchor) for r in found.orderBy("node").collect()]
    assert rows[:3] == [(0, "head 1", 1, 60, 0, None, "layout", None), (1, "Part 1", 1, 31, 1, 0, "model", "head 1"), (2, "Part 1", 1, 11, 2, 1, "model", "head 1")]
    assert [r[5] for r in rows[1:]] == [0, 1, 1, 1, 1, 0, 6, 6, 6] and rows[5][1:4] == ("Part 31", 31, 31)
    assert [r.failure for r in trees.validate_tree(found, pages).collect()] == [None]


def plain_summaries(nodes, texts, told, context):
    """Summaries of one document by the rules, node by node from the last; or its failure."""
    import json

    said = {}
    evidence = lambda p: {"page": p, "label": None, "text": texts[p]}
    size = lambda x: len(json.dumps(x, separators=(",", ":"), ensure_ascii=False))
    for node, title, start, end, parent in sorted(nodes, reverse=True):
        kids = sorted(n for n in nodes if n[4] == node)
        own = [p for p in range(start, end + 1) if p in texts and not any(k[2] <= p <= k[3] for k in kids)]
        whole = "\n".join(texts[p] for p in own)
        if not kids and len(whole) <= trees.SHORT_LEAF:
            said[node] = whole.strip()
            continue
        windows, group = [], []
        for p in own:
            if size({"pages": [evidence(p)]}) > context - 2000:
                return "page_context_too_large"
            if len(group) >= 8 or (group and size([evidence(q) for q in [*group, p]]) > context - 4000):
                windows.append(group)
                group = []
            group.append(p)
        windows += [group] if group else []
        parts = [(w[0], w[-1], told(node, 0, i)) for i, w in enumerate(windows)]
        if not kids and len(parts) == 1:
            said[node] = parts[0][2]
            continue
        if not parts and len(kids) == 1 and len(f"{kids[0][1]}: {said[kids[0][0]]}") <= 1600:
            said[node] = f"{kids[0][1]}: {said[kids[0][0]]}"
            continue
        parts = [json.dumps({"title": k[1], "start": k[2], "end": k[3], "summary": said[k[0]]}, separators=(",", ":"), ensure_ascii=False) for k in kids] + [
            json.dumps({"start": a, "end": b, "summary": s}, separators=(",", ":"), ensure_ascii=False) for a, b, s in parts
        ]
        if not parts:
            return "summary_evidence_missing"
        turn = 0
        while len(parts) > 1 or len(parts[0]) > 1600:
            turn, after, at = turn + 1, [], 0
            while at < len(parts):
                n, chars = 1, len(parts[at])
                while at + n < len(parts) and chars + len(parts[at + n]) < context - 4000 and n < 12:
                    chars += len(parts[at + n])
                    n += 1
                at += n
                after.append(told(node, turn, len(after)))
            if len(after) >= len(parts) and len(after) > 1:
                return "summary_context_too_small"
            parts = after
        said[node] = parts[0]
    return said


def test_summaries_equal_the_rules_node_by_node(spark):
    rng = random.Random(4)
    trees_of, rows, page_rows = {}, [], []
    for d in range(12):
        texts = {p: "x" * rng.choice([40, 300, 900, 1500, 3700 if d == 3 else 10]) for p in range(1, 31) if not (d == 5 and p < 31)}
        nodes = [(0, "root", 1, 30, None), (1, "a", 1, 12, 0), (2, "b", 1, 3, 1), (3, "c", 4, 12, 1), (4, "d", 13, 30, 0), (5, "e", 13, 30, 4)]
        trees_of[d] = nodes, texts
        depth = {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 2}
        rows += [(d, n, t, s, e, depth[n], p) for n, t, s, e, p in nodes]
        page_rows += [(d, p, None, t) for p, t in texts.items()]
    nodes = spark.createDataFrame(rows, "doc_id long, node int, title string, start int, end int, depth int, parent int")
    pages = spark.createDataFrame(page_rows, "doc_id long, page int, label string, text string")
    long_ = lambda n, r: 1700 if r == 1 and n % 4 == 0 else 300 + n * 60
    told = lambda n, r, b: f"{n}/{r}/{b}".ljust(long_(n, r), ".")
    wide = F.when((F.col("round") == 1) & (F.col("node") % 4 == 0), 1700).otherwise(300 + F.col("node") * 60)
    answer = lambda df: df.withColumn("summary", F.rpad(F.concat_ws("/", "node", "round", "batch"), wide, "."))
    for context in (5200, 9000):
        found, failures = refining.summarise_tree(nodes, pages, answer, context)
        wanted = {d: plain_summaries(*trees_of[d], told, context) for d in trees_of}
        assert {r.doc_id: r.failure for r in failures.collect()} == {d: w for d, w in wanted.items() if isinstance(w, str)}
        assert {(r.doc_id, r.node): r.summary for r in found.collect()} == {(d, n): s for d, w in wanted.items() if isinstance(w, dict) for n, s in w.items()}


def test_rows_and_texts_go_on_from_batch_to_batch():
    rng = np.random.default_rng(3)
    page, y = np.sort(rng.integers(0, 40, 3000)), np.round(rng.random(3000) * 300, 1)
    order = np.lexsort((y, page))
    page, y, height = page[order], y[order], rng.choice([1.0, 8.0, 16.0, 40.0], 3000)
    wanted, before = [], None
    for p, at, h in zip(page, y, height):
        if p != before:
            before, row, first = p, -1, None
        if first is None or at - first[0] > max(2.0, 0.25 * min(first[1], h)):
            row, first = row + 1, (at, h)
        wanted.append(row)
    cuts = np.unique(np.append([0, 3000], rng.integers(0, 3000, 700)))
    slices = lambda *columns: (tuple(pa.array(c[i:j]) for c in columns) for i, j in zip(cuts, cuts[1:]))
    assert np.concatenate([np.asarray(r) for r in layout.number_rows(slices(np.zeros(3000, int), page, y, height))]).tolist() == wanted
    first = np.append(True, rng.random(2999) < 0.3)
    texts = [t for batch in layout.chunk_texts(slices([str(i) for i in range(3000)], first, np.append(first[1:], True))) for t in batch.to_pylist()]
    ends = np.append(np.flatnonzero(first)[1:], 3000)
    assert [t for t in texts if t is not None] == ["".join(map(str, range(i, j))) for i, j in zip(np.flatnonzero(first), ends)]
    assert np.flatnonzero([t is not None for t in texts]).tolist() == (ends - 1).tolist()


def test_reading_order_moves_no_text(spark, data):
    plan = registry.queries()["L6_reading_order"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "chunk_texts" not in plan and "MapInArrow" not in plan


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["L1_cluster_rows", "L2_split_chunks", "L3_join_text"])
def test_words_of_documents_are_not_moved(spark, data, name):
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # a plan's last lines come first


def test_repeated_ids_share_their_pages(spark, short_batches):
    docs = spark.createDataFrame([(1, "b a"), (2, "c"), (1, "d " * 90), (None, "e f")], "doc_id long, text string").repartition(3)
    items = tables.items_from_text(tables.by_document(docs, mb=1e-6))
    chunked = layout.split_chunks(layout.cluster_rows(items, together=True), together=True)
    moved = layout.split_chunks(layout.cluster_rows(tables.items_from_text(docs)).repartition(3))
    columns = ["doc_id", "page", "row", "chunk", "x", "seq"]
    assert sorted(map(tuple, chunked.select(columns).collect()), key=str) == sorted(map(tuple, moved.select(columns).collect()), key=str)
    lines, apart = layout.join_text(chunked, in_order=True), layout.join_text(moved)
    assert sorted(map(tuple, lines.drop("text").collect()), key=str) == sorted(map(tuple, apart.drop("text").collect()), key=str)


def test_chunks_and_boxes_equal_plain_rules(spark, short_batches):
    rng = random.Random(4)
    pick = lambda *options: rng.choice(options)
    rows = [
        (d, p, s, p + s % 3, pick("a", "b1", "(c", "d)", "é", "", None, " f"), pick("f", "g", None), round(rng.random() * 300, 1) if rng.random() > 0.05 else None,
         pick(1.0, 2.5, None), pick(4.0, 9.0, None), pick(8.0, 16.0, None), pick(300.0, 600.0, None), 800.0)
        for d in (1, 2, None) for p in range(4) for s in range(pick(1, 9, 40))
    ]
    kind = "doc_id long, page int, seq int, row int, text string, font string, x double, y double, width double, height double, page_width double, page_height double"
    groups, wanted = {}, []
    for r in rows:
        groups.setdefault((r[0], r[1], r[3]), []).append(r)
    least = lambda values: min((v for v in values if v is not None), default=None)
    chunk_of = {}
    for key, group in groups.items():
        group.sort(key=lambda r: (r[6] is not None, r[6] or 0, r[7] is not None, r[7] or 0, r[2]))
        chunk, lines = 0, {}
        for before, r in zip([None, *group], group):
            gap = None if before is None or None in (r[6], before[6], before[8]) else r[6] - before[6] - before[8]
            bounds = [v for v in (r[9] and r[9] * 2.3, r[10] and r[10] * 0.06) if v is not None]
            chunk += gap is not None and bool(bounds) and gap >= max(bounds)
            chunk_of[r[0], r[1], r[2]] = chunk
            own = lines.setdefault(chunk, [])
            latin = own and None not in (gap, r[9], r[4], before[4]) and re.search("[A-Za-z0-9)]$", before[4]) and re.search("^[A-Za-z0-9(]", r[4])
            own.append((" " if latin and gap > r[9] * 0.12 else "") + (r[4] or ""))
            lines.setdefault((chunk, "items"), []).append(r)
        for c in range(chunk + 1):
            of = lines[c, "items"]
            x, end = least(r[6] for r in of), of[-1]
            width = None if None in (end[6], end[8]) else end[6] + end[8] - x
            high = [r[9] for r in of if r[9] is not None]
            wanted.append((*key, c, "".join(lines[c]).strip(), x, least(r[7] for r in of), width, max(high, default=None), of[0][5], of[0][10], of[0][11]))
    items = spark.createDataFrame(rows, kind).repartition(5)
    chunked = layout.split_chunks(items)
    assert {(r.doc_id, r.page, r.seq): r.chunk for r in chunked.collect()} == chunk_of
    for lines in (layout.join_text(chunked, in_order=True), layout.join_text(chunked.repartition(3))):
        assert sorted(map(tuple, lines.collect()), key=str) == sorted(wanted, key=str)
    assert layout.join_text(layout.split_chunks(items.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["L5_detect_columns", "L6_reading_order", "L7_page_text"])
def test_lines_of_documents_are_not_moved(spark, data, name):
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_order_of_lines_equals_plain_rules(spark, short_batches):
    rng = random.Random(5)
    pick = lambda *options: rng.choice(options)
    rows = []
    for page in range(60):
        odd = page % 3 == 0
        for i in range(pick(1, 8, 30)):
            x = pick(50.0, 60.0, 330.0, 340.0, *([None, 200.0] if odd else []))
            y = pick(40.0, 60.0, 100.0, 200.0, 300.0, 750.0, *([None] if odd else []))
            rows.append((page % 2, page, i // 3, i % 3, f"t{page}-{i}", x, y, pick(100.0, 200.0, *([260.0, 500.0, None] if odd else [])), 612.0, 792.0))
    kind = "doc_id long, page int, row int, chunk int, text string, x double, y double, width double, page_width double, page_height double"
    less = lambda a, b: a is not None and b is not None and a < b
    low = lambda v: (v is not None, v or 0)  # noqa: E731  missing values come first
    wanted, sides = {}, {}
    for page in range(60):
        own = [(r, r[5], r[6], None if None in (r[5], r[7]) else r[5] + r[7], r[7]) for r in sorted((r for r in rows if r[1] == page), key=lambda r: r[2:4])]
        left = [end for _, x, _, end, _ in own if end is not None and end <= 612 * 0.53 and x < 612 * 0.35]
        right = [x for _, x, _, _, w in own if x is not None and w is not None and x >= 612 * 0.45 and w < 612 * 0.5]
        two = len(left) >= 3 and len(right) >= 3 and min(right) - sorted(left)[len(left) // 2] > 612 * 0.035
        gutter = (max([*left, 0.0]) + min([*right, 612.0])) / 2
        sides[page] = (gutter, 2 if two else 1, len(left), len(right))
        cuts = [two and (less(x, gutter) and less(gutter, end) or less(y, 792 * 0.065) or less(792 * 0.92, y)) for _, x, y, end, _ in own]
        ranked = sorted((i for i in range(len(own)) if cuts[i]), key=lambda i: (low(own[i][2]), i))
        keys = []
        for i, (_, x, y, _, _) in enumerate(own):
            if not two:
                keys.append((0, 0, low(y), low(x), i))
            elif cuts[i]:
                keys.append((ranked.index(i), 2, low(y), 0, i))
            else:
                keys.append((sum(low(own[k][2]) <= low(y) for k in ranked), 0 if less(x, gutter) else 1, low(y), 0, i))
        for place, key in enumerate(sorted(keys)):
            wanted[own[key[-1]][0][4]] = place
    assert {s[1] for s in sides.values()} == {1, 2}
    lines = spark.createDataFrame(rows, kind).repartition(5)
    columns = layout.detect_columns(lines)
    assert {r.page: (r.gutter, r.columns, r.n_left, r.n_right) for r in columns.collect()} == sides
    for ordered in (layout.reading_order(lines), layout.reading_order(lines, columns)):
        assert {r.text: r.ord for r in ordered.collect()} == wanted
        for texts in (layout.page_text(ordered, together=True), layout.page_text(ordered.repartition(3))):
            found = {r.page: r.text.split("\n") for r in texts.collect()}
            assert {t: i for of in found.values() for i, t in enumerate(of)} == wanted and len(found) == 60
