"""Folds and windows against plain models of the same rules."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.operators import layout, library, reading, refining, trees
from folio.plans import registry
from folio.sources import tables
from folio.streaming import streams


def headings(rng, n_docs=60):
    rows = []
    for doc in range(n_docs):
        page = 1
        for i in range(rng.randint(1, 14)):
            page += rng.choice([0, 0, 1, 2])
            rows.append((doc, page, i, f"t{i}", rng.randint(-1, 10), "layout"))
    return rows


def test_hierarchy_and_ranges_equal_a_stack(spark):
    rows = headings(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, title string, depth int, origin string")
    counts = df.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    found = {}
    for r in trees.assign_ranges(trees.assign_hierarchy(df), counts).collect():
        found.setdefault(r.doc_id, []).append((r.node, r.depth, r.parent, r.start, r.end))
    for doc, nodes in found.items():
        own = [r for r in rows if r[0] == doc]
        last, stack, model = max(r[1] for r in own), [], []
        for i, r in enumerate(own):
            depth = min(max(0, r[4]), len(stack), 8)
            del stack[depth:]
            model.append([i, depth, stack[-1] if stack else None, r[1], None])
            stack.append(i)
        for i, m in enumerate(model):
            after = next((x for x in model[i + 1 :] if x[1] <= m[1]), None)
            m[4] = max(m[3], after[3]) if after else last
        assert sorted(nodes) == [tuple(m) for m in model]


def test_merge_small(spark):
    rng, rows, pages = random.Random(2), [], []
    for doc in range(40):
        n = rng.randint(2, 9)
        chars = [rng.choice([50, 200, 400, 900, 3000]) for _ in range(n)]
        pages += [(doc, p + 1, "x" * c) for p, c in enumerate(chars)]
        start = 1
        for node in range(rng.randint(1, 8)):
            end = min(n, start + rng.randint(0, 1))
            rows.append((doc, node, f"t{node}", start, end, 0 if node == 0 or rng.random() < 0.7 else 1, None, "layout"))
            start = min(n, end + rng.randint(0, 1))
    fixed = []
    for r in rows:
        before = [x for x in fixed if x[0] == r[0]]
        parent = max((x[1] for x in before if x[5] == 0), default=None) if r[5] == 1 else None
        fixed.append((*r[:6], parent, r[7]))
    nodes = spark.createDataFrame(fixed, "doc_id long, node int, title string, start int, end int, depth int, parent int, origin string")
    text = spark.createDataFrame(pages, "doc_id long, page int, text string")
    found = {}
    for r in trees.merge_small(trees.node_sizes(nodes, text)).collect():
        found.setdefault(r.doc_id, []).append((r.node, r.end, r.merged_titles))
    length = {(d, p): len(t) for d, p, t in pages}
    for doc in found:
        tree = [{"node": r[1], "title": r[2], "start": r[3], "end": r[4], "depth": r[5], "parent": r[6], "merged": []} for r in fixed if r[0] == doc]
        size = lambda n: sum(length[doc, p] for p in range(n["start"], n["end"] + 1))  # noqa: B023, E731
        leaf = lambda n: all(x["parent"] != n["node"] for x in tree)  # noqa: B023, E731
        for i in range(len(tree) - 1, 0, -1):
            n, b = tree[i], tree[i - 1]
            if leaf(n) and leaf(b) and n["parent"] == b["parent"] and n["depth"] == b["depth"] and size(n) < 500 and size(n) + size(b) <= 5000 and n["start"] <= b["end"] + 1:
                b["end"] = max(b["end"], n["end"])
                b["merged"] += [n["title"], *n["merged"]]
                del tree[i]
        assert sorted(found[doc]) == sorted((n["node"], n["end"], " | ".join(n["merged"])) for n in tree)


def test_windows_of_pages(spark):
    rng = random.Random(3)
    pages = [(d, p, None if p % 2 else str(p), 'a"' * rng.randint(0, 900)) for d in range(20) for p in range(1, rng.randint(2, 25))]
    df = spark.createDataFrame(pages, "doc_id long, page int, label string, text string")
    found = {(r.doc_id, r.page): (r.window, r.failure) for r in trees.pack_windows(df, 7000).collect()}
    dumps = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    for doc in range(20):
        window, group, model, refused = 0, [], {}, False
        for d, p, label, text in pages:
            if d != doc:
                continue
            page = {"page": p, "label": label, "text": text}
            refused |= len(dumps({"pages": [page]})) > 5000
            if group and (len(group) >= 8 or len(dumps([*group, page])) > 3000):
                window, group = window + 1, []
            group.append(page)
            model[doc, p] = window
        for key, w in model.items():
            assert found[key] == ((None, "page_context_too_large") if refused else (w, None))


def test_batches_of_parts(spark):
    rng = random.Random(4)
    parts = [(d, 0, i, rng.randint(100, 3000)) for d in range(10) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(parts, "doc_id long, parent int, pos int, size int")
    found = {(r.doc_id, r.pos): r.batch for r in trees.rollup_batches(df, 9000).collect()}
    for doc in range(10):
        own = [p for p in parts if p[0] == doc]
        i = batch = 0
        while i < len(own):
            n, chars = 0, 0
            while True:
                assert found[doc, i] == batch
                chars, n, i = chars + own[i][3], n + 1, i + 1
                if not (i < len(own) and chars + own[i][3] < 5000 and n < 12):
                    break
            batch += 1


def library_model(events):
    state, out = {}, []
    for doc, seq, kind, operation, expected, attempt in sorted(events):
        s = state.setdefault(doc, {"rev": 0, "retired": False, "op": None, "exp": -1, "att": None})
        outcome = "unchanged"
        if kind == "accept":
            outcome = "document_unavailable" if s["retired"] else "accepted" if expected == s["rev"] else "document_changed"
            if outcome == "accepted":
                s |= {"op": operation, "exp": expected, "att": attempt}
        elif kind == "attempt":
            outcome = "retried" if operation == s["op"] else "retry_obsolete"
            if outcome == "retried":
                s["att"] = attempt
        elif kind == "activate":
            won = not s["retired"] and operation == s["op"] and s["exp"] == s["rev"] and attempt == s["att"]
            outcome = "activated" if won else "publication_conflict"
            s["rev"] += won
        elif kind == "retire" and not s["retired"]:
            outcome = "retired"
            s["retired"], s["rev"] = True, s["rev"] + 1
        out.append((doc, seq, outcome, s["rev"]))
    return out


EVENTS = "document_id string, seq long, kind string, operation string, expected int, attempt string"


def library_events():
    rng = random.Random(5)
    kinds = ["accept", "accept", "attempt", "activate", "activate", "activate", "retire"]
    return [(f"d{rng.randint(0, 30)}", i, rng.choice(kinds if rng.random() < 0.3 else kinds[:-1]), f"o{rng.randint(0, 1)}", rng.randint(0, 2), f"a{rng.randint(0, 1)}") for i in range(1500)]


def test_activation(spark):
    events = library_events()
    found = library.activate(spark.createDataFrame(events, EVENTS)).collect()
    assert sorted(map(tuple, found)) == sorted(library_model(events))
    assert {r.outcome for r in found} >= {"accepted", "activated", "publication_conflict", "retired", "document_changed"}


def test_library_stream_equals_the_fold_over_several_batches(spark, tmp_path):
    events, source, out = library_events(), str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(events[500 * i : 500 * i + 500], EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    q = streams.library_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    # files come in the order of their time, as the events do
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(library_model(events))


def streamed(spark, events, schema, build, mode, tmp_path):
    source, found = str(tmp_path / "in"), []
    spark.createDataFrame(events, schema).repartition(5).write.parquet(source)
    stream = build(spark.readStream.schema(schema).parquet(source))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        write = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        write.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return sorted(found)


def test_progress_of_a_hot_operation_in_small_chunks(spark, tmp_path):
    rng, schema = random.Random(11), "operation string, seq long, attempt string, status string, stage string, reason string"
    # most operations end with several statuses after the last opening, some of attempts that are replaced
    events = [(f"o{i % 9 if i % 3 else 0}", i, f"a{rng.randint(0, 2)}", None if i < 540 and rng.random() < 0.1 else f"s{i}", f"g{i}", None) for i in range(600)]
    rng.shuffle(events)
    wanted = sorted(map(tuple, streams.progress_state(spark.createDataFrame(events, schema)).collect()))
    assert len({r[2] for r in wanted}) > 2
    assert streamed(spark, events, schema, streams.progress_stream, "update", tmp_path) == wanted


TIMED = "operation string, seq long, attempt string, status string, stage string, reason string, at timestamp"


def run_timed(spark, source, check, found):
    """Run what has come to ``source`` through the stream at its checkpoint; rows go to ``found``. Rows of state after it."""
    events = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "10 seconds")
    stream = streams.progress_stream(events, "at", keep_ms=60_000)
    write = stream.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True)
    q = write.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).start()
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_progress_state_ends_with_its_operation_and_outlives_a_restart(spark, tmp_path):
    source, check, found = str(tmp_path / "in"), str(tmp_path / "c"), []

    def come(*rows):
        timed = [(o, seq, a, status, status and "g", None, datetime(2024, 1, 1) + timedelta(seconds=second)) for o, seq, a, status, second in rows]
        spark.createDataFrame(timed, TIMED).coalesce(1).write.mode("append").parquet(source)

    come(("ended", 1, "a", None, 0), ("ended", 2, "a", "ready", 1), ("open", 3, "a", None, 1), ("open", 4, "a", "processing", 2), ("again", 5, "a", None, 2), ("again", 6, "a", "failed", 3), ("orphan", 7, "a", "failed", 3))
    assert run_timed(spark, source, check, found) == 4
    assert sorted(found) == [("again", "a", "failed", "g", None), ("ended", "a", "ready", "g", None), ("open", "a", "processing", "g", None)]
    found.clear()
    # within the period: a new attempt keeps the operation alive, and the old one's words don't count
    come(("again", 8, "b", None, 20), ("again", 9, "a", "ready", 20))
    assert run_timed(spark, source, check, found) == 4
    assert found == [("again", "b", "queued", "accepted", None)]
    found.clear()
    # the watermark passes the period of those that ended or never opened: two are left, besides the one that comes
    come(("late", 10, "a", None, 100))
    assert run_timed(spark, source, check, found) == 3
    assert found == [("late", "a", "queued", "accepted", None)]
    found.clear()
    come(("open", 11, "a", "ready", 101), ("ended", 12, "a", "ready", 101), ("again", 13, "b", "processing", 101))
    run_timed(spark, source, check, found)
    assert sorted(found) == [("again", "b", "processing", "g", None), ("open", "a", "ready", "g", None)]


def test_library_stream_of_a_hot_document_in_small_chunks(spark, tmp_path):
    events = [("d0" if i % 2 else e[0], *e[1:]) for i, e in enumerate(library_events()) if e[2] != "retire"]
    random.Random(12).shuffle(events)
    assert streamed(spark, events, EVENTS, streams.library_stream, "append", tmp_path) == sorted(library_model(events))


def test_rows_come_in_order_from_several_runs():
    import pandas as pd

    seqs = list(range(12_000))
    random.Random(13).shuffle(seqs)
    chunks = [pd.DataFrame({"seq": seqs[i : i + 100]}) for i in range(0, len(seqs), 100)]
    assert [r.seq for r in streams.in_order(iter(chunks), run_rows=5500)] == sorted(seqs)
    assert list(streams.in_order(iter([]))) == []


def test_breaches_are_written_once_a_batch(spark, tmp_path):
    calls = spark.createDataFrame([(1, 5, 1.0)] * 4 + [(2, 5, 1.0)], "run_id long, tokens long, elapsed_ms double")
    write = streams.breaches_to(str(tmp_path / "b"))
    for _ in range(2):
        write(streams.usage_stream(calls, 3), 0)
    assert [r.run_id for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [1]


def test_reading_goes_on_until_every_page_is_whole(spark):
    rng = random.Random(6)
    pages = [(d, p, "".join(rng.choice("abc") for _ in range(rng.choice([0, 10, 90, 100, 250])))) for d in range(12) for p in range(1, 6)]
    text = spark.createDataFrame(pages, "doc_id long, page int, text string")
    counts = text.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    asked = {d: ([1, 3, 4, 5], 0) for d in range(12)}
    got: dict = {}
    for _ in range(20):
        if not asked:
            break
        requests = spark.createDataFrame([(d, d, p, o) for d, (p, o) in asked.items()], "request_id long, doc_id long, pages array<int>, offset int")
        rows = reading.page_slices(requests, text, counts, budget=100).collect()
        following = {}
        for r in sorted(rows, key=lambda r: (r.request_id, r.pos)):
            assert r.failure is None
            got.setdefault((r.doc_id, r.page), []).append(r.slice)
            if r.next_pos is not None:
                following[r.doc_id] = (asked[r.doc_id][0][r.next_pos :], r.next_offset)
        for d in asked:
            assert sum(len(r.slice) for r in rows if r.doc_id == d) <= 100
        asked = following
    assert not asked
    assert {k: "".join(v) for k, v in got.items()} == {(d, p): t for d, p, t in pages if p != 2}


@pytest.mark.parametrize(("pages", "offset", "failure"), [([9], 0, "page_out_of_bounds"), ([1], 99, "page_offset_out_of_bounds"), ([2], 0, "page_unavailable")])
def test_bad_requests_have_a_code(spark, pages, offset, failure):
    text = spark.createDataFrame([(1, 1, "abc")], "doc_id long, page int, text string")
    counts = spark.createDataFrame([(1, 3)], "doc_id long, n_pages int")
    request = spark.createDataFrame([(1, 1, pages, offset)], "request_id long, doc_id long, pages array<int>, offset int")
    assert reading.page_slices(request, text, counts).first().failure == failure


def line(page, order, text, y, height=9.0):
    return (1, page, order, text, 50.0, y, 100.0, height, "serif", False)


LINES = "doc_id long, page int, ord int, text string, x double, y double, width double, height double, font string, margin boolean"


def test_repeated_margins_are_marked_and_left_out(spark):
    body = "a line of body text that is long enough"
    rows = [x for p in range(1, 6) for x in (line(p, 0, f"Annual Report {p}", 20.0), line(p, 1, body + str(p), 300.0, 11.0), line(p, 2, "Other" if p == 3 else f"— {p} —", 760.0))]
    marked = layout.mark_margins(spark.createDataFrame(rows, LINES))
    found = {(r.page, r.ord): r.margin for r in marked.collect()}
    assert found == {(p, o): o == 0 or (o == 2 and p != 3) for p in range(1, 6) for o in range(3)}
    assert tables.page_texts(marked).where("page = 3").first().navigation_text == f"{body}3\nOther"


def test_two_columns_are_read_left_then_right_between_headings(spark):
    rows = [("Heading across the page here", 50, 40, 500)] + [(f"left {i}", 50, 80 + 20 * i, 200) for i in range(4)] + [(f"right {i}", 330, 80 + 20 * i, 200) for i in range(4)]
    rows += [("Second heading across it all", 50, 200, 500), ("left z", 50, 230, 200), ("right z", 330, 230, 200)]
    items = [(1, 1, i, t, "serif", float(x), float(y), float(w), 11.0, 612.0, 792.0) for i, (t, x, y, w) in enumerate(rows)]
    df = spark.createDataFrame(items, "doc_id long, page int, seq int, text string, font string, x double, y double, width double, height double, page_width double, page_height double")
    own = layout.join_text(layout.split_chunks(layout.cluster_rows(df)))
    found = layout.reading_order(own, layout.detect_columns(own)).orderBy("ord").collect()
    assert [r.text for r in found] == [
        "Heading across the page here", *[f"left {i}" for i in range(4)], *[f"right {i}" for i in range(4)], "Second heading across it all", "left z", "right z"
    ]


def test_invented_titles_fail_and_flat_prose_has_no_tree(spark):
    prose = spark.createDataFrame([(1, 1, i, "plain prose goes on and on in one size " * 2, 50.0, 100.0 + i, 100.0, 11.0, "serif", False) for i in range(9)], LINES)
    assert [r.failure for r in trees.without_structure(prose, trees.build_tree(prose)).collect()] == ["structural_extraction_inadequate"]
    node = spark.createDataFrame([(1, 0, "Never said", 1, 1, 0, None, "model")], "doc_id long, node int, title string, start int, end int, depth int, parent int, origin string")
    assert trees.validate_tree(node, tables.page_texts(prose)).first().failure == "tree_location_unverified"


def test_a_store_refuses_gaps_and_keeps_what_it_has(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 3, "c")], "doc_id long, page int, text string")
    path = str(tmp_path / "pages")
    assert [r.doc_id for r in tables.write_pages(pages, path).collect()] == [2]
    tables.write_pages(pages, path, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 2


def test_an_existing_report_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n int")
    tables.write_report(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_report(df, str(tmp_path / "r"))


def test_refining_reads_its_inputs_once(spark, data):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(title):
        asked.add(1)
        return title

    rows = [(1, d, p, 0, f"t{p}", f"t{p}") for d in range(3) for p in range(1, 61) if p % (20, 5, 2)[d] == 1 or p == 1]
    proposed = spark.createDataFrame(rows, "doc_id long, depth int, page int, ord int, title string, anchor string").withColumn("anchor", seen.asNondeterministic()("anchor"))
    pages = spark.createDataFrame([(1, p, f"t{p}", f"t{p}") for p in range(1, 61)], "doc_id long, page int, text string, navigation_text string")
    nodes = spark.createDataFrame([(1, 0, "t1", 1, 60, 0, None, "layout")], "doc_id long, node int, title string, start int, end int, depth int, parent int, origin string")
    tree, failures = refining.subdivide_to_end(nodes, pages, proposed)
    assert failures.count() == 0 and tree.count() > 4
    assert asked.value == len(rows)
    for name in ("T23_summaries", "T23_summary_failures"):
        assert not any("documents" in f and data in f for f in registry.queries()[name](spark, data).inputFiles())
