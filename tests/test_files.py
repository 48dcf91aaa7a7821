"""Files as sink and source, layouts, ruling lines, progress and breakers, against plain loops."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import fallbacks, figures, intake, progress, rasters
from foliospark.sources import file_tree, layouts
from foliospark.streaming import audit, breaker

FILES = [("a_images", "p-000.bin", b"\x00\xff" * 2000), ("a_images", "p-001.bin", b""), ("b", "x.bin", None), ("b", "ç y.bin", b"1")]
SCHEMA = "folder string, file_name string, content binary"


def rows(df):
    return sorted((r.folder, r.file_name, bytes(r.content)) for r in df.collect())


def test_files_come_back_and_add_up(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.createDataFrame(FILES, SCHEMA)
    want = sorted(x for x in FILES if x[2])  # Spark's reader passes over empty files
    assert file_tree.read_files(spark, path).collect() == []
    file_tree.write_files(df, path)
    assert rows(file_tree.read_files(spark, path)) == want
    assert len([p for p in (tmp_path / "out").rglob("*.bin") if p.stat().st_size == 0]) == 2
    file_tree.write_files(spark.createDataFrame([("c", "z.bin", b"9")], SCHEMA), "file:" + path)
    assert rows(file_tree.read_files(spark, path)) == [*want, ("c", "z.bin", b"9")]
    file_tree.write_files(spark.createDataFrame([("d", "q.bin", b"8")], SCHEMA), path, overwrite=True)
    assert rows(file_tree.read_files(spark, path)) == [("d", "q.bin", b"8")]
    assert sorted(p.name[:5] for p in (tmp_path / "out").iterdir()) == ["_mani", "part-"]
    file_tree.write_files(df.limit(0), path, overwrite=True)
    assert file_tree.read_files(spark, path).collect() == []


def test_only_attempts_that_ended_count(spark, tmp_path):
    path = str(tmp_path / "out")
    file_tree.write_files(spark.createDataFrame(FILES, SCHEMA), path)
    writer = file_tree.FileTreeWriter(path, False)
    for attempt in ("00000-1", "00000-2", "00001-3"):  # a lost attempt, its repetition, and another task
        folder = tmp_path / "out" / f"part-{writer.write_id}-{attempt}" / "f"
        folder.mkdir(parents=True)
        (folder / f"n{attempt[4]}.bin").write_bytes(b"x")
    before = rows(file_tree.read_files(spark, path))
    assert len(before) == 2
    writer.commit([file_tree.Written(f"part-{writer.write_id}-00000-2", 1), None, file_tree.Written(f"part-{writer.write_id}-00001-3", 1)])
    assert rows(file_tree.read_files(spark, path)) == sorted([*before, ("f", "n0.bin", b"x"), ("f", "n1.bin", b"x")])
    assert not (tmp_path / "out" / f"part-{writer.write_id}-00000-1").exists()


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    file_tree.write_files(spark.createDataFrame(FILES, SCHEMA), path)
    for bad in (("a/b", "x"), ("a", ""), (None, "x")):
        with pytest.raises(Exception, match="plain name"):
            file_tree.write_files(spark.createDataFrame([("e", "ok.bin", b"1"), (*bad, b"2")], SCHEMA).coalesce(1), path)
    assert len(rows(file_tree.read_files(spark, path))) == 2
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]) <= 2


def test_content_files(spark):
    files = spark.createDataFrame([(1, "p-5.png", 9000, 10, 10), (1, "p-4.png", 9000, 10, 10), (1, "p-7.png", 2047, 900, 900), (1, "p-9.png", 3999, None, None), (1, "p-10.png", 4000, None, None), (1, "logo.png", 5000, 100, 100), (2, "p-5.png", 5000, 151, 200)], "page_no int, file_name string, n_bytes long, file_width int, file_height int")
    images = spark.createDataFrame([(1, 5, True), (1, 7, True)], "page_no int, num int, content boolean")
    got = sorted((r.page_no, r.file_name, r.num) for r in intake.content_files(files, images).collect())
    # index 4 takes the image with number 5; pages without image rows judge the file
    assert got == [(1, "p-10.png", None), (1, "p-4.png", 5), (1, "p-5.png", 5), (2, "p-5.png", None)]


LAYOUT = """<?xml?><pdf2xml><page number="2" width="600" height="oops"><image left="1" top="2" width="3" height="4"><IMAGE x="5"/>
<text top="10" left="20" width="30" height="8" font="1"> A &amp;lt; <b>b&#160;</b>
c</text><text top="1">  <i></i> </text><text top="9">open
<page number="0"><text>lost</text></page><page><text>lost</text></page>
<PAGE NUMBER="1"><text y="3" x="4">café</text></page><page number="2"><text>last</text></page><page number="7"/></pdf2xml>"""


def test_layouts_of_broken_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.xml").write_text(LAYOUT)
    (tmp_path / "in" / "deep" / "two.XML").write_bytes(b'<page number="3"><text>\xff</text>')
    (tmp_path / "in" / "none.xml").write_text("")
    (tmp_path / "in" / "other.txt").write_text(LAYOUT)
    got = {(r.pdf, r.number): r for r in layouts.read_layouts(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {("one", 1), ("one", 2), ("one", 7), ("two", 3)}
    assert [tuple(t) for t in got["one", 1].texts] == [(4.0, 3.0, 0.0, 0.0, "café")]
    assert [t.text for t in got["one", 2].texts] == ["last"] and got["one", 2].images == []
    assert (got["one", 7].width, got["one", 7].height, got["one", 7].texts) == (595.0, 842.0, [])
    assert got["two", 3].texts[0].text == "�"
    first = layouts.pages_of(LAYOUT.split('<page number="0"')[0])[0]
    assert (first["width"], first["height"]) == (600.0, 842.0)
    assert [tuple(x.values()) for x in first["images"]] == [(1.0, 2.0, 3.0, 4.0), (5.0, 0.0, 0.0, 0.0)]
    assert [t["text"] for t in first["texts"]] == ["A < b c"]
    small = spark.read.format("layout").option("bytesPerPartition", 10).load(str(tmp_path / "in"))
    assert small.rdd.getNumPartitions() == 3 and small.count() == 4


def test_covered_by_text(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<page number="1"><text left="0" top="0" width="10" height="10">' + "x" * 40 + "</text></page>")
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "pdf_id string, page_no int")
    found = layouts.with_layout(pages, layouts.read_layouts(spark, str(tmp_path / "d.xml")))
    rect = lambda w: F.struct(F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.lit(w).alias("width"), F.lit(1.0).alias("height"))
    assert {(r.pdf_id, r.page_no): r.covered for r in layouts.covered(found.withColumn("rect", rect(3.0))).collect()} == {("d", 1): True, ("d", 2): False, ("e", 1): False}
    assert not layouts.covered(found.withColumn("rect", rect(0.0))).where("covered").collect()


def plain_opening(ink, length):
    h, w = ink.shape
    lead, out = length // 2, np.zeros_like(ink)
    fits = np.zeros_like(ink)
    for y in range(h):
        for x in range(w):
            fits[y, x] = all(ink[y, k] for k in range(x - lead, x - lead + length) if 0 <= k < w)
        for x in range(w):
            # the mirrored window: what the eroded pixel covered
            out[y, x] = any(fits[y, k] for k in range(x - (length - 1 - lead), x + lead + 1) if 0 <= k < w)
    return out


def test_ruling_lines_by_plain_loops():
    rng = np.random.default_rng(3)
    for length in (1, 2, 3, 5, 6):
        ink = rng.random((6, 30)) < 0.75
        assert np.array_equal(rasters.opened(ink, length), plain_opening(ink, length))
    for _ in range(20):
        p = rng.integers(0, 256, (9, 9)).astype(np.uint8)
        best, at = -1.0, 0
        for t in range(255):
            a, b = p[p <= t], p[p > t]
            v = len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0.0
            if v > best * (1 + 1e-12) + 1e-9:
                best, at = v, t
        assert rasters.threshold(p) == at
    assert rasters.centres(np.array([], int), 8) == []
    assert rasters.centres(np.array([1, 2, 9, 18]), 8) == [4, 18]


def test_rasters_that_do_not_fit(spark):
    page = np.full((100, 120), 230, np.uint8)
    page[:, [10, 60, 110]] = 5
    page[[8, 50, 90], :] = 5
    data = [(1, 120, 100, page.tobytes()), (2, 120, 99, page.tobytes()), (3, None, 100, b""), (4, 120, 100, None), (5, 40, 40, b"\xff" * 1600)]
    df = spark.createDataFrame(data, "page long, width int, height int, pixels binary").withColumn("at", F.lit("x"))
    got = sorted(tuple(r) for r in rasters.ruling_lines(df, "page").where("page < 5").collect())
    assert got == sorted([(1, "x", k) for k in (10, 60, 110)] + [(1, "y", k) for k in (8, 50, 90)])
    assert rasters.ruling_lines(df.limit(0), "page").collect() == []


def test_progress_and_observation(spark, tmp_path):
    pages = [("a", k, ("native", "hybrid", "image_page")[k % 3], k == 4 or None, k == 2) for k in range(1, 6)] + [("b", 9, "native", True, False)]
    df = spark.createDataFrame(pages, "pdf_id string, page_no int, page_class string, forced boolean, ocr_failed boolean").withColumn("total", F.lit("x"))
    got = [tuple(r) for r in progress.events(df).orderBy("pdf_id", "place").collect()]
    assert got[0] == ("a", 0, "classification", 0, 5, 1, 2, 2, 1)
    assert [x[1:5] for x in got[1:6]] == [(k, "page", k, 5) for k in range(1, 6)]
    assert got[6:] == [("b", 0, "classification", 0, 1, 1, 0, 0, 1), ("b", 1, "page", 9, 1, None, None, None, None)]
    seen_df, seen = progress.observed(df.drop("total"))
    seen_df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 6, "native": 2, "hybrid": 2, "image_page": 2, "failed": 1}
    df.drop("total").repartition(2).write.parquet(str(tmp_path / "in"))
    listener = progress.RunListener()
    done = threading.Event()
    listener.onQueryTerminated = lambda event: done.set()
    spark.streams.addListener(listener)
    try:
        stream = audit.read_arriving(spark, str(tmp_path / "in"), df.drop("total").schema, files_at_once=1).observe("run", *progress.counts())
        audit.run_to_folder(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        done.wait(30)
    finally:
        spark.streams.removeListener(listener)
    assert listener.sums == {"total": 6, "native": 2, "hybrid": 2, "image_page": 2, "failed": 1}
    assert [k for k, _ in listener.batches] == [0, 1]


def plain_changes(calls, failures, cool):
    out = []
    for end in sorted({c[0] for c in calls}):
        streak, until = 0, None
        for _, at, ok, _ in sorted((c for c in calls if c[0] == end and c[2] is not None), key=lambda c: (c[1], c[3])):
            if until is not None and at > until:
                out.append((end, until, "closed", "cool-down"))
                until = None
            if ok:
                if until is not None:
                    out.append((end, at, "closed", "success"))
                streak, until = 0, None
            else:
                streak += 1
                if streak >= failures:
                    if until is None:
                        out.append((end, at, "open", "failures"))
                    until = at + cool
        if until is not None:
            out.append((end, until, "closed", "cool-down"))
    return sorted(out)


def calls_of(rng, n):
    return [(rng.choice("abc"), rng.randrange(600), rng.choice([True, False, False, None]), k) for k in range(n)]


@pytest.mark.parametrize("failures", [1, 3])
def test_breaker_in_batch_and_stream(spark, tmp_path, failures):
    calls = calls_of(random.Random(failures), 150)
    frame = lambda c: spark.createDataFrame([(e, at, ok, k) for e, at, ok, k in c], "endpoint string, at long, ok boolean, call_id long").withColumn("ts", F.timestamp_seconds("at"))
    said = lambda df: sorted((r.endpoint, r.at, r.state, r.reason) for r in df.withColumn("at", F.unix_seconds("ts")).collect())
    want = plain_changes(calls, failures, 20)
    assert said(breaker.changes(frame(calls), failures, 20)) == want
    # three files in the order of time, and a last call that moves the watermark on
    calls.sort(key=lambda c: (c[1], c[3]))
    for k, part in enumerate([calls[:50], calls[50:90], calls[90:], [("z", 10_000, True, 999)]]):
        frame(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(frame(calls).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    found = breaker.streamed(stream, failures, 20, late="1 second")
    audit.run_to_folder(found, str(tmp_path / "out"), str(tmp_path / "check"))
    assert said(spark.read.schema(found.schema).parquet(str(tmp_path / "out"))) == want
    assert breaker.changes(frame(calls).limit(0)).collect() == []


def test_pages_by_page_only_where_refused(spark):
    files = [("ok", "a\fb \f", 2), ("few", "a\fb", 3), ("none", None, 1), ("empty", "x", 0), ("unknown", "a\fb", None)]
    df = spark.createDataFrame(files, "path string, text string, n_pages int")

    def read(path, page):
        if path == "ok":
            raise ValueError("accepted pages are not read again")
        return None if page == 2 else f" {path}{page}\n"

    got = sorted((r.path, r.page_no, r.text, r.by_page) for r in fallbacks.page_texts(df, read).collect())
    assert got == [("few", 1, "few1", True), ("few", 2, "", True), ("few", 3, "few3", True), ("none", 1, "none1", True), ("ok", 1, "a", False), ("ok", 2, "b", False)]


def test_batches_count_as_a_whole(spark):
    pages = [("a", 1), ("a", 5), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("d", 2), ("e", 9)]
    one = lambda t, tables=None: (t, tables, "por")
    batches = [("a", [one(" x "), one("y", ["", "|t|"])]), ("b", [one("lost")]), ("c", [one("alone")]), ("d", None)]
    singles = [(k, n, (f"{k}{n}", None, None)) for k, n in pages if k != "e"]
    out = fallbacks.batch_results(spark.createDataFrame(pages, "k string, page_no int"), spark.createDataFrame(batches, f"k string, results array<{fallbacks.RESULT}>"), spark.createDataFrame(singles, f"k string, page_no int, result {fallbacks.RESULT}"), ["k"])
    got = {(r.k, r.page_no): (r.text, r.from_batch, r.has_tables, r.tables) for r in out.collect()}
    assert got.pop(("a", 1)) == ("x", True, False, []) and got.pop(("a", 5)) == ("y", True, True, ["|t|"]) and got.pop(("e", 9)) == ("", False, False, [])
    assert got == {(k, n): (f"{k}{n}", False, False, []) for k, n in pages if k in "bcd"}


def plain_merge(rows, threshold=0.35):
    kept = [r for r in rows if r[1] == 0]
    for r in rows:
        if r[1] == 1:
            def iou(o):
                w, h = min(r[4] + r[6], o[4] + o[6]) - max(r[4], o[4]), min(r[5] + r[7], o[5] + o[7]) - max(r[5], o[5])
                both = max(0, w) * max(0, h)
                return both / (r[6] * r[7] + o[6] * o[7] - both)

            close = [k for k, o in enumerate(kept) if iou(o) >= threshold]
            weaker = [k for k in close if kept[k][8] < r[8]]
            if not close:
                kept.append(r)
            elif weaker:
                kept[weaker[0]] = r
    return sorted((r[0], r[3], r[4], r[5], r[6], r[7], r[8]) for r in kept)


@pytest.mark.parametrize("most", [64, 1])
def test_merged_words_meet_their_neighbours(spark, monkeypatch, most):
    monkeypatch.setattr(figures._Grid, "MOST", most)
    rng = random.Random(most)
    rows = [(p, s, n, f"w{n}", rng.randrange(-20, 300), rng.randrange(200), rng.choice([5, 20, 30, 250]), rng.choice([5, 9, 120]), rng.randrange(100)) for p in range(3) for s in (0, 1) for n in range(80)]
    rows += [(9, 1, 0, "only", 1, 1, 5, 5, 1)]
    df = spark.createDataFrame(rows, "page long, source int, word_no int, word string, x long, y long, w long, h long, conf long")
    got = [tuple(r) for r in figures.merge_words(df, "page").select("page", "word", "x", "y", "w", "h", "conf").collect()]
    assert sorted(got) == sorted(x for p in (0, 1, 2, 9) for x in plain_merge([r for r in rows if r[0] == p]))


def test_many_boxes_of_a_page_end_soon():
    boxes = [{"x": 12 * (k % 500), "y": 9 * (k // 500), "w": 10, "h": 8} for k in range(40_000)]
    grid = figures._Grid(boxes)
    for k, b in enumerate(boxes):
        grid.add(k, b)
    assert max(len(grid.near(b)) for b in boxes) <= 24
