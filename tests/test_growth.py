"""Plans that must not change with size, and values that must be worked out once."""

import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import formatters, forms, pages, stamps, tokens
from foliospark.functions.text import filled_lines, strip
from foliospark.operators import intake, layout, tables, walks
from foliospark.operators import forms as form_ops
from foliospark.operators import pages as page_ops
from foliospark.plans import runs
from foliospark.sources import file_tree


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ruled_tables_broadcast_no_exploded_rows(spark, tmp_path):
    # read from a file, so that the planner's estimate is the small file's, whatever is exploded from it
    spark.range(20).select(F.col("id").alias("k")).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    marks = t.select("k", F.explode(F.expr("transform(sequence(0, 5), i -> struct(if(i < 3, 'x', 'y') as axis, i % 3 * 100L as at))")).alias("m")).select("k", "m.*")
    words = t.select("k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("k", F.concat(F.lit("w"), "i").alias("word"), (F.col("i") % 2 * 100 + 20).alias("x"), (F.floor(F.col("i") / 2) * 100 + 30).alias("y"), F.lit(20).alias("w"), F.lit(10).alias("h"))
    out = layout.ruled_tables(marks, words, "k")
    assert "Broadcast" not in _plan(out)
    assert [(r.row, r.col, r.text, r.colspan) for r in out.where("k = 7").orderBy("row", "col").collect()] == [(0, 0, "w0", 1), (0, 1, "w1", 1), (1, 0, "w2", 1), (1, 1, "w3", 1)]


def test_a_raster_is_drawn_dealt_and_searched_once(spark, tmp_path):
    spark.range(9).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    plan = _plan(runs.j4_raster_tables(spark, str(tmp_path)))
    # the small table is dealt out before its pages are drawn, and neither branch of the grid works out the pixels again
    assert plan.count("MapInArrow") == 1 and "array_join(transform(UnsafeArrayData" not in re.sub(r"org[.a-z]*expressions[.]|@[0-9a-f]*", "", plan) and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 3 and "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow"):]
    k = F.col("p_partkey")
    drawn = spark.read.parquet(f"{tmp_path}/part.parquet").select(k, runs._ruled_page(k, F.lit(165) + k % 3 * 40).alias("pixels"))
    for r in drawn.collect():
        w = 165 + r.p_partkey % 3 * 40
        ink = lambda x, y, k=r.p_partkey: x % 40 in (5, 6) or (y % 30 in (4, 5) and k % 4 > 0) or (y % 30 == 15 and 12 <= x % 40 <= 28)
        assert bytes(r.pixels) == bytes(0x10 if ink(x, y) else 0xE0 for y in range(100) for x in range(w))


@pytest.mark.parametrize("rule, words", [(pages.readable, "lower"), (pages.overlay_only, "lower"), (pages.readable, "trim(coalesce"), (pages.overlay_only, "trim(coalesce")])
def test_a_page_is_lowered_and_stripped_once(spark, rule, words):
    assert _plan(spark.createDataFrame([("a",)], "x string").select(rule(F.col("x")).alias("y"))).count(words) == 1


def test_strip_takes_all_white_space_that_the_pattern_takes(one):
    white = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    other = [chr(c) for c in (0x180E, 0x200B, 0x2060, 0xFEFF, 0x1C, 0x1F)]
    values = [None, "", " \n ", "a b", *[w + "a" + w + "b" + w for w in white], *[o + "a" + o for o in other]]
    by_pattern = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")
    assert one(strip, *values) == one(by_pattern, *values)


def test_walks_take_many_keys_a_batch_and_keys_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select((F.col("id") % 23).alias("k"), (200 - F.col("id")).alias("n")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, n long"))
        out = walks.walked(rows, "k", ["n"], lambda page: [] if page[0][0] % 23 == 5 else [(len(page), [n for n, in page])], "size int, seen array<bigint>")
        got = {r.k: (r.size, r.seen) for r in out.collect()}
        want: dict = {None: [1, 2]}
        for i in range(200):
            want.setdefault(i % 23, []).append(200 - i)
        assert got == {k: (len(v), sorted(v)) for k, v in want.items() if min(v) % 23 != 5}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rule", [lambda w: tables.named_tables(w, "k"), lambda w: tables.slip_events(w, "k"), lambda w: layout.visual_lines(w.withColumns({"y": F.col("line_no"), "h": F.lit(1)}), "k")])
def test_pages_share_calls_of_python(spark, rule):
    words = spark.createDataFrame([(1, 0, 0, "Nada", 0, 32)], "k long, line_no int, word_no int, word string, x int, w int")
    assert "FlatMapGroups" not in _plan(rule(words))


def test_files_are_listed_by_tasks(spark, tmp_path):
    rows = [("a", "x.bin", b"1"), ("a", "y.txt", b"2"), ("b", "x.bin", b"345"), ("b", "z.bin", b"")]
    file_tree.write_files(spark.createDataFrame(rows, "folder string, file_name string, content binary"), f"{tmp_path}/f")
    found = file_tree.read_files(spark, f"{tmp_path}/f", "*.bin")
    assert not found.inputFiles()
    assert sorted((r.folder, r.file_name, bytes(r.content), r.n_bytes) for r in found.collect()) == [("a", "x.bin", b"1", 1), ("b", "x.bin", b"345", 3)]


@pytest.mark.parametrize("rule, part, most", [
    (formatters.slip_events, "translate(", 1),
    (formatters.slip_events, forms.EVENT_ROW, 5),
    (formatters.amounts, formatters.VERBAS_OPEN, 2),
    (formatters.column_events, formatters.SLIP_DESCRIPTIONS, 1),
    (formatters.column_history, "array_repeat(", 1),
    (lambda c: formatters.register_sections(F.map_from_entries(F.array(F.struct(c.alias("k"), c.alias("v"))))), "map_from_entries(", 1),
    (filled_lines, "trim(", 0),
])
def test_a_form_is_read_once(spark, rule, part, most):
    assert _plan(spark.createDataFrame([("a",)], "x string").select(rule(F.col("x")).alias("y"))).count(part) <= most


def test_values_below_split_their_text_once(spark):
    assert _plan(intake.values_below(spark.createDataFrame([(1, "Nome\nAna")], "k long, t string"), "k", "t", ["Nome"])).count("split(") == 1


def test_lines_without_a_label_are_not_exploded(spark, one):
    labels = ["Nome", "CPF"]
    assert one(lambda c: forms.has_label(c, labels), "nome: Ana", "o CPF", "renome", "nomes", "", None) == [True, True, False, False, False, None]
    df = spark.createDataFrame([(1, "x\nNome: Ana\n\ny\nnome: Eva CPF 1"), (2, "z"), (3, None)], "k long, t string")
    exploded = [x for x in _plan(form_ops.key_values(df, "k", "t", labels)).split("\n") if "posexplode" in x]
    assert any("RLIKE" in x for x in exploded)
    assert sorted(map(tuple, form_ops.key_values(df, "k", "t", labels).collect())) == [(1, "CPF", "1"), (1, "Nome", "Ana")]


def test_a_position_is_the_first_that_fits(spark):
    df = spark.createDataFrame([(["a", "b", None, "b"],), (["a"],), ([],), (None,)], "x array<string>")
    assert [r.y for r in df.select(formatters._position(F.col("x"), lambda v: v == "b").alias("y")).collect()] == [1, None, None, None]


def test_letterheads_judge_a_line_once_and_short_ones_only(spark, tmp_path):
    body = "\n".join(f"corpo {k} " + "palavra " * 40 for k in range(20))
    page = "Fonseca & Braga Advogados\n \n" + body + "\n\nRua do Sol\nwww.x.example.org\n"
    long = "Rua do Sol " + "de muitas palavras " * 9
    rows = [("d", 1, page), ("d", 2, page), ("d", 3, page + "\n"), ("d", 4, long + "\n" + body), ("e", 1, page), ("f", 1, "\n\n"), ("g", 1, "Rua do Sol")]
    spark.createDataFrame(rows, "pdf_id string, page_no int, residual_text string").write.parquet(f"{tmp_path}/p")
    pages_ = spark.read.parquet(f"{tmp_path}/p")
    out = page_ops.strip_letterheads(pages_)
    plan = _plan(out)
    assert plan.count("Generate ") == 1 and "Broadcast" not in plan
    assert _plan(page_ops.repeated_lines(page_ops.band_chrome(pages_))).count("Scan parquet") == 1
    # a line of white space is no line of a band, and stays
    want = {("d", k): body.strip() for k in (1, 2, 3)} | {("d", 4): (long + "\n" + body).strip(), ("e", 1): "Fonseca & Braga Advogados\n \n" + body.rstrip(), ("f", 1): "", ("g", 1): ""}
    assert {(r.pdf_id, r.page_no): r.residual_text for r in out.collect()} == want
    assert [(r.band, r.pdf_id, r.norm, r.n_pages) for r in page_ops.repeated_lines(page_ops.band_chrome(pages_)).collect()] == [("header", "d", "fonseca & braga advogados", 3)]


def test_a_document_is_collapsed_once_and_a_body_pruned_once(spark, one):
    x = spark.createDataFrame([("a",)], "x string")
    assert _plan(x.select(tokens.heuristics(F.col("x")).alias("y"))).count("regexp_replace") == 1
    assert _plan(x.select(tokens.heuristic(F.col("x"), "gemini").alias("y"))).count("regexp_replace") == 1
    body = stamps.clean_body(F.col("x"), F.lit(True), F.lit(None).cast("array<string>"))
    section = page_ops.page_section(F.lit(1), F.lit(2), body, F.lit(False), F.lit(""))
    assert _plan(x.select(section.alias("y"))).count("Quadro") == 1
    values = (None, "", "  \n ", "a", " a\u00a0 b\tc ", "um dois " * 30)
    for provider in tokens.FACTORS:
        assert one(lambda c, p=provider: tokens.heuristics(c)[p], *values) == one(lambda c, p=provider: tokens.heuristic(c, p), *values)
    assert one(lambda c: tokens.heuristic(c, "openai"), *values) == [0, 0, 0, 1, 4, 116]
