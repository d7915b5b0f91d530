"""Hot keys: the ways around one large group give the same rows as a plain one."""

import random
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators.collisions import resolve_collisions
from quillspark.operators.matching import match_requests, missing_files
from quillspark.operators.parts import assemble_parts, slice_parts

from .helpers import plan_of


@pytest.fixture(scope="module")
def files(spark):
    """A third of the rows on one path, a third failed, the rest spread."""
    i = F.col("id")
    path = F.when(i % 3 == 0, "/out/index/index.md").when(
        i % 3 == 1, F.concat(F.lit("/out/"), (i % 500).cast("string"))
    )
    return spark.range(3000).select(
        F.format_string("/in/%05d", "id").alias("file"), path.alias("output_path")
    )


def _expected(files):
    by_path = Window.partitionBy("output_path")
    known = F.col("output_path").isNotNull()
    return files.select(
        "*",
        F.when(known, F.count("*").over(by_path)).otherwise(0).alias("n_same_path"),
        (known & (F.row_number().over(by_path.orderBy(F.desc("file"))) == 1)).alias("survives"),
    )


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 7}])
def test_collisions_with_a_hot_path(files, limits):
    got = resolve_collisions(files, **limits)
    expected = _expected(files)
    assert got.count() == 3000
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    survivors = got.filter("survives")
    assert survivors.count() == survivors.select("output_path").distinct().count()


def test_small_collision_tables_leave_documents_in_place(files):
    plan = plan_of(resolve_collisions(files))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_salted_collisions_have_no_window(files):
    plan = plan_of(resolve_collisions(files, broadcast_bytes=0, hot_rows=7), "simple")
    assert "Window" not in plan and "_own_salt" in plan


def _turns(spark):
    """One document holds a third of the parts."""
    i = F.col("id")
    doc = F.when(i % 3 == 0, 0).otherwise(1 + i % 97)
    return spark.range(3000).select(
        doc.alias("doc"), i.alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("text "), i.cast("string")).alias("text"),
    )


def test_a_long_document_is_cut_into_whole_pieces(spark):
    turns = _turns(spark)
    whole = {r["doc"]: r["markdown"] for r in assemble_parts(turns, "doc", "turn", "role", "text").collect()}
    pieces = assemble_parts(turns, "doc", "turn", "role", "text", max_bytes=2000)
    rows = sorted(pieces.collect(), key=lambda r: (r["doc"], r["piece"]))
    assert sum(r["doc"] == 0 for r in rows) > 5
    assert all(len(r["markdown"]) <= 2000 for r in rows)
    joined = {}
    for r in rows:
        joined.setdefault(r["doc"], []).append(r["markdown"])
    assert {doc: "\n\n".join(texts) for doc, texts in joined.items()} == whole
    assert {r["piece"] for r in rows if len(joined[r["doc"]]) == 1} == {0}


def _pieces(spark, parts, max_bytes):
    df = spark.createDataFrame([("d", o, "h", "x" * n) for o, n in parts] + [("short", 1, "h", "y")], "doc string, turn int, role string, text string").repartition(4)
    got = {}
    for r in assemble_parts(df, "doc", "turn", "role", "text", max_bytes).orderBy("doc", "piece").collect():
        got.setdefault(r["doc"], []).append(r)
    assert [r["piece"] for r in got["short"]] == [0]
    assert [r["piece"] for r in got["d"]] == list(range(len(got["d"])))
    ordered = sorted(parts, key=lambda p: (p[0] is not None, p[0] or 0))
    assert "\n\n".join(r["markdown"] for r in got["d"]) == "\n\n".join("## h\n\n" + "x" * n for _, n in ordered)
    return [len(r["markdown"]) for r in got["d"]]


def test_pieces_are_dense(spark):
    one_large = [(o, 500 if o == 5 else 10) for o in range(11)]
    assert len(_pieces(spark, one_large, 300)) == 3
    holes = [(o * o * 1000 - 7, 40) for o in range(60)]
    sizes = _pieces(spark, holes, 400)
    assert max(sizes) <= 400 and sum(sizes[:-1]) / len(sizes[:-1]) > 300


def test_pieces_of_any_sizes_stay_under_the_limit(spark):
    rng = random.Random(3)
    parts = [(None if o == 0 else o, rng.choice([0, 3, 90, 140, 700])) for o in rng.sample(range(-500, 3000), 700)]
    parts = [p for p in parts if p[0] is not None] + [(None, 50)]
    sizes = _pieces(spark, parts, 300)
    assert all(n <= 300 or n == 706 for n in sizes)


def test_many_pieces_of_one_document(spark):
    sizes = _pieces(spark, [(o, 30) for o in range(3000)], 80)
    assert len(sizes) == 1500 and max(sizes) <= 80


def test_parts_are_joined_in_order(spark):
    df = spark.createDataFrame(
        [(1, 10, "user", "c"), (1, 9, "bot", "b"), (1, 2, "user", None), (2, 0, None, "z")],
        "doc int, turn int, role string, text string",
    )
    got = {r["doc"]: r["markdown"] for r in assemble_parts(df, "doc", "turn", "role", "text").collect()}
    assert got == {1: "## user\n\n\n\n## bot\n\nb\n\n## user\n\nc", 2: "z"}


@pytest.mark.parametrize(
    "start, end, expected",
    [(0, None, [0, 1, 2, 3, 4]), (2, 3, [2, 3]), (3, 3, [3]), (0, 0, [0]), (9, None, [])],
)
def test_page_ranges(spark, start, end, expected):
    df = spark.range(5).withColumnRenamed("id", "page")
    assert sorted(r["page"] for r in slice_parts(df, "page", start, end).collect()) == expected


@pytest.mark.parametrize("start, end", [(5, 2), (-1, 2), (0, -1)])
def test_bad_page_ranges(spark, start, end):
    with pytest.raises(ValueError):
        slice_parts(spark.range(5), "id", start, end)


def test_page_ranges_per_request(spark):
    df = spark.createDataFrame(
        [(d, p, s, e) for d, s, e in ((1, 1, 2), (2, None, None), (3, 3, None)) for p in range(5)],
        "doc int, page int, first int, last int",
    )
    got = slice_parts(df, "page", F.col("first"), F.col("last")).groupBy("doc").count()
    assert {r["doc"]: r["count"] for r in got.collect()} == {1: 2, 2: 5, 3: 2}


def test_requests_split_into_found_and_missing(spark):
    asked = spark.range(300).select((F.col("id") % 7).alias("file"), "id")
    files = spark.range(5).select(F.col("id").alias("file"), F.lit("text").alias("text"))
    found, lost = match_requests(asked, files, "file"), missing_files(asked, files, "file")
    assert found.count() + lost.count() == 300
    assert {r["file"] for r in lost.collect()} == {5, 6}
    assert lost.columns == asked.columns


@pytest.mark.parametrize("join", [match_requests, missing_files])
def test_a_hot_file_is_split_at_run_time(spark, join):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        i = F.col("id")
        asked = spark.range(0, 60000, 1, 8).select(
            F.when(i % 3 == 0, -1).otherwise(i).alias("file"), F.sha2(i.cast("string"), 256).alias("note")
        )
        files = spark.range(0, 60000, 2).select(i.alias("file"))
        done = join(asked, files, "file")
        rows = done.toPandas()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    present = 20000
    assert len(rows) == (present if join is match_requests else 60000 - present)


def test_a_size_check_covers_every_kind_of_column(spark):
    from quillspark.plans.sizing import broadcast_if_small, measured_bytes

    df = spark.range(10).select(
        "id",
        F.repeat(F.lit("é"), 500).alias("text"),
        F.create_map(F.lit("k"), F.repeat(F.lit("x"), 2000)).alias("extra"),
        F.lit(None).cast("string").alias("none"),
    )
    assert 30_000 < measured_bytes(df) < 40_000
    assert measured_bytes(df.limit(0)) == 0
    other = spark.range(10)
    hinted = other.join(broadcast_if_small(df, 40_000), "id")._jdf.queryExecution().analyzed().toString()
    plain = other.join(broadcast_if_small(df, 20_000), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


def test_engines_by_extension_without_a_broadcast(spark, monkeypatch):
    from quillspark.operators import routing
    from quillspark.operators.registry import default_registry

    docs = spark.createDataFrame([(".HTML",), (".csv",), (".zip",)], "ext string")
    support = default_registry().support(spark)
    expected = {".HTML": "html", ".csv": "csv", ".zip": None}
    for limit in (routing.BROADCAST_BYTES, 0):
        monkeypatch.setattr(routing, "BROADCAST_BYTES", limit)
        rows = routing.engine_for_extension(docs, support).collect()
        assert {r["ext"]: r["engine"] for r in rows} == expected
