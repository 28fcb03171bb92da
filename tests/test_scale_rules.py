"""Results that must not depend on batch sizes, limits, curve lengths or on where a session runs."""

from types import SimpleNamespace

import __spark_entry__ as entry
import pytest
from clipline.operators.audio import autocorr_peak
from clipline.operators import ordered
from clipline.operators.blueprint import merge_blueprint
from clipline.operators.ranges import meeting, overlapping
from clipline.session import store, work_folder
from clipline.sources import scripts as scripts_io
from clipline.sources import stages
from clipline.streaming import live
from oracle_check import compare, connect
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _spans(side, start, end):
    lengths = (0.0, 0.5, 3.0, 40.0, 300.0, 5000.0, 1e5)
    rows = [(1, i, float((i * 37 + side * 11) % 6000), lengths[(i + side) % 7]) for i in range(120)] + [(1, 120, 0.0, 1e7)]
    return rows, [(k, i, s, s + n) for k, i, s, n in rows], f"k long, {'ij'[side]} long, {start} double, {end} double"


def test_spans_of_all_lengths_meet_once(spark):
    _, left, left_schema = _spans(0, "a", "b")
    _, right, right_schema = _spans(1, "c", "d")
    one, two = spark.createDataFrame(left, left_schema), spark.createDataFrame(right, right_schema)
    found = overlapping(one, two, ["k"], ("a", "b"), ("c", "d"), bucket=1.0)
    want = sorted((x[1], y[1]) for x in left for y in right if max(x[2], y[2]) < min(x[3], y[3]))
    assert sorted((r.i, r.j) for r in found.collect()) == want
    alone = meeting(one.filter("i = 120"), two.filter("j = 120"), ["k"], ("a", "b"), ("c", "d"), bucket=1.0)
    assert alone.count() == 1


def test_ranks_from_sketches_of_many_partitions(spark):
    values = spark.range(20000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 20011).cast("double").alias("v"))
    found = ordered.percentiles(values.repartition(40), ["k"], "v", {"a": 0.25, "b": 0.9}, exact_below=100).first()
    whole = sorted(float(i * 7919 % 20011) for i in range(20000))
    for p, got in ((0.25, found.a), (0.9, found.b)):
        at = 19999 * p
        want = whole[int(at)] + (whole[int(at) + 1] - whole[int(at)]) * (at - int(at))
        assert abs(got - want) < 1e-9


def test_rank_outside_its_bracket_is_an_error(spark):
    values = spark.range(500).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    wrong = {"a": (0.1, lambda n: n - 1)}  # the fraction does not fit the rank
    with pytest.raises(Exception, match="outside its bracket"):
        ordered.order_statistics(values, ["k"], "v", wrong, exact_below=50).collect()


def test_stage_run_without_rows_replaces_older_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "video_id long, t_s double")
    root = str(tmp_path)
    assert stages.load_stage(spark, root, "cuts") is None
    stages.save_stage(rows, root, "cuts")
    stages.save_stage(rows.filter("false"), root, "cuts", rows.filter("video_id = 1").select("video_id"))
    assert [tuple(r) for r in stages.load_stage(spark, root, "cuts").collect()] == [(2, 1.5)]


def test_lines_of_one_script(spark, tmp_path):
    lines = spark.range(300).select((F.col("id") % 30).alias("script_id"), F.floor(F.col("id") / 30).alias("line_no"),
                                    F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    path = str(tmp_path / "lines")
    scripts_io.write_lines(lines, path)
    assert [r.line for r in scripts_io.read_lines(spark, path, 7).collect()] == [f"line {7 + 30 * i}" for i in range(10)]
    assert not [p for p in (tmp_path / "lines").iterdir() if p.is_dir()]


def test_events_of_one_day_are_spread_and_read_back(spark, tmp_path):
    from clipline.streaming.events import EVENT_SCHEMA, write_events

    day = spark.range(2000).select(
        F.lit(1).cast("long").alias("job_id"), (F.col("id") % 3).alias("video_id"), F.lit("m").alias("module_id"),
        F.timestamp_micros(F.col("id") * 1_000_001).alias("ts"), F.col("id").alias("seq"), F.lit("progress").alias("kind"),
        F.lit(0.5).alias("progress"), F.lit(None).cast("double").alias("t_s"), F.lit(None).cast("double").alias("end_s"),
        F.lit("x").alias("payload"))
    path = str(tmp_path / "events")
    write_events(day, path)
    form = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    back = spark.read.schema(EVENT_SCHEMA).option("timestampFormat", form).json(path)
    own = ["video_id", "kind", F.unix_micros("ts").alias("us")]
    count = F.count(F.lit(1)).alias("n")
    assert sorted(map(tuple, back.select(*own).groupBy("video_id", "kind").agg(count, F.sum("us")).collect())) == sorted(
        map(tuple, day.select(*own).groupBy("video_id", "kind").agg(count, F.sum("us")).collect()))


def test_scripts_read_alike_from_lines_and_documents(spark, tmp_path):
    heads = spark.createDataFrame([("s", "1.0.0", "t"), ("empty", "1.0.0", "t")], "script_id string, version string, title string")
    modules = spark.range(50).select(F.lit("s").alias("script_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"),
                                     F.lit("title").alias("type"))
    scripts_io.write_scripts(heads, modules, None, str(tmp_path / "lines"))
    scripts_io.script_documents(heads, modules).write.json(str(tmp_path / "documents"))
    for folder in ("lines", "documents"):
        s, m, t = scripts_io.read_scripts(spark, str(tmp_path / folder))
        assert sorted(r.script_id for r in s.collect()) == ["empty", "s"] and t.count() == 0
        assert [(r.pos, r.id) for r in m.orderBy("pos").collect()] == [(i, str(i)) for i in range(50)]


@pytest.mark.parametrize("name", ["x02_throttle", "x03_expire_heartbeats", "x05_until_terminal"])
def test_live_order_in_tiny_arrow_batches(spark, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        frame = entry.queries()[name](spark, SF)
        rows = [tuple(r) for r in frame.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    cursor = connect(SF).execute(entry.oracle_sql()[name])
    assert compare(rows, frame.columns, cursor.fetchall(), [c[0] for c in cursor.description]) == ""


def test_replay_without_live_events(spark, tmp_path):
    history = spark.createDataFrame([(1, 0, "segment"), (1, 1, "segment")], "video_id long, seq long, kind string")
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema("video_id long, seq long, kind string").json(str(tmp_path / "empty"))
    found = live.replay(history, stream).orderBy("origin", "seq").collect()
    assert [tuple(r) for r in found] == [(1, 0, "segment", 0), (1, 1, "segment", 0), (1, 2, "done", 2)]


def test_blueprint_with_more_slots_than_any_template(spark):
    slots = spark.createDataFrame([("wide", i, f"s{i}", f"k{i}", 1.0, True) for i in range(9)],
                                  "template string, slot_idx int, name string, key string, default_dur double, required boolean")
    words = spark.createDataFrame([(f"k{i}", ["word"]) for i in range(9)], "key string, words array<string>")
    modules = spark.createDataFrame([(1, p, f"m{p}", "label", ["a word"], float(p), 1.0) for p in range(12)],
                                    "script_id long, pos long, id string, label string, texts array<string>, start_time double, duration double")
    scripts = spark.createDataFrame([(1, "wide")], "script_id long, template string")
    found = merge_blueprint(scripts, modules, slots, words).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in found} == {"matched": 9, "passthrough": 3}


def test_short_curve_has_no_pulse_on_either_path(spark):
    curve = spark.range(60).select(F.lit(1).alias("video_id"), F.col("id").alias("idx"), (F.col("id") % 7 + 1).cast("double").alias("value"))
    for below in (1 << 20, 10):
        assert [r.pulse_regularity for r in autocorr_peak(curve, whole_below=below).collect()] == [0.0]


def test_work_folder_needs_a_shared_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="a")
    with pytest.raises(ValueError):
        work_folder(SimpleNamespace(sparkContext=context))


def test_many_saves_are_merged_and_load_alike(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stages, "COMPACT_AFTER", 3)
    root, want = str(tmp_path / "store"), {}
    for i in range(9):
        rows = [(i % 4, float(i)), (10 + i, 0.5)]
        stages.save_stage(spark.createDataFrame(rows, "video_id long, t_s double"), root, "cuts")
        want.update({k: v for k, v in rows})
        assert {r.video_id: r.t_s for r in stages.load_stage(spark, root, "cuts").collect()} == want
    gone = spark.createDataFrame([(2,)], "video_id long")
    stages.save_stage(spark.createDataFrame([], "video_id long, t_s double"), root, "cuts", gone)
    del want[2]
    assert {r.video_id: r.t_s for r in stages.load_stage(spark, root, "cuts").collect()} == want
    assert len(list((tmp_path / "store" / "stage=cuts" / "rows").iterdir())) <= 5


@pytest.mark.parametrize("name", ["w04_peak_ratio", "w06_fading_flag", "w03_points_in_windows", "w05_keyword_flags",
                                  "w07_edge_in_span", "w08_overlap_seconds", "w09_window_features"])
def test_windows_are_never_broadcast(spark, name):
    """What is found for windows has a row for each of them, whatever size Spark guesses from the files."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftOuter" in line and "win#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_overlapping_modules_and_issues_are_never_broadcast(spark):
    """Modules are stored small, but meet in many copies: no side of a join may be broadcast by its size on disk."""
    plan = entry.queries()["t17_validate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_stored_rows_keep_values_and_types(spark):
    rows = spark.createDataFrame([(1, {"k": "v"}, None), (None, None, 2.5)], "a long, m map<string,string>, d double")
    back = store(rows)
    assert back.dtypes == rows.dtypes and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert store(rows.withColumn("nothing", F.lit(None))).count() == 2


@pytest.mark.parametrize("long_group", [1_000_000, 2])
def test_modules_are_paired_without_storing_them_over_and_over(spark, monkeypatch, long_group):
    """All groups at once, or those above ``long_group`` in chunks: as a plain loop; ordinary groups store two tables."""
    from clipline.operators import modules as M

    kinds = ["video_segment", "effect", "title", "effect", "video_segment", None]
    rows = [(i % 3, i, kinds[(i * 7 + i // 5) % 6], float(i // 6 % 3), 30.0, "ab"[i // 2 % 2] if i % 11 else None,
             {"k": f"m{i}"}, {"z": "0", "k": "old"}) for i in range(90)]
    want = []
    for script in range(3):
        own = [r for r in rows if r[0] == script]
        place, kept = {}, []
        for r in own:
            place.setdefault(r[3], r[1])
        sides = {t: {} for t in ("video_segment", "effect")}
        for r in own:
            if r[2] in sides:
                sides[r[2]].setdefault((r[3], r[5]), []).append(r)
        for r in own:
            other = {"video_segment": "effect", "effect": "video_segment"}.get(r[2])
            extra, key = r[7], (r[3], r[5])
            if other:
                pairs, nth = sides[other].get(key, []), sides[r[2]][key].index(r)
                if nth < len(pairs):
                    if other == "video_segment":
                        continue
                    extra = {**extra, **pairs[nth][6]}
            kept.append((place[r[3]], r[1], r[6]["k"], extra))
        want += [(script, n, k, extra["k"]) for n, (_, _, k, extra) in enumerate(sorted(kept, key=lambda x: x[:2]))]
    stored = []
    monkeypatch.setattr(M, "store", lambda df: stored.append(1) or store(df))
    table = spark.createDataFrame(rows, "script_id long, pos long, type string, start_time double, duration double, "
                                        "detail string, params map<string,string>, extra_params map<string,string>")
    found = (M.dedupe_modules(table) if long_group > 2 else M.dedupe_modules(table, long_group=long_group)).collect()
    assert sorted((r.script_id, r.pos, r.params["k"], r.extra_params["k"]) for r in found) == want
    assert long_group == 2 or len(stored) == 2


@pytest.mark.parametrize("name", ["w04_peak_ratio", "w06_fading_flag"])
def test_curve_of_window_signals_is_stored_once(spark, name):
    """The plan reads the events for the durations and the stored curve, not the ordering of the curve again and again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_found" not in plan


def test_ranks_of_many_values_come_from_a_small_sketch(spark):
    """Above a million values ranks stay exact, although a sketch keeps thousands of values, not a million for each task."""
    n = 1_200_000
    values = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
    ranks = ordered.nearest_rank(values, [], "v", {"p50": 50.0, "p99": 99.0})
    assert tuple(ranks.first()) == (n * 0.5, n * 0.99)
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and ", 1000000," not in plan


def test_windows_are_made_behind_the_shuffle(spark):
    """Signals are shuffled as ranges of windows, so no exchange has a row for each window; a long video spans many blocks."""
    from clipline.operators import windows as W

    videos = spark.createDataFrame([(1, 700.3), (2, 0.5), (3, 20.2)], "video_id long, duration_s double")
    rows = [(v, i, i * 0.7, (i * 37 % 11) / 2, i % 3, "ab"[i % 2]) for v, n in ((1, 1000), (3, 28)) for i in range(n)]
    table = spark.createDataFrame(rows, "video_id long, idx long, t_s double, value double, k long, text string")
    spans = table.filter("k = 1").select("video_id", F.col("t_s").alias("start_s"), (F.col("t_s") + F.col("value") * 40).alias("end_s"))
    given = dict(curve=table.select("video_id", "idx", "t_s", "value"), cuts=table.filter("k = 0"), silence=spans, speech=spans)
    found = W.window_signals(videos=videos, **given)
    steps = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    shuffle = next(i for i, line in enumerate(steps) if "RepartitionByExpression [video_id" in line)
    assert any("Aggregate [" in line and "win#" in line for line in steps[:shuffle])
    assert not any("win#" in line for line in steps[shuffle:])
    windows = W.sliding_windows(videos)
    same = W.window_signals(windows, videos, **given)
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(same.dtypes)]
    assert sorted(map(tuple, found.select(*rounded).collect())) == sorted(map(tuple, same.select(*rounded).collect()))
    parts = {"cuts": W.points_in_windows(given["cuts"], windows), "peak_ratio": W.peak_ratio(given["curve"], windows),
             "is_fading": W.fading_flag(given["curve"], windows), "silence_edge": W.edge_in_span(spans, windows),
             "speech_s": W.overlap_seconds(spans, windows)}
    for name, alone in parts.items():
        one, two = ({(r.video_id, r.win): r[name] if isinstance(r[name], bool) else round(r[name], 6) for r in x.collect()}
                    for x in (found, alone))
        assert one == two and len(one) == windows.count()


def test_checks_are_done_one_after_the_other(spark):
    """The issues of each check are stored, so the last plan neither pairs modules nor holds the shuffles of all checks."""
    plan = entry.queries()["t17_validate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" not in plan and "_grid" not in plan


@pytest.mark.parametrize("few", [False, True])
def test_stored_spans_meet_the_same_with_fewer_copies(spark, few):
    _, left, left_schema = _spans(0, "a", "b")
    _, right, right_schema = _spans(1, "c", "d")
    one, two = spark.createDataFrame(left, left_schema), spark.createDataFrame(right, right_schema)
    if few:
        one, two = one.filter("b - a < 100"), two.filter("d - c < 100")
    plain, lean = (meeting(one, two, ["k"], ("a", "b"), ("c", "d"), bucket=1.0, stored=s) for s in (False, True))
    found = sorted((r.i, r.j) for r in lean.filter("a < d and c < b").collect())
    assert found and found == sorted((r.i, r.j) for r in plain.filter("a < d and c < b").collect())


def test_written_scripts_are_compressed(spark, tmp_path):
    from clipline.session import CLEANUP

    before = spark.conf.get(CLEANUP)
    heads = spark.createDataFrame([(1, "1.0.0", "a", 3.0)], "script_id long, version string, title string, total_duration double")
    rows = [(1, i, f"m{i}", "title", "x" * 50, float(i), 1.0, 0) for i in range(200)]
    modules = spark.createDataFrame(rows, "script_id long, pos long, id string, type string, label string, start_time double, "
                                          "duration double, track_index long")
    tracks = spark.createDataFrame([(1, 0, "t", "video")], "script_id long, index long, name string, type string")
    scripts_io.write_scripts(heads, modules.withColumn("detail", F.lit("d")), tracks, str(tmp_path / "s"))
    names = [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names) and spark.conf.get(CLEANUP) == before
    s, m, t = scripts_io.read_scripts(spark, str(tmp_path / "s"))
    assert (s.count(), m.count(), t.count()) == (1, 200, 1) and m.agg(F.sum("pos")).first()[0] == 199 * 100
