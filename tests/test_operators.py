"""Small worked examples and edge cases of the operators."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograin import catalog
from heliograin.functions import stats
from heliograin.operators import datasets, decimals, flows, frame, graph, market, retrieval, signal, text, windows
from heliograin.sources import files
from heliograin.streaming import events, kernels


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, i long, x double")


# relational core


def test_select_and_new_columns_reject_unknown_or_repeated_names(spark):
    df = spark.createDataFrame([(1, 10.0, "x"), (2, 20.0, "y"), (3, 30.0, "z")], "a long, b double, c string")
    assert frame.select(df, ["c", "a"]).columns == ["c", "a"]
    for bad in (["nope"], ["a", "a"]):
        with pytest.raises(ValueError):
            frame.select(df, bad)
    with pytest.raises(ValueError):
        frame.with_new_column(df, "a", F.lit(1))
    assert frame.head(df, 100, "a").count() == 3 and rows(frame.head(df, 2, "a"), "a") == [(1,), (2,)]


def test_doubles_sort_nan_last_both_ways_and_minus_zero_first(spark):
    df = spark.createDataFrame([(3.0, "c"), (1.0, "a"), (float("nan"), "x"), (2.0, "b"), (0.0, "p"), (-0.0, "m")], "f double, tag string")
    assert [r.tag for r in frame.sort_by_double(df, "f").collect()] == ["m", "p", "a", "b", "c", "x"]
    assert [r.tag for r in frame.sort_by_double(df, "f", descending=True).collect()] == ["c", "b", "a", "p", "m", "x"]


def test_grouped_aggregates_are_named_doubles(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("a", 2.0), ("a", 3.0), ("b", 20.0)], "k string, v double")
    got = frame.group_by_agg(df, "k", "v", ["sum", "mean", "count", "min", "max"]).orderBy("k")
    assert got.columns == ["k", "v_sum", "v_mean", "v_count", "v_min", "v_max"] and rows(got) == [("a", 6.0, 2.0, 3.0, 1.0, 3.0), ("b", 30.0, 15.0, 2.0, 10.0, 20.0)]
    with pytest.raises(ValueError):
        frame.group_by_agg(df, "k", "v", "median")


def test_join_renames_the_right_side(spark):
    left = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    right = spark.createDataFrame([(2, "R2a", 100.0), (2, "R2b", 101.0), (4, "R4", 200.0)], "id long, name string, score double")
    got = frame.join(left, right, "id").orderBy("score")
    assert got.columns == ["id", "name", "name_right", "score"] and rows(got) == [(2, "B", "R2a", 100.0), (2, "B", "R2b", 101.0)]


def test_asof_join_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([("u", 5.0, 1), ("u", 1.0, 2), ("v", 5.0, 3)], "k string, t double, id long")
    right = spark.createDataFrame([("u", 2.0, 20.0), ("u", 5.0, 50.0), ("u", 6.0, 60.0)], "k string, t double, v double")
    assert sorted(rows(frame.asof_join(left, right, ["k"], "t", ["v"]), "id", "v_asof")) == [(1, 50.0), (2, None), (3, None)]


def test_csv_is_strict(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"', 1, 1.5, True), ("line\nend", 2, -0.25, False)], "name string, n long, f double, b boolean")
    files.write_csv(df.coalesce(1), str(tmp_path / "t"))
    assert sorted(rows(files.read_csv(spark, str(tmp_path / "t"), df.schema))) == sorted(rows(df))
    (tmp_path / "bad.csv").write_text("n,f\n1,2.0\nx,3.0\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad.csv"), "n long, f double").collect()


def test_sensor_parsers(spark):
    line = lambda u, c: " ".join(map(str, [u, c, *range(24)]))
    df = spark.createDataFrame([(line(1, c),) for c in (1, 2, 3)] + [(line(2, 1),), ("",)], "value string")
    assert sorted(rows(files.parse_turbofan(df), "unit", "cycle", "rul")) == [(1, 1, 2), (1, 2, 1), (1, 3, 0), (2, 1, 0)]
    with pytest.raises(Exception):
        files.parse_turbofan(spark.createDataFrame([("1 2 3",)], "value string")).collect()
    lines, labels = spark.createDataFrame([(0, "1 NaN 3")], "row long, value string"), spark.createDataFrame([(0, '-1 "19/07/2008 11:55:00"')], "row long, value string")
    got = files.parse_process_rows(lines, labels, width=3).first()
    assert got.label == 0 and math.isnan(got.features[1]) and got["at"] == "19/07/2008 11:55:00"
    log = files.parse_drive_log(spark.createDataFrame([(7, 1.0, 2.0, 3.0)], "segment_id long, b double, a double, y double"), "y").first()
    assert tuple(log) == (7, 3.0, [2.0, 1.0])


# statistics


def test_describe_and_quantiles(spark):
    df = series(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    r = stats.describe(df, ["k"], "x").first()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (5.0, 4.5, 2.0, 9.0) and r["variance"] == pytest.approx(32 / 7)
    assert rows(stats.quantiles(series(spark, [1, 2, 3, 4]), ["k"], "x", [-1.0, 0.5, 2.0])) == [("a", 1.0, 2.5, 4.0)]


def test_degenerate_regression_and_polynomial(spark):
    assert rows(stats.linear_regression(series(spark, [3, 3]).withColumn("y", F.lit(1.0)), ["k"], "x", "y"), "slope", "intercept") == [(0.0, 1.0)]
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), (1 + 2 * F.col("id") + 3 * F.col("id") * F.col("id")).cast("double").alias("y"))
    assert stats.polynomial_fit(df, "x", "y", 2) == pytest.approx([1.0, 2.0, 3.0])


def test_weighted_median_takes_the_midpoint_on_an_exact_half(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0), ("a", 3.0, 1.0, 1)], "k string, x double, w double, i long")
    assert rows(stats.weighted_median(df, ["k"], "x", "w", "i"), "weighted_median") == [(2.0,)]


# windows


def test_windows_are_null_until_full(spark):
    s = windows.Series(["k"], ["i"])
    got = rows(series(spark, [1, 2, 3, 4]).select("i", s.sma("x", 3), s.rolling_max("x", 2)).orderBy("i"))
    assert got == [(0, None, None), (1, None, 2.0), (2, 2.0, 3.0), (3, 3.0, 4.0)]


def test_centred_windows_mirror_the_edges(spark):
    got = rows(windows.centred(series(spark, [1, 2, 4, 8]), ["k"], ["i"], "x", 1, windows.mean_of).orderBy("i"), "smooth")
    assert [round(x, 6) for (x,) in got] == [round((2 + 1 + 2) / 3, 6), round(7 / 3, 6), round(14 / 3, 6), round(16 / 3, 6)]


def test_hampel_repairs_one_spike(spark):
    got = windows.hampel(series(spark, [1, 2, 1, 50, 2, 1, 2]), ["k"], ["i"], "x", 2, 3.0).orderBy("i").collect()
    assert [r.impulse for r in got] == [False] * 3 + [True] + [False] * 3 and got[3].repaired == 2.0


def test_reversals_keep_ends_and_the_last_of_equals(spark):
    assert rows(windows.reversals(series(spark, [1, 3, 3, 2, 2, 5]), ["k"], ["i"], "x").orderBy("i"), "i", "x") == [(0, 1.0), (2, 3.0), (4, 2.0), (5, 5.0)]


def test_mape_needs_actual_values(spark):
    with pytest.raises(Exception):
        windows.forecast_errors(series(spark, [0, 1]).withColumn("p", F.lit(1.0)), ["k"], "x", "p").collect()


@pytest.mark.parametrize(("kind", "want"), [("linear", [-10.0, 5.0, 20.0, 35.0]), ("nearest", [0.0, 0.0, 20.0, 30.0])])
def test_interpolation_between_and_beyond_nodes(spark, kind, want):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 30.0)], "k string, t double, v double")
    points = spark.createDataFrame([("a", -1.0, 1), ("a", 0.5, 2), ("a", 2.0, 3), ("a", 3.5, 4)], "k string, t double, id long")
    assert [v for _, v in sorted(rows(windows.interpolate(points, nodes, ["k"], "t", "v", kind), "id", "value"))] == want


# streaming


def test_count_windows_drop_the_tail(spark):
    assert sorted(rows(events.count_windows(series(spark, [1, 2, 3, 4, 5, 6]), ["k"], ["i"], "x", 3, 2), "window", "sum")) == [(0, 6.0), (1, 12.0)]
    assert events.count_windows(series(spark, [1, 2]), ["k"], ["i"], "x", 3, 1).count() == 0
    w = events.count_windows(series(spark, [5, 5, 0, 0, 8, 8]), ["k"], ["i"], "x", 2, 2)
    assert rows(events.detect(w, ["k"], F.col("sum") / 10).orderBy("window"), "start", "event_id") == [(0, 0), (4, 1)]


KERNELS = [kernels.ema(0.5), kernels.seeded_ema(3), kernels.wilder(3), kernels.rsi(3), kernels.holt(0.5, 0.5), kernels.holt_winters(0.5, 0.3, 0.2, 4), kernels.cusum(0.0, 0.5, 2.0), kernels.page_hinkley(0.1, 3.0, 3)]
KERNELS += [kernels.ewma_chart(0.0, 1.0, 0.2, 3.0), kernels.health_index(-2.0, 2.0, 0.4), kernels.kalman(0.1, 1.0), kernels.adaptive_alpha(0.1, 0.05), kernels.spikes(4, 0.2, 1.5)]


def test_batch_kernels_keep_series_apart(spark):
    df = series(spark, [1, 2, 3]).union(series(spark, [10, None, 20], "b"))
    got = sorted(rows(kernels.in_batch(df, "k", ["i"], "x", kernels.ema(0.5))))
    assert got == [("a", 0, 1.0), ("a", 1, 1.5), ("a", 2, 2.25), ("b", 0, 10.0), ("b", 2, 15.0)]


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: "-".join(k.names))
def test_kernels_step_like_plain_loops(spark, kernel):
    values = np.random.default_rng(3).standard_normal(40).round(3).tolist()
    want, state = [], kernel.start
    for x in values:
        state, out = kernel.step(state, x)
        want.append(out)
    got = rows(kernels.in_batch(series(spark, values), "k", ["i"], "x", kernel).orderBy("i"), *kernel.names)
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    values = np.random.default_rng(4).standard_normal(30).round(3).tolist()
    df = series(spark, values).union(series(spark, values[::-1], "b"))
    for part in range(3):
        df.filter((F.col("i") >= 10 * part) & (F.col("i") < 10 * part + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    kernel = kernels.cusum(0.0, 0.2, 1.0)
    q = kernels.in_stream(stream, "k", "i", "x", kernel).writeStream.format("memory").queryName("cusums").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(rows(spark.table("cusums"))) == sorted(rows(kernels.in_batch(df, "k", ["i"], "x", kernel)))


def test_hourly_windows_and_sessions_run_on_streams(spark, tmp_path, data):
    spark.read.parquet(f"{data}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for name, f in (("hours", lambda s: events.hourly(s, "ts", ["event_type"], "value")), ("gaps", lambda s: events.sessions(s, "ts", "user_id"))):
        q = f(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        whole = f(spark.read.schema(schema).parquet(str(tmp_path / "in"))).count()
        assert 0 < spark.table(name).count() <= whole


# flows, text, retrieval


def test_flow_columns_guard_their_denominators(spark):
    df = spark.createDataFrame([(0, 10, 1, 1, 5.0, 4.0), (0, 0, 0, 0, 1.0, 3.0)], "bytes_out long, bytes_in long, packets_out long, packets_in long, start_time double, end_time double")
    got = rows(flows.with_derived(df), "duration", "throughput_bps", "asymmetry")
    assert got == [(0.0, 0.0, math.inf), (2.0, 0.0, 0.0)]


def test_alert_lines(spark):
    a = spark.createDataFrame([("port_scan", "s", None, "vertical", 0.97)], "detector string, source string, target string, kind string, confidence double")
    assert "critical" in flows.event_lines(a).first().line
    assert flows.event_lines(a, "cef").first().line == "CEF:0|heliograin|flows|1|port_scan|vertical|9|src=s dst="
    assert flows.event_lines(a, "leef").first().line.startswith("LEEF:2.0|")


def test_tokens_and_spans(spark):
    df = spark.createDataFrame([(1, ' "Hello," World!\t(x) ... ')], "id long, t string")
    assert rows(df.select(text.tokens(F.col("t")), text.normal_tokens(F.col("t")))) == [(['"Hello,"', "World!", "(x)", "..."], ["hello", "world", "x"])]
    tags = spark.createDataFrame([(1, i, t) for i, t in enumerate(["I-a", "I-b", "O", "B-c", "B-c", "?"])], "k long, i long, tag string")
    assert sorted(rows(text.bio_spans(tags, ["k"], "i", "tag"), "start", "end", "label")) == [(0, 2, "a"), (3, 4, "c"), (4, 5, "c")]


def test_minhash_links_equal_sets_and_stay_linear_in_buckets(spark):
    words = [" ".join(f"w{j}" for j in range(k, k + 20)) for k in range(0, 200, 40)]
    df = spark.createDataFrame([(i, words[i % 5]) for i in range(50)], "id long, t string")
    b, r = text.bands_for(0.8, 32)
    links = text.candidate_pairs(text.minhash(df, "id", text.tokens(F.col("t")), 32), b, r)
    assert sorted(rows(links)) == sorted((i % 5, i) for i in range(5, 50))


def test_minhash_links_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = [[f"w{k}" for k in rng.integers(0, 5000, 60)] for _ in range(60)]
    for w in texts[:60]:
        for cuts in (0, 1, 2):  # similarity 1, 0.84 and about 0.7
            other = list(w)
            for at in rng.choice(np.arange(5, 55), cuts, replace=False):
                other[at] = "other"
            texts.append(other)
        texts.append(w[:52])  # 0.86
    df = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(texts)], "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    got = set(rows(catalog.QUERIES["text_minhash_links"](spark, str(tmp_path))))

    def groups(links):
        label = list(range(len(sets)))
        for a, b in links:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        return label

    assert got <= near and groups(got) == groups(near) and len(got) < len(sets)


def test_order_statistics_of_large_and_tied_groups(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.integers(0, 40, 5000).astype(float), "b": rng.standard_normal(3000), "c": np.array([1.0, 5.0]), "d": np.full(2500, 7.0), None: rng.standard_normal(1500)}
    frame = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "k string, x double")
    points = [0.0, 0.003, 0.25, 0.5, 0.9, 0.999, 1.0]
    for r in stats.quantiles(frame, ["k"], "x", points).collect():
        assert np.allclose(r[1:], np.quantile(groups[r.k], points))
    for r in stats.mad(frame, ["k"], "x", consistent=False).collect():
        assert abs(r.mad - np.median(np.abs(groups[r.k] - np.median(groups[r.k])))) < 1e-12
    for r in stats.trimmed_mean(frame, ["k"], "x", 0.1).collect():
        v = np.sort(groups[r.k])
        k = int(len(v) * 0.1)
        w = np.clip(v, v[k], v[len(v) - k - 1])
        assert abs(r.trimmed_mean - v[k : len(v) - k].mean()) < 1e-9 and abs(r.winsorized_mean - w.mean()) < 1e-9
    assert stats.quantiles(frame, [], "x", [0.5]).collect()[0][0] == np.median(np.concatenate(list(groups.values())))


def test_tails_against_known_values(spark):
    from heliograin.functions import tails

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    # tabulated critical values
    for t, dof, p in ((12.706, 1, 0.05), (2.571, 5, 0.05), (2.042, 30, 0.05), (1.96, 10**7, 0.05), (3.169, 10, 0.01)):
        assert abs(value(tails.t_tail(F.lit(t), F.lit(dof))) - p) < 5e-5
    for x, dof, p in ((3.841, 1, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05), (6.635, 1, 0.01)):
        assert abs(value(tails.chi_square_tail(F.lit(x), F.lit(dof))) - p) < 2e-5
    for x, a, b, p in ((4.965, 1, 10, 0.05), (3.326, 5, 10, 0.05), (1.0, 10**5, 10**5, 0.5)):
        assert abs(value(tails.f_tail(F.lit(x), F.lit(a), F.lit(b))) - p) < 5e-5
    assert value(tails.t_tail(F.lit(0.0), F.lit(4), "greater")) == 0.5 and value(tails.t_tail(F.lit(-2.571), F.lit(5), "less")) < 0.0251
    assert value(tails.kolmogorov_tail(F.lit(0.0), F.lit(10))) == 1.0 and abs(value(tails.kolmogorov_tail(F.lit(1.358 / 1000), F.lit(10**6))) - 0.05) < 2e-3


def test_autoregression_against_the_recursion(spark):
    import numpy as np

    from heliograin.operators import fitting

    x = np.random.default_rng(5).standard_normal(80).cumsum()
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 2.0) for i in range(6)] + [("c", 0, 1.0)], "k string, i int, x double")
    got = {r.k: r for r in fitting.autoregression(frame, ["k"], ["i"], "x", 4, 3).collect()}
    r = np.array([((x[: 80 - k] - x.mean()) * (x[k:] - x.mean())).sum() for k in range(5)])
    phi = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)]), r[1:])
    last, want = list(x[-4:]), []
    for _ in range(3):
        want.append(x.mean() * (1 - phi.sum()) + sum(c * v for c, v in zip(phi, reversed(last[-4:]))))
        last.append(want[-1])
    assert np.allclose([got["a"][f"phi_{k}"] for k in range(1, 5)], phi) and np.allclose([got["a"][f"forecast_{k}"] for k in range(1, 4)], want)
    assert got["b"].intercept == 2.0 and got["b"].phi_1 == 0.0 and got["b"].forecast_3 == 2.0 and "c" not in got


def test_relations_by_pattern(spark):
    one = spark.createDataFrame([("the cat Is part of a big house".split(),)], "w array<string>")
    pair = lambda p: (lambda r: r and (r.subject, r.object))(one.select(text.relation(F.col("w"), p)).first()[0])
    assert pair("{SUBJ} is part of {OBJ}") == ("the cat", "a big house") and pair("{OBJ} is * of {SUBJ}") == ("a big house", "the cat")
    assert pair("{SUBJ} is") == ("the cat", "") and pair("the cat {OBJ}") == ("", "Is part of a big house") and pair("{SUBJ} runs {OBJ}") is None
    assert pair("{SUBJ} house {OBJ}") is None and pair("no placeholder") is None


def test_bloom_filters_never_miss(spark):
    df = spark.range(500)
    held = text.bloom_filter(df, F.col("id"), 1 << 13, 4)
    other = text.bloom_contains(spark.range(1000, 3000), F.col("id"), "maybe", held, 1 << 13, 4)
    assert text.bloom_contains(df, F.col("id"), "maybe", held, 1 << 13, 4).filter("not maybe").count() == 0
    assert 0 < other.filter("maybe").count() / 2000 < 5 * text.bloom_fpr(1 << 13, 4, 500)
    assert text.bloom_contains(df, F.col("id"), "maybe", text.bloom_filter(df.filter("false"), F.col("id"), 64, 2), 64, 2).filter("maybe").count() == 0


def test_index_recall_against_exact_search(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    exact = set(rows(retrieval.dense_search(e, q, "vec_id", "embedding", 10), "query", "id"))
    ivf = set(rows(retrieval.ivf_search(e, q, "vec_id", "embedding", 10, lists=32, probes=24), "query", "id"))
    assert len(exact & ivf) / len(exact) >= 0.9


@pytest.mark.parametrize("name", ["retrieval_lsh_top_k", "retrieval_ivf_top_k"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_index_queries_reach_the_recall(spark, name, sf):
    d = f"/root/testdata/{sf}"
    exact = set(rows(catalog.QUERIES["retrieval_dense_top_k"](spark, d), "query", "id"))
    found = set(rows(catalog.QUERIES[name](spark, d), "query", "id"))
    assert len(exact & found) / len(exact) >= retrieval.RECALL


def test_lsh_answers_near_neighbours_from_its_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 1, 16)) + 0.05 * rng.standard_normal((40, 12, 16))).reshape(-1, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    exact = set(rows(retrieval.dense_search(df, df, "id", "v", 5), "query", "id"))
    left, search = [], retrieval.dense_search
    monkeypatch.setattr(retrieval, "dense_search", lambda r, q, *a: (left.append(q.count()), search(r, q, *a))[1])
    found = set(rows(retrieval.lsh_search(df, df, "id", "v", 16, 5), "query", "id"))
    assert len(exact & found) / len(exact) >= 0.9 and left[0] < len(x) / 2


def test_rank_fusion_and_zero_vectors(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 8, 1)], "query long, id long, rank long")
    got = {i: s for _, i, s in rows(retrieval.rank_fusion(ranked))}
    assert got[7] == pytest.approx(1 / 61) and got[8] == pytest.approx(1 / 61 + 1 / 62)
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert z.select(retrieval.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


# graphs, datasets


def test_cycles_and_self_loops_are_errors(spark):
    with pytest.raises(Exception):
        graph.check_edges(spark.createDataFrame([(1, 1)], "src long, dst long")).collect()
    with pytest.raises(ValueError):
        graph.topological_levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
    assert graph.shortest_path(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long"), 1, 4) == [1, 3, 4]
    assert graph.shortest_path(spark.createDataFrame([(1, 2)], "src long, dst long"), 2, 1) == []
    ranks = rows(graph.page_rank(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")))
    assert sum(r for _, r in ranks) == pytest.approx(1.0)


def test_imputer_drops_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, 5.0), (None, 1.0, 5.0)], "a double, b double, c double")
    m = datasets.fit_imputer(df, ["a", "b", "c"])
    assert m == {"a": 2.0} and [r.a for r in datasets.impute(df, m).collect()] == [1.0, 3.0, 2.0]


def test_metrics_are_null_without_cases(spark):
    df = spark.createDataFrame([("g", 0, 0.2), ("g", 0, 0.9)], "k string, y int, s double")
    r = datasets.detection_report(df, ["k"], "y", "s", 0.5).first()
    assert r.recall is None and r.precision == 0.0 and datasets.auroc(df, ["k"], "y", "s").first().auroc is None


def test_splits_are_disjoint_and_stable(spark):
    df = spark.range(2000)
    a, b = (sorted(rows(datasets.random_split(df, "id", {"train": 3, "test": 1}, 5))) for _ in range(2))
    assert a == b and 0.7 < sum(s == "train" for _, s in a) / 2000 < 0.8


def test_batches_number_rows_over_partitions(spark):
    got = sorted(rows(datasets.batches(spark.range(100), ["id"], 7, drop_last=True)))
    assert got == [(i, i // 7) for i in range(98)]


# market, signals, decimals


def test_drawdown_and_trade_stats(spark):
    assert rows(market.drawdown(series(spark, [100, 120, 90, 130]), ["k"], ["i"], "x"), "max_drawdown") == [(0.25,)]
    assert rows(market.trade_stats(series(spark, [1, 2, 0]), ["k"], "x"), "wins", "losses", "profit_factor") == [(2, 0, math.inf)]


def test_cusum_without_reset_and_shewhart_rules(spark):
    x = [0.0, 1.0, 2.0, -3.0, 4.0]
    got = rows(signal.cusum(series(spark, x), ["k"], ["i"], "x", 0.0, 1.0, 0.5, 4.0).orderBy("i"), "cusum_high")
    s, want = 0.0, []
    for v in x:
        s = max(0.0, s + v - 0.5)
        want.append(s)
    assert [v for (v,) in got] == pytest.approx(want)
    assert [r.rule for r in signal.shewhart(series(spark, [0.0] * 8), ["k"], ["i"], "x").collect()] == [0] * 8


def test_cfar_never_detects_at_the_edges(spark):
    d = signal.cfar(series(spark, [9.0] + [1.0] * 9 + [9.0] + [1.0] * 10), ["k"], ["i"], "x", 1, 4, 3.0).filter("detected")
    assert rows(d, "i") == [(10,)]


def test_accrual_ties_and_day_counts(spark):
    df = spark.createDataFrame([(Decimal("0.60"), Decimal("0.1000000"))], "p decimal(14,2), r decimal(9,7)")
    assert tuple(df.select(decimals.accrue(F.col("p"), F.col("r")).alias("a")).first().a) == (Decimal("0.01"), Decimal("0.00"), Decimal("0.61"))
    d = spark.createDataFrame([("2023-02-28", "2023-08-31")], "s string, e string").select(F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    assert d.select(decimals.days_30_360(F.col("s"), F.col("e"))).first()[0] == 180
    assert d.select(decimals.interest_30_360(F.lit(Decimal("100000.00")), F.lit(Decimal("0.0500000")), F.col("s"), F.col("e"))).first()[0] == Decimal("2500.00")


def test_brackets_and_annuities(spark):
    b = [(Decimal("0"), Decimal("0.11")), (Decimal("50000"), Decimal("0.22"))]
    one = spark.range(1)
    assert one.select(decimals.bracket_tax(F.lit(Decimal("100000.00")), b)).first()[0] == Decimal("16500.00")
    assert one.select(decimals.flat_top_tax(F.lit(Decimal("100000.00")), b)).first()[0] == Decimal("22000.00")
    assert decimals.annuity(Decimal("1200"), Decimal("0"), 12) == Decimal("100.00")
    with pytest.raises(ValueError):
        decimals.annuity(Decimal("1"), Decimal("0"), 0)
    s = decimals.schedule(Decimal("1000.00"), Decimal("0.01"), 7)
    assert s[-1][-1] == 0 and sum(r[2] for r in s) == Decimal("1000.00")


def test_unknown_currency_and_full_fields_are_errors(spark):
    rates = spark.createDataFrame([("EUR", Decimal("1"))], "code string, rate decimal(16,8)")
    df = spark.createDataFrame([(Decimal("1.00"), "EUR", "XXX")], "p decimal(14,2), s string, t string")
    with pytest.raises(Exception):
        decimals.convert_with(df, rates, "p", "s", "t").collect()
    with pytest.raises(Exception):
        df.select(decimals.fixed_point(F.lit(Decimal("1000.00")), 5, 2)).collect()


def test_rainflow_cycles_of_a_known_history(spark):
    got = sorted(rows(kernels.rainflow(series(spark, [-2, 1, -3, 5, -1, 3, -4, 4, -2]), "k", ["i"], "x"), "range", "count"))
    assert got == [(3.0, 0.5), (4.0, 0.5), (4.0, 1.0), (6.0, 0.5), (8.0, 0.5), (8.0, 0.5), (9.0, 0.5)]
    assert rows(kernels.rainflow(series(spark, [1, 1, 1]), "k", ["i"], "x")) == []


def test_bar_kernels_agree_with_their_parts(spark):
    rng = np.random.default_rng(8)
    close = 100 + rng.standard_normal(60).cumsum()
    bars = [("a", i, float(c + 1), float(c - 1), float(c)) for i, c in enumerate(close)]
    df = spark.createDataFrame(bars, "k string, i long, h double, l double, c double")
    k = rows(kernels.in_batch(df, "k", ["i"], ["h", "l", "c"], kernels.keltner(5, 2.0)).orderBy("i"), "lower", "middle", "upper")
    ema = [v for (v,) in rows(kernels.in_batch(df, "k", ["i"], "c", kernels.seeded_ema(5)).orderBy("i"), "ema")]
    assert [m for _, m, _ in k] == ema and all(lo < m < hi for lo, m, hi in k[4:])
    s = rows(kernels.in_batch(df, "k", ["i"], ["h", "l", "c"], kernels.supertrend(5, 2.0)).orderBy("i"), "band", "direction")
    assert all((b <= c) == (d > 0) or b == c for (b, d), c in zip(s[5:], close[5:]))
    m = rows(kernels.in_batch(df, "k", ["i"], "c", kernels.macd(3, 6, 4)).orderBy("i"), "macd", "signal")
    assert [x is None for x, _ in m][:6] == [True] * 5 + [False] and m[8][1] is not None and m[7][1] is None


def test_sequence_monitor_and_rollback(spark):
    msgs = [(5, 0), (5, 1), (5, 1), (6, 0), (9, 9), (6, 1)]
    df = spark.createDataFrame([("a", i, float(s), float(q)) for i, (s, q) in enumerate(msgs)], "k string, i long, s double, q double")
    assert [v for (v,) in rows(kernels.in_batch(df, "k", ["i"], ["s", "q"], kernels.sequence_monitor()).orderBy("i"), "verdict")] == [0.0, 1.0, 2.0, 1.0, 3.0, 1.0]
    hits = rows(kernels.in_batch(series(spark, [1, 0, 0, 1, 1, 1]), "k", ["i"], "x", kernels.rollback_monitor(3, 0.5, 3)).orderBy("i"), "rollback")
    assert [h for (h,) in hits] == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0]


def test_hotelling_needs_a_regular_covariance(spark):
    from heliograin.operators import monitoring

    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    with pytest.raises(ValueError):
        monitoring.hotelling(df, df, ["a", "b"], 3.0)
