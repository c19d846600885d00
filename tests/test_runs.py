import inspect
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reprise.functions import stats
from reprise.plans import runs

T0 = datetime(2026, 1, 1)


def test_first_seen_keeps_every_worker(spark, monkeypatch):
    # Workers w6 to w0 of one run, first seen in that order and again later; two of another run at once.
    made = [("a", f"w{6 - n}", T0 + timedelta(minutes=n)) for n in range(7)] + [("a", f"w{n}", T0 + timedelta(hours=1, minutes=n)) for n in range(7)]
    made += [("b", "w1", T0), ("b", "w0", T0)]
    df = spark.createDataFrame(made, "run_id string, worker_id string, started_at timestamp").repartition(3)
    monkeypatch.setattr(runs.views, "requests", lambda spark, sf_dir, *columns: df.select(*columns))
    got = [(r.run_id, r.rank, r.worker_id) for r in runs.so05_first_seen(spark, "").orderBy("run_id", "rank").collect()]
    assert got == [("a", n + 1, f"w{6 - n}") for n in range(7)] + [("b", 1, "w0"), ("b", 2, "w1")]


def test_intervals_draw_all_resamples(spark, monkeypatch):
    asked = []
    for f in ("bootstrap", "poisson_mean_interval"):
        default = inspect.signature(getattr(stats, f)).parameters["resamples"].default
        monkeypatch.setattr(runs.stats, f, lambda *a, resamples=default: asked.append(resamples))
    df = spark.createDataFrame([("warm", 1.0, "q", False)], "arm string, ttft_ms double, engine_request_id string, control boolean")
    monkeypatch.setattr(runs.views, "requests", lambda *a: df)
    monkeypatch.setattr(runs.M, "jn04_clean_pairs", lambda *a: df)
    runs.ag26_bootstrap(spark, "")
    runs.ag26_poisson_interval(spark, "")
    assert asked == [stats.RESAMPLES, stats.RESAMPLES]


def test_poisson_interval_draws(spark):
    made = [(n % 3 or None, float(n * n % 101), f"q{n}") for n in range(400)] + [(1, None, "x")]
    df = spark.createDataFrame(made, "g bigint, x double, id string").repartition(4)
    size = 300
    # The same draws in columns.
    u = spark.createDataFrame([(f"q{n}",) for n in range(400)], "id string").select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda r: F.pmod(F.xxhash64("id", r), F.lit(1 << 53)) / float(1 << 53)).alias("u"))
    weights = {r.id: [sum(x >= s for s in stats._POISSON) for x in r.u] for r in u.collect()}
    got = {r.g: r for r in stats.poisson_mean_interval(df, ["g"], "x", "id", size).collect()}
    assert set(got) == {None, 1, 2}
    for g, r in got.items():
        own = [(x, weights[i]) for k, x, i in made if k == g and x is not None]
        means = sorted(sum(x * w[k] for x, w in own) / sum(w[k] for _, w in own) for k in range(size))
        assert r.n == len(own) and abs(r.point - sum(x for x, _ in own) / len(own)) < 1e-9
        assert abs(r.low - means[7]) < 1e-9 and abs(r.high - means[292]) < 1e-9
