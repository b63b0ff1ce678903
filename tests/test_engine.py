"""Statistical gates on series with a known truth, and the operators around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.functions import kernel, stats
from chronolens.operators import audit, budget, compare, garch, registry, surrogates
from chronolens.plans import series as S
from chronolens.sources import connectors, lake


def frame(spark, r, name="s"):
    return spark.createDataFrame([(name, i + 1, None, float(x)) for i, x in enumerate(r)], "series_id string, i long, dt timestamp_ntz, ret double")


def garch_series(n, omega, alpha, beta, seed):
    rng = np.random.default_rng(seed)
    z = rng.standard_t(6, n + 1000) / np.sqrt(1.5)
    v, e, out = omega / (1 - alpha - beta), 0.0, []
    for x in z:
        v = omega + alpha * e * e + beta * v
        e = np.sqrt(v) * x
        out.append(e)
    return np.array(out[1000:])


def test_kernel_equals_plan(spark):
    r = np.random.default_rng(3).normal(0, 0.01, 400)
    plan = {x["statistic"]: x["value"] for x in stats.all_statistics(frame(spark, r)).collect()}
    bulk = dict(zip(stats.NAMES, kernel.statistics(r[None, :])[0], strict=True))
    for name in stats.NAMES:
        assert plan[name] == pytest.approx(bulk[name], rel=1e-6, abs=1e-9), name


def test_degenerate_series(spark):
    flat = {x["statistic"]: x["value"] for x in stats.all_statistics(frame(spark, [0.0] * 50)).collect()}
    assert flat["Excess kurtosis"] == 0 and flat["ACF r lag 1"] == 0 and flat["Regression R2"] is None
    short = {x["statistic"]: x["value"] for x in stats.all_statistics(frame(spark, [0.1, 0.2, -0.1])).collect()}
    assert short["Same-band rate"] is None and short["ACF |r| lag 22"] == 0


def test_white_noise_isnt_rejected_and_garch_is_only_by_the_shuffle(spark):
    noise = np.random.default_rng(7).normal(0, 0.01, 1500)
    clustered = garch_series(3000, 1e-6, 0.09, 0.89, 5)
    both = frame(spark, noise, "noise").unionAll(frame(spark, clustered, "garch"))
    got = {(x["series_id"], x["statistic"], x["null_name"]): x["p_two_sided"] for x in compare.compare(both, 200, ("shuffled", "garch"), seed=1).collect()}
    for null in ("shuffled", "garch"):
        assert got["noise", "ACF |r| lag 1", null] > 0.01
    for statistic in ("ACF |r| lag 1", "Same-band rate"):
        assert got["garch", statistic, "shuffled"] < 0.05
        assert got["garch", statistic, "garch"] > 0.02


def test_garch_recovery_and_residuals():
    r = garch_series(8000, 2e-6, 0.08, 0.90, 11)
    p, _ = garch.fit(r)
    assert abs(p.alpha - 0.08) < 0.04 and abs(p.beta - 0.90) < 0.04 and abs(p.persistence - 0.98) < 0.02
    z = garch.residuals(r, p)
    assert z.std(ddof=1) == pytest.approx(1)
    kurtosis = lambda x: ((x - x.mean()) ** 4).mean() / x.var() ** 2
    assert kurtosis(z) < kurtosis(r)
    assert garch.fit(np.zeros(100))[0].alpha == 0
    with pytest.raises(ValueError):
        garch.residuals(np.zeros(100), garch.fit(np.zeros(100))[0])


def test_surrogates(spark):
    r = np.random.default_rng(2).normal(size=90)
    own = frame(spark, r)
    shuffled = surrogates.iid_shuffle(own, 2).toPandas()
    for _, g in shuffled.groupby("sim"):
        assert sorted(g["ret"]) == pytest.approx(sorted(r)) and sorted(g["i"]) == list(range(1, 91))
    block = surrogates.circular_block(own, 1, block=10).toPandas().sort_values("i")["source"].to_numpy()
    assert len(block) == 90 and all((b - a) % 90 == 1 for k in range(9) for a, b in zip(block[10 * k : 10 * k + 9], block[10 * k + 1 : 10 * k + 10], strict=True))
    runs = surrogates.stationary_bootstrap(own, 4, mean_block=10).toPandas().sort_values(["sim", "i"])
    steps = np.diff(runs["source"].to_numpy()) % 90 == 1
    assert 0.8 < steps.mean() < 0.98


def test_partition_count_doesnt_matter(spark):
    own = frame(spark, np.random.default_rng(5).normal(size=120))
    setup = compare.Setup(20, seed=3)
    one = compare.distribution(own, setup).toPandas().sort_values(["null_name", "statistic", "value"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        two = compare.distribution(own, setup).toPandas().sort_values(["null_name", "statistic", "value"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one.equals(two)


def test_audits(spark):
    own = frame(spark, np.random.default_rng(1).normal(size=300))
    trailing = F.expr("avg(ret) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
    whole = F.expr("ret - avg(ret) OVER (PARTITION BY series_id)")
    clean = audit.audit_rebuild(own.withColumn("f", trailing), "f", lambda h: h["ret"].tail(20).mean(), "clean", 30).first()
    dirty = audit.audit_rebuild(own.withColumn("f", whole), "f", lambda h: h["ret"].iloc[-1] - h["ret"].mean(), "dirty", 30).first()
    broken = audit.audit_rebuild(own.withColumn("f", trailing), "f", lambda h: 1 / 0, "broken", 5).first()
    assert clean["passed"] and not dirty["passed"] and not broken["passed"]
    by_window = audit.audit_window(own.withColumn("f", whole), "f", lambda w: F.col("ret") - F.avg("ret").over(w), "window").first()
    assert not by_window["passed"]
    peek = audit.shift_test(own.withColumn("signal", F.signum("ret"))).first()
    late = audit.shift_test(own.withColumn("signal", F.expr("coalesce(sign(lag(ret) OVER (ORDER BY i)), 0D)"))).first()
    assert not peek["passed"] and late["passed"]


def test_bridged_returns_and_gates(spark):
    prices = spark.createDataFrame([("a", i, p) for i, p in enumerate([1.0, 0.0, 2.0, float("nan"), 4.0])], "series_id string, dt int, price double")
    assert [round(x["ret"], 6) for x in S.returns(prices.where("not isnan(price)"), bridge=True).orderBy("i").collect()] == [0.693147, 0.693147]
    assert S.with_enough(S.returns(prices, bridge=True), 500).count() == 0
    assert S.normalised(prices.toDF(" Series ID", "Date", "Adj Close")).columns == ["series_id", "date", "adj_close"]


def test_budget(spark):
    grid = spark.sql("SELECT n, 0.001D AS v FROM (SELECT explode(array(1, 2, 10, 1000)) AS n)")
    bars = [x["bar"] for x in budget.with_bar(grid, "n", "v").orderBy("n").collect()]
    assert bars[0] == 0 and bars == sorted(bars) and bars[3] < 10 * bars[2]
    cases = spark.createDataFrame([(0.06, 1500, 0.05, 0.0, 3.0), (0.06, 1500, 0.05, -1.5, 12.0), (0.06, 1, 0.05, 0.0, 3.0)], "sharpe double, n_obs int, bar double, skew double, kurtosis double")
    a, b, c = (x["dsr"] for x in budget.with_dsr(cases).collect())
    assert a > b and c is None


FIELDS = {"mechanism": "index funds must rebalance at the close", "who_is_forced": "index funds at quarter end", "counterparty": "dealers paid for inventory risk", "predicted_sign": "+", "predicted_magnitude_bp": [5, 10], "predicted_timing": "next day", "falsifier": "no drift in the week after"}


def test_gate_and_ledger(spark, tmp_path):
    hypotheses, ledger = registry.Hypotheses(tmp_path / "h"), registry.Ledger(tmp_path / "ledger.json", max_trials=3)
    own = frame(spark, np.random.default_rng(0).normal(0, 0.01, 400))
    gate = registry.Gate("ann", hypotheses, ledger, lambda h: own)
    other = registry.Gate("bob", hypotheses, ledger, lambda h: own)
    with pytest.raises(registry.PreRegistrationError):
        gate.get_returns("H-0001")
    for bad in ({"falsifier": "TBD"}, {"mechanism": ""}, {"counterparty": "dealers"}):
        with pytest.raises(registry.PreRegistrationError):
            gate.register_hypothesis(**FIELDS | bad)
    h = gate.register_hypothesis(**FIELDS)
    assert gate.get_returns(h.hypothesis_id).count() == 400
    for call in (other.get_returns, lambda x: other.submit_for_verdict(x, own)):
        with pytest.raises(registry.PreRegistrationError):
            call(h.hypothesis_id)
    verdict = gate.submit_for_verdict(h.hypothesis_id, own)
    assert verdict["n_trials_at_test"] == 1 and hypotheses.get(h.hypothesis_id).status in ("passed", "failed")
    child = gate.refine_hypothesis(h.hypothesis_id, **FIELDS)
    assert child.hypothesis_id == "H-0002" and child.parent_id == h.hypothesis_id
    gate.submit_for_verdict(child.hypothesis_id, own)
    gate.submit_for_verdict(child.hypothesis_id, own)
    with pytest.raises(registry.PreRegistrationError):
        gate.submit_for_verdict(child.hypothesis_id, own)
    assert gate.budget_status()["n_trials"] == 3 and len(gate.journal()) == 2
    assert ledger.frame(spark).count() == 3
    assert not any(hasattr(ledger, x) for x in ("reset", "clear", "delete"))


def test_lake(spark, tmp_path):
    store = lake.Lake(spark, str(tmp_path))
    rows = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 0.5).alias("b"), F.current_timestamp().alias("retrieved_at"))
    first = store.write("bronze", "x-y", rows)
    assert first == lake.content_digest(rows.orderBy(F.desc("a")).repartition(3)) and first != lake.content_digest(rows.limit(50))
    assert store.query("SELECT count(*) AS n FROM bronze_x_y").first()["n"] == 100
    store.append("bronze", "p", rows, "2024-01-01")
    store.append("bronze", "p", rows.drop("b").withColumn("c", F.lit(1)), "2024-01-02")
    store.append("bronze", "p", rows.limit(10), "2024-01-01")
    assert store.read("bronze", "p").count() == 110 and set(store.read("bronze", "p").columns) == {"a", "b", "c", "retrieved_at"}
    assert store.partitions("bronze", "p") == ["2024-01-01", "2024-01-02"]
    assert store.verify() == {"bronze/p": True, "bronze/x-y": True}
    rows.limit(3).write.mode("overwrite").parquet(store.path("bronze", "x-y") + "/part_key=all")
    assert store.verify()["bronze/x-y"] is False
    assert [x["dataset"] for x in store.summary().collect()] == ["bronze/p", "bronze/x-y"]
    with pytest.raises(ValueError):
        store.path("lead", "x")
    with pytest.raises(FileNotFoundError):
        store.read("gold", "none")


def test_connectors(spark, tmp_path):
    put = lambda name, text: str((tmp_path / name).write_text(text) and tmp_path / name)
    vix = connectors.volatility_index(spark, put("vix.csv", "DATE,OPEN,HIGH,LOW,CLOSE\n01/02/2024,1,2,3,4\n01/03/2024,1,,3,4\n"))
    assert vix.count() == 1 and vix.first()["close"] == 4.0
    cot = connectors.positioning(spark, put("cot.csv", "Market,Report_Date_as_YYYY-MM-DD\nA,2024-01-02\nB,bad\n"))
    row = cot.first()
    assert cot.count() == 1 and (row["knowable_at"] - row["event_time"]).days == 3
    assert connectors.company_tickers(spark, put("t.json", '{"0":{"cik_str":1,"ticker":"A","title":"a"},"1":{"cik_str":2,"ticker":"B","title":"b"}}')).count() == 2
    recent = '{"filings":{"recent":{"form":["10-Q","8-K","10-Q"],"reportDate":["2024-03-31","2024-04-01",""],"filingDate":["2024-05-01","2024-04-02","2024-05-02"]}}}'
    assert connectors.filings(spark, put("f.json", recent), 7, ("10-Q",)).count() == 1
    assert connectors.fund_holdings(spark, put("h.csv", "Fund\nas of\n\nTicker,Name,Weight (%)\nAAPL,Apple,5\n")).columns == ["ticker", "name", "weight_(%)"]
    assert connectors.watchlist(spark, put("w.txt", " aapl \n\nmsft\n")) == ["AAPL", "MSFT"]
    assert connectors.watchlist(spark, str(tmp_path / "none")) == [] and len(connectors.watchlist(spark)) == 19
    store = lake.Lake(spark, str(tmp_path / "lake"))

    def fails():
        raise OSError

    out = connectors.collect(store, {"good": lambda: vix, "none": lambda: vix.limit(0), "bad": fails})
    assert out == {"good": "ok", "none": "empty", "bad": "failed(OSError)"} and connectors.exit_code(out) == 0
    assert connectors.stock_history(lambda s: vix, "X") is None


def test_fetched_files_are_kept(tmp_path):
    source = tmp_path / "a.csv"
    source.write_text("one")
    get = lambda **more: connectors.fetch(source.as_uri(), tmp_path / "landing", rate_limit_s=0, **more).read_text()
    assert get() == "one"
    source.write_text("two")
    assert get() == "one" and get(ttl_hours=0) == "two"
    with pytest.raises(OSError):
        connectors.fetch((tmp_path / "none").as_uri(), tmp_path / "landing", rate_limit_s=0)


def test_positioning_from_a_zip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "cot.zip", "w") as z:
        z.writestr("annual.txt", "Market,As_of_Date_In_Form_YYMMDD,Report_Date_as_YYYY-MM-DD\nA,240102,2024-01-02\nB,240109,2024-01-09\n")
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("old.txt", "Market,As_of_Date_In_Form_YYMMDD\nA,240102\n")
    assert str(connectors.positioning(spark, str(tmp_path / "old.zip"), str(tmp_path)).first()["event_time"]) == "2024-01-02 00:00:00"
    rows = connectors.positioning(spark, str(tmp_path / "cot.zip"), str(tmp_path)).orderBy("event_time").collect()
    assert [(r["market"], (r["knowable_at"] - r["event_time"]).days) for r in rows] == [("A", 3), ("B", 3)]


def test_stamps_are_validated(spark):
    from chronolens.operators import pit

    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02' AS happened, TIMESTAMP_NTZ'2024-01-01' AS known")
    with pytest.raises(pit.PITViolation):
        pit.add_pit(rows, "happened", "known")
    assert pit.add_pit(rows, "happened", "known", validate=False).count() == 1 and pit.add_pit(rows, "known", "happened").count() == 1


def test_shift_test_bounds_infinite_products(spark):
    own = frame(spark, [0.1, -0.2, float("inf"), float("nan"), 0.3]).withColumn("signal", F.lit(1.0))
    out = audit.shift_test(own).first()
    assert out["base"] is not None and np.isfinite(out["base"])


def test_journal_joins_hypotheses_with_their_verdicts(spark):
    own = spark.createDataFrame([("H-0001", "a", "passed", "m" * 200), ("H-0002", "a", "failed", "short"), ("H-0003", "b", "registered", "waits")], "hypothesis_id string, agent string, status string, mechanism string")
    verdicts = spark.createDataFrame([("H-0001", "clears the bar", True)], "hypothesis_id string, reason string, passed boolean")
    got = {r["hypothesis_id"]: r for r in registry.journal_frame(own, verdicts).collect()}
    assert set(got) == {"H-0001", "H-0002"} and len(got["H-0001"]["mechanism"]) == 120 and got["H-0001"]["passed"] and got["H-0002"]["reason"] is None


def test_hardest_null_is_the_one_with_the_largest_p(spark):
    rows = [("s", "x", n, 1.0, p) for n, p in (("shuffled", 0.01), ("block", 0.4), ("stationary", 0.4), ("garch", None))]
    got = compare.survivors(spark.createDataFrame(rows, "series_id string, statistic string, null_name string, real double, p_two_sided double")).first()
    assert got["hardest_null"] == "block" and not got["survives"]


def test_ledger_is_read_again(spark, tmp_path):
    first = registry.Ledger(tmp_path / "l.json", 3)
    first.record("H-0001", "a", frame(spark, np.random.default_rng(0).normal(size=50)))
    again = registry.Ledger(tmp_path / "l.json", 3)
    assert again.trials == first.trials and again.record("H-0002", "b", frame(spark, [0.1, 0.2]))["n_trials_at_test"] == 2


def test_streaming(spark, tmp_path, small):
    from chronolens.streaming import ingest

    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_landing(spark, str(tmp_path / "in"), events.schema)
    ingest.drain(ingest.tumbling(stream, "ts", "1 day", ["event_type"], "value"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] > 0.9 * events.count()


def test_report(spark, tmp_path):
    from chronolens import report

    table = spark.createDataFrame([("a<b", 1.5), (None, None)], "name string, value double")
    text = report.write({"One": table, "Two": table.limit(1)}, tmp_path / "r.html").read_text()
    assert "a&lt;b" in text and text.count("<section") == 2 and "1.5" in text


def test_flat_series_has_no_garch_null(spark):
    own = frame(spark, np.random.default_rng(1).normal(size=300), "a").union(frame(spark, np.zeros(300), "flat"))
    out = compare.compare(own, 12, seed=1)
    flat = {(r["statistic"], r["null_name"]): r for r in out.where("series_id = 'flat'").collect()}
    assert flat["Ann. volatility", "garch"]["p_two_sided"] is None and flat["Ann. volatility", "shuffled"]["p_two_sided"] == 1.0
    assert out.where("series_id = 'a' AND null_name = 'garch' AND p_two_sided IS NOT NULL").count() == 11


def test_own_statistics_nulls_and_parameters(spark):
    r = np.random.default_rng(4).normal(0.2, 1, 400)
    own = frame(spark, r).union(frame(spark, [np.nan, np.inf]).withColumn("i", F.col("i") + 1000))
    flip = {"sign": lambda x, n, rng: x * rng.choice([-1.0, 1.0], size=(n, len(x)))}
    out = {(x["statistic"], x["null_name"]): x for x in compare.compare(own, 99, ("sign", "shuffled"), 3, statistics={"mean": np.mean}, generators=flip).collect()}
    assert set(out) == {("mean", "sign"), ("mean", "shuffled")} and out["mean", "sign"]["real"] == pytest.approx(r.mean())
    assert out["mean", "sign"]["p_two_sided"] == pytest.approx(2 / 100) and out["mean", "shuffled"]["p_two_sided"] > 0.05
    wide = {x["statistic"]: x["real"] for x in compare.compare(own, 5, ("block",), window=10, k=3, horizon=2, block=5).collect()}
    bulk = dict(zip(stats.NAMES, kernel.statistics(r[None, :], 10, 3, 2)[0], strict=True))
    assert all(wide[n] == pytest.approx(bulk[n], rel=1e-6, abs=1e-9) for n in stats.NAMES)
    with pytest.raises(ValueError):
        compare.Setup(10, ("none",))


def test_linear_dependence_survives_shuffling_but_not_blocks(spark):
    rng = np.random.default_rng(8)
    r = np.zeros(1500)
    for t in range(1, 1500):
        r[t] = 0.3 * r[t - 1] + rng.normal()
    out = {x["null_name"]: x["p_two_sided"] for x in compare.compare(frame(spark, r), 99, ("shuffled", "block"), 1).where("statistic = 'ACF r lag 1'").collect()}
    assert out["shuffled"] <= 0.03 < 0.05 < out["block"]


def test_sharpe_of_noise_is_within_its_band(spark):
    rng = np.random.default_rng(11)
    rows = [(str(k), i, None, float(x)) for k in range(60) for i, x in enumerate(rng.normal(0, 0.01, 1000))]
    own = spark.createDataFrame(rows, "series_id string, i long, dt timestamp_ntz, ret double")
    sharpe = np.array([x["sharpe"] for x in stats.moments(own).collect()])
    assert np.mean(np.abs(sharpe) < 1.96 * np.sqrt(252 / 1000)) > 0.85


def test_noise_passes_rarely_and_an_edge_needs_years(spark):
    """200 strategies of noise over six years, then one edge with six years of evidence, and with ten."""
    rng = np.random.default_rng(3)
    paths = [rng.normal(0, 0.01, 1500) for _ in range(200)]
    for days in (1500, 2600):
        x = rng.normal(0, 0.01, days)
        paths.append((x - x.mean()) / x.std(ddof=1) * 0.01 + 1.7 / np.sqrt(252) * 0.01)
    rows = [("b", str(k % 10), k, float(x.mean() / x.std(ddof=1)), len(x), 0.0, 3.0) for k, x in enumerate(paths)]
    table = spark.createDataFrame(rows, "book string, agent string, trial_order long, sharpe double, n_obs long, skew double, kurtosis double")
    out = {r["trial_order"]: r for r in budget.replay(table).collect()}
    assert not any(out[k]["passed"] for k in range(200))
    assert not out[200]["passed"] and out[201]["passed"] and out[200]["dsr"] < 0.95 < out[201]["dsr"]


def test_asof_in_ranges_equals_one_range(spark):
    from chronolens.operators import pit

    rng = np.random.default_rng(2)
    left = spark.createDataFrame([(int(i), int(t) if i % 17 else None, f"k{i % 3}") for i, t in enumerate(rng.integers(0, 500, 400))], "id long, t long, k string")
    right = spark.createDataFrame([(int(i), int(t), f"k{i % 2}") for i, t in enumerate(rng.integers(50, 450, 60))], "rid long, t long, k string")
    rows = lambda **more: sorted((tuple(r) for r in pit.asof_join(left, right, "t", "t", **more).collect()), key=str)
    assert rows(ranges=1) == rows(ranges=7) == rows() and rows(by="k") == rows(by="k", ranges=5)
    best = {}
    for i, t, _ in (tuple(r) for r in left.collect()):
        known = [r["t"] for r in right.collect() if t is not None and r["t"] <= t]
        best[i] = max(known, default=None)
    assert all(best[r[0]] == r[4] for r in rows())


def test_lake_append_reads_only_its_partition(spark, tmp_path):
    store = lake.Lake(spark, str(tmp_path))
    for day in ("2024-01-01", "2024-01-02"):
        store.append("bronze", "p", spark.range(5).withColumn("day", F.lit(day)), day)
    for file in (tmp_path / "bronze" / "p" / "part_key=2024-01-01").glob("*.parquet"):
        file.write_bytes(b"broken")
    for crc in (tmp_path / "bronze" / "p" / "part_key=2024-01-01").glob(".*.crc"):
        crc.unlink()
    store.append("bronze", "p", spark.range(7).withColumn("day", F.lit("x")), "2024-01-03")
    assert store.manifest_entry("bronze", "p")["rows"] == 17


def bars(path, n, seed, drift=0.0):
    close = 100 * np.exp(np.cumsum(garch_series(n, 2e-6, 0.1, 0.88, seed) + drift))
    days = np.datetime64("2018-01-01") + np.arange(n)
    path.write_text("Date,Open,High,Low,Close\n" + "".join(f"{d},{c},{c},{c},{c}\n" for d, c in zip(days, close)))
    return str(path)


def test_commands(spark, tmp_path):
    from chronolens import report
    from chronolens.cli import collect, dashboard, flagship, orchestrate, screener
    from chronolens.operators import oracle
    from chronolens.sources import findings

    store, said = lake.Lake(spark, str(tmp_path / "data")), []
    sp = connectors.index_bars(spark, bars(tmp_path / "sp500.csv", 700, 1))
    results = flagship.run(spark, sp, store, 20, say=said.append)
    assert results.count() == 44 and store.read("gold", "vol_lab_three_worlds").count() == 11
    text = "\n".join(said)
    assert "Same-band rate" in text and "p garch" in text and "persistence" in text and "band 4" in text
    for i, s in enumerate(("AAA", "BBB")):
        bars(tmp_path / f"{s}.csv", 400, 5 + i, 0.001 * i)
    read = lambda s: connectors.daily_bars(spark, str(tmp_path / f"{s}.csv"), s)
    found = screener.run(store, ["AAA", "BBB", "NONE"], read, 20, say=said.append)
    assert {r["series_id"] for r in found.collect()} == {"AAA", "BBB"} and "NONE: no bars" in said
    document = findings.newest(store, "stocks")
    assert {r["series_id"] for r in document["stocks"]} == {"AAA", "BBB"} and document["n_sim"] == 20 and document["stocks"][0]["last_close"] > 0
    ledger, hypotheses = registry.Ledger(tmp_path / "ledger.json", 5), registry.Hypotheses(tmp_path / "h")
    assert orchestrate.run(spark, store, ledger, hypotheses, {"athena", "who"}, 12, say=said.append) == 0
    own = findings.newest(store, "oracle")["findings"]
    assert [x["dataset"] for x in own] == ["bronze/sp500_daily", "silver/sp500_returns"] and own[0]["n_obs"] == 699 and "p_garch" in own[0]["statistics"]["Same-band rate"]
    assert any("athena" in x for x in said) and any("unknown roles: who" in x for x in said) and not ledger.trials
    assert oracle.returns_of(store, "sp500").count() == 699 and oracle.returns_of(store, "nothing") is None
    assert screener.symbols_of(spark, ["x"], None) == ["X"] and len(screener.symbols_of(spark, [], None)) == 19
    assert set(dashboard.tabs(spark, store, ledger, hypotheses)) == {"Stocks", "Volatility", "Research", "Pipeline", "Budget"}
    page = report.write(dashboard.tabs(spark, store, ledger, hypotheses), tmp_path / "d.html").read_text()
    assert page.count("<section") == 5 and "AAA" in page
    assert collect.verify(store, said.append) == 0
    outcomes = connectors.collect(store, collect.jobs(spark, str(tmp_path)))
    assert outcomes["sp500_daily"] == "ok" and outcomes["vix_daily"].startswith("failed")
