"""Work that must not grow past the input: passes over a fact, rows moved to a few keys."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantile_brackets_do_not_sort_rows_by_group(spark, no_auto_broadcast):
    from ledgerlens.operators.ranks import _bracketed, grouped_quantiles

    df = spark.range(4000).select((F.col("id") % 4).alias("g"), (F.col("id") / 4).cast("int").cast("double").alias("v"))
    plan = executed(_bracketed(df, "v", [0.25, 0.99], ["g"]))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = {r.g: r.m for r in grouped_quantiles(df, "v", [0.5], by=["g"], names=["m"]).collect()}
    assert got == {g: 499.5 for g in range(4)}


@pytest.fixture
def counted(spark):
    """A frame that counts the rows taken from it, and the counter."""
    def make(rows, schema):
        seen = spark.sparkContext.accumulator(0)

        def look(row):
            seen.add(1)
            return row
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(look), schema), seen
    return make


def months(n, start=0):
    return [(f"{2000 + m // 12}-{m % 12 + 1:02d}-{d:02d}", float(m + d), float(m * m % 7 + d), f"g{m % 3}")
            for m in range(start, start + n) for d in (3, 17)]


MONTHS = "t string, y double, x double, g string"


def dated(df):
    return df.withColumn("t", F.col("t").cast("timestamp"))


@pytest.mark.parametrize("use", ["trend_series", "rolling_corr", "lagged_corr", "first_last_change"])
def test_period_series_reads_the_fact_once(counted, use):
    from ledgerlens.operators import correlation

    df, seen = counted(months(30), MONTHS)
    series = correlation.trend_series(dated(df), "t", "y", "x")
    (series if use == "trend_series" else getattr(correlation, use)(series)).collect()
    assert seen.value == 60


@pytest.mark.parametrize("freq, agg", [("M", "sum"), ("Q", "mean"), ("Y", "mean")])
def test_period_series_from_month_sums(spark, freq, agg):
    from ledgerlens.operators.correlation import trend_series

    rows = months(160)
    got = trend_series(dated(spark.createDataFrame(rows[1:], MONTHS)), "t", "y", "x", agg, "sum", freq).collect()
    want = {}
    for t, y, x, _ in rows[1:]:
        year, month = int(t[:4]), int(t[5:7])
        key = (year, {"M": month, "Q": (month - 1) // 3 * 3 + 1, "Y": 1}[freq])
        want.setdefault(key, []).append((y, x))
    assert {(r.period.year, r.period.month) for r in got} == set(want)
    for r in got:
        ys, xs = zip(*want[r.period.year, r.period.month])
        assert r.y == pytest.approx(sum(ys) / (len(ys) if agg == "mean" else 1)) and r.x == pytest.approx(sum(xs))


def test_discount_tables_read_the_ledger_once(counted):
    from ledgerlens.operators.overview import discount_kpis, monthly_discount

    df, seen = counted(months(30), MONTHS)
    kpis = discount_kpis(dated(df), "t", "y", "x").collect()
    assert seen.value == 60 and kpis[0].year == 2002
    assert len(monthly_discount(dated(df), "t", "y", "x", 2001).collect()) == 12
    assert seen.value == 120


def test_calendar_growth_reads_the_fact_once(counted):
    from ledgerlens.operators.overview import period_growth

    df, seen = counted(months(30), MONTHS)
    got = period_growth(dated(df), "t", "y", "quarter", "yoy", calendar=True).collect()
    assert seen.value == 60
    value = {r.period: r.value for r in got}
    assert len(got) == 10 and sum(r.base is not None for r in got) == 6
    assert all(r.base == value[r.period.replace(year=r.period.year - 1)] for r in got if r.base is not None)


def test_chosen_periods_filter_below_the_join(spark):
    from ledgerlens.operators.filters import period_filter

    lines = dated(spark.createDataFrame(months(8) + [(None, 1.0, 1.0, "g1")], MONTHS))
    both = lines.join(spark.createDataFrame([("g0",), ("g1",), ("g2",)], "g string"), "g")
    out = period_filter(both, "t")
    assert {r.t.month for r in out.collect()} == {6, 7, 8} and out.count() == 6
    assert out.columns == both.columns
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("2000-07")


def test_two_way_anova_reads_the_fact_once(counted):
    from ledgerlens.operators.hypothesis import anova_twoway

    rows = [(f"a{i % 5}" if i % 11 else None, f"b{i % 7 % 4}", (i * 37 % 23) + 0.5 * (i % 5)) for i in range(400)]
    df, seen = counted(rows, "a string, b string, y double")
    got = {r.term: r for r in anova_twoway(df, "y", "a", "b", top_a=2, top_b=2).collect()}
    assert seen.value == 400

    def top(col, kept):
        sizes = {}
        for r in kept:
            sizes[r[col]] = sizes.get(r[col], 0) + 1
        first = sorted(sizes, key=lambda v: (-sizes[v], v))[:2]
        return lambda v: v if v in first else "Other"
    kept = [r for r in rows if r[0] is not None]
    fa, fb = top(0, kept), top(1, kept)
    cells = {}
    for a, b, y in kept:
        cells.setdefault((fa(a), fb(b)), []).append(y)
    within = sum(sum((v - sum(ys) / len(ys)) ** 2 for v in ys) for ys in cells.values())
    assert got["Residual"].sum_sq == pytest.approx(within) and got["Residual"].dof == len(kept) - len(cells)


def test_lines_move_for_orders_and_parts_only(spark, no_auto_broadcast, tmp_path):
    from ledgerlens.sources.fixtures import sales_fact

    tables = {
        "lineitem": "select id as l_orderkey, 1 as l_linenumber, id % 3 as l_suppkey, id % 5 as l_partkey, timestamp'2000-01-05' "
                    "as l_shipdate, double(id) as l_extendedprice, 2d as l_quantity, 0.1d as l_discount, 'O' as l_linestatus, "
                    "'N' as l_returnflag from range(40)",
        "orders": "select id as o_orderkey, nullif(id % 7, 6) as o_custkey, 'LOW' as o_orderpriority from range(30) union all "
                  "select 1, 1, 'HIGH'",
        "customer": "select id as c_custkey, int(id % 2) as c_nationkey, 'AUTO' as c_mktsegment from range(5)",
        "nation": "select int(id) as n_nationkey, int(0) as n_regionkey from range(2)",
        "region": "select int(0) as r_regionkey, 'ASIA' as r_name",
        "part": "select id as p_partkey, concat('b', id) as p_brand from range(4)"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    fact = sales_fact(spark, str(tmp_path))
    orders = [(i, i % 7 if i % 7 != 6 else None) for i in range(30)] + [(1, 1)]
    want = sorted((i, c) for i, c in orders if c is not None and c < 5 and i % 5 < 4)
    assert sorted((r.l_orderkey, r.o_custkey) for r in fact.collect()) == want
    plan = executed(fact).split("== Initial Plan ==")[0]
    moved = plan[plan.index("hashpartitioning(o_custkey"):]
    scan = moved[moved.index("FileScan parquet"):].split("\n")[0]
    assert "o_orderkey" in scan and "l_orderkey" not in scan


@pytest.fixture
def ranked_rows(monkeypatch):
    """How many rows each range-partitioned ranking pass is given."""
    from ledgerlens.operators import correlation, hypothesis, ranks

    seen, plain = [], ranks.attach_midranks

    def look(df, *args, **kwargs):
        seen.append(df.count())
        return plain(df, *args, **kwargs)
    for module in (correlation, hypothesis):
        monkeypatch.setattr(module, "attach_midranks", look)
    return seen


def pairs_frame(spark, n=600):
    rows = [(i, float(i * 7919 % n) / 2 if i % 41 else None, float(i * i % 5), float(i * 31 % 4), float(i * 977 % n // 2),
             -0.0 if i % 2 else 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, a double, b double, c double, z double")


def spearman_of(pdf, x, y):
    both = pdf[[x, y]].dropna()
    return both[x].rank().corr(both[y].rank()), len(both)


def test_spearman_ranks_few_valued_drivers_by_value(spark, ranked_rows):
    from ledgerlens.operators.correlation import correlation_table

    df = pairs_frame(spark)
    pdf = df.toPandas()
    for y, xs in (("y", ["a", "b"]), ("a", ["y", "b", "c"])):
        del ranked_rows[:]
        got = {r.x: r for r in correlation_table(df, y, xs, "spearman").collect()}
        assert sum(ranked_rows) <= len(xs) * 600 + 20
        for x in xs:
            r, n = spearman_of(pdf, x, y)
            assert got[x].n == n and got[x].r == pytest.approx(r, abs=1e-12)


@pytest.mark.parametrize("few", [0, 100, 1000])
def test_spearman_ways_agree(spark, monkeypatch, few):
    from ledgerlens.operators import correlation

    monkeypatch.setattr(correlation, "FEW", few)
    df = pairs_frame(spark)
    pdf = df.toPandas()
    got = {r.x: r for r in correlation.correlation_table(df, "y", ["a", "b", "c", "z"], "spearman").collect()}
    assert got["z"].r is None and got["z"].n == 585
    for x in "abc":
        assert got[x].r == pytest.approx(spearman_of(pdf, x, "y")[0], abs=1e-12)
    cells = {(r.a, r.b): r.r for r in correlation.corr_matrix(df, ["y", "a", "b", "c"], "spearman").collect()}
    full = pdf[["y", "a", "b", "c"]].dropna()
    for x in "yabc":
        for z in "yabc":
            assert cells[x, z] == pytest.approx(full[x].rank().corr(full[z].rank()), abs=1e-12)


def test_spearman_matrix_ranges_only_long_columns(spark, ranked_rows, monkeypatch):
    from ledgerlens.operators import correlation

    monkeypatch.setattr(correlation, "FEW", 100, raising=False)
    correlation.corr_matrix(pairs_frame(spark), ["y", "a", "b"], "spearman")
    assert sorted(ranked_rows)[-1] <= 600 and sum(n > 100 for n in ranked_rows) == 1


def test_pairwise_mann_whitney_counts_values_once(spark, ranked_rows, monkeypatch):
    from ledgerlens.operators import hypothesis

    rows = [(f"g{i % 4}", float(i * 37 % 90) + i % 4) for i in range(400)]
    given, plain = [], hypothesis.ordered_prefix if hasattr(hypothesis, "ordered_prefix") else None

    def look(df, *args, **kwargs):
        given.append(df.count())
        return plain(df, *args, **kwargs)
    monkeypatch.setattr(hypothesis, "ordered_prefix", look, raising=False)
    got = hypothesis.posthoc_mw_holm(spark.createDataFrame(rows, "g string, y double"), "y", "g").collect()
    assert len(got) == 6 and sum(ranked_rows) + sum(given) == len({y for _, y in rows})
    values = {}
    for g, y in rows:
        values.setdefault(g, []).append(y)
    for r in got:
        u = sum((a > b) + (a == b) / 2 for a in values[r.group_a] for b in values[r.group_b])
        pool = values[r.group_a] + values[r.group_b]
        n1, n2, n = len(values[r.group_a]), len(values[r.group_b]), len(pool)
        ties = sum(pool.count(v) ** 3 - pool.count(v) for v in set(pool))
        var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
        assert r.u == u and r.z == pytest.approx(max((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / var ** 0.5, 0.0))
