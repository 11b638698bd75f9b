import pytest
from pyspark.sql import functions as F

from turnwise.functions import stats
from turnwise.operators import cohorts, pricing, rules
from turnwise.schemas import COMPACTION, MODEL_USAGE

VERDICT = "STRUCT<score: BIGINT, outcome: STRING, missing: ARRAY<STRING>, turns: ARRAY<STRUCT<i: BIGINT, label: STRING, cause: STRING>>>"
SCHEMA = (
    "path STRING, sid STRING, machine STRING, kind STRING, cwd STRING, latest_ts STRING, latest_at TIMESTAMP, human_turns BIGINT, askuser BIGINT, tool_calls_total BIGINT, "
    "interrupts BIGINT, interrupts_tool BIGINT, denied_user BIGINT, denied_plan BIGINT, steering BIGINT, lex_corrections BIGINT, reexplain BIGINT, "
    "reexplain_after_compaction BIGINT, turns_after_compaction BIGINT, cache_resets BIGINT, ctx_peak BIGINT, ctx_window BIGINT, git_commits BIGINT, "
    "plan_mode BOOLEAN, mentions_plan BOOLEAN, has_path BOOLEAN, has_constraint BOOLEAN, has_done_criterion BOOLEAN, resumed_from STRING, active_min DOUBLE, "
    f"tools MAP<STRING, BIGINT>, tool_bytes MAP<STRING, BIGINT>, by_model MAP<STRING, {MODEL_USAGE}>, compactions ARRAY<{COMPACTION}>, "
    f"ctx_series ARRAY<STRUCT<min: DOUBLE, ctx: BIGINT>>, j {VERDICT}"
)
COLS = [c.strip().split()[0] for c in (
    "path,sid,machine,kind,cwd,latest_ts,latest_at,human_turns,askuser,tool_calls_total,interrupts,interrupts_tool,denied_user,denied_plan,steering,"
    "lex_corrections,reexplain,reexplain_after_compaction,turns_after_compaction,cache_resets,ctx_peak,ctx_window,git_commits,plan_mode,mentions_plan,"
    "has_path,has_constraint,has_done_criterion,resumed_from,active_min,tools,tool_bytes,by_model,compactions,ctx_series,j").split(",")]
TEXT = {"path", "sid", "machine", "kind", "cwd", "latest_ts", "latest_at", "resumed_from", "j", "by_model", "active_min"}


def one(**given):
    base = {c: None if c in TEXT else 0 for c in COLS}
    base |= dict.fromkeys(("plan_mode", "mentions_plan", "has_path", "has_constraint", "has_done_criterion"), False)
    base |= {"tools": {}, "tool_bytes": {}, "compactions": [], "ctx_series": [], "human_turns": 10, "tool_calls_total": 5, "ctx_window": 1000000}
    return base | given


def table(spark, *rows):
    flat = []
    for i, r in enumerate(rows):
        r = {"path": f"/{i}", "sid": f"s{i}"} | {k: v for k, v in r.items() if v is not None or k not in ("path", "sid")}
        flat.append(tuple(r.get(c) for c in COLS))
    return rules.prepare(spark.createDataFrame(flat, SCHEMA))


def found(spark, *rows):
    ev = rules.evaluate(table(spark, *rows))
    return {r.rule_id: r for r in ev.collect()}


def test_pooled_rate_is_not_a_mean_of_rates(spark):
    df = spark.createDataFrame([(1, 1), (0, 99)], "e bigint, t bigint")
    r = cohorts.pooled_rate(df, [], F.col("e"), F.col("t")).first()
    assert r.rate == pytest.approx(0.1) and r.band_lo == 0.0 and r.n == 2
    empty = cohorts.pooled_rate(df.filter("e > 9"), [], F.col("e"), F.col("t")).first()
    assert (empty.rate, empty.band_hi, empty.turns) == (0.0, 0.0, 0)


def test_ratio_needs_a_reference_rate(spark):
    df = spark.createDataFrame([(2.0, 1.0, 5, 5), (2.0, 0.1, 5, 4)], "w double, b double, wn int, bn int")
    rows = df.select(*[c.alias(k) for k, c in stats.compare_columns(*[F.col(c) for c in df.columns]).items()]).collect()
    assert rows[0].ratio == 2.0 and rows[0].phrase == "2.0 times" and rows[0].enough
    assert rows[1].ratio is None and not rows[1].can_ratio and rows[1].phrase == "1.9 more per 10 messages" and not rows[1].enough


def test_rules_fire_on_clear_differences_and_rank(spark):
    few = [one(interrupts=5) for _ in range(10)]
    many = [one(interrupts=1, has_path=True, has_constraint=True) for _ in range(10)]
    resumed = [one(interrupts=9, resumed_from="s0") for _ in range(6)]
    got = found(spark, *few, *many, *resumed)
    anchors = got["first_prompt_anchors"]
    assert anchors.fired and anchors.ratio == pytest.approx(5.0) and anchors.effect == 2.0 and anchors.reach == 0.5 and anchors.n == 20
    assert got["resumed_vs_fresh"].fired and not got["long_session_knee"].fired
    assert got["first_prompt_score"].reason == "waiting for reviews: 5 wanted, 0 there" and got["cache_resets"].reason == "no clear difference"
    ranked = rules.rank_findings(rules.evaluate(table(spark, *few, *many, *resumed))).orderBy("rank").collect()
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True) and all(r.headline and r.advice for r in ranked)


def test_small_groups_and_reversed_gaps_stay_silent(spark):
    assert not found(spark, *[one(interrupts=5)] * 4, *[one(has_path=True, has_constraint=True)] * 10)["first_prompt_anchors"].fired
    assert not found(spark, *[one()] * 10, *[one(interrupts=3, has_path=True, has_constraint=True)] * 10)["first_prompt_anchors"].fired


def test_longer_sessions_and_the_knee(spark):
    rows = [one(human_turns=3, interrupts=1)] * 5 + [one(human_turns=10, interrupts=5)] * 5 + [one(human_turns=20, interrupts=12)] * 5
    r = found(spark, *rows)["long_session_knee"]
    assert r.fired and r.detail == "6-15 turns" and r.worse_rate == pytest.approx(6.0)


def test_planning_asking_and_tools(spark):
    rows = [one(tool_calls_total=20, denied_user=4, interrupts=2, steering=6, tool_bytes={"Read": 900, "Bash": 100}, ctx_peak=800000)] * 6
    rows += [one(tool_calls_total=20, plan_mode=True, askuser=1, tool_bytes={"Read": 10}, ctx_peak=1000)] * 6
    got = found(spark, *rows)
    assert got["plan_mode_big_tasks"].fired and got["plan_mode_big_tasks"].n == 12
    assert got["assistant_asked"].fired and got["tool_output_bloat"].detail == "Read" and got["tool_output_bloat"].fired
    assert got["tool_output_bloat"].effect == 2.0


def test_resets_and_judged_rules(spark):
    usage = {"m": (1, 10, 80, 0, 10, 0, 0, 0)}
    bad = {"score": 1, "outcome": "partial", "missing": ["priority"], "turns": [(1, "correction", "prompt_gap")] * 4}
    good = {"score": 5, "outcome": "completed", "missing": [], "turns": [(1, "correction", "env_issue")]}
    pack = lambda j: (j["score"], j["outcome"], j["missing"], j["turns"])
    rows = [one(tool_calls_total=10, cache_resets=2, by_model=usage, interrupts=6, j=pack(bad))] * 6
    rows += [one(tool_calls_total=10, by_model=usage, interrupts=1, j=pack(good))] * 6
    got = found(spark, *rows)
    assert got["cache_resets"].fired and got["cache_resets"].effect == 1.0 and got["cache_resets"].reach == 0.5
    assert got["first_prompt_score"].fired and got["missing_ingredient_cost"].fired and got["missing_ingredient_cost"].detail == "priority"
    assert got["correction_causes"].fired and got["correction_causes"].share_pct == pytest.approx(80.0)


def test_empty_input_is_safe(spark):
    got = found(spark)
    assert len(got) == len(rules.RULES) and not any(r.fired for r in got.values())
    assert rules.report(table(spark), rules.rank_findings(rules.evaluate(table(spark)))).first().report == "No sessions to report on."
    assert rules.compaction_verdict(table(spark)).first().verdict == "too few to say"


def comp(trigger="manual", pre=500000, post=100000):
    return (trigger, pre, post, 1, 1.0, 1)


def test_compaction_ladder(spark):
    def verdict(*rows):
        return rules.compaction_verdict(table(spark, *rows)).first()

    lossy = [one(human_turns=40, reexplain=4, reexplain_after_compaction=3, turns_after_compaction=10, compactions=[comp()])] * 5
    assert verdict(*lossy).verdict == "loses detail"
    assert verdict(*[one(compactions=[comp("auto")])] * 8).verdict == "late, by the limit"
    assert verdict(*[one(compactions=[comp(pre=900000)])] * 8).verdict == "late, by the limit"
    assert verdict(*[one(ctx_peak=900000)] * 5).verdict == "rarely compacted"
    assert verdict(*[one(compactions=[comp()])] * 3).verdict == "too few to say"
    assert verdict(*[one(compactions=[comp()])] * 8).verdict == "frequent"
    v = verdict(*[one(human_turns=100, compactions=[comp()])] * 8)
    assert v.verdict == "deliberate" and v.med_drop == pytest.approx(80.0)


def test_prices(spark):
    prices = spark.createDataFrame(
        [("alpha", 5.0, 25.0, None), ("alpha-1", 10.0, 50.0, 0.025)], "price_id string, p_in double, p_out double, own_cache_read double"
    ).selectExpr("*", "1.25D cache_write_5m", "2.0D cache_write_1h", "0.1D cache_read", "2.0D fast_multiplier")
    usage = spark.createDataFrame(
        [("a", "alpha-2025", 2, 1000000, 1000000, 1000000, 1000000, 1000000, 0, 1), ("b", "alpha-1-x", 1, 0, 0, 0, 1000000, 0, 0, 0), ("c", "zeta", 7, 1, 1, 1, 1, 1, 1, 1)],
        "sid string, model string, calls bigint, `in` bigint, cc5 bigint, cc1h bigint, cr bigint, out bigint, think bigint, fast_calls bigint",
    )
    got = {r.sid: (round(r.usd, 6), r.unpriced) for r in pricing.session_cost(usage, prices, ["sid"]).collect()}
    assert got == {"a": ((5 + 6.25 + 10 + 0.5 + 25) * 1.5, 0), "b": (0.025, 0), "c": (0.0, 7)}


def test_visible_sessions_table_and_detail(spark):
    t = lambda d: __import__("datetime").datetime(2026, 1, d)
    df = table(
        spark, one(machine="a", latest_at=t(20), latest_ts="2026-01-20", cwd="/x/app/"), one(machine="b", latest_at=t(1), latest_ts="2026-01-01"),
        one(machine="a", latest_at=t(20), kind="judge"), one(machine="a", latest_at=t(20), resumed_from="q", interrupts=2, human_turns=4),
    )
    now = F.lit("2026-01-21").cast("timestamp")
    assert [r.sid for r in rules.visible_sessions(df, now, 7).collect()] == ["s0"]
    assert rules.visible_sessions(df, now, None, resumed=True).count() == 3
    drill = spark.createDataFrame([("s3",)], "sid string")
    assert [r.sid for r in rules.visible_sessions(df, now, None, ("a",), True, drill).collect()] == ["s3"]
    top = rules.session_table(df, "hard", limit=2).collect()
    assert top[0].sid == "s3" and len(top) == 2 and len(top[0]) == 13
    asc = rules.session_table(df, "score", descending=False).collect()
    assert len(asc) == 4
    cost = spark.createDataFrame([("/3", 1.5, 0)], "path string, usd double, unpriced bigint")
    d = {r.sid: r for r in rules.session_detail(df, cost).collect()}
    assert d["s3"].signals == "Signals: 2 runs stopped." and d["s3"].usd == 1.5 and d["s0"].signals.startswith("No ")
