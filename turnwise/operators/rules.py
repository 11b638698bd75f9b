"""Findings: rules are data (SQL conditions), evaluated together.

A rule names a pool of sessions, cohorts inside it, and what counts as an event
per what.  All rules are evaluated in one pass: every session is expanded into
the cohorts it belongs to, and one map-side combined aggregate gives every
cohort's totals.  The verdict per rule is then an expression over one small row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import formats, stats
from turnwise.operators import cohorts, sessions as S
from turnwise.operators.ordered import count_if
from turnwise.operators.ordering import medians


@dataclass(frozen=True)
class Cohort:
    name: str
    where: str
    shown: bool = True
    events: str | None = None
    per: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    pool: str
    cohorts: tuple[Cohort, ...]
    events: str = "hard"
    per: str = "human_turns"
    scale: float = fixed.RATE_PER
    worse: str = ""
    better: str = ""
    judged: bool = False
    advice: str = ""


BANDS = (("1-5 turns", 1, 5), ("6-15 turns", 6, 15), ("16-40 turns", 16, 40), ("41+ turns", 41, None))
BAND_NAMES = tuple(b[0] for b in BANDS)
KNEE = 1.3
TOP_TOOL_PCT = 40
HOT_CONTEXT_PCT = 70
CAUSE_PCT = 35
MIN_ATTRIBUTED = 20

_POOL = Cohort("pool", "true", shown=False)
_JUDGED = "j.score is not null"


def _missing_cohorts() -> tuple[Cohort, ...]:
    out = []
    for item in fixed.MISSING_ITEMS:
        hit = f"coalesce(array_contains(j.missing, '{item}'), false)"
        out += [Cohort(f"{item}: absent", hit), Cohort(f"{item}: present", f"not {hit}")]
    return tuple(out)


RULES = (
    Rule(
        "first_prompt_anchors", "Concrete openings", "not is_resumed and tool_calls_total >= 1",
        (
            *[Cohort(f"{k} of three", f"anchors = {k}") for k in range(4)],
            Cohort("few", "anchors <= 1", shown=False), Cohort("many", "anchors >= 2", shown=False), _POOL,
        ),
        worse="few", better="many",
        advice="Open with three things: where to work, what must not change, and how you will know it is finished.",
    ),
    Rule(
        "long_session_knee", "Session length", "human_turns >= 1",
        (
            *[Cohort(n, f"human_turns >= {lo}" + (f" and human_turns <= {hi}" if hi else "")) for n, lo, hi in BANDS],
            _POOL,
        ),
        advice="Finish one thing per session and hand over to a fresh one.",
    ),
    Rule(
        "resumed_vs_fresh", "Continued sessions", "tool_calls_total >= 1",
        (Cohort("new", "not is_resumed"), Cohort("continued", "is_resumed"), _POOL),
        worse="continued", better="new",
        advice="Restate where things stand when resuming.",
    ),
    Rule(
        "plan_mode_big_tasks", "Plans on large jobs", "not is_resumed and tool_calls_total >= 1",
        (
            Cohort("plan", "is_big and (plan_mode or coalesce(mentions_plan, false))"),
            Cohort("straight in", "is_big and not (plan_mode or coalesce(mentions_plan, false))"),
            Cohort("big", "is_big", shown=False), _POOL,
        ),
        events="denied_user + interrupts_tool", per="tool_calls_total / 10.0",
        worse="straight in", better="plan",
        advice="Ask for the plan first on anything large.",
    ),
    Rule(
        "assistant_asked", "Questions back", "not is_resumed and tool_calls_total >= 10",
        (Cohort("some questions", "askuser >= 1"), Cohort("no questions", "askuser = 0"), _POOL),
        events="interrupts + steering", per="greatest(1, human_turns - askuser)",
        worse="no questions", better="some questions",
        advice="Invite questions at the end of an open-ended request.",
    ),
    Rule(
        "tool_output_bloat", "Largest tool outputs", "true",
        (
            Cohort("window mostly full", f"ctx_pct >= {HOT_CONTEXT_PCT}", shown=False),
            Cohort("window mostly free", f"ctx_pct < {HOT_CONTEXT_PCT}", shown=False), _POOL,
        ),
        advice="Search first and read only the lines that are needed.",
    ),
    Rule(
        "cache_resets", "Cache rebuilds", "tool_calls_total >= 10",
        (
            Cohort("rebuilt", "cache_resets >= 1"), Cohort("kept", "cache_resets = 0"),
            Cohort("pool", "true", shown=False, events="cache_resets", per="human_turns"),
        ),
        events="cache_writes", per="input_tokens", scale=100.0,
        advice="Finish the step before a long pause.",
    ),
    Rule(
        "first_prompt_score", "Opening checklist", f"{_JUDGED} and tool_calls_total >= 1",
        (
            *[Cohort(f"{lo}-{hi}", f"j.score between {lo} and {hi}") for lo, hi in ((0, 1), (2, 3), (4, 5))],
            _POOL,
        ),
        judged=True,
        advice="Say goal, place, state, check and boundary.",
    ),
    Rule("correction_causes", "Sources of corrections", _JUDGED, (_POOL,), judged=True,
         advice="Treat each prompt gap as a line missing from the first message."),
    Rule(
        "missing_ingredient_cost", "Costliest omission", _JUDGED, (*_missing_cohorts(), _POOL), judged=True,
        advice="Put that one item in every first message for a week.",
    ),
)
RULE_IDS = tuple(r.id for r in RULES)

_VERDICT_TYPE = (
    "struct<score:bigint,outcome:string,missing:array<string>,"
    "turns:array<struct<i:bigint,label:string,cause:string>>>"
)


def prepare(sessions: DataFrame) -> DataFrame:
    """Sessions with every column the rules mention."""
    absent = {
        "resumed_from": F.lit(None).cast("string"), "machine": F.lit(None).cast("string"),
        "j": F.lit(None).cast(_VERDICT_TYPE), "kind": F.lit(None).cast("string"),
    }
    df = sessions.withColumns({c: v for c, v in absent.items() if c not in sessions.columns})
    df = S.session_measures(df)

    def over(*parts: str) -> Column:
        return F.aggregate(
            F.coalesce(F.map_values("by_model"), F.array()), F.lit(0).cast("bigint"),
            lambda n, u: n + sum((u[p] for p in parts[1:]), u[parts[0]]),
        )

    return df.withColumns(
        {
            "cache_writes": over("cc5", "cc1h"),
            "input_tokens": over("in", "cc5", "cc1h", "cr"),
            "output_size": F.aggregate(F.coalesce(F.map_values("tool_bytes"), F.array()), F.lit(0).cast("bigint"), lambda n, v: n + v),
        }
    )


def membership(prepared: DataFrame) -> DataFrame:
    """One row per session and cohort it belongs to: rule, cohort, events, denominator."""
    plan_pool = prepared.filter(next(r.pool for r in RULES if r.id == "plan_mode_big_tasks"))
    cut = cohorts.global_median(plan_pool, F.col("tool_calls_total")).scalar()
    df = prepared.withColumn("is_big", F.col("tool_calls_total") >= cut)
    slots = []
    for rule in RULES:
        for ord_, c in enumerate(rule.cohorts):
            slot = F.struct(
                F.lit(rule.id).alias("rule_id"), F.lit(c.name).alias("cohort"), F.lit(ord_).alias("ord"),
                F.expr(c.events or rule.events).cast("double").alias("events"),
                F.expr(c.per or rule.per).cast("double").alias("turns"),
                (F.size("compactions") > 0).alias("compacted"),
            )
            slots.append(F.when(F.expr(f"coalesce(({rule.pool}) and ({c.where}), false)"), slot))
    return df.select(F.explode(F.array_compact(F.array(*slots))).alias("m")).select("m.*")


def _cohort_list(df: DataFrame) -> DataFrame:
    rows = [
        (r.id, RULE_IDS.index(r.id), c.name, i, c.shown, float(r.scale), r.judged)
        for r in RULES
        for i, c in enumerate(r.cohorts)
    ]
    return df.sparkSession.createDataFrame(
        rows, "rule_id string, rule_ord int, cohort string, ord int, shown boolean, scale double, judged boolean"
    )


def cohort_groups(prepared: DataFrame) -> DataFrame:
    """Totals of every cohort of every rule, empty cohorts included; one pass over sessions."""
    sums = membership(prepared).groupBy("rule_id", "cohort").agg(
        F.count("*").alias("n"), F.sum("events").alias("events"), F.sum("turns").alias("turns"),
        count_if(F.col("compacted")).alias("compacted"),
    )
    full = _cohort_list(prepared).join(sums, ["rule_id", "cohort"], "left").fillna(0, ["n", "compacted"]).fillna(0.0, ["events", "turns"])
    r = stats.rate(F.col("events"), F.col("turns")) / fixed.RATE_PER * F.col("scale")
    half = stats.band_half(F.col("events"), F.col("turns"))
    plain = F.col("scale") == fixed.RATE_PER
    return full.withColumns(
        {
            "rate": r,
            "band_lo": F.when(plain, F.greatest(F.lit(0.0), r - half)).otherwise(r),
            "band_hi": F.when(plain, r + half).otherwise(r),
            "too_small": F.col("n") < fixed.MIN_N,
        }
    )


def finding_groups(groups: DataFrame) -> DataFrame:
    """The table twin of each chart."""
    return groups.filter("shown").select(
        "rule_id", "cohort", "ord", "n", "events", "turns", "rate", "band_lo", "band_hi", "too_small"
    )


def band_context(prepared: DataFrame) -> DataFrame:
    """Per length band: share of compacted sessions and median peak context."""
    band = F.lit(None).cast("string")
    for name, lo, _hi in reversed(BANDS):
        band = F.when(F.col("human_turns") >= lo, name if _hi is None else F.when(F.col("human_turns") <= _hi, name).otherwise(band)).otherwise(band)
    banded = prepared.select(band.alias("cohort"), "ctx_pct", F.size("compactions").alias("k")).filter("cohort is not null")
    compacted = cohorts.share(banded, ["cohort"], F.col("k") > 0).select("cohort", "n", F.col("pct").alias("compacted_pct"))
    return compacted.join(medians(banded, ["cohort"], "ctx_pct", "median_ctx_pct"), "cohort", "left")


def heavy_light_medians(prepared: DataFrame) -> DataFrame:
    """Median returned size of sessions that did and did not fill their context."""
    sided = prepared.select(
        F.when(F.col("ctx_pct") >= HOT_CONTEXT_PCT, "window mostly full").otherwise("window mostly free").alias("cohort"), "output_size"
    )
    return medians(sided, ["cohort"], "output_size", "median_size")


def verdict_turns(prepared: DataFrame) -> DataFrame:
    judged = prepared.filter(_JUDGED)
    return judged.select("sid", F.explode("j.turns").alias("t")).select("sid", "t.*")


def _sides() -> tuple[Column, Column]:
    """Worse and better cohort of each rule, as structs from the row's cohort map."""
    c = F.col("c")

    def at(name: str) -> Column:
        return F.try_element_at(c, F.lit(name))

    usable = F.filter(F.array(*[at(b) for b in BAND_NAMES]), lambda g: g["n"] >= fixed.MIN_N)
    pairs = F.array(*[F.struct(at(f"{i}: absent").alias("w"), at(f"{i}: present").alias("b"), F.lit(-k).alias("k")) for k, i in enumerate(fixed.MISSING_ITEMS)])
    ready = F.filter(pairs, lambda p: (p["w"]["n"] >= fixed.MIN_N) & (p["b"]["n"] >= fixed.MIN_N))
    ranked = F.transform(ready, lambda p: F.struct((p["w"]["rate"] - p["b"]["rate"]).alias("gap"), p["k"], p["w"], p["b"]))
    worst = F.array_max(ranked)
    worse = (
        F.when(F.col("rule_id") == "long_session_knee", F.try_element_at(usable, F.lit(-1)))
        .when(F.col("rule_id") == "first_prompt_score", at("0-1"))
        .when(F.col("rule_id") == "missing_ingredient_cost", worst["w"])
        .when(F.col("rule_id") == "tool_output_bloat", at("window mostly full"))
        .when(F.col("rule_id") == "cache_resets", at("rebuilt"))
    )
    better = (
        F.when(F.col("rule_id") == "long_session_knee", F.try_element_at(usable, F.lit(1)))
        .when(F.col("rule_id") == "first_prompt_score", F.when(at("4-5")["n"] >= fixed.MIN_N, at("4-5")).otherwise(at("2-3")))
        .when(F.col("rule_id") == "missing_ingredient_cost", worst["b"])
        .when(F.col("rule_id") == "tool_output_bloat", at("window mostly free"))
        .when(F.col("rule_id") == "cache_resets", at("kept"))
    )
    for rule in RULES:
        if rule.worse:
            worse = worse.when(F.col("rule_id") == rule.id, at(rule.worse))
            better = better.when(F.col("rule_id") == rule.id, at(rule.better))
    return worse, better


def _chain(values: dict[str, Column], default: Column) -> Column:
    out = None
    for rule_id, v in values.items():
        test = F.col("rule_id") == rule_id
        out = F.when(test, v) if out is None else out.when(test, v)
    return default if out is None else out.otherwise(default)


def evaluate(prepared: DataFrame) -> DataFrame:
    """One row per rule: fired or locked with its reason, effect, reach, score and rank."""
    groups = cohort_groups(prepared)
    group = F.struct("cohort", "ord", "n", "events", "turns", "rate")
    rows = groups.groupBy("rule_id", "rule_ord", "judged").agg(
        F.map_from_entries(F.collect_list(F.struct("cohort", group))).alias("c")
    )
    tools = S.explode_tools(prepared, []).groupBy("tool").agg(F.sum("size").alias("size"))
    tool = tools.agg(F.struct(F.max_by("tool", F.struct("size", "tool")).alias("name"), F.max("size").alias("top"), F.sum("size").alias("all")).alias("t"))
    turns = verdict_turns(prepared)
    cause = turns.agg(
        F.struct(
            F.count("cause").alias("attributed"), count_if(F.col("cause") == "prompt_gap").alias("gap"),
            count_if(F.col("label").isin(*fixed.REVISION_LABELS)).alias("labelled"),
        ).alias("t")
    )
    judged_n = prepared.filter(_JUDGED).agg(F.count("*").alias("n"))
    worse, better = _sides()
    rows = rows.select(
        "rule_id", "rule_ord", "judged", "c", worse.alias("w"), better.alias("b"),
        tool.scalar().alias("tool"), cause.scalar().alias("cause"), judged_n.scalar().alias("judged_n"),
    )
    pool = F.try_element_at(F.col("c"), F.lit("pool"))
    big = F.try_element_at(F.col("c"), F.lit("big"))
    zero = F.lit(0)
    w_n, b_n = F.coalesce("w.n", zero), F.coalesce("b.n", zero)
    cmp = stats.compare_columns(F.col("w.rate"), F.col("b.rate"), w_n, b_n)
    usable = F.size(F.filter(F.array(*[F.try_element_at(F.col("c"), F.lit(b)) for b in BAND_NAMES]), lambda g: g["n"] >= fixed.MIN_N))
    tool_pct = stats.share(F.col("tool.top"), F.coalesce("tool.all", zero))
    cause_pct = stats.share(F.col("cause.gap"), F.col("cause.attributed"))
    full_pool = pool["n"] >= fixed.MIN_N * 2
    judged_ready = F.col("judged_n") >= fixed.MIN_N
    usual = cmp["enough"] & (cmp["gap"] > 0)
    fired = _chain(
        {
            "long_session_knee": usual & (usable >= 3),
            "plan_mode_big_tasks": usual & full_pool,
            "tool_output_bloat": (tool_pct >= TOP_TOOL_PCT) & cmp["enough"],
            "cache_resets": full_pool & (w_n >= fixed.MIN_N),
            "first_prompt_score": usual & judged_ready,
            "correction_causes": judged_ready & (F.col("cause.attributed") >= MIN_ATTRIBUTED) & (cause_pct >= CAUSE_PCT),
            "missing_ingredient_cost": judged_ready & (cmp["gap"] > 0),
        },
        usual,
    )
    two = F.lit(2.0)
    effect = _chain(
        {
            "tool_output_bloat": F.least(two, tool_pct / TOP_TOOL_PCT),
            "cache_resets": F.least(two, pool["events"] / F.greatest(F.lit(1), pool["n"])),
            "correction_causes": F.least(two, cause_pct / CAUSE_PCT),
            "missing_ingredient_cost": F.least(two, cmp["gap"] / 2),
        },
        stats.effect(cmp["can_ratio"], cmp["ratio"], cmp["gap"]),
    )
    one = F.lit(1.0)
    reach = _chain({"tool_output_bloat": one, "correction_causes": one}, w_n / F.greatest(F.lit(1), pool["n"]))
    n = _chain({"plan_mode_big_tasks": big["n"]}, pool["n"])
    knee = F.try_element_at(
        F.filter(
            F.array(*[F.try_element_at(F.col("c"), F.lit(b)) for b in BAND_NAMES]),
            lambda g: (g["n"] >= fixed.MIN_N) & (g["ord"] > F.col("b.ord")) & (g["rate"] >= F.col("b.rate") * KNEE),
        ),
        F.lit(1),
    )
    out = rows.withColumns(
        {
            "fired": F.coalesce(fired, F.lit(False)),
            "effect": effect, "reach": reach, "n": n,
            "gap": cmp["gap"], "can_ratio": cmp["can_ratio"], "ratio": cmp["ratio"], "phrase": cmp["phrase"],
            "detail": _chain(
                {
                    "long_session_knee": F.coalesce(knee["cohort"], F.col("w.cohort")),
                    "tool_output_bloat": F.col("tool.name"),
                    "missing_ingredient_cost": F.regexp_replace("w.cohort", ": absent$", ""),
                },
                F.col("w.cohort"),
            ),
            "share_pct": _chain({"tool_output_bloat": tool_pct, "correction_causes": cause_pct}, reach * 100),
        }
    )
    return out.withColumns(
        {
            "score": F.when(F.col("fired"), stats.score(F.col("effect"), F.col("reach"), F.col("n"))),
            "reason": F.when(F.col("fired"), F.lit(None).cast("string"))
            .when(F.col("judged") & ~judged_ready, F.format_string("waiting for reviews: %d wanted, %d there", F.lit(fixed.MIN_N), "judged_n"))
            .otherwise("no clear difference"),
        }
    ).select(
        "rule_id", "rule_ord", "fired", "reason", "detail", F.col("w.n").alias("worse_n"), F.col("w.rate").alias("worse_rate"),
        F.col("b.n").alias("better_n"), F.col("b.rate").alias("better_rate"), "gap", "can_ratio", "ratio", "phrase",
        "share_pct", "effect", "reach", "n", "score",
    )


def _text(field: str) -> Column:
    return F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r.id), F.lit(getattr(r, field)))]), F.col("rule_id"))


def rank_findings(evaluated: DataFrame) -> DataFrame:
    """Fired rules, strongest first; equal scores keep rule order."""
    headline = _chain(
        {
            "long_session_knee": F.format_string("Sessions from %s on ran %s as many corrections as the shortest", "detail", "phrase"),
            "plan_mode_big_tasks": F.format_string(
                "Large tasks begun from a plan had %.1f of 100 actions turned down or broken off; those begun without one had %.1f", "better_rate", "worse_rate"
            ),
            "tool_output_bloat": F.format_string("The %s tool returned %.0f%% of everything read", "detail", "share_pct"),
            "cache_resets": F.format_string("The whole conversation was sent again in %d sessions", "worse_n"),
            "correction_causes": F.format_string("%.0f%% of explained corrections trace back to the request", "share_pct"),
            "missing_ingredient_cost": F.format_string("Leaving out %s went with %.1f more corrections per 10 messages", "detail", "gap"),
        },
        F.format_string("%s: %s in group '%s'", _text("title"), F.col("phrase"), F.col("detail")),
    )
    # At most one row per rule, so this window is of fixed size.
    w = Window.orderBy(F.desc("score"), "rule_ord")
    return evaluated.filter("fired").select(
        "rule_id", _text("title").alias("title"), headline.alias("headline"), _text("advice").alias("advice"),
        "effect", "reach", "n", "score", "can_ratio", "ratio", "gap", F.row_number().over(w).alias("rank"),
    )


def locked_rules(evaluated: DataFrame) -> DataFrame:
    return evaluated.filter("not fired").select("rule_id", _text("title").alias("title"), "reason")


def report(prepared: DataFrame, findings: DataFrame) -> DataFrame:
    """One paragraph from the two strongest findings."""
    whole = prepared.agg(
        F.count("*").alias("n"), stats.share(count_if(F.col("clean")), F.count("*")).alias("clean_pct"),
        count_if(F.expr(_JUDGED)).alias("judged"),
    )

    def nth(k: int, field: str) -> Column:
        return findings.filter(F.col("rank") == k).agg(F.max(field)).scalar()

    head = F.format_string("Across %d sessions, %.0f%% ran start to finish without a correction.", "n", "clean_pct")
    reviewed = F.when(F.col("judged") > 0, F.format_string("Reviews exist for %d of them.", "judged"))
    first, second = nth(1, "headline"), nth(2, "headline")
    text = F.concat_ws(
        " ", head, reviewed,
        F.coalesce(F.concat(F.lit("The thing most worth changing: "), first, F.lit(".")), F.lit("No difference is large enough to name.")),
        F.concat(F.lit("After that: "), second, F.lit(".")),
        F.concat(F.lit("If you change one thing: "), nth(1, "advice")),
    )
    return whole.select(F.when(F.col("n") == 0, "No sessions to report on.").otherwise(text).alias("report"))


# --- compaction ---------------------------------------------------------------

LOSS_EVENTS = 10
LOSS_TURNS = 10
LOSS_PCT = 2
LOSS_FACTOR = 1.5
ENOUGH_COMPACTIONS = 8
AUTO_PCT = 70
LATE_TOKENS = 850_000
RAN_HOT_PCT = 80
OFTEN_PER_100 = 3


def compaction_verdict(prepared: DataFrame) -> DataFrame:
    """Whether compactions lose information, come too late, or too often; first match wins."""
    comps = prepared.select(F.explode("compactions").alias("x")).select("x.*")
    med_pre = cohorts.global_median(comps.filter("pre > 0"), F.col("pre"))
    drops = comps.filter("pre > 0 and post > 0")
    med_drop = cohorts.global_median(drops, (F.col("pre") - F.col("post")) / F.col("pre") * 100)
    n = F.size("compactions")
    sums = prepared.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.size(F.filter("compactions", lambda c: c["trigger"] == "auto"))), F.lit(0)).alias("auto"),
        count_if(n > 0).alias("sessions_with"),
        count_if((F.col("ctx_pct") >= RAN_HOT_PCT) & (n == 0)).alias("ran_hot"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (
            ("human_turns", "turns"), ("reexplain", "repeats"), ("turns_after_compaction", "after"),
            ("reexplain_after_compaction", "repeats_after"),
        )],
    ).withColumns(
        {"med_pre": F.coalesce(med_pre.scalar(), F.lit(0.0)), "med_drop": F.coalesce(med_drop.scalar(), F.lit(0.0))}
    )
    base_turns = F.greatest(F.lit(0), F.col("turns") - F.col("after"))
    base_repeats = F.greatest(F.lit(0), F.col("repeats") - F.col("repeats_after"))
    sums = sums.withColumns(
        {
            "per_100": stats.share(F.col("count"), F.col("turns")),
            "auto_pct": stats.share(F.col("auto"), F.col("count")),
            "rate_after": stats.share(F.col("repeats_after"), F.col("after")),
            "rate_base": stats.share(base_repeats, base_turns),
        }
    )
    comparable = (F.col("repeats_after") >= LOSS_EVENTS) & (F.col("after") >= LOSS_TURNS) & (F.col("sessions_with") >= fixed.MIN_N)
    lossy = comparable & (F.col("rate_after") >= F.col("rate_base") * LOSS_FACTOR) & (F.col("rate_after") >= LOSS_PCT)
    late = (F.col("count") >= ENOUGH_COMPACTIONS) & ((F.col("auto_pct") >= AUTO_PCT) | (F.col("med_pre") >= LATE_TOKENS))
    hot = (F.col("ran_hot") >= fixed.MIN_N) & (F.col("ran_hot") >= F.col("sessions_with"))
    verdict = (
        F.when(lossy, "loses detail").when(late, "late, by the limit").when(hot, "rarely compacted")
        .when(F.col("count") < ENOUGH_COMPACTIONS, "too few to say")
        .when(F.col("per_100") > OFTEN_PER_100, "frequent").otherwise("deliberate")
    )
    return sums.select(
        verdict.alias("verdict"), "count", "per_100", "auto_pct", "med_pre", "med_drop", "ran_hot", "sessions_with",
        "after", "repeats_after", "rate_after", "rate_base", comparable.alias("comparable"),
    )


# --- at a glance --------------------------------------------------------------


def glance(prepared: DataFrame, cost: DataFrame) -> DataFrame:
    """Headline figures over the sessions in view; ``cost`` has usd and unpriced per sid."""
    df = prepared.join(cost, ["path"], "left")
    turns = F.greatest(F.lit(1), F.coalesce(F.sum("human_turns"), F.lit(0)))
    n = F.greatest(F.lit(1), F.count("*"))
    return df.agg(
        F.count("*").alias("sessions"),
        stats.share(count_if(F.col("clean")), F.count("*")).alias("clean_pct"),
        (F.sum("hard") / turns * 10).alias("corrections_per_10"),
        (F.sum("steering") / turns * 10).alias("mid_run_per_10"),
        (F.sum("tokens") / n).alias("tokens_per_session"),
        (F.coalesce(F.sum("usd"), F.lit(0.0)) / n).alias("usd_per_session"),
        F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced"),
        F.coalesce(F.sum("cache_resets"), F.lit(0)).alias("resets"),
        count_if(F.expr(_JUDGED)).alias("reviewed"),
    )


def visible_sessions(
    sessions: DataFrame, now: Column, days: int | None = None, machines: tuple[str, ...] = (),
    resumed: bool = False, drill: DataFrame | None = None,
) -> DataFrame:
    """Sessions in view: period, machines, resumed or not, optional drill-down set."""
    out = sessions.filter(F.coalesce(F.col("kind") != "judge", F.lit(True)))
    if days is not None:
        out = out.filter(F.col("latest_at") >= formats.days_before(now, days))
    if machines:
        out = out.filter(F.col("machine").isin(*machines))
    if not resumed:
        out = out.filter(F.col("resumed_from").isNull())
    return out.join(drill.select("sid").distinct(), "sid", "left_semi") if drill is not None else out


TABLE_COLUMNS = {
    "latest_ts": "latest_ts", "project": "project", "machine": "machine", "human_turns": "human_turns", "hard": "hard",
    "steering": "steering", "lex_corrections": "lex_corrections", "score": "j.score", "tokens": "tokens",
    "ctx": "ctx_pct", "compactions": "size(compactions)", "outcome": "j.outcome",
}


def session_table(prepared: DataFrame, key: str = "latest_ts", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Twelve display columns, sorted by any of them, nulls last in both directions; a page where a limit is given."""
    from turnwise.functions.text import basename

    named = prepared.withColumn("project", basename(F.col("cwd")))
    shown = named.select("sid", *[F.expr(e).alias(c) for c, e in TABLE_COLUMNS.items()])
    by = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    page = shown.orderBy(by, "sid")
    return page.limit(limit) if limit is not None else page


SIGNAL_NAMES = (
    ("interrupts", "runs stopped"), ("denied_user", "calls refused"), ("denied_plan", "plans sent back"),
    ("steering", "notes sent mid-run"), ("lex_corrections", "turns opening with pushback"),
    ("reexplain", "turns with earlier wording"),
)


def session_detail(prepared: DataFrame, cost: DataFrame) -> DataFrame:
    """What the detail view of a session shows."""
    parts = [F.when(F.col(c) > 0, F.format_string(f"%d {label}", c)) for c, label in SIGNAL_NAMES]
    signals = F.concat_ws(", ", *parts)
    return prepared.join(cost, ["path"], "left").select(
        "path", "sid", "human_turns", "tool_calls_total", "active_min", "tokens", F.coalesce("usd", F.lit(0.0)).alias("usd"),
        F.when(signals == "", "No signals.").otherwise(F.concat(F.lit("Signals: "), signals, F.lit("."))).alias("signals"),
        "ctx_series", "compactions", F.col("j.score").alias("score"), F.col("j.outcome").alias("outcome"), F.col("j.missing").alias("missing"),
    )
