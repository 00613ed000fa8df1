"""Discounted-cash-flow valuation: cost of capital, three models, their consensus and a sensitivity grid.

A company is a row. Its five latest annual statements are reduced to a few figures by one aggregation; the models are column expressions
over those, five years written out, so a whole universe is valued in one pass without Python. What a model can't value has a status
and no value. Rates are rounded to four places before they are used, as they are when shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady_sql

YEARS = 5
Steps = list[tuple[str, str]]

#: Aggregates over an asset's latest statements; ``rn`` is 1 for the newest.
FACTS: Steps = [
    *((f"{c}_now", f"max(case when rn = 1 then {c} end)") for c in ("revenue", "ebit", "operating_income", "interest_expense", "tax_provision", "total_debt", "total_equity", "cash", "dividends_paid", "eps_diluted", "eps_basic", "shares_diluted", "shares_basic")),
    ("fcf_base", "avg(case when rn <= 3 then free_cashflow end)"),
    ("capex_base", "avg(case when rn <= 3 then coalesce(operating_cashflow, 0) - abs(coalesce(capex, 0)) end)"),
    ("flow_base", "avg(case when rn <= 3 then case when coalesce(operating_cashflow, 0) <> 0 then operating_cashflow - abs(coalesce(capex, 0)) else coalesce(net_income, 0) end end)"),
    *(
        (f"{short}_{end}", f"{pick}({value}, rn) filter (where {value} is not null)")
        for short, value in (("fcf", "free_cashflow"), ("rev", "revenue"), ("eps", "eps_diluted"), ("div", "abs(dividends_paid)"))
        for end, pick in (("new", "min_by"), ("old", "max_by"))
    ),
    *((f"{short}_n", f"cast(count({value}) as bigint)") for short, value in (("fcf", "free_cashflow"), ("rev", "revenue"), ("eps", "eps_diluted"), ("div", "dividends_paid"))),
]

#: Shares of the newest statement, dividends a share by it, and the earnings a share that a projection starts from.
_DILUTED = "coalesce(nullif(shares_diluted_now, 0), nullif(shares_basic_now, 0))"
_PAID = f"abs(dividends_paid_now) / nullif(coalesce({_DILUTED}, shares_outstanding), 0)"
_EPS_START = "coalesce(case when eps_trailing > 0 then eps_trailing end, case when coalesce(nullif(eps_diluted_now, 0), eps_basic_now) > 0 then coalesce(nullif(eps_diluted_now, 0), eps_basic_now) end, 0.01e0)"


def facts(highlights: DataFrame, statements: DataFrame) -> DataFrame:
    """``highlights`` (a row for each asset_id) with the FACTS of its five latest annual ``statements``."""
    rows = statements.withColumn("rn", F.expr("row_number() over (partition by asset_id order by period_end desc)")).where(F.col("rn") <= YEARS)
    return highlights.join(rows.groupBy("asset_id").agg(*(F.expr(sql).alias(name) for name, sql in FACTS)), "asset_id", "left")


def applied(df: DataFrame, steps: Steps) -> DataFrame:
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df


def _cagr(short: str, most: float) -> str:
    return f"case when {short}_n >= 2 and {short}_old > 0 and {short}_new > 0 then least(greatest(power({short}_new / {short}_old, 1.0 / ({short}_n - 1)) - 1, 0.0), {most}) end"


def wacc_steps(rf: float = 0.04, erp: float = 0.055) -> Steps:
    return [
        ("ke", steady_sql(f"{rf}e0 + coalesce(nullif(beta, 0), 1e0) * {erp}e0")),
        ("kd", steady_sql(f"coalesce(coalesce(interest_expense_now, 0) / nullif(total_debt_now, 0), {rf}e0 + 0.02e0)")),
        ("profit", "coalesce(nullif(ebit_now, 0), operating_income_now)"),
        ("ratio", "coalesce(tax_provision_now, 0) / nullif(profit, 0)"),
        ("tax", steady_sql("case when ratio between 0 and 1 then ratio else 0.25e0 end")),
        ("equity", "case when coalesce(market_cap, 0) > 0 then market_cap when coalesce(total_equity_now, 0) > 0 then total_equity_now else 1e6 end"),
        ("debt", "coalesce(total_debt_now, 0)"),
        ("we", "coalesce(equity / nullif(equity + debt, 0), 1e0)"),
        ("wd", "coalesce(debt / nullif(equity + debt, 0), 0e0)"),
        ("wacc", steady_sql("least(greatest(we * ke + wd * kd * (1 - tax), 0.05e0), 0.20e0)")),
    ]


def price_steps() -> Steps:
    return [
        ("shares", f"coalesce(nullif(shares_outstanding, 0), {_DILUTED}, 0)"),
        ("price", "coalesce(nullif(last_close, 0), case when coalesce(pe_ratio, 0) <> 0 and coalesce(eps_trailing, 0) <> 0 then pe_ratio * eps_trailing end, (week_52_high + week_52_low) / 2)"),
    ]


def _present(base: str, growth: str, rate: str, last: str) -> str:
    """Five years' growing payments at their present value, and a Gordon terminal value with growth ``last``."""
    sums = " + ".join(f"power((1 + {growth}) / (1 + {rate}), {t})" for t in range(1, YEARS + 1))
    return f"({base}) * ({sums} + power((1 + {growth}) / (1 + {rate}), {YEARS}) * (1 + {last}) / nullif({rate} - {last}, 0))"


def _floored(value: str) -> str:
    """A value a share: not below 0, and null where it isn't known (``greatest`` passes nulls over)."""
    return steady_sql(f"case when {value} is not null then greatest({value}, 0e0) end", 2)


def fcf_steps(terminal: float = 0.025, growth: float | None = None) -> Steps:
    own = f"coalesce({_cagr('fcf', 0.2)}, {_cagr('rev', 0.2)}, 0.04e0)" if growth is None else f"{growth}e0"
    return [
        ("fcf_start", "coalesce(fcf_base, flow_base, 0)"),
        ("fcf_growth", own),
        ("fcf_last", f"least({terminal}e0, wacc - 0.005e0)"),
        ("fcf_equity", _present("fcf_start", "fcf_growth", "wacc", "fcf_last") + " - (coalesce(total_debt_now, 0) - coalesce(cash_now, 0))"),
        ("fcf_value", _floored("fcf_equity / nullif(shares, 0)")),
    ]


def eps_steps(terminal: float = 0.025, growth: float | None = None) -> Steps:
    own = f"coalesce(trend_0y, trend_1y, {_cagr('eps', 0.2)}, 0.05e0)" if growth is None else f"{growth}e0"
    steps = [
        ("eps_start", _EPS_START),
        ("eps_growth", own),
        ("eps_last", f"least({terminal}e0, ke - 0.005e0)"),
        ("multiple", "case when coalesce(nullif(pe_ratio, 0), pe_forward, 0) <= 0 then 15e0 else least(greatest(coalesce(nullif(pe_ratio, 0), pe_forward), 10e0), 30e0) end"),
        ("eps_0", "eps_start"),
    ]
    for t in range(1, YEARS + 1):
        steps.append((f"eps_{t}", f"eps_{t - 1} * (1 + eps_growth * {1 - t / YEARS!r}e0 + eps_last * {t / YEARS!r}e0)"))
    paid = " + ".join(f"eps_{t} / power(1 + ke, {t})" for t in range(1, YEARS + 1))
    return [*steps, ("eps_value", _floored(f"{paid} + eps_{YEARS} * multiple / power(1 + ke, {YEARS})"))]


def ddm_steps(terminal: float = 0.02, growth: float | None = None) -> Steps:
    own = f"coalesce({_cagr('div', 0.15)}, 0.03e0)" if growth is None else f"{growth}e0"
    base = [
        "nullif(greatest(dividend_rate, 0), 0)",
        "nullif(greatest(dividend_yield * pe_ratio * eps_trailing, 0), 0)",
        f"nullif({_PAID}, 0)",
    ]
    return [
        ("ddm_start", f"coalesce({', '.join(base)})"),
        ("ddm_growth", own),
        ("ddm_last", f"least({terminal}e0, ke - 0.005e0)"),
        ("ddm_value", _floored(_present("ddm_start", "ddm_growth", "ke", "ddm_last"))),
        ("ddm_status", "case when ddm_start is null then 'no dividend' else 'ok' end"),
    ]


def consensus_steps(weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Steps:
    models = list(zip(("fcf_value", "eps_value", "ddm_value"), weights, strict=True))
    total = " + ".join(f"coalesce({w}e0 * {m}, 0)" for m, w in models)
    held = " + ".join(f"case when {m} is not null then {w}e0 else 0e0 end" for m, w in models)
    return [
        ("consensus", steady_sql(f"({total}) / nullif({held}, 0)", 2)),
        ("upside", steady_sql("(consensus / nullif(price, 0) - 1) * 100", 2)),
    ]


def valued(company: DataFrame, **params) -> DataFrame:
    """``company`` (see ``facts``) with the cost of capital, all models and their consensus."""
    return applied(company, [*wacc_steps(), *price_steps(), *fcf_steps(**params), *eps_steps(**params), *ddm_steps(), *consensus_steps()])


def grid(low: float, high: float, step: float) -> list[float]:
    """An inclusive range, to four places."""
    n = round((high - low) / step)
    return [round(low + i * step, 4) for i in range(n + 1) if low + i * step <= high + 1e-9]


def compared(company: DataFrame) -> DataFrame:
    """asset_id, model, value, upside, status: a row for each model of each company; a model without a value has 0 for both and says why."""
    df = valued(company)
    status = {m: F.when(F.col(f"{m}_value").isNull(), "no value").otherwise("ok") for m in ("fcf", "eps")} | {"ddm": F.col("ddm_status")}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"{m}_value").alias("value"), c.alias("status")) for m, c in status.items())))
    return applied(df.select("asset_id", "price", rows.alias("r")).select("asset_id", "price", "r.*"), compare_steps()).select("asset_id", "model", "value", "upside", "status")


def compare_steps() -> Steps:
    return [("upside", f"coalesce({steady_sql('(value / nullif(price, 0) - 1) * 100', 2)}, 0e0)"), ("value", "coalesce(value, 0e0)")]


def sensitivity(company: DataFrame, rates: list[float], growths: list[float], model: str = "fcf") -> DataFrame:
    """asset_id, rate, growth, value, upside of a ``model`` (fcf, eps, ddm) for each rate and terminal growth; the grid is a constant, so rows are exploded and not joined."""
    lists = [F.explode(F.array(*map(F.lit, rates))).alias("rate")]
    df = applied(company, base_steps(model)).select("*", *lists)
    df = df.select("*", F.explode(F.array(*map(F.lit, growths))).alias("growth"))
    return applied(df, sensitivity_steps(model)).select("asset_id", "rate", "growth", "value", "upside")


def base_steps(model: str = "fcf") -> Steps:
    """What a model's grid starts from; its growth is that of the statements alone."""
    start = {
        "fcf": [("fcf_start", "coalesce(fcf_base, capex_base, 0)"), fcf_steps()[1]],
        "eps": [
            ("eps_start", _EPS_START),
            ("eps_growth", f"coalesce({_cagr('eps', 0.2)}, 0.04e0)"),
            *(x for x in eps_steps() if x[0] == "multiple"),
        ],
        "ddm": [("ddm_start", f"coalesce(case when dividend_rate > 0 then dividend_rate end, nullif({_PAID}, 0))"), ("ddm_growth", f"coalesce({_cagr('div', 0.15)}, 0.04e0)")],
    }
    return [*wacc_steps(), *price_steps(), *start[model]]


def sensitivity_steps(model: str = "fcf") -> Steps:
    used = ("used", "least(growth, rate - 0.005e0)")
    upside = ("upside", f"case when value is not null then coalesce({steady_sql('(value / nullif(price, 0) - 1) * 100', 2)}, 0e0) end")
    if model == "fcf":
        return [used, ("value", _floored("(" + _present("fcf_start", "fcf_growth", "rate", "used") + " - (coalesce(total_debt_now, 0) - coalesce(cash_now, 0))) / nullif(shares, 0)")), upside]
    if model == "ddm":
        return [used, ("value", _floored(_present("ddm_start", "ddm_growth", "rate", "used"))), upside]
    years = [("year_0", "eps_start")]
    for t in range(1, YEARS + 1):
        years.append((f"year_{t}", f"year_{t - 1} * (1 + eps_growth * {1 - t / YEARS!r}e0 + used * {t / YEARS!r}e0)"))
    paid = " + ".join(f"year_{t} / power(1 + rate, {t})" for t in range(1, YEARS + 1))
    return [used, *years, ("value", _floored(f"{paid} + year_{YEARS} * multiple / power(1 + rate, {YEARS})")), upside]
