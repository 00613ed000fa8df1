"""Queries over company valuations: customers stand for companies, their yearly orders for statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady_sql
from tidemark.operators import valuation as op
from tidemark.sources.adapters import read

YEARLY = "select o_custkey as asset_id, year(o_orderdate) as period_end, sum(o_totalprice) as revenue from orders group by o_custkey, year(o_orderdate)"
STATEMENT = [
    ("free_cashflow", "case when (asset_id + period_end) % 4 <> 0 and asset_id % 14 <> 0 then revenue * 0.1e0 end"), ("operating_cashflow", "case when asset_id % 11 = 0 then 0e0 when asset_id % 28 <> 0 then revenue * 0.15e0 end"),
    ("capex", "revenue * -0.05e0"), ("net_income", "revenue * 0.08e0"), ("ebit", "case when asset_id % 5 <> 0 then revenue * 0.12e0 end"), ("operating_income", "case when asset_id % 35 <> 0 then revenue * 0.11e0 end"),
    ("interest_expense", "case when asset_id % 17 <> 0 then revenue * 0.004e0 end"), ("tax_provision", "case when asset_id % 13 <> 0 then revenue * case when asset_id % 19 = 0 then -0.02e0 else 0.02e0 end end"), ("total_debt", "case when asset_id % 3 = 0 then 0e0 else revenue * 0.3e0 end"), ("total_equity", "revenue * 0.5e0"),
    ("cash", "revenue * 0.1e0"), ("dividends_paid", "case when asset_id % 2 = 1 then revenue * -0.03e0 end"), ("eps_diluted", "case when asset_id % 16 = 0 then 0e0 else revenue / 1e4 end"), ("eps_basic", "revenue / 9e3"),
    ("shares_diluted", "case when asset_id % 18 <> 0 then cast(10000 as bigint) end"), ("shares_basic", "cast(9000 as bigint)"),
]
HIGHLIGHT = [
    ("beta", "case when c_custkey % 7 <> 0 then (c_custkey % 20) / 1e1 end"), ("market_cap", "case when c_custkey % 6 = 0 then 0e0 else c_acctbal * 1e3 end"), ("eps_trailing", "case when c_custkey % 4 <> 0 then abs(c_acctbal) / 1e2 * case when c_custkey % 23 = 0 then -1 else 1 end end"),
    ("pe_ratio", "cast(c_custkey % 40 - 5 as double)"), ("pe_forward", "cast(12 as double)"), ("dividend_rate", "case when c_custkey % 3 = 2 then 1.5e0 end"), ("dividend_yield", "case when c_custkey % 5 > 1 then 0.02e0 end"),
    ("shares_outstanding", "case when c_custkey % 9 <> 0 then cast(10000 as bigint) end"), ("week_52_high", "cast(120 + c_custkey % 50 as double)"), ("week_52_low", "cast(80 as double)"),
    ("last_close", "case when c_custkey % 20 = 0 then cast(0 as double) when c_custkey % 10 = 0 then cast(100 as double) end"), ("trend_0y", "case when c_custkey % 12 = 0 then 0.15e0 end"), ("trend_1y", "case when c_custkey % 8 = 0 then 0.12e0 end"),
]


def companies(spark: SparkSession, d: str) -> DataFrame:
    statements = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("asset_id"), F.year("o_orderdate").alias("period_end")).agg(F.sum("o_totalprice").alias("revenue"))
    highlights = read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), *(F.expr(sql).alias(n) for n, sql in HIGHLIGHT))
    return op.facts(highlights, op.applied(statements, STATEMENT))


def _columns(steps) -> str:
    return ", ".join(f"{sql} as {n}" for n, sql in steps)


# The SQL below is written from the models' definitions and shares no text with the operator: a company's statements are a list, newest first, and years are summed over lists.
_FIELDS = ["revenue", *(n for n, _ in STATEMENT)]


def _history(field: str, value: str = "x.{f}") -> str:
    return f"[{value.format(f=field)} for x in statements if x.{field} is not null]"


def _growth(values: str, most: str) -> str:
    """Yearly growth from the last to the first of ``values``, between 0 and ``most``; null where it can't be told."""
    return f"case when len({values}) >= 2 and {values}[-1] > 0 and {values}[1] > 0 then greatest(0e0, least({most}, power({values}[1] / {values}[-1], 1e0 / (len({values}) - 1)) - 1)) end"


def _gordon(base: str, g: str, rate: str, last: str) -> str:
    return f"(list_sum([{base} * power(1 + {g}, t) / power(1 + {rate}, t) for t in [1, 2, 3, 4, 5]]) + coalesce({base} * power(1 + {g}, 5) * (1 + {last}) / nullif({rate} - {last}, 0), 0) / power(1 + {rate}, 5))"


def _faded(base: str, g: str, rate: str, last: str, multiple: str) -> str:
    """Earnings whose growth fades from ``g`` to ``last`` within five years, and a multiple of the last ones."""
    year = f"{base} * list_product([1 + {g} * (1 - k / 5e0) + {last} * (k / 5e0) for k in range(1, t + 1)])"
    return f"list_sum([({year}) / power(1 + {rate}, t) * case when t = 5 then 1 + {multiple} else 1 end for t in range(1, 6)])"


_COMPANY = f"""with yearly as (select *, {_columns(STATEMENT)} from ({YEARLY})), recent as (select *, row_number() over (partition by asset_id order by period_end desc) as rn from yearly qualify rn <= 5),
  listed as (select asset_id, list({{{", ".join(f"'{f}': {f}" for f in _FIELDS)}}} order by rn) as statements from recent group by 1),
  c as (select * from (select c_custkey as asset_id, {_columns(HIGHLIGHT)} from customer) left join (select *, statements[1] as s, statements[1:3] as three from listed) using (asset_id)),
  k as (select *, 0.04e0 + case when coalesce(beta, 0) = 0 then 1e0 else beta end * 0.055e0 as ke_, case when coalesce(s.total_debt, 0) = 0 then 0.06e0 else coalesce(s.interest_expense, 0) / s.total_debt end as kd_,
    case when coalesce(s.ebit, 0) = 0 then coalesce(s.operating_income, 0) else s.ebit end as profit, case when coalesce(market_cap, 0) > 0 then market_cap when coalesce(s.total_equity, 0) > 0 then s.total_equity else 1e6 end as cap, coalesce(s.total_debt, 0) as owed,
    {_history("free_cashflow")} as flows, {_history("revenue")} as revenues, {_history("eps_diluted")} as earned, {_history("dividends_paid", "abs(x.{f})")} as paid,
    case when coalesce(s.shares_diluted, 0) <> 0 then s.shares_diluted when coalesce(s.shares_basic, 0) <> 0 then s.shares_basic end as of_statement,
    case when coalesce(last_close, 0) <> 0 then last_close when coalesce(pe_ratio, 0) <> 0 and coalesce(eps_trailing, 0) <> 0 then pe_ratio * eps_trailing else (week_52_high + week_52_low) / 2 end as price from c),
  w as (select *, {steady_sql("ke_")} as ke, {steady_sql("kd_")} as kd, {steady_sql("case when profit = 0 then 0.25e0 when coalesce(s.tax_provision, 0) / profit < 0 or coalesce(s.tax_provision, 0) / profit > 1 then 0.25e0 else coalesce(s.tax_provision, 0) / profit end")} as tax,
    case when coalesce(shares_outstanding, 0) <> 0 then shares_outstanding else coalesce(of_statement, 0) end as shares, [x.free_cashflow for x in three if x.free_cashflow is not null] as near,
    case when (case when coalesce(pe_ratio, 0) = 0 then pe_forward else pe_ratio end) > 0 then greatest(10e0, least(30e0, case when pe_ratio = 0 then pe_forward else pe_ratio end)) else 15e0 end as multiple,
    case when eps_trailing > 0 then eps_trailing when (case when coalesce(s.eps_diluted, 0) = 0 then s.eps_basic else s.eps_diluted end) > 0 then (case when coalesce(s.eps_diluted, 0) = 0 then s.eps_basic else s.eps_diluted end) else 0.01e0 end as eps0,
    abs(coalesce(s.dividends_paid, 0)) / nullif(coalesce(of_statement, shares_outstanding), 0) as share_paid, dividend_yield * pe_ratio * eps_trailing as share_made from k),
  z as (select *, {steady_sql("greatest(0.05e0, least(0.20e0, cap / (cap + owed) * ke + owed / (cap + owed) * kd * (1 - tax)))")} as wacc, {_growth("flows", "0.2e0")} as flow_growth, {_growth("revenues", "0.2e0")} as revenue_growth, {_growth("earned", "0.2e0")} as earned_growth, {_growth("paid", "0.15e0")} as paid_growth,
    case when len(near) > 0 then list_avg(near) when len(three) > 0 then list_avg([case when coalesce(x.operating_cashflow, 0) <> 0 then x.operating_cashflow - abs(coalesce(x.capex, 0)) else coalesce(x.net_income, 0) end for x in three]) else 0e0 end as flow0,
    case when len(near) > 0 then list_avg(near) when len(three) > 0 then list_avg([coalesce(x.operating_cashflow, 0) - abs(coalesce(x.capex, 0)) for x in three]) else 0e0 end as grid_flow0,
    case when dividend_rate > 0 then dividend_rate when share_made > 0 then share_made when share_paid > 0 then share_paid end as div0, case when dividend_rate > 0 then dividend_rate when share_paid > 0 then share_paid end as grid_div0 from w),
  m as (select *, greatest(0e0, {_gordon("flow0", "coalesce(flow_growth, revenue_growth, 0.04e0)", "wacc", "least(0.025e0, wacc - 0.005e0)")} - (coalesce(s.total_debt, 0) - coalesce(s.cash, 0))) / nullif(shares, 0) as fcf_, greatest(0e0, {_faded("eps0", "coalesce(trend_0y, trend_1y, earned_growth, 0.05e0)", "ke", "least(0.025e0, ke - 0.005e0)", "multiple")}) as eps_,
    case when div0 is not null then greatest(0e0, {_gordon("div0", "coalesce(paid_growth, 0.03e0)", "ke", "least(0.02e0, ke - 0.005e0)")}) end as ddm_ from z),
  v as (select *, {steady_sql("fcf_", 2)} as fcf_value, {steady_sql("eps_", 2)} as eps_value, {steady_sql("ddm_", 2)} as ddm_value, case when div0 is null then 'no dividend' else 'ok' end as ddm_status from m),
  n as (select *, {steady_sql("list_sum([x.v * x.w for x in models if x.v is not null]) / nullif(list_sum([x.w for x in models if x.v is not null]), 0)", 2)} as consensus from (select *, [{{'v': fcf_value, 'w': 0.5e0}}, {{'v': eps_value, 'w': 0.3e0}}, {{'v': ddm_value, 'w': 0.2e0}}] as models from v)),
  u as (select *, {steady_sql("(consensus / nullif(price, 0) - 1) * 100", 2)} as upside from n)"""


def _told(*columns: str):
    names = ["asset_id", *columns]
    return lambda spark, d: op.valued(companies(spark, d)).select(*names), f"{_COMPANY} select {', '.join(names)} from u"


RATES, GROWTHS = op.grid(0.07, 0.11, 0.02), op.grid(0.01, 0.03, 0.01)
_CELL = {
    "fcf": "greatest(0e0, (" + _gordon("grid_flow0", "coalesce(flow_growth, revenue_growth, 0.04e0)", "rate", "last") + " - (coalesce(s.total_debt, 0) - coalesce(s.cash, 0))) / nullif(shares, 0) + 0)",
    "eps": "greatest(0e0, " + _faded("eps0", "coalesce(earned_growth, 0.04e0)", "rate", "last", "multiple") + ")",
    "ddm": "greatest(0e0, " + _gordon("grid_div0", "coalesce(paid_growth, 0.04e0)", "rate", "last") + ")",
}
_HAS = {"fcf": "shares <> 0", "eps": "true", "ddm": "grid_div0 is not null"}


def _grid(model: str):
    sql = f"""{_COMPANY}, g as (select *, case when growth >= rate - 0.005e0 then rate - 0.005e0 else growth end as last from v cross join (select cast(unnest({RATES}) as double) as rate) cross join (select cast(unnest({GROWTHS}) as double) as growth)),
      p as (select *, case when {_HAS[model]} then {steady_sql(_CELL[model], 2)} end as value from g)
      select asset_id, rate, growth, value, case when value is not null then coalesce({steady_sql("(value - price) / nullif(price, 0) * 100", 2)}, 0) end as upside from p"""
    return lambda spark, d: op.sensitivity(companies(spark, d), RATES, GROWTHS, model), sql


QUERIES = {
    "wacc": _told("ke", "kd", "tax", "wacc"),
    "dcf_fcf": _told("fcf_value"),
    "dcf_eps": _told("eps_value"),
    "dcf_ddm": _told("ddm_value", "ddm_status"),
    "dcf_consensus": _told("fcf_value", "eps_value", "ddm_value", "price", "consensus", "upside"),
    "dcf_sensitivity": _grid("fcf"),
    "dcf_sensitivity_eps": _grid("eps"),
    "dcf_sensitivity_ddm": _grid("ddm"),
    "dcf_compare": (
        lambda spark, d: op.compared(companies(spark, d)),
        f"""{_COMPANY}, r as (
          select asset_id, price, 'fcf' as model, fcf_value as value, case when fcf_value is null then 'no value' else 'ok' end as status from v
          union all select asset_id, price, 'eps', eps_value, case when eps_value is null then 'no value' else 'ok' end from v union all select asset_id, price, 'ddm', ddm_value, ddm_status from v)
        select asset_id, model, coalesce(value, 0) as value, coalesce({steady_sql("(value / nullif(price, 0) - 1) * 100", 2)}, 0) as upside, status from r""",
    ),
}
