"""Queries over provider pages: each customer is a page of one provider, with the faults that pages have (tags left open, single quotes, entities, empty cells); and the headings of the given pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.sources import connectors as op
from tidemark.sources.adapters import read, spread

_K, _D = "cast(c_custkey as varchar)", "cast(c_custkey % 10 as varchar)"
PROVIDERS = ["zonebourse", "barrons", "wallstreetjournal", "marketwatch", "morningstar", "investing", "boursedirect", "investir", "boursorama", "fortuneo"]
#: <k> stands for the customer's number, <d> for its last digit, <i> for it in eight digits.
HTML = {
    "zonebourse": "<h1 class=a> Firm &amp; <k></h1><ul><li>ISIN : FR<k><li><b>Secteur</b>: S<d></ul><span class='x esg-rank'> A<d> </span><table><tr><th>Chiffre d&#39;affaires<td>-<td>1 2<d>4,5 €<td>9<tr><td>R&eacute;sultat net</td><td></td><td><k></td></tr><tr><td>PER 2024<td>n<td><d>,5x<tr><td>PER 2025</table>",
    "barrons": "<h1>Firm <k></h1><div id=a><p>P/E Ratio (TTM)<p>12.<d>x</div><section><ul><li>Dividend Yield: 2.<d>%</ul></section><div><p>EPS</p><p>$<k>.25</div>",
    "wallstreetjournal": "<h1>Firm <b><k></b></h1><table><tr><td>P/E Ratio<td>15.<d><tr><td>Yield: 3.<d>%<td>x<tr><td>EPS (TTM)<td>-</table><span>EPS: -<k></span><span>EPS: 7</span>",
    "marketwatch": "<h1>Firm <k><p>x</h1><ul><li>P/E Ratio</li><li>16.<d></ul><div>a text about the Yield of shares that is much too long to be a label: 99</div><!-- EPS: 1 --><script>EPS: 2</script>",
    "morningstar": "<h1><i>x</i><span>Firm <k></span></h1><div class=\"b sal-dp-name\">Secteur</div> <div> S<d> </div><h3>Cap. boursi&egrave;re</h3>\n<p><k> Mio</p><div class=sal-dp-name>Cours/B&eacute;n&eacute;fices</div><div>1<d>,5</div><h3>Industrie</h3><div id=message-box-price><k>,10",
    "investing": "<h1>Firm <k></h1><dl><dt>P/E Ratio<dd>12.<d><dt>EPS<dd>9<dt>EPS <b>diluted</b></dt>\n<dd><k>.5<dt>EPS basic<dd>-<dt>Dividend Yield</dt><dd>(3.<d>%)</dl>",
    "boursedirect": "<meta content='Cours FR00<i>: <k>' property=\"og:description\"><h1>Firm <k></h1><div class='b quotation-last'>1 2<d>4,50</div><p class=quotation-variation>+0,<d> %<div class=\"sticker sticker-default-reverse\"> T<k> </div>",
    "investir": "<link href=\"https://x/cours/firm-t<k>-fr00<i>-xpar\" rel='canonical'><h1>Firm <k></h1><span class=\"x typography-secondary-2xl-regular\">29<d>,32 $</span><span class='typography-secondary-2xl-bold'>-1,<d> %",
    "boursorama": "<h1>Firm <k></h1><p class='c-faceplate__isin'>FR00<i> T<k><div class=c-gauge__label>Low</div>",
    "fortuneo": "<body><h1>Firm <k>",
}


def _made(text: str) -> str:
    quoted = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("<k>", f"' || {_K} || '").replace("<d>", f"' || {_D} || '").replace("<i>", f"' || lpad({_K}, 8, '0') || '")


PAGE = f"""select c_custkey as key, case c_custkey % 10 {" ".join(f"when {i} then '{p}'" for i, p in enumerate(PROVIDERS))} end as provider,
  case when c_custkey % 37 = 0 then null when c_custkey % 41 = 0 then 'no element &' when c_custkey % 29 = 0 then '<p>nothing' else case c_custkey % 10 {" ".join(f"when {i} then {_made(HTML[p])}" for i, p in enumerate(PROVIDERS))} end end as html from customer"""
HIT = f"select c_custkey as key, case c_custkey % 10 {' '.join(f'''when {i} then '{p}' ''' for i, p in enumerate(PROVIDERS))} end as provider, 'Found ' || {_K} as name, 'US' || lpad({_K}, 10, '0') as isin, c_custkey + 0.5e0 as price, 1.5e0 as change_percent from customer where c_custkey % 3 = 0"
_TRADE = "<table class=\"cr_mod_insider z\"><tbody><tr><td>3 months<td><span class=data_data>6 Purchases</span><td> <k> Purchased<tr><td>short</table><table class='cr_mod_transactions'><thead><tr><td>a<td>b<td>c<td>d<td>e</thead><tbody><tr><td>01/0<d>/24</td><td>O &lt;<k>&gt;<td>1,<d>00<td><td>$<k></tbody></table>"


def _rows(sql: str, given=read):
    return lambda spark, d: spark.sql(sql.replace("\\", "\\\\").replace("varchar", "string").replace("from customer", "from {customer}"), customer=given(spark, d, "customer"))


def _spread(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(read(spark, d, name))


pages, hits, trades = _rows(PAGE, _spread), _rows(HIT), _rows(f"select c_custkey as key, case when c_custkey % 7 <> 0 then {_made(_TRADE)} end as html from customer", _spread)


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return op.provider_fields(pages(spark, d))


FIGURES = ["price", "change_percent", "pe_ratio", "dividend_yield", "eps", "revenue", "net_income"]
TEXTS = ["name", "ticker", "isin", "sector", "esg_score", "market_cap", "price_text"]
WANTED = f"""with p as (select c_custkey, c_custkey % 10 as n, {_K} as k, {_D} as d, c_custkey % 10 as x, lpad({_K}, 8, '0') as i from customer), b as (select c_custkey, c_custkey % 37 = 0 or c_custkey % 41 = 0 as failed, c_custkey % 29 = 0 as bare from customer),
  t as (select c_custkey, case when n = 0 then 'Firm & ' || k when n = 2 then 'Firm' || k when n = 3 then 'Firm ' || k || 'x' else 'Firm ' || k end as name, case n when 0 then 'FR' || k when 6 then 'T' || k when 7 then 'T' || k end as ticker, case when n in (6, 7, 8) then 'FR00' || i end as isin,
    case when n in (0, 4) then 'S' || d end as sector, case n when 0 then 'A' || d when 8 then 'Low' end as esg_score, case when n = 4 then k || ' Mio' end as market_cap, case when n = 4 then k || ',10' end as price_text,
    case n when 6 then 1204.5e0 + 10 * x when 7 then 290.32e0 + x end as price, case n when 6 then x / 1e1 when 7 then -1 - x / 1e1 end as change_percent,
    case n when 0 then x + 0.5e0 when 1 then 12 + x / 1e1 when 2 then 15 + x / 1e1 when 3 then 16 + x / 1e1 when 4 then 10 + x + 0.5e0 when 5 then 12 + x / 1e1 end as pe_ratio, case n when 1 then 2 + x / 1e1 when 2 then 3 + x / 1e1 when 5 then 3 + x / 1e1 end as dividend_yield,
    case n when 1 then c_custkey + 0.25e0 when 2 then c_custkey when 5 then c_custkey + 0.5e0 end as eps, case when n = 0 then 1204.5e0 + 10 * x end as revenue, case when n = 0 then c_custkey + 0e0 end as net_income from p),
  f as (select c_custkey as key, provider, case when failed then 'error' when bare then 'no_data' else 'ok' end as status, {", ".join(f"case when not (failed or bare) then {c} end as {c}" for c in TEXTS + FIGURES)} from t join b using (c_custkey) join (select key as c_custkey, provider from ({PAGE})) using (c_custkey))"""
_TOLD = ", ".join([*TEXTS, *(f"{steady_sql(c)} as {c}" for c in FIGURES)])

QUERIES = {
    "connector_fields": (lambda spark, d: _fields(spark, d).select("key", "provider", "status", *TEXTS, *(steady(c).alias(c) for c in FIGURES)), f"{WANTED} select key, provider, status, {_TOLD} from f"),
    "connector_filled": (
        lambda spark, d: op.filled(_fields(spark, d), hits(spark, d)).select("key", "provider", "status", "name", "isin", steady("price").alias("price"), steady("change_percent").alias("change_percent")),
        f"""{WANTED}, h as ({HIT}) select key, f.provider, case when h.key is not null then 'ok' else status end as status, coalesce(f.name, h.name) as name, coalesce(f.isin, h.isin) as isin, {steady_sql("coalesce(f.price, h.price)")} as price, {steady_sql("coalesce(f.change_percent, h.change_percent)")} as change_percent
        from f left join h using (key)""",
    ),
    "connector_errors": (
        lambda spark, d: _fields(spark, d).groupBy("provider", "status", "error").agg(F.count(F.lit(1)).alias("n")),
        f"select provider, case when c % 37 = 0 or c % 41 = 0 then 'error' when c % 29 = 0 then 'no_data' else 'ok' end as status, case when c % 37 = 0 then 'ValueError: no page' when c % 41 = 0 then 'ValueError: no element' end as error, count(*) as n from (select key as c, provider from ({PAGE})) group by 1, 2, 3",
    ),
    "insider_tables": (
        lambda spark, d: op.insider_tables(trades(spark, d)).select("key", F.size("summary").cast("bigint").alias("n"), F.get("summary", F.lit(0))["shares"].alias("bought"), F.get("transactions", F.lit(0))["owner"].alias("owner"), F.get("transactions", F.lit(0))["shares"].alias("shares"), F.size("transactions").cast("bigint").alias("m")),
        f"select c_custkey as key, cast(c_custkey % 7 <> 0 as bigint) as n, case when c_custkey % 7 <> 0 then {_K} || ' Purchased' end as bought, case when c_custkey % 7 <> 0 then 'O <' || {_K} || '>' end as owner, case when c_custkey % 7 <> 0 then '1,' || {_D} || '00' end as shares, cast(c_custkey % 7 <> 0 as bigint) as m from customer",
    ),
    "page_headings": (
        lambda spark, d: op.provider_fields(spread(read(spark, d, "pages")).select(F.col("page_id").alias("key"), F.lit("msn").alias("provider"), "html")).select("key", "status", "name"),
        "with h as (select page_id as key, nullif(trim(replace(replace(replace(regexp_extract(html, '(?s)<h1[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') as name from pages) select key, case when name is null then 'no_data' else 'ok' end as status, name from h",
    ),
}
