"""Feed definitions as configuration rows: id, section, kind, cadence, history, threshold ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One feed per line; thresholds are tried from the left, the first match wins.
FEEDS = """
caiso-co2 | grid | metric | 30m | 576 |
gb-carbon-intensity | grid | metric | 30m | 336 | critical gte 235; serious gte 150; warning gte 90
eia-us48-demand | grid | metric | 1h | 336 |
gb-frequency | grid | metric | 30m | 576 | critical lt 49.5; critical gt 50.5; serious lt 49.8; serious gt 50.2; warning lt 49.9; warning gt 50.1
gb-market-price | grid | metric | 30m | 336 |
ercot-fuel-mix | grid | metric | 30m | 576 |
ercot-prc | grid | metric | 30m | 576 | critical lt 1750; serious lt 2300; warning lt 3000
ercot-rt-price | grid | metric | 30m | 384 | critical gte 4000; serious gte 1000; warning gte 100
ercot-storage | grid | metric | 30m | 576 |
ercot-demand | grid | metric | 30m | 576 |
ercot-wind-solar | grid | metric | 1h | 336 |
us-nuclear-fleet | grid | metric | 1d | 365 |
grid-alerts | grid | events | 30m | 120 |
nyiso-fuel-mix | grid | metric | 30m | 576 |
yield-curve-10y2y | econ | metric | 6h | 780 | warning lte 0
weekly-economic-index | econ | metric | 6h | 160 | serious lte -2; warning lte 0
gdpnow | econ | metric | 6h | 22 | serious lte -2; warning lte 0
treasury-10y | econ | metric | 6h | 780 |
mortgage-30y | econ | metric | 6h | 160 | serious gte 8; warning gte 7
cpi-yoy | econ | metric | 6h | 84 | critical gte 6; serious gte 4; warning gte 3
gas-regular | econ | metric | 6h | 160 | critical gte 5; serious gte 4; warning gte 3.5
unemployment-rate | econ | metric | 6h | 72 | critical gte 7; serious gte 5.5; warning gte 4.5
initial-claims | econ | metric | 6h | 160 | critical gte 400000; serious gte 300000; warning gte 250000
vix | econ | metric | 6h | 780 | critical gte 40; serious gte 30; warning gte 20
high-yield-spread | econ | metric | 6h | 780 | critical gte 10; serious gte 7; warning gte 5
fomc-hold-odds | econ | metric | 6h | 700 |
recession-odds | econ | metric | 6h | 720 |
fed-funds-effective | econ | metric | 6h | 780 |
data-releases | econ | events | 6h | 120 |
federal-debt | econ | metric | 6h | 520 |
sp500 | econ | metric | 6h | 400 |
airnow-aqi | health | metric | 12h | 720 | critical gte 151; serious gte 101; warning gte 51
ari-ed-visits | health | metric | 12h | 400 |
wastewater-covid | health | metric | 12h | 160 | critical gte 8; serious gte 4.5; warning gte 3
wastewater-influenza-a | health | metric | 12h | 160 | critical gte 8; serious gte 4.5; warning gte 3
wastewater-rsv | health | metric | 12h | 160 | critical gte 8; serious gte 4.5; warning gte 3
hosp-rate-covid | health | metric | 12h | 160 |
hosp-rate-influenza | health | metric | 12h | 160 |
ili-national | health | metric | 12h | 200 | critical gte 7; serious gte 5; warning gte 3
ed-visits-covid | health | metric | 12h | 160 |
ed-visits-influenza | health | metric | 12h | 160 |
heat-cold-alerts | health | metric | 12h | 288 | critical gte 150; serious gte 50; warning gte 10
fda-food-recalls | health | events | 12h | 120 |
drug-shortages | health | metric | 12h | 365 |
who-outbreak-news | health | events | 12h | 120 |
ipv6-capable | net | metric | 1d | 400 |
radar-l7-attacks | net | metric | 1h | 168 |
radar-bgp-anomalies | net | metric | 1h | 336 |
radar-http3-share | net | metric | 1h | 336 |
ioda-outage-alerts | net | metric | 1h | 336 |
ioda-alerts | net | events | 1h | 120 |
npm-downloads | net | metric | 6h | 365 |
bgp-table-v4 | net | metric | 1d | 365 |
bgp-table-v6 | net | metric | 1d | 365 |
providers-degraded | net | metric | 1h | 288 | critical gte 4; serious gte 2; warning gte 1
provider-incidents | net | events | 1h | 120 |
tor-users | net | metric | 6h | 365 |
tor-relays | net | metric | 6h | 365 |
internet-pageviews | net | metric | 6h | 400 |
iss-altitude | sky | metric | 6h | 480 |
neo-closest-approach | sky | metric | 6h | 240 | critical lte 0.11; serious lte 0.5; warning lte 1
neo-close-approaches | sky | events | 6h | 80 |
donki-cme | sky | events | 1h | 120 |
swpc-alerts | sky | events | 1h | 150 |
aurora-hemispheric-power | sky | metric | 1h | 576 | critical gte 150; serious gte 100; warning gte 50
f107-flux | sky | metric | 3h | 365 |
solar-flares | sky | events | 1h | 200 |
proton-flux-10mev | sky | metric | 1h | 2016 | critical gte 1000; serious gte 100; warning gte 10
electron-flux-2mev | sky | metric | 1h | 2016 | serious gte 10000; warning gte 1000
goes-xray-flux | sky | metric | 1h | 1440 | critical gte 1000; serious gte 100; warning gte 10
kp-planetary | sky | metric | 1h | 224 | critical gte 8; serious gte 7; warning gte 5
noaa-scales | sky | metric | 1h | 672 | critical gte 4; serious gte 3; warning gte 1
sunspot-number | sky | metric | 1d | 360 |
solar-wind-speed | sky | metric | 1h | 1440 | critical gte 900; serious gte 700; warning gte 500
solar-wind-bz | sky | metric | 1h | 1440 | serious lte -20; warning lte -10
ai-providers-degraded | compute | metric | 6h | 288 | serious gte 2; warning gte 1
ai-incidents | compute | events | 6h | 120 |
lab-announcements | compute | events | 6h | 150 |
aa-intelligence-index | compute | metric | 6h | 240 |
arxiv-ai-papers | compute | metric | 6h | 240 |
epoch-frontier-models | compute | metric | 1d | 400 |
epoch-largest-cluster | compute | metric | 1d | 200 |
hf-new-models-24h | compute | metric | 6h | 720 |
hf-lab-releases | compute | events | 6h | 120 |
hf-daily-papers | compute | events | 6h | 120 |
npm-ai-sdk-downloads | compute | metric | 1d | 400 |
openrouter-models | compute | metric | 6h | 240 |
openrouter-price-longctx | compute | metric | 6h | 240 |
gpu-h100-spot | compute | metric | 6h | 720 |
"""

SCHEMA = (
    "id string, section string, kind string, cadence string, history int, position int, "
    "rules array<struct<level:string,gte:double,gt:double,lte:double,lt:double,eq:double>>"
)


def feed_rows() -> list[tuple]:
    """(id, section, kind, cadence, history, position, rules) with rules as (level, gte, gt, lte, lt, eq)."""
    out = []
    for position, line in enumerate(FEEDS.strip().splitlines()):
        ident, section, kind, cadence, history, *ladder = [c.strip() for c in line.split("|")]
        rules = []
        for rule in filter(None, (r.strip() for r in (ladder[0] if ladder else "").split(";"))):
            level, op, bound = rule.split()
            rules.append((level, *[float(bound) if op == o else None for o in ("gte", "gt", "lte", "lt", "eq")]))
        out.append((ident, section, kind, cadence, int(history), position, rules))
    check_registry(out)
    return out


def check_registry(rows: list[tuple]) -> None:
    """Duplicate ids, unknown kinds and unreadable cadences stop the load."""
    ids = [r[0] for r in rows]
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate feed ids")
    for ident, _, kind, cadence, history, *_ in rows:
        if kind not in ("metric", "events") or not cadence[:-1].isdigit() or cadence[-1] not in "mhdw" or history <= 0:
            raise ValueError(f"feed {ident} is not well formed")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(feed_rows(), SCHEMA)


def public_view(df: DataFrame, private=("rules",)) -> DataFrame:
    """Registry rows without the fields that stay internal."""
    return df.drop(*private)
