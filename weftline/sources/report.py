"""A sectioned JSON report of a domain as long-format metrics with their state.

The report is read as VARIANT, so sections may lack or add fields. What is read stands in the tables below, which are fixed
values: the sections the report should have, and the places of their figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("summary", "backlinks", "visitorEngagement", "trafficByDevice", "searchTraffic", "trafficByCountry", "trafficJourney", "trafficAi", "competitors", "keywords")
#: metric: (section, path of the figure)
HEADS = {
    "authority": ("backlinks", "authorityScore.value"),
    "backlinks": ("backlinks", "backlinks.value"),
    "referring_domains": ("backlinks", "referringDomains.value"),
    "world_rank": ("summary", "trafficStats.globalRank.value"),
    "category_rank": ("summary", "trafficStats.categoryRank.value"),
    "visits": ("visitorEngagement", "visits.value"),
    "pages_per_visit": ("visitorEngagement", "pagesPerVisit.value"),
    "visit_seconds": ("visitorEngagement", "timeOnSite.value"),
    "bounce_rate": ("visitorEngagement", "bounceRate.value"),
    "organic_visits": ("searchTraffic", "organic.value"),
    "paid_visits": ("searchTraffic", "paid.value"),
}
#: metric: (section, path); said only where the report has them
EXTRAS = {
    "penalty_risk": ("backlinks", "googlePenaltyRisk.value"),
    "backlinks_change": ("backlinks", "backlinks.valueDiffPercent"),
    "referring_domains_change": ("backlinks", "referringDomains.valueDiffPercent"),
    "visits_change": ("visitorEngagement", "visits.valueDiffPercent"),
    "organic_visits_change": ("searchTraffic", "organic.valueDiffPercent"),
    "country_rank": ("summary", "trafficStats.countryRank.value"),
    "other_than_ai_visits": ("trafficAi", "other.traffic.value"),
}
#: (section, path of the list, name of the subject, metrics by field). Subjects are dates, countries, hosts or queries.
LISTS = (
    ("backlinks", "backlinksHistory", "displayDate", {"backlinks@": "backlinks"}),
    ("backlinks", "referringDomainsHistory", "displayDate", {"referring_domains@": "referringDomains"}),
    ("visitorEngagement", "visitsHistory", "displayDate", {"visits@": "visits"}),
    ("trafficByDevice", "history", "displayDate", {"desktop_visits@": "desktopVisits", "mobile_visits@": "mobileVisits"}),
    ("searchTraffic", "history", "displayDate", {"organic_visits@": "organic", "paid_visits@": "paid"}),
    ("trafficByCountry", "series", "country", {"country_visits": "traffic", "country_share": "trafficShare"}),
    ("trafficJourney", "in.items", "host", {"visits_from": "value"}),
    ("trafficJourney", "out.items", "host", {"visits_to": "value"}),
    ("trafficAi", "items", "id", {"ai_visits": "traffic.value"}),
    ("competitors", "items", "slug", {"competitor_visits": "visits", "competitor_relevance": "relevance"}),
    ("keywords", "series", "keyword", {"position": "position", "search_volume": "searchVolume", "cost_per_click": "cpc", "query_share": "traffic"}),
)
ROW = "array<struct<metric:string,subject:string,value:double,state:string>>"


def report_metrics(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, metric, subject, value, state) of a JSON report. A section that is missing, or held back (``visible`` false),
    gives a BLIND row of its own. A figure that is null is ABSENT, unless its section is held back or has a history with
    figures: then the source has it and withholds it, and it is BLIND. Text that is no JSON lacks every section."""
    get = lambda s, path, kind="double": F.try_variant_get(f"_{s}", f"$.{path}", kind)
    one = lambda metric, value, state, subject=None: F.struct(F.lit(metric).alias("metric"), (F.lit(None).cast("string") if subject is None else subject).alias("subject"), value.alias("value"), state.alias("state"))
    none = F.lit(None).cast("double")
    # in steps, so that the text is parsed once, each section and list is looked up once and each rule worked out once
    parsed = df.select(key, F.try_parse_json(column).alias("_v"))
    sections = parsed.select(key, *[F.try_variant_get("_v", f"$.{s}", "variant").alias(f"_{s}") for s in SECTIONS])
    lists = {f"_list{i}": entry for i, entry in enumerate(LISTS)}
    read = sections.select("*", *[F.coalesce(get(s, path, "array<variant>"), F.array().cast("array<variant>")).alias(c) for c, (s, path, _, _) in lists.items()])
    hidden = {s: F.coalesce(~get(s, "visible", "boolean"), F.lit(False)) for s in SECTIONS}

    def figures(section: str) -> Column:
        """Whether any history of the section holds a figure."""
        any_of = lambda fields: lambda x: F.coalesce(*[F.try_variant_get(x, f"$.{f}", "double") for f in fields]).isNotNull()
        found = [F.exists(c, any_of(entry[3].values())) for c, entry in lists.items() if entry[0] == section and entry[2] == "displayDate"]
        return reduce(lambda a, b: a | b, found, F.lit(False))

    numbers = {**HEADS, **EXTRAS}
    figured = read.select(
        key, *lists,
        *[F.col(f"_{s}").isNotNull().alias(f"_there_{s}") for s in SECTIONS],
        *[hidden[s].alias(f"_hidden_{s}") for s in SECTIONS],
        *[(hidden[s] | figures(s)).alias(f"_withheld_{s}") for s in SECTIONS],
        *[get(s, path).alias(f"_of_{m}") for m, (s, path) in numbers.items()],
    )
    flag = lambda kind, s: F.col(f"_{kind}_{s}")
    absent = lambda value: F.when(value.isNotNull(), "MEASURED").otherwise("ABSENT")
    parts = [F.when(~flag("there", s) | flag("hidden", s), one(f"section_{s}", none, F.lit("BLIND"))) for s in SECTIONS]
    for metric, (s, _) in HEADS.items():
        value = F.col(f"_of_{metric}")
        parts.append(F.when(flag("there", s), one(metric, value, F.when(value.isNotNull(), "MEASURED").when(flag("withheld", s), "BLIND").otherwise("ABSENT"))))
    for metric in EXTRAS:
        value = F.col(f"_of_{metric}")
        parts.append(F.when(value.isNotNull(), one(metric, value, F.lit("MEASURED"))))

    def rows_of(name: str, fields: dict[str, str]):
        def one_item(x: Column) -> Column:
            subject = F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit("unknown"))
            values = [(m, F.try_variant_get(x, f"$.{f}", "double")) for m, f in fields.items()]
            return F.array(*[one(m, value, absent(value), subject) for m, value in values])

        return one_item

    told = [F.flatten(F.transform(c, rows_of(name, fields))).cast(ROW) for c, (_, _, name, fields) in lists.items()]
    return figured.select(key, F.inline(F.concat(F.array_compact(F.array(*parts)).cast(ROW), *told)))
