"""Landed JSON payloads -> postings.

Each payload shape is one JSON schema, the path of its job array and one
projection.  A body is parsed once per scan with exactly the fields that are
used, and the array is exploded in place: no shuffle, no Python.  Land payloads
partitioned by ``provider`` so that each shape's scan prunes to its own files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import dates
from hirelake.functions.text import (
    WS,
    blank_to_null,
    capitalize,
    company_from_source,
    filled,
    join_filled,
    once,
    or_empty,
    strip,
)
from hirelake.schema import POSTING_FIELDS

NOT_SPECIFIED = "Not specified"
FULL_TIME = "Full-time"


@dataclass(frozen=True)
class PayloadShape:
    """``items`` and ``total`` read a parsed body, ``keep`` and ``fields`` one
    element of the job array; ``usable`` guards what may be parsed at all."""

    schema: str
    items: Callable[[Column], Column]
    total: Callable[[Column], Column]
    fields: Callable[[Column, object], dict[str, Column]]
    keep: Callable[[Column], Column] | None = None
    usable: Callable[[Column], Column] | None = None

    def parse(self, body: Column) -> Column:
        return F.from_json(body if self.usable is None else F.when(self.usable(body), body), self.schema)

    def kept(self, doc: Column) -> Column:
        return self.items(doc) if self.keep is None else F.filter(self.items(doc), self.keep)


def _strings(*names: str) -> str:
    return ", ".join(f"{name} STRING" for name in names)


def _at(value: Column, path: str) -> Column:
    return reduce(lambda column, name: column[name], path.split("."), value)


def _default(job: Column, path: str, value: str) -> Column:
    return F.coalesce(_at(job, path), F.lit(value))


def _linked(prefix: Column, tail: Column, *needed: Column) -> Column:
    """prefix + tail, or '' unless the tail and everything needed is filled."""
    complete = reduce(lambda a, b: a & b, [filled(c) for c in (tail, *needed)])
    return F.when(complete, F.concat(prefix, tail)).otherwise(F.lit(""))


def _place(*parts: Column) -> Column:
    return F.coalesce(blank_to_null(join_filled(", ", *parts)), F.lit(NOT_SPECIFIED))


def _company() -> Column:
    return company_from_source(F.col("source"))


# Patterns over free-text descriptions.
_PLACES_IN_TEXT = (
    rf"(?Ud)Locations?{WS}+(?:In this role you can work from{WS}+)?(.+?)(?:{WS}+Overview|{WS}+About)"
)
_NEXT_SECTION = rf"(?U){WS}(Responsibilities|Qualifications|Requirements|About the role)"


def _github(job, as_of) -> dict[str, Column]:
    text = or_empty(_at(job, "data.description"))
    city_state = join_filled(", ", _at(job, "data.city"), _at(job, "data.state"))
    found = strip(F.regexp_extract(text, _PLACES_IN_TEXT, 1))
    guessed = F.when(text.contains("Remote"), F.lit("Remote")).when(
        text.contains("Locations"), found
    )
    after = F.substring(text, F.instr(text, "Overview") + F.length(F.lit("Overview")), F.length(text))
    summary = (
        F.when(~text.contains("Overview"), F.substring(text, 1, 300))
        .when(after.rlike(_NEXT_SECTION), F.split(after, _NEXT_SECTION, 2)[0])
        .otherwise(F.substring(after, 1, 300))
    )
    return {
        "title": _default(job, "data.title", "Unknown"),
        "company": F.lit("GitHub"),
        "location": F.coalesce(
            blank_to_null(city_state), blank_to_null(guessed), F.lit(NOT_SPECIFIED)
        ),
        "url": _linked(
            F.lit("https://www.github.careers/careers-home/jobs/"), _at(job, "data.slug")
        ),
        "description": strip(summary),
        "date_posted": _at(job, "data.posted_date"),
        "job_type": _default(job, "data.employment_type", FULL_TIME),
    }


def _amazon(job, as_of) -> dict[str, Column]:
    return {
        "title": _default(job, "title", "Unknown"),
        "company": F.lit("Amazon"),
        "location": _place(_at(job, "city"), _at(job, "state")),
        "url": _linked(F.lit("https://www.amazon.jobs"), _at(job, "job_path")),
        "description": F.coalesce(
            blank_to_null(_at(job, "description_short")),
            F.substring(or_empty(_at(job, "description")), 1, 300),
        ),
        "date_posted": or_empty(dates.month_name_text(_at(job, "posted_date"), dates.LONG_MONTH)),
        "job_type": capitalize(_default(job, "job_schedule_type", FULL_TIME)),
    }


def _eightfold(job, as_of) -> dict[str, Column]:
    department = _at(job, "department")
    number = _at(job, "displayJobId")
    numbered = F.concat(F.lit("Job ID: "), number)
    return {
        "title": _default(job, "name", "Unknown"),
        "company": _company(),
        "location": F.when(
            F.array_size(_at(job, "locations")) > 0, F.array_join(_at(job, "locations"), ", ")
        ).otherwise(F.lit(NOT_SPECIFIED)),
        "url": _linked(F.col("base_url"), _at(job, "positionUrl"), F.col("base_url")),
        "description": F.when(
            filled(number), join_filled(" | ", numbered, department)
        ).otherwise(or_empty(department)),
        "date_posted": dates.epoch_seconds_text(_at(job, "postedTs")),
        "job_type": F.lit(FULL_TIME),
    }


def _workday(job, as_of) -> dict[str, Column]:
    return {
        "title": _default(job, "title", "Unknown"),
        "company": _company(),
        "location": _default(job, "locationsText", NOT_SPECIFIED),
        "url": _linked(or_empty(F.col("base_url")), _at(job, "externalPath")),
        "description": or_empty(F.get(_at(job, "bulletFields"), 0)),
        "date_posted": dates.days_ago_text(_at(job, "postedOn"), as_of),
        "job_type": F.lit(FULL_TIME),
    }


def _lever(job, as_of) -> dict[str, Column]:
    plain = _at(job, "descriptionPlain")
    return {
        "title": _default(job, "text", "Unknown"),
        "company": _company(),
        "location": _default(job, "categories.location", NOT_SPECIFIED),
        "url": or_empty(_at(job, "hostedUrl")),
        "description": F.when(filled(plain), strip(F.substring(plain, 1, 300))).otherwise(
            or_empty(_at(job, "text"))
        ),
        "date_posted": dates.epoch_millis_text(_at(job, "createdAt")),
        "job_type": F.coalesce(blank_to_null(_at(job, "categories.commitment")), F.lit(FULL_TIME)),
    }


def _greenhouse(job, as_of) -> dict[str, Column]:
    updated = _at(job, "updated_at")
    # Digits keep their wall clock; only the age test looks at the offset.
    recent = dates.iso_instant(updated) > dates.days_before(as_of, 61)
    names = F.filter(F.transform(_at(job, "departments"), lambda d: d["name"]), filled)
    return {
        "title": _default(job, "title", "Unknown"),
        "company": _company(),
        "location": _default(job, "location.name", NOT_SPECIFIED),
        "url": or_empty(_at(job, "absolute_url")),
        "description": or_empty(F.array_join(names, ", ")),
        "date_posted": F.when(recent, dates.wall_clock_text(updated)).otherwise(F.lit("")),
        "job_type": F.lit(FULL_TIME),
    }


def _oracle_hcm(job, as_of) -> dict[str, Column]:
    site = F.coalesce("site_number", F.lit("CX_1001"))
    folder = F.concat(
        F.col("base_url"), F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/")
    )
    return {
        "title": _default(job, "Title", "Unknown"),
        "company": _company(),
        "location": _default(job, "PrimaryLocation", NOT_SPECIFIED),
        "url": _linked(folder, _at(job, "Id"), F.col("base_url")),
        "description": or_empty(_at(job, "ShortDescriptionStr")),
        "date_posted": or_empty(dates.day_text(_at(job, "PostedDate"))),
        "job_type": F.lit(FULL_TIME),
    }


def _phenom(job, as_of) -> dict[str, Column]:
    number = F.coalesce(_at(job, "jobId"), _at(job, "reqId"))
    built = _linked(
        F.concat(F.col("base_url"), F.lit("/us/en/job/")), number, F.col("base_url")
    )
    return {
        "title": _default(job, "title", "Unknown Title"),
        "company": strip(_company()),
        "location": F.coalesce(_at(job, "location"), _at(job, "cityStateCountry"), F.lit("")),
        "url": F.coalesce(blank_to_null(_at(job, "applyUrl")), built),
        "description": join_filled(" | ", _at(job, "category"), _at(job, "descriptionTeaser")),
        "date_posted": or_empty(_at(job, "postedDate")),
        "job_type": _default(job, "type", "Full time"),
    }


def _goldman_sachs(job, as_of) -> dict[str, Column]:
    places = F.filter(
        F.transform(
            _at(job, "locations"),
            lambda p: join_filled(", ", p["city"], p["state"], p["country"]),
        ),
        filled,
    )
    return {
        "title": _default(job, "jobTitle", "Unknown Title"),
        "company": F.lit("Goldman Sachs"),
        "location": F.coalesce(
            blank_to_null(F.array_join(places, "; ")), F.lit(NOT_SPECIFIED)
        ),
        "url": _linked(F.lit("https://higher.gs.com/roles/"), _at(job, "externalSource.sourceId")),
        "description": join_filled(
            " | ", _at(job, "corporateTitle"), _at(job, "division"), _at(job, "jobFunction")
        ),
        "date_posted": F.lit(""),
        "job_type": F.lit(FULL_TIME),
    }


def _epam(job, as_of) -> dict[str, Column]:
    city = F.get(_at(job, "city"), 0)
    country = F.get(_at(job, "country"), 0)
    text = strip(F.regexp_replace(or_empty(_at(job, "description")), r"<[^>]+>", ""))
    return {
        "title": _default(job, "name", "Unknown"),
        "company": _company(),
        "location": _place(city["name"], city["state"]["name"], country["name"]),
        "url": _linked(F.lit("https://careers.epam.com"), _at(job, "seo.url")),
        "description": F.substring(text, 1, 500),
        "date_posted": F.lit(""),
        "job_type": F.coalesce(blank_to_null(_at(job, "vacancy_type")), F.lit(FULL_TIME)),
    }


def _apple(job, as_of) -> dict[str, Column]:
    place = F.get(_at(job, "locations"), 0)
    number = _at(job, "id")
    page = F.concat(number, F.lit("/"), or_empty(_at(job, "transformedPostingTitle")))
    posted = _at(job, "postingDate")
    return {
        "title": _default(job, "postingTitle", "Unknown"),
        "company": F.lit("Apple"),
        "location": _place(place["name"], place["countryName"]),
        "url": _linked(F.lit("https://jobs.apple.com/en-us/details/"), page, number),
        "description": F.substring(or_empty(_at(job, "jobSummary")), 1, 500),
        "date_posted": F.coalesce(
            dates.month_name_text(posted, dates.SHORT_MONTH), posted, F.lit("")
        ),
        "job_type": F.lit(FULL_TIME),
    }


_APPLE_JOB = (
    "STRUCT<"
    + _strings("postingTitle", "id", "transformedPostingTitle", "jobSummary", "postingDate")
    + ", locations ARRAY<STRUCT<name STRING, countryName STRING>>>"
)


# The JSON field names of each payload shape.
SHAPES = {
    "github": PayloadShape(
        schema="totalCount BIGINT, jobs ARRAY<STRUCT<data STRUCT<"
        + _strings(
            "title", "city", "state", "description", "slug", "posted_date", "employment_type"
        )
        + ">>>",
        items=lambda doc: _at(doc, "jobs"),
        total=lambda doc: _at(doc, "totalCount"),
        fields=_github,
    ),
    "amazon": PayloadShape(
        schema="hits BIGINT, jobs ARRAY<STRUCT<"
        + _strings(
            "title", "country_code", "city", "state", "job_path", "description_short",
            "description", "posted_date", "job_schedule_type",
        )
        + ">>",
        items=lambda doc: _at(doc, "jobs"),
        total=lambda doc: _at(doc, "hits"),
        keep=lambda job: F.coalesce(job["country_code"] == "USA", F.lit(False)),
        fields=_amazon,
    ),
    "eightfold": PayloadShape(
        schema="data STRUCT<total BIGINT, positions ARRAY<STRUCT<"
        + _strings("name", "positionUrl", "displayJobId", "department")
        + ", locations ARRAY<STRING>, postedTs BIGINT>>>",
        items=lambda doc: _at(doc, "data.positions"),
        total=lambda doc: _at(doc, "data.total"),
        fields=_eightfold,
    ),
    "workday": PayloadShape(
        schema="total BIGINT, jobPostings ARRAY<STRUCT<"
        + _strings("title", "locationsText", "externalPath", "postedOn")
        + ", bulletFields ARRAY<STRING>>>",
        items=lambda doc: _at(doc, "jobPostings"),
        total=lambda doc: _at(doc, "total"),
        fields=_workday,
    ),
    "lever": PayloadShape(
        schema="ARRAY<STRUCT<"
        + _strings("text", "hostedUrl", "descriptionPlain")
        + ", createdAt BIGINT, categories STRUCT<location STRING, commitment STRING>>>",
        items=lambda doc: doc,
        total=lambda doc: F.lit(0).cast("bigint"),
        # from_json reads a lone object as a one-element array; here it is no list.
        usable=lambda body: body.rlike(r"^\s*\["),
        fields=_lever,
    ),
    "greenhouse": PayloadShape(
        schema="meta STRUCT<total BIGINT>, jobs ARRAY<STRUCT<"
        + _strings("title", "absolute_url", "updated_at")
        + ", location STRUCT<name STRING>, departments ARRAY<STRUCT<name STRING>>>>",
        items=lambda doc: _at(doc, "jobs"),
        total=lambda doc: _at(doc, "meta.total"),
        fields=_greenhouse,
    ),
    "oracle_hcm": PayloadShape(
        schema="items ARRAY<STRUCT<TotalJobsCount BIGINT, requisitionList ARRAY<STRUCT<"
        + _strings(
            "Id", "Title", "PrimaryLocation", "PrimaryLocationCountry", "PostedDate",
            "ShortDescriptionStr",
        )
        + ">>>>",
        items=lambda doc: F.get(doc["items"], 0)["requisitionList"],
        total=lambda doc: F.get(doc["items"], 0)["TotalJobsCount"],
        keep=lambda job: ~filled(job["PrimaryLocationCountry"])
        | (job["PrimaryLocationCountry"] == "US"),
        fields=_oracle_hcm,
    ),
    "phenom": PayloadShape(
        schema="refineSearch STRUCT<totalHits BIGINT, data STRUCT<jobs ARRAY<STRUCT<"
        + _strings(
            "title", "location", "cityStateCountry", "jobId", "reqId", "postedDate", "type",
            "descriptionTeaser", "category", "applyUrl",
        )
        + ">>>>",
        items=lambda doc: _at(doc, "refineSearch.data.jobs"),
        total=lambda doc: _at(doc, "refineSearch.totalHits"),
        fields=_phenom,
    ),
    "goldman_sachs": PayloadShape(
        schema="data STRUCT<roleSearch STRUCT<totalCount BIGINT, items ARRAY<STRUCT<"
        + _strings("jobTitle", "division", "jobFunction", "corporateTitle")
        + ", locations ARRAY<STRUCT<city STRING, state STRING, country STRING>>"
        + ", externalSource STRUCT<sourceId STRING>>>>>",
        items=lambda doc: _at(doc, "data.roleSearch.items"),
        total=lambda doc: _at(doc, "data.roleSearch.totalCount"),
        fields=_goldman_sachs,
    ),
    "epam": PayloadShape(
        schema="data STRUCT<total BIGINT, jobs ARRAY<STRUCT<"
        + _strings("name", "description", "vacancy_type")
        + ", city ARRAY<STRUCT<name STRING, state STRUCT<name STRING>>>"
        + ", country ARRAY<STRUCT<name STRING>>, seo STRUCT<url STRING>>>>",
        items=lambda doc: _at(doc, "data.jobs"),
        total=lambda doc: _at(doc, "data.total"),
        fields=_epam,
    ),
    "apple": PayloadShape(
        schema=f"res STRUCT<totalRecords BIGINT, searchResults ARRAY<{_APPLE_JOB}>>"
        f", totalRecords BIGINT, searchResults ARRAY<{_APPLE_JOB}>",
        items=lambda doc: F.when(
            doc["res"].isNotNull(), _at(doc, "res.searchResults")
        ).otherwise(doc["searchResults"]),
        total=lambda doc: F.when(
            doc["res"].isNotNull(), _at(doc, "res.totalRecords")
        ).otherwise(doc["totalRecords"]),
        fields=_apple,
    ),
}


def _by_provider(branch: Callable[[str, PayloadShape], Column]) -> Column:
    """The branch of the row's own provider; the others are not evaluated."""
    (first, shape), *rest = SHAPES.items()
    chosen = F.when(F.col("provider") == first, branch(first, shape))
    for name, shape in rest:
        chosen = chosen.when(F.col("provider") == name, branch(name, shape))
    return chosen


#: Error of a page whose body is no JSON.
UNREADABLE = "response is no JSON"


def page_stats(payloads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per landed page: jobs left after the shape's own row filter, and the
    total the site announced.  Input of the page cut-off; one scan.

    A fetched body that is no JSON is a failed page.  Only bodies that showed
    neither jobs nor a total are looked at for that.
    """

    def numbers(_: str, shape: PayloadShape) -> Column:
        return once(
            shape.parse(F.col("body")),
            lambda doc: F.struct(
                F.coalesce(F.array_size(shape.kept(doc)), F.lit(0)).cast("bigint").alias("n_jobs"),
                shape.total(doc).alias("total"),
            ),
        )

    return (
        payloads.filter(F.col("provider").isin(*SHAPES))
        .withColumn("_page", _by_provider(numbers))
        .withColumn("_fetched", F.coalesce("success", F.lit(False)))
        .withColumn(
            "_unreadable",
            F.when(
                F.col("_fetched")
                & (F.coalesce("_page.n_jobs", F.lit(0)) == 0)
                & (F.coalesce("_page.total", F.lit(0)) == 0),
                F.try_parse_json("body").isNull(),
            ).otherwise(F.lit(False)),
        )
        .select(
            *(keys or ["source"]),
            "provider",
            "page_no",
            (F.col("_fetched") & ~F.col("_unreadable")).alias("success"),
            F.when(F.col("_unreadable"), F.lit(UNREADABLE)).otherwise(F.col("error")).alias("error"),
            F.coalesce("_page.n_jobs", F.lit(0)).cast("bigint").alias("n_jobs"),
            "_page.total",
        )
    )


_ORDINALS = ["provider", "src_idx", "page_no", "item_no"]


def _posting_columns(fields: dict[str, Column]) -> list[Column]:
    ordinals = [F.col(name).cast("bigint").alias(name) for name in _ORDINALS[1:]]
    return [*[fields[name].alias(name) for name in POSTING_FIELDS], F.col("provider"), *ordinals]


def flatten(payloads: DataFrame, provider: str, as_of=None) -> DataFrame:
    """Postings of one provider.

    ``payloads`` has source, src_idx, page_no, provider, body, base_url and
    site_number (see :func:`attach_sources`).  ``as_of`` is needed by the
    shapes that only state an age (workday) or test it (greenhouse).
    """
    shape = SHAPES[provider]
    rows = (
        payloads.filter(F.col("provider") == provider)
        .withColumn("doc", shape.parse(F.col("body")))
        .select(
            "source", "provider", "src_idx", "page_no", "base_url", "site_number",
            # Outer: else the optimizer adds a test of the array's size below,
            # and a body that is the array itself is parsed again for it.
            F.posexplode_outer(shape.items(F.col("doc"))).alias("item_no", "job"),
        )
        .filter("item_no IS NOT NULL")
    )
    if shape.keep is not None:
        rows = rows.filter(shape.keep(F.col("job")))
    fields = shape.fields(F.col("job"), as_of)
    return rows.select(*_posting_columns({**fields, "source": F.col("source")}))


def flatten_all(payloads: DataFrame, as_of, *carried: str) -> DataFrame:
    """Postings of all providers in one scan, whatever the file layout.

    Each row is parsed with its own provider's schema only.  The array of a
    page is turned into postings inside the row and exploded afterwards.
    ``carried`` names further columns of the landed page to keep.
    """

    def postings(_: str, shape: PayloadShape) -> Column:
        def posting(job: Column, item_no: Column) -> Column:
            fields = shape.fields(job, as_of)
            keep = F.lit(True) if shape.keep is None else shape.keep(job)
            return F.struct(
                item_no.cast("bigint").alias("item_no"),
                keep.alias("keep"),
                *[fields[name].alias(name) for name in POSTING_FIELDS if name != "source"],
            )

        return F.transform(shape.items(shape.parse(F.col("body"))), posting)

    rows = payloads.filter(F.col("provider").isin(*SHAPES)).select(
        "source", "provider", "src_idx", "page_no", *carried,
        F.explode(_by_provider(postings)).alias("job"),
    )
    fields = {name: F.col(f"job.{name}") for name in POSTING_FIELDS if name != "source"}
    return (
        rows.filter("job.keep")
        .withColumn("item_no", F.col("job.item_no"))
        .select(*_posting_columns({**fields, "source": F.col("source")}), *carried)
    )


def attach_sources(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Add provider, src_idx and link bases from the routed catalog.

    No broadcast hint: the optimizer broadcasts the catalog when its size is
    known to be small, and joins by shuffle otherwise.
    """
    details = sources.filter(F.col("provider").isNotNull()).select(
        F.col("name").alias("source"), "src_idx", "provider", "base_url", "site_number"
    )
    known = [c for c in details.columns if c != "source" and c in payloads.columns]
    return payloads.drop(*known).join(details, "source")


# Sites read as cards; part of the address -> link base.
CARD_SITES = [
    ("google.com/about/careers", "https://www.google.com/about/careers/applications/"),
    ("metacareers.com", "https://www.metacareers.com"),
    ("careers.oracle.com", "https://careers.oracle.com"),
    ("paypal.eightfold.ai", "https://paypal.eightfold.ai"),
]


def flatten_cards(cards: DataFrame, sources: DataFrame, *carried: str) -> DataFrame:
    """Browser cards -> postings; cards of an unknown site give no rows.

    Cards that tell their ``src_idx`` are joined by it, others by name.
    ``carried`` names further columns of the cards to keep.
    """
    base = F.lit(None).cast("string")
    for part, link_base in reversed(CARD_SITES):
        base = F.when(F.col("site_url").contains(part), F.lit(link_base)).otherwise(base)
    sites = (
        sources.filter(F.col("provider") == "browser")
        .select(F.col("name").alias("source"), "src_idx", F.col("url").alias("site_url"))
        .select("source", "src_idx", base.alias("base_url"))
        .filter(F.col("base_url").isNotNull())
    )
    by = "src_idx" if "src_idx" in cards.columns else "source"
    other = "source" if by == "src_idx" else "src_idx"
    joined = cards.drop(other).filter(filled(F.col("title"))).join(sites, by)
    link = or_empty(F.col("url"))
    absolute = F.concat(
        F.rtrim(F.col("base_url"), F.lit("/")), F.lit("/"), F.ltrim(link, F.lit("/"))
    )
    return joined.select(
        strip(F.col("title")).alias("title"),
        strip(_company()).alias("company"),
        strip(or_empty(F.col("location"))).alias("location"),
        F.when((link == "") | link.startswith("http"), link).otherwise(absolute).alias("url"),
        F.lit("").alias("description"),
        F.lit("").alias("date_posted"),
        "source",
        F.lit(FULL_TIME).alias("job_type"),
        F.lit("browser").alias("provider"),
        F.col("src_idx").cast("bigint").alias("src_idx"),
        F.lit(1).cast("bigint").alias("page_no"),
        F.col("item_no").cast("bigint").alias("item_no"),
        *carried,
    )


def union_postings(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)
