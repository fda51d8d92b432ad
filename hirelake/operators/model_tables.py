"""Tables exchanged with an offline language model; the model is not called.

Requests and batches go out as rows, responses come back as rows and are
parsed, checked and put in place of (or next to) the originals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.position import in_chunks, ranged_position, running_position
from hirelake.functions.text import blank_to_null, filled, once, or_empty, strip
from hirelake.schema import POSTING_FIELDS

BATCH_SIZE = 3
#: Batches of up to so many rows are read off a window, each row's followers beside it.
WINDOW_BATCH = 32
POSTING_LIST = (
    "ARRAY<STRUCT<" + ", ".join(f"{name}: STRING" for name in POSTING_FIELDS) + ">>"
)

REQUEST_HEAD = "List every job posting on the page below."
REQUEST_TAIL = "Answer with a JSON array of objects and nothing else."


def extract_requests(contexts: DataFrame, flattened: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pages that need a model: those of sources without flattened rows.

    ``contexts`` has source, url and context.  A page without text gives an
    error instead of a request.  ``keys`` tell sources apart: by default their names.
    """
    by = keys or ["source"]
    done = flattened.select(*by).distinct()
    request = F.concat(
        F.lit(REQUEST_HEAD + "\nSource: "), F.col("source"),
        F.lit("\nSource URL: "), or_empty(F.col("url")),
        F.lit("\n\nContent:\n"), F.col("context"),
        F.lit("\n\n" + REQUEST_TAIL),
    )
    has_text = filled(F.col("context"))
    return contexts.join(done, by, "left_anti").select(
        *(keys or []),
        "source",
        "url",
        F.when(has_text, request).alias("request"),
        F.when(
            ~has_text, F.concat(F.lit("No text content to parse for "), F.col("source"))
        ).alias("error"),
    )


def bypasses_model(page_type: Column, skip_normalization: bool = False) -> Column:
    """API rows, and all rows in skip mode, are not sent for normalization."""
    return F.lit(skip_normalization) | (page_type == "api")


def with_bypass(
    postings: DataFrame, sources: DataFrame, skip_normalization: bool = False
) -> DataFrame:
    """Add ``bypass``: whether a row passes normalization unchanged."""
    types = sources.select(F.col("name").alias("source"), F.col("type").alias("_type"))
    bypass = bypasses_model(F.coalesce("_type", F.lit("career_page")), skip_normalization)
    return postings.join(types, "source", "left").withColumn("bypass", bypass).drop("_type")


def model_batches(
    postings: DataFrame,
    chunk: Column | None,
    order_by: list[str],
    size: int = BATCH_SIZE,
    keys: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Consecutive groups of ``size`` rows per source, in input order.

    Positions come from :func:`running_position`, or where the caller knows no
    chunk from :func:`ranged_position`, so a source with a third of all rows is
    numbered by many tasks; a group never has more than ``size``.  ``keys`` tell
    sources apart: by default their names.  With a chunk, whole rows are shuffled
    once: a batch is put together where its rows are numbered.  They go as the text
    that a batch sends, which is shorter than a row.  With ``tasks`` and a chunk the
    batches have ``place``, by which they lie in so many tasks.
    """
    keys = keys or ["source"]
    if chunk is not None and size <= WINDOW_BATCH:
        members = _batches_in_chunks(postings, chunk, order_by, size, keys, tasks)
        return members.select(
            *keys,
            "batch_id",
            F.size("members").cast("bigint").alias("n"),
            F.concat(F.lit("["), F.array_join("members", ","), F.lit("]")).alias("jobs_json"),
            *(["place"] if tasks else []),
        )
    else:
        if chunk is None:
            numbered = ranged_position(postings, keys, order_by)
        else:
            numbered = running_position(postings, keys, order_by, chunk)
        record = F.struct("position", F.struct(*POSTING_FIELDS).alias("job"))
        members = (
            numbered.withColumn("batch_id", F.floor(F.col("position") / size))
            .groupBy(*keys, "batch_id")
            .agg(F.array_sort(F.collect_list(record)).alias("members"))
            .select(*keys, "batch_id", F.transform("members", lambda m: m["job"]).alias("members"))
        )
    return members.select(
        *keys,
        "batch_id",
        F.size("members").cast("bigint").alias("n"),
        _sent("members").alias("jobs_json"),
    )


def _sent(jobs: Column | str) -> Column:
    return F.to_json(jobs, {"ignoreNullFields": "false"})


def _batches_in_chunks(
    postings: DataFrame, chunk: Column, order_by: list[str], size: int, keys: list[str], tasks: int | None
) -> DataFrame:
    """``keys``, ``batch_id``, ``members`` (texts) and ``place`` of batches of up to WINDOW_BATCH rows.

    The first row of a batch finds the others behind it in its chunk.  Only what a
    chunk's end cuts off, less than ``size`` rows on either side, meets again by batch,
    in the place of the first of them.
    """
    jobs = postings.withColumn("_job", _sent(F.struct(*POSTING_FIELDS)))
    rows, inside = in_chunks(jobs, keys, order_by, chunk, tasks)
    rows = rows.select("_group", "_offset", "_job", *order_by).withColumn("_row", F.row_number().over(inside))
    position = F.col("_offset") + F.col("_row") - 1
    slot = F.col("_slot")
    rows = rows.withColumns({"batch_id": F.floor(position / size), "_slot": position % size})
    # A row is carried to its place in a batch only: elsewhere the follower is NULL.
    behind = {f"_{n}": F.lead(F.when(slot == n, F.col("_job")), n).over(inside) for n in range(1, size)}
    pieces = (
        rows.withColumns(behind)
        .filter((slot == 0) | (F.col("_row") <= slot))
        .select(
            *(F.col("_group")[key].alias(key) for key in keys),
            F.col("_group").alias("place"),
            "batch_id",
            "_slot",
            F.array_compact(F.array("_job", *behind)).alias("members"),
        )
    )
    whole = F.size("members") == size
    piece = F.struct("_slot", "members")
    cut = (
        pieces.filter(~whole)
        .groupBy(*keys, "batch_id")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.min("place").alias("place"))
    )
    met = cut.withColumn("members", F.flatten(F.transform("pieces", lambda p: p["members"]))).drop("pieces")
    if tasks:
        met = met.repartition(tasks, "place")
    return pieces.filter(whole).drop("_slot").unionByName(met)


def json_in_response(text: Column) -> Column:
    """The JSON part of a response: inside the last fence marked json, else
    inside the first pair of fences, then from the first [ to the last ]."""

    def unfenced(t: Column) -> Column:
        marked = F.substring_index(F.substring_index(t, "```json", -1), "```", 1)
        fenced = F.split_part(t, F.lit("```"), F.lit(2))
        return (
            F.when(t.contains("```json"), strip(marked))
            .when(t.contains("```"), strip(fenced))
            .otherwise(t)
        )

    def array_or_all(inner: Column) -> Column:
        return once(
            F.regexp_extract(inner, r"(?s)\[.*\]", 0),
            lambda array: F.when(array != "", array).otherwise(inner),
        )

    return once(once(strip(or_empty(text)), unfenced), array_or_all)


def answer_elements(text: Column) -> Column:
    """Response text -> the elements of its list, each a variant; a lone object is
    a list of one.  NULL for anything else.

    The text is parsed once, as the one element of a list in an object with an
    end mark behind it: parsers stop after the first value, and only a single
    complete value leaves the mark where it is.
    """

    def read(payload: Column) -> Column:
        document = F.try_parse_json(F.concat(F.lit('{"v":['), payload, F.lit('],"end":0}')))

        def elements(d: Column) -> Column:
            alone = (F.try_variant_get(d, "$.end", "int") == 0) & F.try_variant_get(d, "$.v[1]", "variant").isNull()
            several = F.try_variant_get(d, "$.v[0]", "array<variant>")
            one = F.array(F.try_variant_get(d, "$.v[0]", "variant"))
            first = F.ltrim(payload).startswith("{")
            return F.when(alone, F.when(first, one).otherwise(several))

        return once(document, elements)

    return once(json_in_response(text), read)


def is_record(element: Column) -> Column:
    """Whether a variant is an object: only such is read as a struct, whatever its fields."""
    read = F.try_variant_get(element, "$", "struct<title variant>")
    return F.when(element.isNotNull(), read.isNotNull())


def _posting_of(element: Column) -> Column:
    fields = [F.try_variant_get(element, f"$.{name}", "string").alias(name) for name in POSTING_FIELDS]
    return F.when(is_record(element), F.struct(*fields))


def parsed_list(text: Column) -> Column:
    """Response text -> array of postings, NULL where an element is no object.
    NULL for anything but a list or an object."""
    return F.transform(answer_elements(text), _posting_of)


def answer_quality(responses: DataFrame) -> DataFrame:
    """Per answer: whether it is readable, its good records and its stray elements."""
    read = F.transform(answer_elements(F.col("text")), is_record)
    return responses.withColumn("_read", read).select(
        *[c for c in responses.columns if c not in ("text", "error")],
        F.col("_read").isNotNull().alias("readable"),
        F.coalesce(F.size(F.filter("_read", lambda x: x)), F.lit(0)).alias("records"),
        F.coalesce(F.size(F.filter("_read", lambda x: ~x)), F.lit(0)).alias("strays"),
    )


def parse_responses(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Extraction responses -> postings with source and address filled in.

    Elements that are no objects are left out (see :func:`answer_quality`).
    """
    addresses = sources.select(F.col("name").alias("source"), F.col("url").alias("site_url"))
    rows = (
        responses.select("source", "batch_id", F.posexplode(parsed_list(F.col("text"))).alias("item_no", "job"))
        .filter(F.col("job").isNotNull())
        .join(addresses, "source", "left")
    )
    fields = {name: F.col(f"job.{name}") for name in POSTING_FIELDS}
    fields["source"] = F.col("source")
    fields["url"] = F.coalesce(
        blank_to_null(F.col("job.url")), blank_to_null(F.col("site_url")), F.col("job.url")
    )
    return rows.select(
        *[fields[name].alias(name) for name in POSTING_FIELDS],
        "batch_id",
        F.col("item_no").cast("bigint").alias("item_no"),
    )


def apply_responses(batches: DataFrame, responses: DataFrame, place: str | None = None) -> DataFrame:
    """Normalized rows of each batch, its own rows where the response is
    missing, failed or unreadable.  An empty list is an answer: no rows.
    Elements of an answer that are no objects are left out.  ``place`` is a column
    of both that follows from the batch, where both lie in order of it."""
    by = ["source", "batch_id", *([place] if place else [])]
    answers = responses.select(
        *by,
        F.when(~filled(F.col("error")), parsed_list(F.col("text"))).alias("parsed"),
    )
    jobs = F.coalesce("parsed", F.from_json("jobs_json", POSTING_LIST))
    rows = batches.join(answers, by, "left").select(
        F.col("source").alias("from_source"), "batch_id", F.posexplode(jobs).alias("item_no", "job")
    )
    rows = rows.filter(F.col("job").isNotNull())
    fields = {name: F.col(f"job.{name}") for name in POSTING_FIELDS}
    fields["source"] = F.coalesce("job.source", "from_source")
    fields["job_type"] = or_empty(F.col("job.job_type"))
    return rows.select(
        *[fields[name].alias(name) for name in POSTING_FIELDS],
        "batch_id",
        F.col("item_no").cast("bigint").alias("item_no"),
    )


def record_checks(document: Column) -> Column:
    """Whether a record, a variant, has the right types.

    ``source`` and ``job_type`` get their defaults before types are checked.
    """

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))

    def is_text(name: str) -> Column:
        return F.coalesce(kind(name) == "STRING", F.lit(False))

    def absent_or_text(name: str, *also: str) -> Column:
        return F.coalesce(kind(name).isin("STRING", *also), F.lit(True))

    valid = is_text("title") & is_text("company") & absent_or_text("date_posted", "VOID")
    for name in ("location", "url", "description", "source", "job_type"):
        valid = valid & absent_or_text(name)
    return valid


def validate(records: DataFrame, source: Column, json: str = "record") -> DataFrame:
    """One JSON object per row -> the eight fields with defaults, and whether
    the record has the right types.  Invalid rows are kept."""
    document = F.try_parse_json(F.col(json))

    def text(name: str) -> Column:
        return F.try_variant_get(document, f"$.{name}", "string")

    def absent(name: str) -> Column:
        return F.try_variant_get(document, f"$.{name}", "variant").isNull()

    fields = {name: text(name) for name in POSTING_FIELDS}
    fields["source"] = F.when(absent("source"), source).otherwise(text("source"))
    fields["job_type"] = F.when(absent("job_type"), F.lit("")).otherwise(text("job_type"))
    return records.select(
        *[c for c in records.columns if c not in POSTING_FIELDS],
        *[fields[name].alias(name) for name in POSTING_FIELDS],
        record_checks(document).alias("is_valid"),
    )


def api_or_model(flattened: DataFrame, parsed: DataFrame, *keys: str) -> DataFrame:
    """Flattened rows, and parsed rows of the sources that have none.

    ``keys`` tell sources apart: by default their names.
    """
    by = list(keys) or ["source"]
    done = flattened.select(*by).distinct()
    return flattened.unionByName(parsed.join(done, by, "left_anti"), allowMissingColumns=True)


# Place abbreviations, and words that tell the kind of work.
LOCATION_ALIASES = {"NYC": "New York, NY", "SF": "San Francisco, CA"}
JOB_TYPE_WORDS = [
    ("Internship", r"(?i)\bintern(ship)?s?\b"),
    ("Part-time", r"(?i)\bpart[- ]time\b"),
    ("Contract", r"(?i)\bcontract(or)?\b"),
    ("Full-time", r"(?i)\bfull[- ]time\b"),
]
_TWO_SENTENCES = r"(?s)^((?:.*?[.!?](?=\s|$)){2}).*$"


def _headline_case(text: Column) -> Column:
    """Capitalize words where the text is in one case only; a single upper-case
    word of up to five letters is a short name and stays."""
    one_case = (text == F.upper(text)) | (text == F.lower(text))
    short_name = text.rlike(r"^\p{Lu}{1,5}$")
    return F.when(one_case & ~short_name, F.initcap(text)).otherwise(text)


def normalize_rules(postings: DataFrame) -> DataFrame:
    """Rule-based stand-in for model normalization, deterministic and native."""
    place = strip(or_empty(F.col("location")))
    alias = F.lit(None).cast("string")
    for short, full in LOCATION_ALIASES.items():
        alias = F.when(F.upper(place) == short, F.lit(full)).otherwise(alias)
    title = strip(F.regexp_replace(or_empty(F.col("title")), r"(?U)\s+", " "))
    text = strip(or_empty(F.col("description")))
    words = F.concat_ws(" ", F.col("title"), F.col("description"))
    detected = F.lit("")
    for kind, pattern in reversed(JOB_TYPE_WORDS):
        detected = F.when(words.rlike(pattern), F.lit(kind)).otherwise(detected)
    changed = {
        "title": _headline_case(title),
        "company": _headline_case(strip(or_empty(F.col("company")))),
        "location": F.coalesce(alias, place),
        "description": F.regexp_replace(text, _TWO_SENTENCES, "$1"),
        "job_type": F.coalesce(blank_to_null(F.col("job_type")), detected),
    }
    return postings.withColumns(changed)
