"""Registered queries: cleaning and novelty, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions.location import is_us_location
from hirelake.operators import cleaning, novelty
from hirelake.plans.views import AS_OF, CYCLES, POSTINGS, WIDE_AGE, Inputs
from hirelake.schema import POSTING_FIELDS

FIELDS = ", ".join(POSTING_FIELDS)
_BLANKS = "' ' || chr(9)"
# The check's own lists, not the operator's.
_WORDS = """
    ('alberta'), ('amsterdam'), ('australia'), ('bangalore'), ('beijing'), ('berlin'),
    ('brazil'), ('british columbia'), ('canada'), ('chennai'), ('china'), ('delhi'),
    ('dublin'), ('england'), ('france'), ('germany'), ('hyderabad'), ('india'), ('ireland'),
    ('israel'), ('italy'), ('japan'), ('madrid'), ('melbourne'), ('mexico'), ('milan'),
    ('mumbai'), ('munich'), ('netherlands'), ('ontario'), ('paris'), ('poland'), ('pune'),
    ('quebec'), ('rome'), ('scotland'), ('shanghai'), ('singapore'), ('spain'), ('stockholm'),
    ('sweden'), ('switzerland'), ('sydney'), ('são paulo'), ('tel aviv'), ('tokyo'), ('uk'),
    ('united kingdom'), ('wales'), ('warsaw'), ('zurich')"""
_STATES = """
    'AK', 'AL', 'AR', 'AZ', 'CA', 'CO', 'CT', 'DC', 'DE', 'FL', 'GA', 'HI', 'IA', 'ID', 'IL',
    'IN', 'KS', 'KY', 'LA', 'MA', 'MD', 'ME', 'MI', 'MN', 'MO', 'MS', 'MT', 'NC', 'ND', 'NE',
    'NH', 'NJ', 'NM', 'NV', 'NY', 'OH', 'OK', 'OR', 'PA', 'RI', 'SC', 'SD', 'TN', 'TX', 'UT',
    'VA', 'VT', 'WA', 'WI', 'WV', 'WY'"""

SQL_US = f"""
CASE WHEN coalesce(location, '') = '' THEN true
     WHEN lower(trim(location)) IN ('not specified', 'remote', 'united states', 'us', 'usa') THEN true
     WHEN location ILIKE '%remote%' AND (location ILIKE '%us%' OR location ILIKE '%united states%')
       THEN true
     WHEN strpos(location, ',') > 0 AND upper(trim(string_split(location, ',')[-1])) IN ({_STATES})
       THEN true
     WHEN location ILIKE '%united states%' OR location ILIKE '%, us%' THEN true
     WHEN EXISTS (SELECT 1 FROM (VALUES {_WORDS}) AS w(word)
                  WHERE contains(lower(location), word)) THEN false
     ELSE true END"""

SQL_INSTANT = """
CASE WHEN date_posted LIKE '%+0000' THEN try_strptime(date_posted, '%Y-%m-%dT%H:%M:%S+0000')
     WHEN date_posted LIKE '%Z' THEN try_strptime(date_posted, '%Y-%m-%dT%H:%M:%SZ')
     WHEN date_posted LIKE '%-05:00'
       THEN try_strptime(left(date_posted, 19), '%Y-%m-%dT%H:%M:%S') + INTERVAL 5 HOUR END"""


def sql_tested(days: int) -> str:
    """WITH-clauses up to ``tested``: postings, key and first failing test."""
    return f"""
postings AS ({POSTINGS}),
us AS (SELECT location, {SQL_US} AS is_us FROM (SELECT DISTINCT location FROM postings) AS d),
tested AS (
  SELECT p.*,
    lower(trim(title, {_BLANKS})) || '|' || lower(trim(company, {_BLANKS})) || '|'
      || lower(trim(coalesce(p.location, ''), {_BLANKS})) AS dedup_key,
    CASE WHEN trim(title, {_BLANKS}) = '' THEN 'title'
         WHEN {SQL_INSTANT} < TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY THEN 'date'
         WHEN NOT is_us THEN 'location' END AS reason
  FROM postings AS p JOIN us ON p.location IS NOT DISTINCT FROM us.location)"""


def sql_final(days: int = WIDE_AGE) -> str:
    return f"""{sql_tested(days)},
final AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dedup_key
                                 ORDER BY src_idx, page_no, item_no, url) AS rn
    FROM tested WHERE reason IS NULL) AS ranked
  WHERE rn = 1)"""


def final_postings(inputs: Inputs):
    return cleaning.clean_postings(inputs.postings(), AS_OF, WIDE_AGE)


# History and batch for the novelty queries: what was fetched before 2000.
SPLIT = "2000-01-01"


def seen_and_batch(inputs: Inputs):
    keyed = cleaning.with_key(inputs.postings())
    history = keyed.filter(F.col("fetched_at") < F.lit(SPLIT).cast("timestamp"))
    batch = keyed.filter(F.col("fetched_at") >= F.lit(SPLIT).cast("timestamp"))
    return history.select("dedup_key").distinct(), batch


SQL_SEEN = f"""{sql_tested(WIDE_AGE)},
seen AS (SELECT DISTINCT dedup_key FROM tested WHERE fetched_at < TIMESTAMP '{SPLIT} 00:00:00'),
batch AS (SELECT * FROM tested WHERE fetched_at >= TIMESTAMP '{SPLIT} 00:00:00')"""


def mark_seen(inputs: Inputs):
    seen, batch = seen_and_batch(inputs)
    fresh = novelty.fresh_seen_rows(batch, seen, AS_OF, 7)
    return fresh.withColumn("first_seen_at", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss"))


def new_rows(inputs: Inputs):
    seen, batch = seen_and_batch(inputs)
    return novelty.new_rows(batch, seen).select("dedup_key", "title", "company", "url")


def new_final(inputs: Inputs):
    seen, batch = seen_and_batch(inputs)
    new_keys = novelty.fresh_seen_rows(batch, seen, AS_OF, 7)
    return novelty.keep_new(final_postings(inputs), new_keys).select("dedup_key", *POSTING_FIELDS)


def seen_reset(inputs: Inputs):
    seen, _ = seen_and_batch(inputs)

    def counted(state, keys):
        return keys.agg(F.lit(state).alias("state"), F.count(F.lit(1)).alias("n_keys"))

    return counted("before", seen).unionByName(counted("after", novelty.emptied(seen)))


QUERIES = {
    "clean_postings": (
        lambda i: final_postings(i).select(*POSTING_FIELDS, "dedup_key"),
        f"WITH {sql_final()} SELECT {FIELDS}, dedup_key FROM final",
    ),
    "clean_postings_two_days": (
        lambda i: cleaning.clean_postings(i.postings(), AS_OF).select(*POSTING_FIELDS, "dedup_key"),
        f"WITH {sql_final(2)} SELECT {FIELDS}, dedup_key FROM final",
    ),
    "dedup_stages": (
        lambda i: cleaning.stage_counts(i.postings(), AS_OF, WIDE_AGE),
        f"""WITH {sql_tested(WIDE_AGE)}
        SELECT coalesce(reason, 'passed') AS outcome, count(*) AS n_rows FROM tested GROUP BY 1""",
    ),
    "age_filter": (
        lambda i: i.postings()
        .groupBy(
            "date_posted",
            cleaning.is_too_old(AS_OF).alias("dropped_2"),
            cleaning.is_too_old(AS_OF, WIDE_AGE).alias("dropped_365"),
        )
        .agg(F.count(F.lit(1)).alias("n_rows")),
        f"""WITH postings AS ({POSTINGS}),
        dated AS (SELECT date_posted, {SQL_INSTANT} AS posted FROM postings)
        SELECT date_posted,
          coalesce(posted < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY, false) AS dropped_2,
          coalesce(posted < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY, false) AS dropped_365,
          count(*) AS n_rows
        FROM dated GROUP BY ALL""",
    ),
    "us_location": (
        lambda i: i.postings()
        .groupBy("location", is_us_location(F.col("location")).alias("is_us"))
        .agg(F.count(F.lit(1)).alias("n_rows")),
        f"""WITH postings AS ({POSTINGS}),
        counted AS (SELECT location, count(*) AS n_rows FROM postings GROUP BY location)
        SELECT location, {SQL_US} AS is_us, n_rows FROM counted""",
    ),
    "dedup_key": (
        lambda i: cleaning.with_key(i.postings())
        .groupBy("dedup_key")
        .agg(F.count(F.lit(1)).alias("n_rows")),
        f"""WITH {sql_tested(WIDE_AGE)}
        SELECT dedup_key, count(*) AS n_rows FROM tested GROUP BY dedup_key""",
    ),
    "dedup_first": (
        lambda i: cleaning.first_wins(cleaning.with_key(i.postings())).select(
            "dedup_key", *POSTING_FIELDS
        ),
        f"""WITH {sql_tested(WIDE_AGE)}
        SELECT DISTINCT ON (dedup_key) dedup_key, {FIELDS} FROM tested
        ORDER BY dedup_key, src_idx, page_no, item_no, url""",
    ),
    "drop_counters": (
        lambda i: cleaning.drop_counters(i.postings(), AS_OF, WIDE_AGE),
        f"""WITH {sql_tested(WIDE_AGE)},
        counted AS (SELECT count(*) AS total,
          count(*) FILTER (reason = 'title') AS missing_title,
          count(*) FILTER (reason = 'date') AS filtered_by_date,
          count(*) FILTER (reason = 'location') AS filtered_by_location,
          count(DISTINCT dedup_key) FILTER (reason IS NULL) AS remaining FROM tested)
        SELECT *, total - remaining - filtered_by_date - filtered_by_location
          AS duplicates_removed FROM counted""",
    ),
    "mark_seen": (
        mark_seen,
        f"""WITH {SQL_SEEN},
        firsts AS (SELECT DISTINCT ON (dedup_key) * FROM batch
                   ORDER BY dedup_key, src_idx, page_no, item_no, url)
        SELECT dedup_key, title, company, url, '{AS_OF}' AS first_seen_at,
          CAST(7 AS bigint) AS run_id
        FROM firsts WHERE dedup_key NOT IN (SELECT dedup_key FROM seen)""",
    ),
    "new_rows": (
        new_rows,
        f"""WITH {SQL_SEEN}
        SELECT dedup_key, title, company, url FROM batch
        WHERE dedup_key NOT IN (SELECT dedup_key FROM seen)""",
    ),
    "new_final": (
        new_final,
        f"""WITH {sql_final()},
        new_keys AS (SELECT dedup_key FROM tested GROUP BY dedup_key
                     HAVING min(fetched_at) >= TIMESTAMP '{SPLIT} 00:00:00')
        SELECT dedup_key, {FIELDS} FROM final
        WHERE dedup_key IN (SELECT dedup_key FROM new_keys)""",
    ),
    "seen_count": (
        lambda i: novelty.seen_count(seen_and_batch(i)[0]),
        f"WITH {SQL_SEEN} SELECT count(*) AS seen_count FROM seen",
    ),
    "seen_reset": (
        seen_reset,
        f"""WITH {SQL_SEEN} SELECT 'before' AS state, count(*) AS n_keys FROM seen
        UNION ALL SELECT 'after', count(*) FROM seen WHERE false""",
    ),
    "cycle_new": (
        lambda i: novelty.cycle_new(i.cycles()).withColumn("cycle", F.col("cycle").cast("string")),
        f"""WITH cycles AS ({CYCLES}),
        firsts AS (SELECT dedup_key, min(cycle) AS cycle FROM cycles GROUP BY dedup_key)
        SELECT c.cycle::varchar AS cycle, count(DISTINCT c.dedup_key) AS n_keys,
          count(DISTINCT f.dedup_key) AS n_new
        FROM cycles AS c LEFT JOIN firsts AS f
          ON c.dedup_key = f.dedup_key AND c.cycle = f.cycle
        GROUP BY c.cycle""",
    ),
    "first_cycles": (
        lambda i: novelty.first_cycles(i.cycles()).withColumn(
            "cycle", F.col("cycle").cast("string")
        ),
        f"""WITH cycles AS ({CYCLES})
        SELECT dedup_key, min(cycle)::varchar AS cycle FROM cycles GROUP BY dedup_key""",
    ),
}
