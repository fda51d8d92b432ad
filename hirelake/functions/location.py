"""Is a location text in the United States (or not clearly elsewhere)?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import strip

# Codes of the 50 states and the capital district.
STATE_CODES = [
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA",
    "ID", "IL", "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS",
    "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
]

# Whole texts that are kept without looking further.
OPEN_LOCATIONS = ["", "not specified", "remote", "united states", "us", "usa"]

# Words that mark a location as foreign, wherever they occur.
FOREIGN_WORDS = [
    "united kingdom", "uk", "england", "scotland", "wales",
    "canada", "ontario", "british columbia", "quebec", "alberta",
    "india", "bangalore", "hyderabad", "mumbai", "delhi", "pune", "chennai",
    "australia", "sydney", "melbourne",
    "germany", "berlin", "munich",
    "france", "paris",
    "netherlands", "amsterdam",
    "ireland", "dublin",
    "singapore",
    "japan", "tokyo",
    "china", "beijing", "shanghai",
    "brazil", "são paulo",
    "mexico",
    "poland", "warsaw",
    "sweden", "stockholm",
    "switzerland", "zurich",
    "spain", "madrid",
    "italy", "milan", "rome",
    "israel", "tel aviv",
]

_FOREIGN_PATTERN = "|".join(FOREIGN_WORDS)


def is_us_location(location: Column) -> Column:
    """False only for a foreign word that no sign of the United States outweighs.

    All word tests are plain substring tests.  The foreign words come first in
    the condition: for most rows it is the only part that is evaluated.
    """
    lowered = F.lower(location)
    code = F.upper(strip(F.substring_index(location, ",", -1)))
    names_country = lowered.contains("united states")
    outweighed = (
        names_country
        | lowered.contains(", us")
        | (lowered.contains("remote") & lowered.contains("us"))
        | (location.contains(",") & code.isin(STATE_CODES))
        | strip(lowered).isin(OPEN_LOCATIONS)
    )
    return F.coalesce(~(lowered.rlike(_FOREIGN_PATTERN) & ~outweighed), F.lit(True))
