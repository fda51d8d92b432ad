"""hirelake: job-postings data as Spark tables.

Landed job-board payloads, career pages and model responses go in; cleaned
postings, novelty flags and report tables come out.  Every operator is a
``DataFrame -> DataFrame`` function that takes an explicit ``as_of`` time.
"""
