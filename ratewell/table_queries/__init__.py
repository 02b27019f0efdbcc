"""Every operator as a query on the driver's tables, each next to the SQL that checks it.

The tables stand in for assays: events are reads, lineitem holds standards, an
embedding holds the wells of one read, a conversation is a sheet of sections.
"""

from ratewell.table_queries import calibration, curves, files, layout, rates, reports, sections, whole_assays

QUERIES = {
    **rates.QUERIES, **calibration.QUERIES, **layout.QUERIES, **curves.QUERIES,
    **sections.QUERIES, **reports.QUERIES, **whole_assays.QUERIES, **files.QUERIES,
}
