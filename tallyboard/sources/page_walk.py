"""A scan's pages in the order of their links, whatever the order in which they landed.

The next page of each page is a pointer. Pointers are doubled: knowing for each page the one 2^k
links on, the pages known to be reached give as many more, so a walk of n pages takes about log2 n
rounds of joins over all scans at once, however long it is. A page that the walk comes back to keeps
its first place, which ends the walk as the guard of a scan does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables


def walk(pages: DataFrame, starts: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(scan_id, url, at): the places, from 0, of the pages that each scan reaches, landed or not.

    ``pages`` has scan_id, url, next_url and page_no; of pages of one address the one with the lowest
    page_no counts. ``starts`` has scan_id and url. Null scans and addresses are left out.
    A walk goes on to its end unless ``most_pages`` is given.
    """
    first = pages.filter("scan_id IS NOT NULL AND url IS NOT NULL").groupBy("scan_id", "url").agg(F.min_by("next_url", "page_no").alias("to"))
    tables = Tables(pages.sparkSession, "walk")
    jump = tables.write(first.filter("to IS NOT NULL"))
    reached = tables.write(starts.filter("scan_id IS NOT NULL AND url IS NOT NULL").select("scan_id", "url").distinct().withColumn("at", F.lit(0)))
    step, n = 1, reached.count()
    while most_pages is None or step < most_pages:
        more = reached.join(jump, ["scan_id", "url"]).select("scan_id", F.col("to").alias("url"), (F.col("at") + step).alias("at"))
        if most_pages is not None:
            more = more.filter(F.col("at") < most_pages)
        known = tables.write(reached.unionByName(more).groupBy("scan_id", "url").agg(F.min("at").alias("at")))
        before, n = n, known.count()
        if n == before:
            break
        onward = jump.select("scan_id", F.col("url").alias("to"), F.col("to").alias("further"))
        reached, jump = known, tables.write(jump.join(onward, ["scan_id", "to"]).select("scan_id", "url", F.col("further").alias("to")))
        step *= 2
    return reached


def outcomes(pages: DataFrame, walked: DataFrame) -> DataFrame:
    """(scan_id, status, stopped_at, n_pages): how each scan ended: read, loginRequired or failed.

    ``pages`` has login (a sign-in page) and ok (it loaded). The first page in the walk that is a
    sign-in page or did not load, or never landed, ends the scan without any ticket; the first page
    of a scan is always there, so only sign-in ends it. ``n_pages`` counts up to there.
    """
    page = pages.groupBy(F.col("scan_id").alias("p_scan"), F.col("url").alias("p_url")).agg(F.min_by(F.struct("login", "ok"), "page_no").alias("p"))
    d = walked.join(page, (F.col("scan_id") == F.col("p_scan")) & (F.col("url") == F.col("p_url")), "left")
    failed = (F.col("at") > 0) & (F.col("p").isNull() | ~F.coalesce("p.ok", F.lit(True)))
    why = F.when(failed, "failed").when(F.coalesce("p.login", F.lit(False)), "loginRequired")
    stop = F.min(F.when(why.isNotNull(), F.struct("at", why.alias("why")))).alias("stop")
    return d.groupBy("scan_id").agg(stop, F.count("*").alias("n")).select("scan_id", F.coalesce("stop.why", F.lit("read")).alias("status"), F.col("stop.at").alias("stopped_at"), F.coalesce(F.col("stop.at").cast("long"), "n").alias("n_pages"))


def scan_rows(pages: DataFrame, walked: DataFrame, ended: DataFrame) -> DataFrame:
    """(scan_id, at, row fields): the tickets of scans that were read, each id where it came first.

    Rows without id or subject are left out.
    """
    read = ended.filter("status = 'read'").select("scan_id")
    page = pages.groupBy("scan_id", "url").agg(F.min_by("rows", "page_no").alias("rows"))
    d = walked.join(read, "scan_id", "left_semi").join(page, ["scan_id", "url"])
    rows = d.select("scan_id", "at", F.posexplode("rows").alias("pos", "r")).filter("r.id <> 0 AND r.subject <> ''")
    nth = F.row_number().over(Window.partitionBy("scan_id", "r.id").orderBy("at", "pos"))
    return rows.withColumn("nth", nth).filter("nth = 1").select("scan_id", "at", "r.*")
