"""Lines of streams that arrive in chunks cut anywhere.

A line may begin in one chunk and end many chunks later. Each chunk is split by itself; its inner lines
are whole. Its first and last pieces belong to lines that are numbered by how many chunks with a
line end come before: a running count, added up by blocks of chunks, so that no task goes
through a whole stream. The pieces of one such number, in order, are one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of a stream whose line ends one window counts.
BLOCK = 4096
#: What ends a line.
ENDS = "[\n\r\u000b\u000c\u0085\u2028\u2029]"


def lines(chunks: DataFrame, ended: bool = True) -> DataFrame:
    """(stream, seq, pos, line): the lines that are not empty, placed by the chunk in which they end.

    ``chunks`` has stream, seq (from 0 on, unique in a stream) and data. The rest behind the last line end is a line
    once the streams have ``ended``; its pos is that of the last piece. A null chunk is empty; null streams or numbers are left
    out; an empty table gives an empty one.
    """
    c = chunks.filter("stream IS NOT NULL AND seq IS NOT NULL").select("stream", F.col("seq").cast("long").alias("seq"), F.split(F.coalesce("data", F.lit("")), ENDS, -1).alias("parts"))
    c = c.withColumn("block", F.floor(F.col("seq") / BLOCK))
    cut = (F.size("parts") > 1).cast("long")
    totals = c.groupBy("stream", "block").agg(F.sum(cut).alias("n"))
    before = F.sum("n").over(Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("stream").alias("t_stream"), F.col("block").alias("t_block"), F.coalesce(before, F.lit(0)).alias("earlier"))
    running = F.sum(cut).over(Window.partitionBy("stream", "block").orderBy("seq"))
    d = c.withColumn("upto", running).join(totals, (F.col("stream") == F.col("t_stream")) & (F.col("block") == F.col("t_block")))
    d = d.withColumn("upto", F.col("upto") + F.col("earlier"))
    n = F.size("parts")
    # inner lines need no number, so they are not dealt out
    inner = c.filter(n > 2).select("stream", "seq", F.posexplode(F.slice("parts", 2, n - 2)).alias("pos", "line")).select("stream", "seq", (F.col("pos") + 1).alias("pos"), "line")
    head = F.struct((F.col("upto") - F.when(n > 1, 1).otherwise(0)).alias("number"), F.element_at("parts", 1).alias("piece"), F.lit(0).alias("pos"), (n > 1).alias("whole"))
    tail = F.struct(F.col("upto").alias("number"), F.element_at("parts", -1).alias("piece"), (n - 1).alias("pos"), F.lit(False).alias("whole"))
    pieces = d.select("stream", "seq", F.inline(F.when(n > 1, F.array(head, tail)).otherwise(F.array(head)))).filter("piece <> '' OR whole")
    joined = pieces.groupBy("stream", "number").agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "piece"))).alias("ps"), F.bool_or("whole").alias("whole"))
    joined = joined if ended else joined.filter("whole")
    last = F.element_at("ps", -1)
    made = joined.select("stream", last["seq"].alias("seq"), last["pos"].alias("pos"), F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("line"))
    return inner.unionByName(made).filter("line <> ''")
