"""Strict CSV read in blocks.

Whether a line begins inside a quoted value depends on all lines before it.  A
line is therefore a function of two states, outside (0) and inside (1) quotes,
found from the line alone.  Such functions compose: a line either sets the state,
turns it, or leaves it, so the state before a line is the last one set and the
turns since.  One scan does this over the lines of a block and one over the blocks
of a file, so no task holds more than a block, whatever the file's size.

A value is quoted if it begins with a quote; quotes elsewhere stand for
themselves.  After a closing quote only a comma or the end of the row may follow,
and the file may not end inside quotes: such files are malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

_BODY = r'[^"]*+(?:""[^"]*+)*+'
_VALUE = rf'(?:"{_BODY}"|[^",][^,]*+|)'
_ENDS_INSIDE = rf'\A(?:{_VALUE},)*+"{_BODY}\z'
_ENDS_OUTSIDE = rf"\A(?:{_VALUE},)*+{_VALUE}\z"
_VALUES = rf',(?:"{_BODY}"|[^,]*+)'
_WRONG = -1


def _body(piece: Column) -> Column:
    return F.rtrim(piece, F.lit("\r\n"))


def _end_state(line: Column) -> Column:
    return F.when(line.rlike(_ENDS_INSIDE), 1).when(line.rlike(_ENDS_OUTSIDE), 0).otherwise(_WRONG)


def _after(df: DataFrame, keys: list[str], order: list[str], from_outside: str, from_inside: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """df, and the states before and after each row, for each of the two states that the first row may begin in."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, ins = F.greatest(from_outside, F.lit(0)), F.greatest(from_inside, F.lit(0))
    df = df.withColumn("turns", F.sum(((out == 1) & (ins == 0)).cast("long")).over(so_far))
    df = df.withColumn("held", F.last(F.when(out == ins, (out + F.col("turns")) % 2), ignorenulls=True).over(so_far))
    after = [((F.coalesce("held", F.lit(c).cast("long")) + F.col("turns")) % 2).cast("int") for c in (0, 1)]
    before = [F.lag(a, 1, c).over(rows) for c, a in enumerate(after)]
    return df, before, after


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, part (their order), piece (a line with its end), empty, and the states that it leads to from outside and from inside.

    Lines end with a line feed, a carriage return or both.  A file whose lines
    end with carriage returns alone is one row to the reader.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("\n")).alias("value")
    )
    cuts = F.when(F.col("value").rlike(r"\r[^\n]"), F.split("value", r"(?<=\r)(?!\n)")).otherwise(F.array("value"))
    pieces = raw.select("file", "block", "at", F.posexplode(cuts).alias("part", "piece"))
    body, quoted = _body(F.col("piece")), F.col("piece").contains('"')
    return pieces.withColumns({
        "empty": body == "", "from_outside": F.when(quoted, _end_state(body)).otherwise(0), "from_inside": F.when(quoted, _end_state(F.concat(F.lit('"'), body))).otherwise(1),
        "unreadable": F.col("piece").contains("\0") | ~F.is_valid_utf8("piece"),
    })


def _placed(rows: DataFrame) -> DataFrame:
    """Lines with before, after, ends (a row that isn't empty) and rank (such rows before it in the block), each for a block that begins outside (0) or inside (1)."""
    order = ["at", "part"]
    rows, before, after = _after(rows, ["file", "block"], order, "from_outside", "from_inside")
    rows = rows.withColumns({f"before{c}": before[c] for c in (0, 1)} | {f"after{c}": after[c] for c in (0, 1)})
    ends = {f"ends{c}": ((F.col(f"after{c}") == 0) & ((F.col(f"before{c}") == 1) | ~F.col("empty"))).cast("long") for c in (0, 1)}
    earlier = Window.partitionBy("file", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns(ends).withColumns({f"rank{c}": F.coalesce(F.sum(f"ends{c}").over(earlier), F.lit(0)) for c in (0, 1)})


def blocks(rows: DataFrame) -> DataFrame:
    """file, block, begins (its state), first (rows of the file before it) and fault (malformed, unreadable or null); few rows, checkpointed."""
    wrong = [F.max(F.when(F.col(f"before{c}") == 0, F.col("from_outside")).otherwise(F.col("from_inside")) == _WRONG) for c in (0, 1)]
    each = [(F.max_by(f"after{c}", F.struct("at", "part")).alias(f"to{c}"), F.sum(f"ends{c}").alias(f"n{c}"), wrong[c].alias(f"wrong{c}")) for c in (0, 1)]
    found = cut(_placed(rows).groupBy("file", "block").agg(*each[0], *each[1], F.max("unreadable").alias("unreadable")))
    found, before, after = _after(found, ["file"], ["block"], "to0", "to1")
    found = found.withColumns({"begins": before[0], "leaves": after[0]})
    mine = lambda name: F.when(F.col("begins") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    order = Window.partitionBy("file").orderBy("block")
    last = F.lead("block").over(order).isNull()
    fault = F.when(F.col("unreadable"), "unreadable").when(mine("wrong") | (last & (F.col("leaves") == 1)), "malformed")
    first = F.coalesce(F.sum(mine("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(found.select("file", "block", "begins", first.alias("first"), fault.alias("fault")))


def records(rows: DataFrame, known: DataFrame) -> DataFrame:
    """file, number (from 0, empty lines not counted) and values of every row of files without fault, given their lines and `blocks`.

    Rows of one line are taken as they are; only those that run over several lines are
    gathered.  Both read the same columns, so that text is dealt to its blocks once.
    """
    joined = _placed(rows).hint("merge").join(known.hint("merge"), ["file", "block"])
    mine = lambda name: F.when(F.col("begins") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    joined = joined.select("file", "block", "at", "part", "piece", "empty", mine("before").alias("before"), mine("after").alias("after"), (F.col("first") + mine("rank")).alias("number"))
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    short = joined.filter(alone & ~F.col("empty")).select("file", "number", _body(F.col("piece")).alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "part", F.when(F.col("after") == 0, _body(F.col("piece"))).otherwise(F.col("piece")).alias("text"))))
    long = joined.filter(~alone).groupBy("file", "number").agg(F.array_join(ordered["text"], "").alias("row"))
    found = F.regexp_extract_all(F.concat(F.lit(","), "row"), F.lit(_VALUES), 0)
    plain = F.transform(found, lambda v: F.when(v.startswith(',"'), F.replace(v.substr(F.lit(3), F.length(v) - 3), F.lit('""'), F.lit('"'))).otherwise(v.substr(F.lit(2), F.length(v))))
    return short.unionByName(long).select("file", "number", plain.alias("values"))
