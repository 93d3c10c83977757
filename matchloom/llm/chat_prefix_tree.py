"""Chat formatting into prefix trees.

Conversations that begin with the same turns share them: the turns of all
conversations form trees, whose nodes are known by an order-aware hash of all
turns up to theirs.  Chains of nodes that the same conversations share make one
segment.  Each tree is one packed sequence of its segments in depth-first order;
a shared segment stands there once.  A segment carries the position in its
conversation of its first character and the intervals of the packed sequence
that it attends to besides itself: those of its ancestors.  Units are code
points of the formatted text and, in a second set of columns, tokens.

A turn is OPEN role newline text CLOSE newline.  In roles and texts a backslash
is put before every backslash and inside every control string, so none is left
there, and taking the backslashes out gives the text back.

As tokens, OPEN and CLOSE are two ids next after the vocabulary, so no text
can hold them; role and text between them are encoded each by itself, as they
are, without backslashes and with special tokens' strings as plain text.  Tokens of
a turn hence don't depend on its neighbours: only turns of distinct nodes are
encoded, once, and the segments of a conversation give its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .stage import cut, ensure

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Inside a text these are broken up by a backslash after their first character.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
SALTS = 16

_ESCAPED = r"\\|<(?=\|im_start\|>|\|im_end\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)([\\<\[])\\", "$1")


def header(role: Column) -> Column:
    """The escaped role; newlines become a mark that escaping leaves nowhere else."""
    return F.regexp_replace(escape(role), "\n", r"<\\n>")


def _roles_back(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"<\\n>", "\n"))


def _salted(left: DataFrame, right: DataFrame, key: list[str], source: str) -> DataFrame:
    """left joined with right, whose keys are distinct, so that a key that many rows of left hold is dealt to SALTS tasks."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(source), F.lit(SALTS)))
    some = left.select(*key, "_salt").distinct().hint("merge").join(right.hint("merge"), key)
    return left.hint("merge").join(some.hint("merge"), [*key, "_salt"]).drop("_salt")


def turns(chats: DataFrame) -> DataFrame:
    """Turns in order with formatted text, position, node hash, and how many conversations share the node."""
    chats = ensure(chats, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = chats.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("at", F.row_number().over(order))
    rows = rows.withColumns({"head": F.concat(F.lit(OPEN), header(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))})
    rows = rows.withColumns({
        "chars": (F.length("head") + F.length("body") + F.lit(len(CLOSE))).cast("long"),
        "p1": F.bit_xor(F.xxhash64("at", "role", "text")).over(so_far), "p2": F.bit_xor(F.xxhash64(F.lit("second"), "text", "role", "at")).over(so_far),
    })
    rows = rows.withColumns({"position": F.sum("chars").over(so_far) - F.col("chars"), "tree": F.first("p1").over(so_far)})
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")
    some = rows.select("p1", "p2", "conv_id", salt).groupBy("p1", "p2", "salt").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    node = Window.partitionBy("p1", "p2")
    shared = some.select("p1", "p2", "salt", F.sum("n").over(node).alias("sharing"), F.min("low").over(node).alias("owner"))
    return rows.withColumn("salt", salt).hint("merge").join(shared.hint("merge"), ["p1", "p2", "salt"]).drop("salt")


def _segmented(rows: DataFrame) -> DataFrame:
    """Turns with the number of their segment: it grows where fewer conversations go on."""
    order = Window.partitionBy("conv_id").orderBy("at")
    new = F.coalesce((F.lag("sharing").over(order) != F.col("sharing")).cast("int"), F.lit(1))
    return rows.withColumn("new", new).withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _contents(rows: DataFrame, tokenizer: str | None) -> DataFrame:
    """c, s (conversation and segment of each distinct node), text, loss, ids, n_tokens and loss_tokens, loss in units of the segment."""
    own = rows.filter(F.col("owner").eqNullSafe(F.col("conv_id")))
    own = own.select("conv_id", "segment", "at", "role", "text", F.length("body").cast("long").alias("chars"), F.concat("head", "body", F.lit(CLOSE)).alias("formatted"), F.length("head").cast("long").alias("inner"), (F.col("role") == LOSS_ROLE).alias("loss"))
    size = bpe.vocabulary_size(tokenizer)
    coded = bpe.encode_columns(own, ("role", "text"), ("conv_id", "segment", "at", "formatted", "inner", "chars", "loss"), tokenizer)
    coded = coded.select(
        "conv_id", "segment", "at", "formatted", "loss", "inner", "chars",
        F.concat(F.array(F.lit(size)), "ids_role", "ids_text", F.array(F.lit(size + 1))).alias("ids"),
        (F.size("ids_role") + 1).cast("long").alias("inner_tokens"), F.size("ids_text").cast("long").alias("own_tokens"),
    )
    earlier = Window.partitionBy("conv_id", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.length("formatted")).over(earlier), F.lit(0)) + F.col("inner")
    first_token = F.coalesce(F.sum(F.size("ids")).over(earlier), F.lit(0)) + F.col("inner_tokens")
    span = lambda start, n: F.when(F.col("loss"), F.struct(start.cast("long").alias("start"), (start + F.col(n)).cast("long").alias("end")))
    spans = coded.select("conv_id", "segment", "at", "formatted", "ids", span(first, "chars").alias("l"), span(first_token, "own_tokens").alias("lt"))
    turns_ = spans.groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("at", "formatted", "ids"))).alias("t"), F.array_sort(F.collect_list("l")).alias("loss"), F.array_sort(F.collect_list("lt")).alias("loss_tokens")
    )
    whole = turns_.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.array_join(F.col("t.formatted"), "").alias("text"), "loss", F.flatten(F.col("t.ids")).alias("ids"), "loss_tokens")
    return whole.withColumn("n_tokens", F.size("ids").cast("long"))


def build(chats: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed segments, and (conv_id, segment, k1, k2): which segments make up each conversation.

    Segments: tree, k1, k2 (key), conv_id (smallest that holds it), depth,
    start and end in the tree's packed sequence, position of the first character
    in its conversations, attends (array of start, end of all ancestors in
    order), text, loss (array of start, end within text under the loss mask),
    sharing; and ids with token_start, token_end, token_position, token_attends
    and token_loss, which say the same in tokens.  The position id of a segment's
    i-th token is token_position + i.  Rows are ordered by turn, role and text
    within a conversation, null roles and texts are empty, rows without conv_id
    are one conversation, and repeated rows are turns of their own.
    """
    rows = cut(_segmented(turns(chats)))
    per = rows.groupBy("conv_id", "segment").agg(
        F.min_by("p1", "at").alias("k1"), F.min_by("p2", "at").alias("k2"), F.first("tree").alias("tree"), F.first("sharing").alias("sharing"),
        F.first("owner").alias("owner"), F.min("position").alias("position"), F.sum("chars").alias("chars"),
    )
    path = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per, contents = cut(per), cut(_contents(rows, tokenizer))
    mine = per.withColumn("path", F.collect_list("k1").over(path)).filter(F.col("owner").eqNullSafe(F.col("conv_id")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))
    mine = mine.hint("merge").join(contents.select("c", "s", "n_tokens").hint("merge"), same).drop("c", "s")

    # depth-first order is the order of paths; ranges of it are summed one by one, so a hot tree isn't one task
    parts = max(2, int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(mine.repartitionByRange(parts, "tree", "path").withColumn("block", F.spark_partition_id()))
    sums = ranged.groupBy("tree", "block").agg(F.sum("chars").alias("sum"), F.sum("n_tokens").alias("token_sum"))
    before = Window.partitionBy("tree").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("tree", "block").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = sums.select("tree", "block", so_far("sum", before).alias("offset"), so_far("token_sum", before).alias("token_offset"))
    placed = ranged.withColumns({"inner": so_far("chars", within), "token_inner": so_far("n_tokens", within)})
    placed = placed.hint("merge").join(offsets.hint("merge"), ["tree", "block"])
    placed = placed.withColumns({"start": F.col("offset") + F.col("inner"), "token_start": F.col("token_offset") + F.col("token_inner")})
    placed = cut(placed.select(
        "tree", "k1", "k2", "conv_id", "segment", "sharing", "position", "start", (F.col("start") + F.col("chars")).alias("end"),
        "token_start", (F.col("token_start") + F.col("n_tokens")).alias("token_end"), "path",
    ))

    # ancestors: all keys of the path but the last
    up = placed.select("tree", "k1", "k2", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("a1"))
    token_span = F.struct(F.col("token_start").alias("start"), F.col("token_end").alias("end"))
    spans = placed.select("tree", F.col("k1").alias("a1"), F.struct("start", "end").alias("span"), token_span.alias("token_span"))
    attends = _salted(up, spans, ["tree", "a1"], "k2").groupBy("tree", "k1", "k2").agg(
        F.array_sort(F.collect_list("span")).alias("attends"), F.array_sort(F.collect_list("token_span")).alias("token_attends")
    )
    whole = placed.hint("merge").join(contents.hint("merge"), same).drop("c", "s")
    whole = whole.hint("merge").join(attends.hint("merge"), ["tree", "k1", "k2"], "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    seen = F.coalesce("token_attends", none)
    segments = whole.select(
        "tree", "k1", "k2", "conv_id", F.size("path").alias("depth"), "sharing", "start", "end", "position", F.coalesce("attends", none).alias("attends"), "text", "loss",
        "ids", "token_start", "token_end", F.aggregate(seen, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("token_position"),
        seen.alias("token_attends"), F.col("loss_tokens").alias("token_loss"),
    )
    return segments, per.select("conv_id", "segment", "k1", "k2")


def read_back(segments: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text), loss_text: each conversation put together from packed segments and parsed."""
    pieces = F.transform("loss", lambda x: F.substring(F.col("text"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    parts = segments.select("k1", "k2", "text", pieces.alias("pieces"))
    rows = _salted(members, parts, ["k1", "k2"], "conv_id")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "text", "pieces"))).alias("s"))
    whole = whole.select("conv_id", F.array_join(F.col("s.text"), "").alias("formatted"), F.flatten(F.col("s.pieces")).alias("pieces"))
    split = F.split("formatted", r"<\|im_start\|>", -1)
    blocks = F.slice(split, F.lit(2), F.size(split))
    text = lambda b: F.regexp_replace(b, r"(?s)\A[^\n]*\n|<\|im_end\|>\n\z", "")
    parsed = F.transform(blocks, lambda b: F.struct(_roles_back(F.substring_index(b, "\n", 1)).alias("role"), unescape(text(b)).alias("text")))
    return whole.select("conv_id", "formatted", parsed.alias("turns"), F.array_join(F.transform("pieces", unescape), "").alias("loss_text"))


def op6_chat_prefix_tree(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = read_back(*build(chats.unionByName(odd)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_BROKEN = "replace(x, '\\', '\\\\')"
for _c in CONTROLS:
    _BROKEN = f"replace({_BROKEN}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum({len(OPEN)} + length({_BROKEN.replace('(x,', '(role,')}) + 3 * (length(role) - length(replace(role, chr(10), ''))) + 1
           + length({_BROKEN.replace('(x,', '(text,')}) + {len(CLOSE)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
