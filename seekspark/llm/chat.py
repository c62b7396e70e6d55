"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds a conversation once for each of its turns, every time with all turns so far. Each turn gets two
64-bit hashes of its number, role and text; the exclusive-or of those up to a turn is the rolling hash of the
conversation up to there. A conversation whose whole (length, hash) is also that of a shorter beginning of another is
a snapshot of the other and is dropped by an anti-join; of equal conversations the one with the smallest conv_id stays.
Both sides of the anti-join are distinct, so a first turn that everybody shares is one row. What stays is rendered.

Rolling hashes are prefix sums in two levels, blocks of `BLOCK` turn numbers and sums over blocks, and a conversation is
rendered in parts of `PART` turns: no task needs a whole conversation, however long it is.

Defined results: rows equal in conv_id, turn, role and text are one turn. Unlike rows with one turn number are all kept, by
role and text. Null turns come first; null roles are rendered as `user`, null texts as empty. Rows with a null conv_id are
one conversation. Texts of any length are taken whole. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, PART = 4096, 64


def rolling(turns: DataFrame) -> DataFrame:
    """The distinct turns with n (turns up to this one), h1 and h2 (rolling hashes) and total (turns of the conversation)."""
    t = turns.select("conv_id", "turn", "role", "text").distinct()
    tag = F.struct("turn", "role", "text")
    t = t.withColumns({"block": F.floor(F.coalesce("turn", F.lit(0)) / BLOCK), "x1": F.xxhash64(F.lit(1), tag), "x2": F.xxhash64(F.lit(2), tag)})
    order = "turn", "role", "text"
    here = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"n0": F.count(F.lit(1)).over(here), "y1": F.bit_xor("x1").over(here), "y2": F.bit_xor("x2").over(here)})
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("c"), F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.select(F.col("conv_id").alias("bc"), F.col("block").alias("bb"), zero(F.sum("c").over(over)).alias("c"), zero(F.bit_xor("b1").over(over)).alias("b1"), zero(F.bit_xor("b2").over(over)).alias("b2"), F.sum("c").over(whole).alias("total"))
    t = t.join(blocks, t.conv_id.eqNullSafe(blocks.bc) & (t.block == blocks.bb))
    return t.select("conv_id", "turn", "role", "text", (F.col("n0") + F.col("c")).alias("n"), F.col("y1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("y2").bitwiseXOR(F.col("b2")).alias("h2"), "total")


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id of the conversations that begin no longer one, each text once."""
    whole = rolled.where("n = total").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("keep"))
    begun = rolled.where("n < total").select("n", "h1", "h2").distinct()
    return whole.join(begun, ["n", "h1", "h2"], "left_anti").select("keep")


def chat_format(turns: DataFrame, scratch: Scratch, template: str = "<|{role}|>\n{text}<|end|>\n", part: int = PART) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the part), rendered: the maximal conversations by the template."""
    rolled = scratch.save(rolling(turns), "rolled")
    keep = scratch.save(maximal(rolled), "maximal")
    kept = rolled.join(keep, rolled.conv_id.eqNullSafe(keep.keep), "left_semi")
    pieces = [F.col("role") if x == "{role}" else F.col("text") if x == "{text}" else F.lit(x) for x in _split(template)]
    said = kept.select("conv_id", F.floor((F.col("n") - 1) / part).alias("part"), "n", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.select("conv_id", "part", F.struct("n", F.concat(*pieces).alias("said")).alias("turn"))
    parts = said.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return parts.select("conv_id", "part", "n_turns", F.array_join("turns.said", "").alias("rendered"))


def _split(template: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{role\}|\{text\})", template) if x]


ORACLE = """
with t as (select distinct conv_id, turn, role, text from conversations),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n from t),
c as (select conv_id, string_agg(turn || chr(1) || role || chr(2) || text || chr(3), '' order by n) as whole, min_by(turn || chr(1) || role || chr(2) || text, n) as head from r group by conv_id),
once as (select min(conv_id) as conv_id, whole, any_value(head) as head from c group by whole),
keep as (select conv_id from once a where not exists (select 1 from once b where b.head = a.head and length(b.whole) > length(a.whole) and starts_with(b.whole, a.whole)))
select conv_id, cast((n - 1) // 64 as bigint) as part, count(*) as n_turns,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by n) as rendered
from r where conv_id in (select conv_id from keep) group by all
"""
