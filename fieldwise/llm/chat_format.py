"""Operator 6: multi-party chat rendering, once from the view of every participant.

For each speaker of a conversation (every role but ``system``), the dialogue is rendered with that speaker as the assistant, all other speakers as
users with their names, and system turns as they are. The mask says which characters are to be learnt: the assistant's
texts with their end marks.

A conversation is rendered in parts of ``PART`` consecutive turn numbers, so that a conversation of any length is many rows; offsets count from the
start of the part. Parts after the first begin with the system turns of the first (they aren't counted as turns). Marks of turns inside texts and names are
parted by a space, so that no one's text can open or end a turn. Columns besides these four are ignored. Nulls: a null text is an empty one, a null role is the speaker ``unknown``, a null turn stands first, null
conv_ids are one conversation. Turns with one number are ordered by role and text; repeated rows are repeated turns. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.llm.store import table

PART = 1024


def perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, part, speaker, n_turns, n_own_turns, rendered, mask); mask: array of (from, to) in characters."""
    plain = lambda c: F.replace(F.col(c), F.lit("<|im_"), F.lit("<| im_"))
    rows = turns.select("conv_id", "turn", F.coalesce(plain("role"), F.lit("unknown")).alias("role"), F.coalesce(plain("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1)).cast("long"))
    # Later parts are few beside turns: a conversation has one for each PART turn numbers.
    later = rows.where("part > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p")).distinct()
    lead = rows.where("part = 0 and role = 'system'").join(later, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "turn", "role", "text", F.col("p").alias("part"), F.lit(True).alias("lead"))
    rows = rows.withColumn("lead", F.lit(False)).unionByName(lead)
    speakers = rows.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    seen = rows.join(speakers.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn("speaker", F.explode("speakers"))
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(F.col("role") == "system", F.lit("<|im_start|>system\n"))
    head = F.coalesce(head, F.concat(F.lit("<|im_start|>user name="), F.col("role"), F.lit("\n")))
    said = seen.withColumn("own", own).withColumn("head", head).withColumn("tail", F.concat("text", F.lit("<|im_end|>\n")))
    said = said.withColumn("n_chars", F.length("head") + F.length("tail"))
    order = Window.partitionBy("conv_id", "part", "speaker").orderBy(F.desc("lead"), F.col("turn").asc_nulls_first(), "role", "text")
    said = said.withColumn("at", F.sum("n_chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_chars"))
    piece = F.struct("at", "n_chars", F.concat("head", "tail").alias("shown"), F.when(F.col("own"), F.struct((F.col("at") + F.length("head")).alias("from"), (F.col("at") + F.col("n_chars")).alias("to"))).alias("mask"))
    whole = said.groupBy("conv_id", "part", "speaker").agg(F.count_if(~F.col("lead")).alias("n_turns"), F.count_if("own").alias("n_own_turns"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return whole.select(
        "conv_id", "part", "speaker", "n_turns", "n_own_turns",
        F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("rendered"),
        F.filter(F.transform("pieces", lambda p: p["mask"]), lambda m: m.isNotNull()).alias("mask"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask as text: from-to pairs joined by commas."""
    shown = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string"))), ",")
    return shown.withColumn("mask", spans)


OP6_SQL = """
with x as (select conv_id, turn, coalesce(replace(role, '<|im_', '<| im_'), 'unknown') as role, coalesce(replace(text, '<|im_', '<| im_'), '') as text, coalesce(cast(floor(turn / 1024) as bigint), -1) as part from conversations),
r as (select *, false as lead from x union all select x.conv_id, x.turn, x.role, x.text, l.part, true from x join (select distinct conv_id, part from x where part > 0) l on x.conv_id is not distinct from l.conv_id where x.part = 0 and x.role = 'system'),
s as (select distinct conv_id, role as speaker from r where role <> 'system'),
j as (select r.*, s.speaker, role = speaker as own,
 case when role = speaker then '<|im_start|>assistant' || chr(10) when role = 'system' then '<|im_start|>system' || chr(10) else '<|im_start|>user name=' || role || chr(10) end as head,
 text || '<|im_end|>' || chr(10) as tail from r join s on r.conv_id is not distinct from s.conv_id),
o as (select *, row_number() over (partition by conv_id, part, speaker order by lead desc, turn nulls first, role, text) as i,
 sum(length(head) + length(tail)) over (partition by conv_id, part, speaker order by lead desc, turn nulls first, role, text rows unbounded preceding) as upto from j)
select conv_id, part, speaker, cast(sum(case when lead then 0 else 1 end) as bigint) as n_turns, cast(sum(case when own then 1 else 0 end) as bigint) as n_own_turns, string_agg(head || tail, '' order by i) as rendered,
 coalesce(string_agg(cast(cast(upto - length(tail) as bigint) as varchar) || '-' || cast(cast(upto as bigint) as varchar), ',' order by i) filter (where own), '') as mask
from o group by conv_id, part, speaker
"""
