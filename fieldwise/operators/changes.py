"""Changes of sources, clauses and answers; hash chains; constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.scalars import money_mentions, repeals, squeeze, upper_tr

GENESIS = "0" * 64


def change_events(snapshots: DataFrame) -> DataFrame:
    """Each snapshot of a source as NEW, UNCHANGED or UPDATED against the one before."""
    before = F.lag("content_hash").over(Window.partitionBy("source_id").orderBy("ts", "event_id"))
    status = F.when(before.isNull(), "NEW").when(before == F.col("content_hash"), "UNCHANGED").otherwise("UPDATED")
    return snapshots.select("source_id", "event_id", status.alias("status"))


def clause_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(clause_key, change, old_hash, new_hash, added, removed, money_changed, repeal) of two clause sets (clause_key, text).

    Keys are compared in upper case with single spaces; of texts, only spacing never counts. A key that stands twice on a side is AMBIGUOUS and isn't compared.
    added and removed: the distinct words of a changed clause that only one side has, in the order of their first place."""

    def one(rows: DataFrame, name: str) -> DataFrame:
        keyed = rows.select(squeeze(upper_tr(F.col("clause_key").cast("string"))).alias("clause_key"), squeeze(F.col("text")).alias("text"))
        return keyed.groupBy("clause_key").agg(F.min("text").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    both = one(previous, "old").join(one(current, "new"), "clause_key", "full_outer")
    repeated = (F.coalesce("n_old", F.lit(0)) > 1) | (F.coalesce("n_new", F.lit(0)) > 1)
    change = F.when(repeated, "AMBIGUOUS").when(F.col("n_old").isNull(), "ADDED").when(F.col("n_new").isNull(), "REMOVED").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("CHANGED")
    sure = F.col("change") != "AMBIGUOUS"
    words = lambda a, b: F.when(F.col("change") == "CHANGED", F.array_except(F.split(F.coalesce(a, F.lit("")), " "), F.split(F.coalesce(b, F.lit("")), " ")))
    amounts = lambda c: F.coalesce(money_mentions(F.col(c)), F.array())
    return both.withColumn("change", change).select(
        "clause_key", "change", F.when(sure, F.sha2("old", 256)).alias("old_hash"), F.when(sure, F.sha2("new", 256)).alias("new_hash"), words("new", "old").alias("added"), words("old", "new").alias("removed"),
        F.when(sure, amounts("old") != amounts("new")).alias("money_changed"), F.when(sure, repeals(F.col("new"))).alias("repeal"),
    )


def harvest(found: DataFrame, known: DataFrame) -> DataFrame:
    """Questions and answers found (question, answer) against known ones: SKIPPED if the pair is known, SUPERSEDES with the next version if
    the question is, else NEW with version 1. Pairs that repeat in a harvest count once; new answers always wait for approval."""
    key = lambda rows: rows.select(F.sha2("question", 256).alias("q"), F.sha2(F.concat_ws("\n", "question", "answer"), 256).alias("h")).distinct()
    live = key(known)
    versions = live.groupBy("q").agg(F.count(F.lit(1)).alias("v"))
    rows = key(found).join(live.select("h", F.lit(True).alias("same")), "h", "left").join(versions, "q", "left")
    status = F.when(F.col("same"), "SKIPPED").when(F.col("v").isNotNull(), "SUPERSEDES").otherwise("NEW")
    nth = F.row_number().over(Window.partitionBy("q", status).orderBy("h"))
    version = F.when(status != "SKIPPED", F.coalesce("v", F.lit(0)) + nth)
    return rows.select("q", "h", status.alias("status"), version.cast("long").alias("version"))


def moderate(faqs: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faqs (faq_id, status, verified) after actions (faq_id, action, actor), and the log of those that applied."""
    after = F.create_map(F.lit("APPROVE"), F.lit("APPROVED"), F.lit("REJECT"), F.lit("REJECTED"), F.lit("SUPERSEDE"), F.lit("SUPERSEDED"))
    rows = faqs.join(actions.where(F.col("action").isin("APPROVE", "REJECT", "SUPERSEDE")), "faq_id", "left")
    done = rows.select("faq_id", F.coalesce(F.try_element_at(after, F.col("action")), "status").alias("status"), F.when(F.col("action").isNull(), F.col("verified")).otherwise(F.col("action") == "APPROVE").alias("verified"))
    return done, rows.where("action is not null").select("faq_id", "action", "actor")


def block_hash(*fields: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def block_sha256(chain: str, index: int, event_id: int, payload: str, before: str) -> str:
    """The same of one block, in a task."""
    import hashlib
    import json

    block = {"block_index": str(index), "chain": chain, "event_id": str(event_id), "payload": payload, "previous_sha256": before}
    return hashlib.sha256(json.dumps(block, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def append_blocks(events: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """events (chain, event_id, payload) to blocks; each chain is walked in order of event_id, different chains by different tasks.

    tips (chain, block_index, block_sha256): where chains stand now. A block needs the one before, so a chain is walked by one task; rows are streamed to it in
    order and it carries the tip alone, so a chain of any length takes no more memory."""
    import pandas as pd

    if tips is None:
        rows = events.withColumn("tip_index", F.lit(-1).cast("long")).withColumn("tip", F.lit(GENESIS))
    else:
        known = tips.select("chain", F.col("block_index").alias("tip_index"), F.col("block_sha256").alias("tip"))
        rows = events.join(known, "chain", "left").fillna({"tip_index": -1, "tip": GENESIS})

    def walk(batches):
        at = None
        for pdf in batches:
            out = []
            for chain, event_id, payload, tip_index, tip in pdf.itertuples(index=False):
                if at is None or at[0] != chain:
                    at = (chain, int(tip_index), tip)
                index, before = at[1] + 1, at[2]
                own = block_sha256(chain, index, event_id, payload, before)
                out.append((chain, index, event_id, payload, before, own))
                at = (chain, index, own)
            yield pd.DataFrame(out, columns=["chain", "block_index", "event_id", "payload", "previous_sha256", "block_sha256"])

    ordered = rows.select("chain", "event_id", "payload", "tip_index", "tip").repartition("chain").sortWithinPartitions("chain", "event_id")
    return ordered.mapInPandas(walk, "chain string, block_index long, event_id long, payload string, previous_sha256 string, block_sha256 string")


def chain_violations(blocks: DataFrame) -> DataFrame:
    """(chain, block_index, violation) of each chain's first block that breaks it; none for intact chains."""
    order = Window.partitionBy("chain").orderBy("block_index")
    last, index = F.lag("block_sha256").over(order), F.lag("block_index").over(order)
    own = block_hash("block_index", "chain", "event_id", "payload", "previous_sha256")
    rows = blocks.select("chain", "block_index", "previous_sha256", "block_sha256", last.alias("last"), index.alias("before"), own.alias("own"))
    why = (
        F.when(F.col("before").isNull() & ((F.col("block_index") != 0) | (F.col("previous_sha256") != GENESIS)), "GENESIS")
        .when(F.col("block_index") != F.col("before") + 1, "INDEX").when(F.col("previous_sha256") != F.col("last"), "PREVIOUS_HASH").when(F.col("own") != F.col("block_sha256"), "BLOCK_HASH")
    )
    bad = rows.select("chain", "block_index", why.alias("violation")).where("violation is not null")
    return bad.groupBy("chain").agg(F.min(F.struct("block_index", "violation")).alias("x")).select("chain", "x.block_index", "x.violation")


def root_hash(blocks: DataFrame) -> DataFrame:
    """(chain, n_blocks, first_index, last_index, root): SHA-256 over the block hashes of a chain in order, streamed through the chain's task."""
    import hashlib

    import pandas as pd

    def roots(batches):
        at, digest, n, first, last = None, None, 0, 0, 0
        for pdf in batches:
            out = []
            for chain, index, own in pdf.itertuples(index=False):
                if chain != at:
                    if at is not None:
                        out.append((at, n, first, last, digest.hexdigest()))
                    at, digest, n, first = chain, hashlib.sha256(), 0, index
                digest.update(own.encode())
                n, last = n + 1, index
            yield pd.DataFrame(out, columns=["chain", "n_blocks", "first_index", "last_index", "root"])
        if at is not None:
            yield pd.DataFrame([(at, n, first, last, digest.hexdigest())], columns=["chain", "n_blocks", "first_index", "last_index", "root"])

    ordered = blocks.select("chain", "block_index", "block_sha256").repartition("chain").sortWithinPartitions("chain", "block_index")
    return ordered.mapInPandas(roots, "chain string, n_blocks long, first_index long, last_index long, root string")


def constraint_violations(rows: DataFrame, key: list[str], checks: dict[str, str], unique: list[str]) -> DataFrame:
    """(key..., violation): rows that fail a SQL check (null passes, as in SQL), and rows whose ``unique`` columns repeat."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*unique))
    found = F.array_compact(F.array(*[F.when(~F.expr(c), F.lit(name)) for name, c in checks.items()], F.when(F.col("_n") > 1, F.lit("UNIQUE"))))
    return rows.withColumn("_n", n).select(*key, F.explode(found).alias("violation"))


def stage(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """new rows as INSERT (key is absent), SAME (row is equal) or CONFLICT (row differs); nothing is overwritten."""
    others = [c for c in new.columns if c not in key]
    old = existing.select(*key, F.struct(*others).alias("_old"))
    rows = new.join(old, key, "left")
    same = F.col("_old").eqNullSafe(F.struct(*others))
    return rows.withColumn("outcome", F.when(F.col("_old").isNull(), "INSERT").when(same, "SAME").otherwise("CONFLICT")).drop("_old")
