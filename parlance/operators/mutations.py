"""Keyed mutations as copy-on-write table jobs (#6-#8, #12, #61-#65, #71).

Each function takes the current table(s) and a batch of changes and returns the
new table; writing it (a partition overwrite or a new table version) is the
caller's choice.  Several updates for one key in a batch are first reduced to
the last one by ``(ts, msg_id)`` per field, which equals applying them in order.
Joins are equi-joins on the key; the change batch is aggregated to one row per
key before it meets the table, so a hot key cannot fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.ids import canonical_uuid, uuid5_dns
from parlance.functions.jsonx import shallow_merge
from parlance.functions.text import iso_text, nonempty_or_null


def last_update_per_key(updates: DataFrame, key: str, fields, order=("ts", "msg_id"),
                        keep_nulls: bool = False) -> DataFrame:
    """Reduce a batch to one row per key: per field the latest value (by ``order``).

    With ``keep_nulls`` a null write counts as a write (``set`` semantics); without
    it the latest non-null value wins (``coalesce`` semantics).  Adds ``touched``
    (any update) and ``<field>_set`` flags (the field was written).
    """
    o = F.struct(*order)
    aggs = []
    for f in fields:
        if keep_nulls:
            aggs.append(F.max_by(F.struct(F.col(f).alias("v")), o)["v"].alias(f))
            aggs.append(F.lit(True).alias(f"{f}_set"))
        else:
            aggs.append(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), o)).alias(f))
            aggs.append(F.max(F.col(f).isNotNull()).alias(f"{f}_set"))
    return updates.groupBy(key).agg(*aggs, F.max(F.struct(*order)).alias("_last"))


def archive_rows(evicted: DataFrame) -> DataFrame:
    """#6: evicted buffer messages as archive rows (id, session uuid, role, content, tokens, time);
    the messages' tool calls too, if they have any such column."""
    sess = F.col("session_id").cast("string")
    calls = [F.col("tool_calls")] if "tool_calls" in evicted.columns else []
    return evicted.select(
        uuid5_dns(F.concat_ws("/", F.lit("msg"), sess, F.col("msg_id").cast("string"))).alias("id"),
        F.coalesce(canonical_uuid(sess), uuid5_dns(sess)).alias("session_id"),
        F.col("role"), F.col("content"),
        F.coalesce(F.col("tokens"), F.lit(0)).cast("int").alias("token_count"), *calls,
        iso_text(F.col("ts")).alias("created_at"))


def archive_append(archive_rows_df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """#6 sink: append archive rows; with a batch id the write is idempotent (replace that batch only)."""
    df = archive_rows_df
    if batch_id is None:
        df.write.mode("append").parquet(path)
        return
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def replace_partitions(existing: DataFrame, new_rows: DataFrame, part_col: str = "shop_id",
                       replaced: DataFrame | None = None) -> DataFrame:
    """#7: every partition present in ``new_rows`` is replaced by it; others are kept.

    ``replaced`` (a frame with ``part_col``) names partitions that are replaced too: one without new
    rows is cleared."""
    touched = new_rows.select(part_col)
    if replaced is not None:
        touched = touched.unionByName(replaced.select(part_col))
    return existing.join(touched, part_col, "left_anti").unionByName(new_rows)


def insert_if_absent(existing: DataFrame, new_rows: DataFrame, key_cols, order_cols=()) -> DataFrame:
    """#8: add rows whose key is absent.  Of several rows with one key the least wins, by
    ``order_cols`` and then by all other columns; the choice is a partial aggregate."""
    keys = list(key_cols)
    rest = [c for c in new_rows.columns if c not in keys]
    order = [*order_cols, *(c for c in rest if c not in order_cols)]
    if rest:
        first = new_rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
        first = first.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest))
    else:
        first = new_rows.distinct()
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti").select(*new_rows.columns))


def session_lookup(requests: DataFrame, sessions: DataFrame, raw_col: str = "requested_id") -> DataFrame:
    """#12: each requested id text -> the session row or null; malformed ids -> null."""
    r = requests.withColumn("_sid", canonical_uuid(F.col(raw_col)))
    s = sessions.select(F.col("id").alias("_sid"), *[F.col(c).alias(f"session_{c}") for c in sessions.columns])
    return r.join(s, "_sid", "left").drop("_sid")


def cascade_delete(shops: DataFrame, products: DataFrame, customers: DataFrame, stages: DataFrame,
                   documents: DataFrame, sessions: DataFrame, messages: DataFrame,
                   doomed_shops: DataFrame, doomed_sessions: DataFrame) -> dict[str, DataFrame]:
    """#61: delete shops (-> products -> documents, customers, stages), sessions (-> messages).

    Sessions whose current stage was deleted keep their row with the stage set to
    null.  Every step is a semi or anti join on a key; nothing is collected.
    """
    ds = doomed_shops.select(F.col("id").alias("shop_id"))   # semi/anti joins need no distinct
    keep_products = products.join(ds, "shop_id", "left_anti")
    gone_products = products.join(ds, "shop_id", "left_semi").select(F.col("id").alias("product_id"))
    keep_docs = documents.join(gone_products, "product_id", "left_anti")
    keep_customers = customers.join(ds, "shop_id", "left_anti")
    keep_stages = stages.join(ds, "shop_id", "left_anti")
    gone_stage_ids = stages.join(ds, "shop_id", "left_semi").select(F.col("stage_id").alias("current_stage_id"),
                                                                   F.lit(True).alias("_gone"))
    dss = doomed_sessions.select(F.col("id"))
    keep_sessions = (sessions.join(dss, "id", "left_anti")
                     .join(gone_stage_ids, "current_stage_id", "left")
                     .withColumn("current_stage_id", F.when(F.col("_gone"), F.lit(None))
                                 .otherwise(F.col("current_stage_id")))
                     .drop("_gone"))
    keep_messages = messages.join(dss.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    return {"shops": shops.join(ds.select(F.col("shop_id").alias("id")), "id", "left_anti"),
            "products": keep_products, "documents": keep_docs, "customers": keep_customers,
            "stages": keep_stages, "sessions": keep_sessions, "messages": keep_messages}


def upsert_handoff_reason(sessions: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """#62: set ``handoff_reason`` (null included) for existing sessions, insert absent ones.

    ``updates`` rows are ``(id, ts, msg_id, handoff_reason)`` and may name the ``user_id``
    of a session to insert; without one the session's own id stands for its user, so the
    required column is never null.  A full outer join of the table with the reduced batch;
    ``touched`` and ``was_inserted`` tell updates and inserts apart.  With ``now``, inserted
    and updated rows get it as ``updated_at`` (and inserted ones as ``created_at``) where
    the table has these columns.
    """
    named = updates if "user_id" in updates.columns else updates.withColumn("user_id", F.col("id"))
    u = (last_update_per_key(named, "id", ["handoff_reason"], keep_nulls=True)
         .select("id", F.col("handoff_reason").alias("_new_reason"), F.lit(True).alias("_touched"))
         .join(named.groupBy("id").agg(F.min("user_id").alias("_user")), "id"))
    j = sessions.withColumn("_there", F.lit(True)).join(u, "id", "full_outer")
    touched, inserted = F.coalesce("_touched", F.lit(False)), F.col("_there").isNull()
    out = (j.withColumn("handoff_reason", F.when(touched, F.col("_new_reason")).otherwise(F.col("handoff_reason")))
           .withColumn("user_id", F.coalesce("user_id", F.when(inserted, F.coalesce("_user", "id")))))
    if now is not None:
        for c, when in (("created_at", inserted), ("updated_at", touched)):
            if c in sessions.columns:
                out = out.withColumn(c, F.when(when, now).otherwise(F.col(c)))
    return (out.withColumn("was_inserted", inserted).withColumn("touched", touched)
            .drop("_new_reason", "_touched", "_user", "_there"))


def metadata_patch(updates: DataFrame, key: str = "id", order=("ts", "msg_id")) -> DataFrame:
    """Fold many metadata updates of one key into one patch object.

    Sequential ``dict.update`` calls leave, for every top-level key, the value of
    the last update that carried it.  So updates are exploded to (key, field,
    value) rows, reduced with ``max_by`` per (key, field) - a partial aggregate,
    bounded per field however many updates a hot key gets - and only the few
    surviving fields of a key are gathered into the patch.
    """
    rows = (updates.where(F.col("metadata").isNotNull())
            .select(key, *order, F.explode(F.from_json(F.col("metadata"), "map<string,variant>"))
                    .alias("_k", "_v")))
    latest = rows.groupBy(key, "_k").agg(F.max_by(F.col("_v"), F.struct(*order)).alias("_v"))
    return latest.groupBy(key).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("_k", "_v")))).alias("_patch"))


def update_session(sessions: DataFrame, updates: DataFrame, now_ts: int) -> tuple[DataFrame, DataFrame]:
    """#63: non-null reason / stage overwrite (null keeps), metadata shallow-merged in order.

    Returns ``(new_sessions, errors)``; an update for an unknown session is an error.
    ``updated_at`` becomes ``now_ts`` for every updated session.
    """
    o = F.struct("ts", "msg_id")
    red = updates.groupBy("id").agg(
        F.max_by(F.col("handoff_reason"), F.when(F.col("handoff_reason").isNotNull(), o)).alias("_reason"),
        F.max_by(F.col("current_stage_id"), F.when(F.col("current_stage_id").isNotNull(), o)).alias("_stage"))
    red = red.join(metadata_patch(updates), "id", "left")
    errors = red.join(sessions.select("id"), "id", "left_anti").select("id", F.lit("session not found").alias("error"))
    j = sessions.join(red.withColumn("_hit", F.lit(True)), "id", "left")
    out = (j.withColumn("handoff_reason", F.coalesce(F.col("_reason"), F.col("handoff_reason")))
           .withColumn("current_stage_id", F.coalesce(F.col("_stage"), F.col("current_stage_id")))
           .withColumn("metadata", F.when(F.col("_patch").isNotNull(), shallow_merge(F.col("metadata"), F.col("_patch")))
                       .otherwise(F.col("metadata")))
           .withColumn("updated_at", F.when(F.col("_hit"), F.lit(now_ts)).otherwise(F.col("updated_at")))
           .drop("_reason", "_stage", "_patch", "_hit"))
    return out, errors


def summary_metadata(summary: Column, tags: Column, topics: Column) -> Column:
    """#64: metadata patch of a summary: ``summary`` always, tags / key_topics only when non-empty."""
    return F.to_json(F.struct(
        summary.alias("summary"),
        F.when(F.size(tags) > 0, tags).alias("tags"),
        F.when(F.size(topics) > 0, topics).alias("key_topics")))


def update_session_summary(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """#64: merge each session's summary patch into its metadata; the handoff reason is untouched.

    Several summaries of a session are folded first, in the order of ``ts`` and ``msg_id``
    where the batch has them, so a session stays one row.
    """
    order = [c for c in ("ts", "msg_id") if c in summaries.columns] or ["metadata"]
    s = metadata_patch(summaries.withColumn(
        "metadata", summary_metadata(F.col("summary"), F.col("tags"), F.col("key_topics"))), order=order)
    return (sessions.join(s, "id", "left")
            .withColumn("metadata", F.when(F.col("_patch").isNotNull(),
                                           shallow_merge(F.col("metadata"), F.col("_patch")))
                        .otherwise(F.col("metadata")))
            .drop("_patch"))


def merge_customer_info(customers: DataFrame, info: DataFrame) -> DataFrame:
    """#65: for existing customers: non-empty name/phone/email overwrite, preferences shallow-merged.

    An info row applies only when it found a name, phone or e-mail.  Several rows of one
    customer are folded first (last non-empty value of each field, patches in order of
    ``ts`` and ``msg_id`` where the batch has them), so a customer stays one row.
    """
    texts = {c: nonempty_or_null(F.col(c)) for c in ("name", "phone", "email")}
    order = [c for c in ("ts", "msg_id") if c in info.columns] or ["name", "phone", "email", "preferences"]
    rows = info.where(F.coalesce(*texts.values()).isNotNull())
    last = F.struct(*order)
    i = rows.groupBy("customer_id").agg(*(F.max_by(t, F.when(t.isNotNull(), last)).alias(f"_{c}") for c, t in texts.items()))
    patches = metadata_patch(rows.withColumn("metadata", F.col("preferences")), key="customer_id",
                             order=order).withColumnRenamed("_patch", "_prefs")
    i = i.join(patches, "customer_id", "left")
    j = customers.join(i, "customer_id", "left")
    hit = F.col("_prefs").isNotNull() | F.col("_name").isNotNull() | F.col("_phone").isNotNull() \
        | F.col("_email").isNotNull()
    return (j.withColumn("full_name", F.coalesce(nonempty_or_null(F.col("_name")), F.col("full_name")))
            .withColumn("phone", F.coalesce(nonempty_or_null(F.col("_phone")), F.col("phone")))
            .withColumn("email", F.coalesce(nonempty_or_null(F.col("_email")), F.col("email")))
            .withColumn("preferences", F.when(hit & F.col("_prefs").isNotNull(),
                                              shallow_merge(F.col("preferences"), F.col("_prefs")))
                        .otherwise(F.col("preferences")))
            .drop("_name", "_phone", "_email", "_prefs"))


def vector_delete(vectors: DataFrame, shop_id=None, doc_id=None, product_id=None) -> DataFrame:
    """#71: keep rows not matched by the delete predicate (typed comparisons, never string-built).

    Delete by shop, by doc id, or by product with an optional shop; a null
    comparison deletes nothing (``coalesce(pred, false)``).
    """
    pred = F.lit(False)
    if product_id is not None:
        pred = F.col("product_id") == F.lit(product_id)
        if shop_id is not None:
            pred = pred & (F.col("shop_id") == F.lit(shop_id))
    elif doc_id is not None:
        pred = F.col("doc_id") == F.lit(doc_id)
    elif shop_id is not None:
        pred = F.col("shop_id") == F.lit(shop_id)
    return vectors.where(~F.coalesce(pred, F.lit(False)))
