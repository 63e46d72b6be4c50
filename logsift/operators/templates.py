"""Template ids on log rows and template statistics.

``assign_exact_templates`` gives each row the template made of its masked,
tokenised message (J6: an equi-key, no join needed).  ``logsift.operators.mining``
mines coarser templates from those (T1) and maps them back with a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import masked_message, short_md5_id


def assign_exact_templates(logs: DataFrame, message: str = "message") -> DataFrame:
    """template = masked message, template_id = 'tmpl_' + md5[:8]."""
    tmpl = masked_message(F.col(message))
    return (logs.withColumn("template", tmpl)
            .withColumn("template_id", short_md5_id("tmpl_", F.col("template"))))


def template_stats(logs: DataFrame) -> DataFrame:
    """One row per template id; count, first/last seen (event
    time), the template text of the first row by arrival.

    Partial aggregation runs map-side, so a template that holds a third of
    all rows costs one small partial row per task, not one hot task.  The rows
    are grouped by id and text with numbers as buffers, which a hash aggregate
    can hold; picking the text by arrival would sort them, so that is done on
    the few (id, text) rows afterwards.
    """
    texts = (logs.where(F.col("template_id").isNotNull())
             .groupBy("template_id", "template")
             .agg(F.min("ingest_seq").alias("seq"),
                  F.count(F.lit(1)).alias("count"),
                  F.min("timestamp").alias("first_seen"),
                  F.max("timestamp").alias("last_seen")))
    return (texts.groupBy("template_id")
            .agg(F.min_by("template", "seq").alias("template"),
                 F.sum("count").alias("count"),
                 F.min("first_seen").alias("first_seen"),
                 F.max("last_seen").alias("last_seen"))
            .withColumn("cluster_size", F.col("count")))


def merge_template_stats(previous: DataFrame, batch_stats: DataFrame) -> DataFrame:
    """S15 upsert as a union + re-aggregate: counts add up, first_seen is the
    earliest, last_seen the latest, the text of the earlier table is kept."""
    cols = ["template_id", "template", "count", "first_seen", "last_seen"]
    u = (previous.select(*cols).withColumn("_o", F.lit(0))
         .unionByName(batch_stats.select(*cols).withColumn("_o", F.lit(1))))
    return (u.groupBy("template_id")
            .agg(F.min_by("template", "_o").alias("template"),
                 F.sum("count").alias("count"),
                 F.min("first_seen").alias("first_seen"),
                 F.max("last_seen").alias("last_seen"))
            .withColumn("cluster_size", F.col("count")))
