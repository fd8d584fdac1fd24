"""Prepared records from raw ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erlink.functions import address, text


def prepare(raw: DataFrame) -> DataFrame:
    """Normalised names, tokens, script, suffix class and address parts of (entity_id, business_name, business_address, country)."""
    name, addr = text.text_key(F.col("business_name")), text.text_key(F.col("business_address"))
    forms = raw.withColumn("__n", text.name_forms(name)).withColumn("addr_norm", text.normalize_name(addr))
    # folding the normalised name is one more crossing, which also serves the suffix
    forms = forms.withColumn("name_fold", text.fold_name(F.col("__n.norm")))
    parts = address.parse_address(addr, F.col("addr_norm"), F.col("country"))
    out = forms.withColumn("__a", parts)
    return out.select(
        "entity_id",
        F.col("__n.norm").alias("name_norm"),
        "name_fold",
        F.col("__n.roman").alias("name_roman"),
        text.name_tokens(F.col("__n.norm")).alias("name_tokens"),
        text.idf_tokens(F.col("__n.norm")).alias("name_idf_tokens"),
        text.script_of(name).alias("name_script"),
        text.strip_suffix(F.col("name_fold")).alias("name_stripped"),
        text.suffix_class(F.col("name_fold")).alias("suffix_class"),
        "addr_norm",
        (F.trim(addr) == "").alias("addr_raw_missing"),
        F.col("__a.house_no").alias("house_no"),
        F.col("__a.street_tokens").alias("street_tokens"),
        F.col("__a.postal").alias("postal"),
        F.col("__a.state_key").alias("state_key"),
        F.col("__a.landmark_flag").alias("landmark_flag"),
        text.country_key(F.col("country")).alias("country"),
    )
