"""Which payloads an archive would take; ``payloads`` writes and reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.constants import CREDENTIAL_PARAMS


def archived(payloads: DataFrame, known: DataFrame) -> DataFrame:
    """New payloads by the hash of their bytes; one that carries a credential is refused, one on record is never written again."""
    secret = rf"[?&](?:{'|'.join(CREDENTIAL_PARAMS)})=[^&\s{{]"
    keyed = payloads.where(~F.col("body").rlike(secret)).withColumn("object_key", F.sha2(F.col("body").cast("binary"), 256))
    return keyed.dropDuplicates(["object_key"]).join(known.select("object_key"), "object_key", "left_anti")
