"""What a tenant wants masked before its events are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mark of a masked text, and the columns that it can stand in.
MASK = "[REDACTED]"
MASKED_TEXTS = ("user_agent", "request_query", "request_path")


def redacted(events: DataFrame, policy: Column, extras: str = "raw_extra") -> DataFrame:
    """Events without what their policy names: a list of columns, of `extras` keys, or `extras` itself; case and outer blanks don't count.

    Texts are marked and addresses become null. A vendor's own fields are marked if the policy names them or if
    they hold, anywhere, a value that is masked. A null policy masks nothing, and neither does a column that isn't there.
    """
    names = F.transform(F.coalesce(policy, F.array().cast("array<string>")), lambda p: F.lower(F.trim(p)))
    rows = events.withColumn("_policy", names)
    named = lambda n: F.array_contains("_policy", n)
    there = [c for c in (*MASKED_TEXTS, "client_ip") if c in events.columns]
    leaked = F.array(*(F.when(named(c) & (F.col(c) != ""), F.col(c)) for c in there)) if there else F.array().cast("array<string>")
    rows = rows.withColumn("_leaked", F.array_compact(leaked))
    out = {c: F.when(named(c) & (F.col(c) != ""), F.lit(MASK)).otherwise(F.col(c)) for c in there if c != "client_ip"}
    if "client_ip" in there:
        out["client_ip"] = F.when(~named("client_ip"), F.col("client_ip"))
    if extras in events.columns:
        holds = lambda v: F.exists("_leaked", lambda s: F.contains(v, s))
        hit = lambda k, v: named("raw_extra") | F.array_contains("_policy", F.lower(k)) | F.coalesce(holds(v), F.lit(False))
        out[extras] = F.transform_values(extras, lambda k, v: F.when(hit(k, v), F.lit(MASK)).otherwise(v))
    return rows.withColumns(out).drop("_policy", "_leaked")
