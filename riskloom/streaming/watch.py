"""Watch lists with state: advisories of watched products and CWEs, each once as new and again as changed, however late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: shares of an item's state, by advisory, so that a CWE that a third of all advisories have is no single task
SHARES = 16
TOLD = "item string, cve_id string, status string, published_date timestamp, last_modified timestamp, looked timestamp"


class Watcher(StatefulProcessor):
    """Keeps, for an item's share, when it last looked and the last change of each advisory it has told of."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "cve_id string", "last_modified timestamp")
        self.look = handle.getValueState("look", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.look.get()[0] if self.look.exists() else None
        told, now = [], before
        for batch in rows:
            for r in batch.sort_values("last_modified", kind="stable").itertuples(index=False):
                now = r.looked if now is None or r.looked > now else now
                old = self.seen.getValue((r.cve_id,)) if self.seen.containsKey((r.cve_id,)) else None
                if old is not None and (pd.isna(r.last_modified) or old[0] is not None and pd.Timestamp(old[0]) >= r.last_modified):
                    continue
                self.seen.updateValue((r.cve_id,), (None if pd.isna(r.last_modified) else r.last_modified.to_pydatetime(),))
                told.append((key[0], r.cve_id, "new" if old is None else "changed", r.published_date, r.last_modified, before))
        if now is not None:
            self.look.update((pd.Timestamp(now).to_pydatetime(),))
        if told:
            yield pd.DataFrame(told, columns=[c.split()[0] for c in TOLD.split(", ")])

    def close(self) -> None:
        pass


def watched(stream: DataFrame, products: list[str] = (), cwes: list[str] = ()) -> DataFrame:
    """(item, cve_id, status, published_date, last_modified, looked) of a stream of advisories, as they come.

    item is a watched product or CWE; status is new, or changed where last_modified is later than when it was told of;
    looked is when the item's share was looked at before, null at first. Needs the RocksDB state store. An advisory with
    several watched items is told of for each; one without a number for none.
    """
    wanted = F.array(*[F.lit(x) for x in (*products, *cwes)]) if products or cwes else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    named = F.array_distinct(F.concat(F.coalesce("affected_products", none), F.coalesce("cwe_ids", none)))
    d = stream.where("cve_id is not null").select("cve_id", "published_date", "last_modified", F.current_timestamp().alias("looked"), F.explode(F.array_intersect(named, wanted)).alias("item"))
    d = d.withColumn("share", F.pmod(F.xxhash64("cve_id"), F.lit(SHARES)).cast("int"))
    return d.groupBy("item", "share").transformWithStateInPandas(Watcher(), TOLD, "Append", "None")
