"""Token-bucket policing per source, exact to the nanosecond."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.fold import fold_ordered
from flowlake.operators.sequence import MAX_GROUP_ROWS, POSITION, Running, Stage, ordered

SECOND_NS = 1_000_000_000


@dataclass
class Bucket:
    """Integer token bucket; ``remainder`` keeps the fraction of a token."""

    rate: int = 100_000
    capacity: int = 100_000
    tokens: int = 100_000
    remainder: int = 0
    last: int | None = None

    def refill(self, now: int) -> None:
        elapsed = SECOND_NS if self.last is None else now - self.last
        # a packet older than the last one counts as a full wait, as an unsigned difference would
        if elapsed < 0 or elapsed >= SECOND_NS:
            self.tokens, self.remainder = self.capacity, 0
        else:
            made = elapsed * self.rate + self.remainder
            self.tokens, self.remainder = self.tokens + made // SECOND_NS, made % SECOND_NS
            if self.tokens > self.capacity:
                self.tokens, self.remainder = self.capacity, 0
        self.last = now

    def admit(self, now: int, size: int) -> bool:
        self.refill(now)
        if self.tokens < size:
            return False
        self.tokens -= size
        return True


def rate_police(
    packets: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    rate: int = 100_000,
    capacity: int = 100_000,
    tie: str = "packet_id",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``passed``: whether the source's bucket held enough tokens for the packet.

    The bucket is a fold over a source's packets in time order, but it restarts
    wherever it is certain to be full again, whatever happened before: after an
    idle second, and at packets that come when even a bucket emptied at the
    start and charged for every packet since would have refilled. Those points
    are found in parallel with running sums and cut a source into independent
    stretches. A stretch streams through its task in Arrow batches with five
    numbers of state; only a source in constant overload is one long stretch.
    """
    names = list(keys)
    first = packets.agg(F.min("ts")).first()[0]
    start = F.unix_micros(F.lit(first).cast("timestamp")) * 1000
    base = packets.withColumn("_ns", F.unix_micros("ts") * 1000)

    def idle(w):
        before = F.lag("_ns").over(w)
        return {"_fresh": before.isNull() | (F.col("_ns") - before >= SECOND_NS)}

    # Demand so far minus supply so far, in tokens. A new low beyond the margin means
    # that the refill since the last low overfills the bucket. The margin covers the
    # fraction of a token and rounding; a missed restart only makes a longer stretch.
    balance = F.coalesce(F.col("_spent"), F.lit(0.0)) - F.col("_supply")
    emptied = -F.col("_supply_0") - F.lit(float(capacity))
    refilled = balance < F.least(F.col("_low"), emptied) - (2.0 + F.abs(balance) * 1e-9)
    restart = F.col("_fresh") | F.coalesce(refilled, F.lit(False))
    cut = ordered(
        base.withColumn("_supply", (F.col("_ns") - start) / F.lit(1e9) * float(rate)),
        names,
        ["_ns", tie],
        [
            Stage(idle, 1),
            Running({"_spent": F.col("packet_size").cast("double")}, "sum", exclusive=True),
            Running({"_supply_0": F.col("_supply")}, "min"),
            Running({"_low": balance}, "min", exclusive=True),
            Running({"_stretch": F.when(restart, F.col(POSITION))}),
        ],
        max_group_rows,
    )
    rows = cut.select(*packets.columns, "_stretch", "_ns", POSITION)

    def fresh_bucket() -> Bucket:
        return Bucket(rate, capacity, capacity)

    out = fold_ordered(rows, [*names, "_stretch"], [POSITION], ["_ns", "packet_size"], fresh_bucket, Bucket.admit, "passed")
    return out.drop("_stretch", "_ns", POSITION)


STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("tokens", "remainder", "last")])
