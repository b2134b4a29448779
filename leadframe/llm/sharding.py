"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into ``N_SLOTS`` virtual slots, which never change. Bytes are
aggregated per slot (a table of at most ``N_SLOTS`` rows), and a map gives each
slot a shard. The map is a small versioned table in the shared folder; growing
or rebalancing writes a new version that moves whole slots and no others, so a
record moves only if its slot does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch, shared_dir

N_SLOTS = 4096
RECORD_OVERHEAD = 8     # bytes a record costs besides its text


def spread_slots(slot_bytes: dict[int, int], n_slots: int, n_shards: int) -> dict[int, int]:
    """First map: largest slot first, each to the shard with the fewest bytes."""
    import heapq

    heap = [(0, 0, sh) for sh in range(n_shards)]
    out = {}
    for slot in sorted(range(n_slots), key=lambda k: (-slot_bytes.get(k, 0), k)):
        b, n, sh = heapq.heappop(heap)
        out[slot] = sh
        heapq.heappush(heap, (b + slot_bytes.get(slot, 0), n + 1, sh))
    return out


def grow_slots(slot_map: dict[int, int], slot_bytes: dict[int, int], n_shards: int) -> dict[int, int]:
    """Edit a map for one more shard: slots move only into it, from the fullest shard each time, up to its share."""
    out, new = dict(slot_map), n_shards - 1
    load, of = _loads(out, slot_bytes, n_shards)
    room = sum(load) / n_shards
    while True:
        hi = max(range(new), key=lambda x: (load[x], -x))
        fit = [k for k in of[hi] if 0 < slot_bytes.get(k, 0) <= room]
        if not fit:
            return out
        k = max(fit, key=lambda k: (slot_bytes[k], -k))
        of[hi].remove(k)
        out[k] = new
        load[hi] -= slot_bytes[k]
        room -= slot_bytes[k]


def rebalance_slots(slot_map: dict[int, int], slot_bytes: dict[int, int], n_shards: int,
                    tolerance: float = 0.01) -> dict[int, int]:
    """Edit a map whose slots have grown unevenly: move slots from the fullest to the
    emptiest shard while that narrows a gap of more than ``tolerance`` of the mean."""
    out = dict(slot_map)
    load, of = _loads(out, slot_bytes, n_shards)
    while True:
        hi, lo = max(range(n_shards), key=lambda x: (load[x], -x)), min(range(n_shards), key=lambda x: (load[x], x))
        gap = load[hi] - load[lo]
        fit = [k for k in of[hi] if 0 < slot_bytes.get(k, 0) < gap]
        if not fit or gap <= tolerance * sum(load) / n_shards:
            return out
        k = min(fit, key=lambda k: (abs(gap / 2 - slot_bytes[k]), k))
        of[hi].remove(k)
        of[lo].append(k)
        out[k] = lo
        load[hi] -= slot_bytes[k]
        load[lo] += slot_bytes[k]


def _loads(slot_map, slot_bytes, n_shards):
    """Bytes and slots of each shard."""
    load, of = [0] * n_shards, {sh: [] for sh in range(n_shards)}
    for slot, sh in slot_map.items():
        load[sh] += slot_bytes.get(slot, 0)
        of[sh].append(slot)
    return load, of


class SlotMap:
    """Versions of the slot-to-shard map, each a folder ``v=<n>`` of at most n_slots rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Finished versions; a half-written one has no _SUCCESS file and is skipped."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names
                      if n.startswith("v=") and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def write(self, slot_map: dict[int, int]) -> int:
        v = max(self.versions(), default=0) + 1
        rows = self.spark.createDataFrame(sorted(slot_map.items()), "vslot int, shard int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={v}")
        return v

    def read(self, version: int | None = None) -> DataFrame:
        v = version or max(self.versions())
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/v={v}")

    def as_dict(self, version: int | None = None) -> dict[int, int]:
        return {r.vslot: r.shard for r in self.read(version).collect()}


COPIES = 16         # equal rows beyond this are dealt over the slots


def with_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Narrow rows: id, size (UTF-8 bytes plus overhead; null text: overhead alone), crc, virtual slot.

    The slot is a hash of the whole record (id, checksum, size), so a repeated
    id with different texts spreads. Rows that are equal more than ``COPIES``
    times hash with their row's number too: equal rows may change places, so
    any deal of them is right, and no slot holds them all. The rows are written
    once, so every reader sees one deal.
    """
    s = Scratch(df.sparkSession, "slots")
    text = F.col(text_col).cast("binary")
    rows = (df.select(F.col(id_col).alias("id"),
                      (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long").alias("size"),
                      F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("crc"),
                      F.monotonically_increasing_id().alias("row")))
    rows = s.put(rows.withColumn("vslot", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(n_slots)).cast("int")), "rows")
    many = s.put(rows.groupBy("id", "crc", "size").count().filter(F.col("count") > COPIES)
                 .select(F.col("id").alias("m_id"), F.col("crc").alias("m_crc"), F.col("size").alias("m_size")), "copies")
    if many.isEmpty():
        return rows.drop("row")
    same = (F.col("id").eqNullSafe(F.col("m_id")) & (F.col("crc") == F.col("m_crc")) & (F.col("size") == F.col("m_size")))
    dealt = F.pmod(F.xxhash64("id", "crc", "size", "row"), F.lit(n_slots)).cast("int")
    return rows.join(many, same, "left").select("id", "size", "crc", F.when(F.col("m_size").isNull(), F.col("vslot"))
                                                .otherwise(dealt).alias("vslot"))


def slot_totals(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most n_slots rows reach the driver."""
    rows = slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.vslot: (r.b, r.n) for r in rows}


def shard_documents(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                    n_slots: int = N_SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """Return per row: ``id_col``, size, text_crc32, vslot, shard, slot.

    ``shard`` comes from the newest version of ``slot_map`` (written balanced
    by bytes when it has none). ``slot`` is the record's place in its shard,
    gapless from 0: the rows in the shard's earlier virtual slots, plus the
    row's rank in its own. No task holds more than one virtual slot at a time.
    Null or empty texts have size 8 and checksum 0; repeated rows get places
    of their own; an empty table gives no rows; other columns aren't read.
    """
    spark = df.sparkSession
    slotted = with_slots(df, id_col, text_col, n_slots)
    totals = slot_totals(slotted)
    if slot_map is None:
        import uuid
        slot_map = SlotMap(spark, f"{shared_dir(spark)}/llm-slot-map-{uuid.uuid4().hex[:12]}")
    if not slot_map.versions():
        slot_map.write(spread_slots({k: b for k, (b, _) in totals.items()}, n_slots, n_shards))
    places, filled = [], [0] * n_shards
    for vslot, shard in sorted(slot_map.as_dict().items()):
        places.append((vslot, shard, filled[shard]))
        filled[shard] += totals.get(vslot, (0, 0))[1]
    places = F.broadcast(spark.createDataFrame(places, "vslot int, shard int, before long"))   # n_slots rows
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("id", "crc", "size")) - 1
    return (slotted.withColumn("rank", rank).join(places, "vslot")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "vslot", "shard",
                    (F.col("before") + F.col("rank")).cast("long").alias("slot")))
