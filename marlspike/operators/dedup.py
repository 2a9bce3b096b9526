"""Messages delivered more than once: exactly one copy of each is kept.

``copy_groups`` says which rows are copies, ``first_copies`` keeps one row per
group by a mergeable aggregate, and ``MessageStore`` keeps a partitioned table
of single copies up to date as batches arrive.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.cells import stripped

_ROW = "__row"
_KEY = "__key"
_IDENT = "__ident"
_PART = "__part"

#: A partition made of more folders than this is rewritten by the next merge.
MAX_FOLDERS = 8


def message_ident(token: Column, ident: Column) -> tuple[Column, Column]:
    """(cleaned token, cleaned id) of a message; a blank one is null."""
    return stripped(token), stripped(ident)


def _keyed(token: Column, ident: Column | None, order: list[Column]) -> tuple[Column, Column]:
    """(key, id): rows of one key are copies whatever else is known.

    The key is the token, else the id, else the row's own ``order`` values.
    """
    t = stripped(token)
    i = stripped(ident) if ident is not None else F.lit(None).cast("string")
    own = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\0")) for c in order])
    key = F.coalesce(F.concat(F.lit("t"), t), F.concat(F.lit("i"), i), F.concat(F.lit("r"), own))
    return key, i


def _settled(keyed: DataFrame) -> DataFrame:
    """(key, id, row, winner) per key, from rows of (key, id, row); ``row`` may be null for keys known from before.

    A key's rows are copies. So are all keys of an id that has a row without a
    token (its key starts with 'i'). ``winner`` is the least row of the group.
    All aggregates are partial before the shuffle; groups meet their winner by a
    join, never in one task.
    """
    nameless = F.col(_KEY).startswith("i")
    one = keyed.groupBy(_KEY).agg(F.min(_IDENT).alias(_IDENT), F.min(_ROW).alias(_ROW), F.max(nameless).alias("__open"))
    # filtered by an aggregate, so that the three branches share one exchange
    opened = one.filter("__open").select(F.col(_IDENT).alias("__home"))
    home = F.coalesce(F.col(_IDENT), F.col(_KEY))
    apart = one.join(opened, home == F.col("__home"), "left_anti")
    together = one.join(opened, home == F.col("__home"))
    best = together.groupBy(F.col("__home").alias("__of")).agg(F.min(_ROW).alias("winner"))
    together = together.join(best, F.col("__home") == F.col("__of"))
    return apart.select(_KEY, _IDENT, _ROW, F.col(_ROW).alias("winner")).unionAll(together.select(_KEY, _IDENT, _ROW, "winner"))


def first_copies(rows: DataFrame, token: Column, ident: Column | None, order: list[Column], keep: list[Column]) -> DataFrame:
    """One row (the columns ``keep``) per group of copies: the least by ``order``.

    Rows are copies if their tokens are equal; if a row's token is missing, all
    rows with its ``ident`` are copies of it. A token belongs to one ident: rows
    of a token count under the least ident that stands with it, a missing ident
    beside a token that has one elsewhere is no difference. Rows without token
    and ident (without ``ident``: without token) are groups of their own,
    told apart by ``order``, which therefore ends with something unique.
    Null ``order`` values stand first, as Spark sorts them.

    All steps are min aggregates with partial results before the shuffle: a
    group that holds a third of all rows leaves each task as a single row. No
    group is ever put into one task as rows.
    """
    key, i = _keyed(token, ident, order)
    row = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], F.struct(*keep).alias("kept"))
    picked = rows.select(key.alias(_KEY), i.alias(_IDENT), row.alias(_ROW))
    winners = picked.groupBy(_KEY).agg(F.min(_IDENT).alias(_IDENT), F.min(_ROW).alias(_ROW))
    if ident is not None:
        bare = stripped(token)
        opened = rows.filter(bare.isNull() & stripped(ident).isNotNull()).select(stripped(ident).alias("__home")).distinct()
        home = F.coalesce(F.col(_IDENT), F.col(_KEY))
        group = F.coalesce(F.concat(F.lit("i"), F.col("__home")), F.col(_KEY))
        winners = winners.join(opened, home == F.col("__home"), "left").groupBy(group.alias(_KEY)).agg(F.min(_ROW).alias(_ROW))
    return winners.select(f"{_ROW}.kept.*")


def copies_removed(rows: DataFrame, kept: DataFrame, row_id: str) -> DataFrame:
    """Ids of ``rows`` that ``kept`` lacks; ids are unique, so no key is hot."""
    return rows.select(row_id).join(kept.select(row_id), row_id, "left_anti")


class MessageStore:
    """A folder of single copies that batches are merged into.

    Data lie in partitions by the winner's period. Beside the rows lies the
    identifier index: one entry (key, id, partition) for every token and every
    id without token that was ever seen, kept or not, always in the partition of
    its group's winner; an entry without a row marks a copy that lost. So
    nothing about a group is forgotten: batches may be merged in any steps and
    give what ``first_copies`` gives on all rows at once.

    ``merge`` looks the batch's identifiers up in the index (these columns of
    the live partitions), reads only the partitions that hold one of them,
    recomputes the winners of these and the batch together, writes new versions
    of only those partitions with their index entries in one pass, and makes all
    of them visible at once by renaming one manifest file. Until then readers
    see the earlier state; a failed merge leaves files nobody refers to. The
    index holds what is live and nothing of earlier versions; a partition that
    late rows were added to ``MAX_FOLDERS`` times is rewritten as one.

    The manifest is the only thing on the driver: one entry per partition, that
    is per period (days, not rows).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifest ---------------------------------------------------------------

    def _versions(self) -> list[int]:
        folder = self._Path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        """{'parts': {partition: [folders]}, 'schema': ...} as last committed."""
        found = self._versions()
        if not found:
            return {"parts": {}, "schema": None}
        stream = self._fs.open(self._Path(f"{self.path}/manifest-{found[-1]:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict, version: int) -> None:
        part, final = (self._Path(f"{self.path}/{n}{version:08d}.json") for n in (".writing-", "manifest-"))
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError(f"another merge committed version {version} of {self.path}")

    # reads ------------------------------------------------------------------

    def _entries(self, m: dict, parts: list[str]) -> DataFrame:
        """Index entries with their rows (null for lost copies) of some partitions, as merges wrote them."""
        row = T.StructType.fromJson(json.loads(m["schema"]))
        shape = T.StructType(
            [T.StructField(_KEY, T.StringType()), T.StructField(_IDENT, T.StringType()), T.StructField(_ROW, row), T.StructField(_PART, T.StringType())]
        )
        folders = [f for p in parts for f in m["parts"][p]]
        if not folders:
            return self.spark.createDataFrame([], shape)
        out = None
        # versions are read below their own base folder, so that the partition's text comes back as a column
        for base in sorted({f.rsplit("/", 1)[0] for f in folders}):
            mine = [f for f in folders if f.startswith(f"{base}/")]
            some = self.spark.read.schema(shape).option("basePath", base).parquet(*mine)
            out = some if out is None else out.unionAll(some)
        return out

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """All single copies, or those of some partitions; an empty store has no columns yet."""
        m = self.manifest()
        wanted = [p for p in (m["parts"] if parts is None else parts) if p in m["parts"]]
        if m["schema"] is None:
            return self.spark.createDataFrame([], T.StructType())
        return self._entries(m, wanted).filter(F.col(_ROW).isNotNull()).select(f"{_ROW}.*")

    # merge ------------------------------------------------------------------

    def merge(self, batch: DataFrame, token: str, ident: str | None, order: list[str], period: Column) -> dict:
        """Merge a batch; returns {'read': partitions read, 'written': partitions written}.

        ``period`` gives the partition (text) of a row. Ordering and copies are
        those of ``first_copies``; ``order`` ends with the row's unique id. A
        null period is the partition 'none'. An empty batch changes nothing, nor
        does a batch merged again, rows without token and id included.
        """
        m, version = self.manifest(), (self._versions() or [0])[-1] + 1
        if m["schema"] is None:
            m["schema"] = batch.schema.json()
        fields = T.StructType.fromJson(json.loads(m["schema"])).names
        key, i = _keyed(F.col(token), F.col(ident) if ident else None, [F.col(c) for c in order])
        arriving = batch.select(key.alias(_KEY), i.alias(_IDENT), F.struct(*fields).alias("new"))
        touched = self._touched(m, arriving)
        as_row = F.struct(*[F.col(f"new.{c}").alias(f"o{n}") for n, c in enumerate(order)], F.col("new").alias("kept"))
        rows = arriving.select(_KEY, _IDENT, as_row.alias(_ROW))
        if touched:
            old = self._entries(m, touched).withColumnRenamed(_ROW, "new")
            rows = rows.unionAll(old.select(_KEY, _IDENT, F.when(F.col("new").isNotNull(), as_row).alias(_ROW)))
        settled = _settled(rows)
        won = F.col(_ROW).isNotNull() & (F.col(_ROW) == F.col("winner"))
        out = settled.select(
            _KEY, _IDENT, F.when(won, F.col(f"{_ROW}.kept")).alias("new"), F.col("winner.kept").alias("first"),
        )
        place = out.select(_KEY, _IDENT, F.col("new").alias(_ROW), "first.*")
        placed = place.select(_KEY, _IDENT, _ROW, F.coalesce(period, F.lit("none")).alias(_PART))
        data = f"{self.path}/data/v{version:08d}"
        # large periods are split and small ones put together by their measured sizes
        placed.hint("rebalance", _PART).write.partitionBy(_PART).parquet(data)
        # the partition's text is what the folder is named, with Hive's escapes
        written = {}
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for status in self._fs.listStatus(self._Path(data)):
            name = status.getPath().getName()
            if name.startswith(f"{_PART}="):
                written[unescape(name[len(_PART) + 1 :])] = f"{data}/{name}"
        for part in touched:
            m["parts"].pop(part, None)
        for part, made in written.items():
            m["parts"].setdefault(part, []).append(made)
        self._commit(m, version)
        return {"read": sorted(touched), "written": sorted(written)}

    def _touched(self, m: dict, arriving: DataFrame) -> list[str]:
        """Partitions that hold a group of the batch's tokens or ids; as many as periods come back at most."""
        if not m["parts"]:
            return []

        def idents(df: DataFrame, *more: str) -> DataFrame:
            known = F.array(F.col(_KEY), F.concat(F.lit("i"), F.col(_IDENT)))
            return df.select(*more, F.explode(F.array_compact(F.array_distinct(known))).alias("x"))

        index = idents(self._entries(m, list(m["parts"])).select(_KEY, _IDENT, _PART), _PART)
        hit = index.join(idents(arriving).distinct(), "x", "left_semi").select(_PART).distinct().collect()
        found = {r[0] for r in hit}
        if not found and not arriving.limit(1).count():
            return []
        return sorted(found | {p for p, folders in m["parts"].items() if len(folders) >= MAX_FOLDERS})

    def vacuum(self) -> int:
        """Delete versions no partition refers to any more; returns how many. Readers of earlier states must have ended."""
        live = {f for folders in self.manifest()["parts"].values() for f in folders}
        gone = 0
        root = self._Path(f"{self.path}/data")
        for base in self._fs.listStatus(root) if self._fs.exists(root) else []:
            for status in self._fs.listStatus(base.getPath()):
                where = f"{self.path}/data/{base.getPath().getName()}/{status.getPath().getName()}"
                if status.isDirectory() and where not in live:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone
