"""Stored tables with a key, changed by commits.

A table is a folder of Parquet pieces and a row of version files.  A version names the pieces that make up each part (a day
of the table's time column, or a bucket of its key), oldest first; where a key is in several, the newest piece counts.  A writer
adds a piece with the rows it changes, then creates the next version file, which fails if another writer was faster; it goes
on if that one touched other parts, else it starts again from what the other left.  So a reader always sees one whole version,
a writer that dies leaves nothing that is ever read, and no write is lost.  A part of many pieces is folded into one.

``once=(writer, batch number)`` makes a commit idempotent: the version remembers the last batch of every writer.  With
``feed=True`` the rows before and after the change are kept too, with ``feed="updates"`` those of known keys only; see
:meth:`StoredTable.changes`.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpulse.plans.per_key import first_per_key
from revpulse.sources.files import Folder
from revpulse.sources.warehouse import use_shared_checkpoints

PART = "stored_part"
_GONE, _PIECE, _BEFORE = "__gone", "__piece", "__before"
TRIES = 20


def held(df: DataFrame) -> DataFrame:
    """Computed once, in the shared checkpoint folder."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution for a piece of work.  A stream runs its batches in a session of its own that has it off, and without it Spark
    ignores the rebalance hint: every task would write a file for each part it has a row of."""
    name = "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _write(rows: DataFrame, path: str) -> None:
    """One piece: each part in as few files as its size allows."""
    with adaptive(rows.sparkSession):
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(path)


class Conflict(Exception):
    """Another writer has changed the same part since the version this write started from."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    schema: str | None = None
    parts: dict[str, list[str]] = field(default_factory=dict)  # part -> pieces, oldest first
    rows: dict[str, int | None] = field(default_factory=dict)  # part -> rows; None after a put, until it is folded
    newest: dict[str, str] = field(default_factory=dict)  # part -> greatest time, as text
    updates: int = 0  # keys that this version changed or took out
    touched: list[str] = field(default_factory=list)  # parts that differ from the version before
    done: dict[str, int] = field(default_factory=dict)  # writer -> its last batch
    feed: str | None = None  # piece with the images of this version's changes
    at: str = ""

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class StoredTable:
    """``time`` (a column of the key, or one that a key never changes) parts the table by day; without it the key does, by ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], *, time: str | None = None, buckets: int = 16, most_pieces: int = 8):
        self.spark, self.path, self.keys, self.time = spark, path.rstrip("/"), list(keys), time
        self.buckets, self.most_pieces = buckets, most_pieces
        self.folder = Folder(spark, self.path)

    # --- versions ---------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json") and not n.startswith(".")]

    def version(self, number: int | None = None) -> Version | None:
        """The newest version or the one asked for; None before the first commit."""
        if number is None:
            number = max(self._numbers(), default=0)
        return Version(**json.loads(self.folder.read(f"versions/{number:012d}.json"))) if number else None

    def _commit(self, base: Version | None, build: Callable[[Version], Version], touched: Iterable[str], once: tuple[str, int] | None) -> Version:
        touched, base = set(touched), base or Version()
        while True:
            new = replace(build(base), number=base.number + 1, touched=sorted(touched), at=dt.datetime.now(dt.timezone.utc).isoformat())
            if once:
                new = replace(new, done={**base.done, once[0]: once[1]})
            if self.folder.create(f"versions/{new.number:012d}.json", json.dumps(asdict(new))):
                return new
            kept = set(self._numbers())
            between = range(base.number + 1, max(kept) + 1)
            if not kept.issuperset(between):
                raise Conflict(f"versions after {base.number} of {self.path} are gone")
            others = [self.version(n) for n in between]
            if any(touched & set(v.touched) for v in others) or once and others[-1].done.get(once[0], -1) >= once[1]:
                raise Conflict(f"{self.path} was changed since version {base.number}")
            base = others[-1]

    def retry(self, attempt: Callable[[Version | None], Version | None]) -> Version | None:
        """Calls ``attempt`` with the newest version until no other writer gets in between."""
        for left in reversed(range(TRIES)):
            try:
                return attempt(self.version())
            except Conflict:
                if not left:
                    raise
        return None

    # --- reading ----------------------------------------------------------------------

    def part(self) -> Column:
        if self.time:
            return F.coalesce(F.date_format(self.time, "yyyy-MM-dd"), F.lit("none"))
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def read(self, parts: Callable[[str], bool] | Iterable[str] | None = None, version: Version | None = None) -> DataFrame | None:
        """The rows of one version, of all parts or those asked for; None before the first commit.  Other parts are not even listed."""
        version = version or self.version()
        if version is None:
            return None
        wanted = parts if callable(parts) else (lambda p, some=None if parts is None else set(parts): some is None or p in some)
        single, several = [], []
        for part, pieces in sorted(version.parts.items()):
            if wanted(part):
                (single if len(pieces) == 1 else several).extend(f"{self.path}/data/{piece}/{PART}={part}" for piece in pieces)
        columns = version.struct().names
        schema = T.StructType([*version.struct().fields, T.StructField(_GONE, T.BooleanType())])
        there = ~F.coalesce(_GONE, F.lit(False))
        out = []
        if single:
            out.append(self.spark.read.schema(schema).parquet(*single).where(there).select(*columns))
        if several:
            rows = self.spark.read.schema(schema).parquet(*several)
            place = rf"/data/([^/]+)/{PART}=([^/]+)/"
            rows = rows.withColumns({_PIECE: F.regexp_extract("_metadata.file_path", place, 1), PART: F.regexp_extract("_metadata.file_path", place, 2)})
            out.append(first_per_key(rows, [PART, *self.keys], [F.desc(_PIECE)]).where(there).select(*columns))
        if not out:
            return self.spark.createDataFrame([], version.struct())
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def changes(self, after: int = 0, upto: int | None = None) -> DataFrame | None:
        """(version, changed_at, kind, *key, before, after) of the commits with a feed; ``kind`` is insert, update or delete."""
        numbers = [n for n in self._numbers() if n > after and (upto is None or n <= upto)]
        return self.changes_of([v for v in map(self.version, numbers) if v.feed])

    def changes_of(self, versions: Sequence[Version]) -> DataFrame | None:
        if not versions:
            return None
        struct = versions[-1].struct()
        schema = T.StructType([*[struct[k] for k in self.keys], T.StructField("before", struct), T.StructField("after", struct)])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/changes/{v.feed}" for v in versions])
        names = self.spark.createDataFrame([(v.feed, v.number, v.at) for v in versions], "feed string, version long, at string")
        rows = rows.withColumn("feed", F.regexp_extract("_metadata.file_path", "/changes/([^/]+)/", 1)).join(F.broadcast(names), "feed")  # a row a commit
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return rows.select("version", F.to_timestamp("at").alias("changed_at"), kind.alias("kind"), *self.keys, "before", "after")

    def commit_of(self, once: tuple[str, int]) -> Version | None:
        """The version in which a writer's batch was committed."""
        found = None
        for v in map(self.version, reversed(self._numbers())):
            if v.done.get(once[0], -1) < once[1]:
                break
            found = v
        return found if found and found.done[once[0]] == once[1] else None

    def stats(self) -> dict:
        """Version, parts, pieces, rows (None if not known) and the newest time, from the version file alone."""
        v = self.version() or Version()
        rows = None if None in v.rows.values() else sum(v.rows.values())
        return {"version": v.number, "parts": len(v.parts), "pieces": sum(map(len, v.parts.values())), "rows": rows, "newest": max(v.newest.values(), default=None)}

    # --- writing ----------------------------------------------------------------------

    def _known(self, once: tuple[str, int] | None, base: Version | None) -> bool:
        return bool(once and base and base.done.get(once[0], -1) >= once[1])

    def _piece(self, base: Version | None) -> str:
        return f"{(base.number if base else 0) + 1:012d}-{uuid.uuid4().hex}"  # names sort by commit within a part

    def upsert(self, batch: DataFrame, update_cols: Sequence[str] | None = None, *, newest: Sequence[Column] = (), defaults: dict | None = None,
               once: tuple[str, int] | None = None, feed: "bool | str" = False) -> Version | None:
        """Inserts new keys and sets ``update_cols`` (by default all) of known ones.

        A batch may carry only some columns: the others keep their stored value, and a new key gets ``defaults`` for them.  Of several
        batch rows with a key the first by ``newest`` counts.  ``batch`` is read more than once: hand in a held frame.  Rows that would change
        nothing are not written, and a batch without any other is no commit, unless ``once`` is to be remembered.
        """
        single = first_per_key(batch, self.keys, list(newest))
        return self.retry(lambda base: self.change(base, single, lambda old, new: self._images(old, new, update_cols, defaults or {}), once=once, feed=feed))

    def insert(self, batch: DataFrame, *, first: Sequence[Column] = (), once: tuple[str, int] | None = None, feed: "bool | str" = False) -> Version | None:
        """Adds the rows whose key the table does not hold."""
        single = first_per_key(batch, self.keys, list(first))
        return self.retry(lambda base: self.change(base, single, lambda old, new: self._images(old, new, [], {}), once=once, feed=feed))

    def delete(self, keys: DataFrame, *, once: tuple[str, int] | None = None, feed: "bool | str" = False) -> Version | None:
        """Takes rows out by key; with ``time`` that column has to be in ``keys`` too, as it tells the part."""
        def images(old, new):
            before = F.struct(*old.columns)
            return old.join(new.select(*self.keys).distinct(), self.keys, "left_semi").select(*old.columns, before.alias(_BEFORE), F.lit(True).alias(_GONE))
        return self.retry(lambda base: self.change(base, keys, images, once=once, feed=feed))

    def put(self, rows: DataFrame, *, once: tuple[str, int] | None = None, base: "Version | None | str" = "newest") -> Version | None:
        """Whole rows, one per key, that replace those of the same key.  Nothing stored is read, and ``rows`` is computed once; how many rows a
        part has is not known until it is folded.  A column ``__gone`` may mark keys to take out.

        ``base`` may name the version that ``rows`` were derived from (None: there was none); another writer's change of a part since
        is a :class:`Conflict` then.
        """
        def attempt(start: Version | None) -> Version | None:
            if self._known(once, start):
                return start
            struct = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != _GONE])
            piece = self._piece(start)
            seen = Observation()
            told = rows.observe(seen, F.max(self.time).cast("string").alias("newest")) if self.time else rows
            _write(told.withColumn(PART, self.part()), f"{self.path}/data/{piece}")
            parts = [n.partition("=")[2] for n in self.folder.names(f"data/{piece}") if n.startswith(f"{PART}=")]
            if not parts and not (once and start):
                return start
            newest = {seen.get["newest"][:10]: seen.get["newest"]} if self.time and parts and seen.get.get("newest") else {}  # of the last day only

            def build(v: Version) -> Version:
                return replace(v, schema=v.schema or struct.json(), feed=None, updates=0, parts={**v.parts, **{p: [*v.parts.get(p, []), piece] for p in parts}},
                               rows={**v.rows, **{p: None for p in parts}}, newest={**v.newest, **{p: max(filter(None, [v.newest.get(p), t])) for p, t in newest.items() if t}})

            return self._folded(self._commit(start, build, parts, once), parts)

        return self.retry(attempt) if base == "newest" else attempt(base)

    def _folded(self, done: Version, parts: Iterable[str]) -> Version:
        full = [p for p in parts if len(done.parts[p]) > self.most_pieces]
        if full:
            self.fold(full)
        return done

    def _images(self, old: DataFrame, new: DataFrame, update_cols: Sequence[str] | None, defaults: dict) -> DataFrame:
        """What the rows of ``new`` turn into, with the row before; those that stay as they are left out."""
        names = old.columns
        update = [c for c in names if c not in self.keys] if update_cols is None else list(update_cols)
        incoming = new.select(*self.keys, *[F.col(c).alias(f"__new_{c}") for c in new.columns if c not in self.keys and c in names])
        joined = incoming.join(old.select(*self.keys, F.struct(*names).alias(_BEFORE)), self.keys, "left")
        known = F.col(_BEFORE).isNotNull()
        after = []
        for f in old.schema.fields:
            if f.name in self.keys:
                after.append(F.col(f.name))
                continue
            given = f"__new_{f.name}" in incoming.columns
            value = F.col(f"__new_{f.name}").cast(f.dataType) if given else F.lit(defaults.get(f.name)).cast(f.dataType)
            kept = F.col(f"{_BEFORE}.{f.name}")
            after.append((value if given and f.name in update else F.when(known, kept).otherwise(value)).alias(f.name))
        rows = joined.select(*after, _BEFORE)
        same = F.lit(True)
        for c in update:
            same = same & F.col(c).eqNullSafe(F.col(f"{_BEFORE}.{c}"))
        return rows.where(F.col(_BEFORE).isNull() | ~same).withColumn(_GONE, F.lit(False))

    def change(self, base: Version | None, batch: DataFrame, images: Callable[[DataFrame, DataFrame], DataFrame], *, once: tuple[str, int] | None = None,
               feed: "bool | str" = False) -> Version | None:
        """One attempt from version ``base``: ``images(stored, batch)`` gives the changed rows, each with ``__before`` and ``__gone``."""
        if self._known(once, base):
            return base
        parts = None  # a batch meets nearly every bucket
        if self.time:
            parts = [r[0] for r in batch.select(self.part().alias("p")).distinct().collect()]
            if not parts and not (once and base):
                return base
        stored = self.read(parts, base) if base else batch.limit(0)
        struct = T.StructType([T.StructField(f.name, f.dataType) for f in stored.schema.fields])
        changed = held(images(stored, batch).withColumn(PART, self.part()))
        gone, fresh = F.col(_GONE), F.col(_BEFORE).isNull()
        told = changed.groupBy(PART).agg(F.sum(F.when(gone, -1).when(fresh, 1).otherwise(0)).alias("more"), F.count_if(~fresh).alias("updates"),
                                         (F.max(self.time).cast("string") if self.time else F.lit(None).cast("string")).alias("newest")).collect()
        if not told and base and not once:
            return base
        piece = self._piece(base)
        if told:
            _write(changed.drop(_BEFORE), f"{self.path}/data/{piece}")
            fed = feed is True or feed == "updates" and any(r["updates"] for r in told)
            if fed:
                after = F.when(~gone, F.struct(*struct.names))
                (changed if feed is True else changed.where(~fresh)).select(*self.keys, F.col(_BEFORE).alias("before"), after.alias("after")).write.parquet(f"{self.path}/changes/{piece}")

        def build(v: Version) -> Version:
            return replace(
                v, schema=v.schema or struct.json(), feed=piece if told and fed else None, updates=sum(r["updates"] for r in told),
                parts={**v.parts, **{r[PART]: [*v.parts.get(r[PART], []), piece] for r in told}},
                rows={**v.rows, **{r[PART]: None if v.rows.get(r[PART], 0) is None else v.rows.get(r[PART], 0) + r["more"] for r in told}},
                newest={**v.newest, **{r[PART]: max(filter(None, [v.newest.get(r[PART]), r["newest"]])) for r in told if r["newest"]}})

        return self._folded(self._commit(base, build, [r[PART] for r in told], once), [r[PART] for r in told])

    def _rewrite(self, base: Version, parts: Sequence[str], rows: DataFrame, once: tuple[str, int] | None = None) -> Version:
        """Replaces whole parts by ``rows``; a part that is left without any goes."""
        piece, struct = self._piece(base), base.struct()
        rows = held(rows.select(*struct.names).withColumn(PART, self.part()))
        told = {r[PART]: r for r in rows.groupBy(PART).agg(F.count("*").alias("n"), (F.max(self.time).cast("string") if self.time else F.lit(None).cast("string")).alias("newest")).collect()}
        if told:
            _write(rows, f"{self.path}/data/{piece}")

        def build(v: Version) -> Version:
            keep = lambda d: {p: x for p, x in d.items() if p not in parts}
            return replace(v, feed=None, updates=0, parts={**keep(v.parts), **{p: [piece] for p in told}}, rows={**keep(v.rows), **{p: r["n"] for p, r in told.items()}},
                           newest={**keep(v.newest), **{p: r["newest"] for p, r in told.items() if r["newest"]}})

        return self._commit(base, build, parts, once)

    def fold(self, parts: Sequence[str]) -> Version | None:
        """Makes one piece of each part.  If another writer is faster the pieces stay for the next time."""
        base = self.version()
        try:
            return self._rewrite(base, parts, self.read(parts, base))
        except Conflict:
            return base

    def move_older(self, cutoff: str, archive: "StoredTable | None" = None) -> int:
        """Takes the rows before ``cutoff`` out, into ``archive`` if one is given; returns how many.

        Whole days leave the version without being read; only the day of the cutoff is written again.  The archive takes the rows by key before
        they go, so doing it again after a failure between the two adds nothing twice.
        """
        moved = 0

        def attempt(base: Version | None) -> Version | None:
            nonlocal moved
            moved = 0
            if base is None:
                return None
            last = cutoff[:10]
            old = [p for p in base.parts if p < last]  # "none" sorts behind every date
            edge = self.read([last], base) if last in base.parts else None
            late = F.col(self.time) < F.lit(cutoff).cast(base.struct()[self.time].dataType)
            few = held(edge.where(late)) if edge is not None else None
            n = few.count() if few is not None else 0
            moved = sum(self.read([p], base).count() if base.rows[p] is None else base.rows[p] for p in old) + n
            if not moved:
                return base
            if archive is not None:
                out = self.read(old, base) if old else few
                archive.insert(held(out if few is None or not old else out.unionByName(few)))
            if n:
                return self._rewrite(base, [*old, last], edge.where(~F.coalesce(late, F.lit(False))))
            return self.drop_parts(base, old)

        self.retry(attempt)
        return moved

    def drop_parts(self, base: Version, parts: Sequence[str]) -> Version:
        """A version without these parts; no row is read."""
        keep = lambda d: {p: x for p, x in d.items() if p not in parts}
        return self._commit(base, lambda v: replace(v, feed=None, updates=0, parts=keep(v.parts), rows=keep(v.rows), newest=keep(v.newest)), parts, None)

    def vacuum(self, versions: int = 20, hours: float = 24.0) -> list[str]:
        """Removes all but the last ``versions`` version files, and pieces that none of these names and no writer of the last ``hours`` can be
        about to commit; returns the pieces removed.  Readers of older versions must have ended."""
        numbers = self._numbers()
        for n in numbers[:-versions]:
            self.folder.remove(f"versions/{n:012d}.json")
        kept = [self.version(n) for n in numbers[-versions:]]
        used = {p for v in kept for pieces in v.parts.values() for p in pieces} | {v.feed for v in kept}
        gone = []
        for kind in ("data", "changes"):
            for piece in self.folder.names(kind):
                if piece not in used and self.folder.age(f"{kind}/{piece}") >= hours * 3600:
                    self.folder.remove(f"{kind}/{piece}")
                    gone.append(f"{kind}/{piece}")
        return gone
