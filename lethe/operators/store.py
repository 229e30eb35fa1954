"""The backup store: ingest, restore, holds, erasure, the attacker's view and space statistics.

Recipes and encrypted chunks are only ever appended.  Data keys exist only wrapped by their owners'
keys; wraps, keys and fingerprints live in tables whose old files are deleted on every change, so
erasing a subject makes their chunks unreadable while the chunk log stays as it is.

An ingest reads its files twice: once for the fingerprints of their pieces, and once to write the chunks
that are new.  Chunk ids and data keys are HMACs of a piece's place with a key that only this process has,
so a piece is packed and encrypted where it is read, and only files with a piece stored elsewhere are shuffled, encrypted.
Payloads are packed pieces, encrypted; ``n_bytes`` and all statistics count the bytes of the pieces themselves.
Scratch tables hold fingerprints and encrypted chunks, and are deleted at the end, after an error too.
Wraps and keys are appended; only an erasure rewrites them.  One writer at a time: a change on top of another's raises RuntimeError.

Choices where the specification and older behaviour differ: pins are derived from live holds at any
time, so a recipe ingested after a hold is pinned too; a hold id is used once; with ``spec_holds``
another person's hold also defers what would destroy the held file; a second erasure redacts the
current copy-out; fingerprints are shredded with their chunks; while a subject's erasure is pending,
ingesting for them is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as Win

from lethe.functions import columns as C
from lethe.plans import scratch
from lethe.sources.tables import Tables

Redactor = Callable[[Column, Column], Column]


def of_bytes(function: Callable[[bytes, str], bytes]) -> Callable[[bytes, str], bytes]:
    """Mark a plain function of a file's bytes and a subject as a redactor."""
    function.of_bytes = True
    return function


@dataclass(frozen=True)
class StoreConfig:
    wrap_mode: str = "or-wrap"
    mixed_policy: str = "never-share"
    redactor: Redactor | Callable[[bytes, str], bytes] | None = None
    spec_holds: bool = True
    #: Mixed files that an erasure copies out or drops: ``all`` of other subjects, or those ``touching`` a chunk of the subject's.
    scope: str = "all"

    def __post_init__(self) -> None:
        C.one_of(self.wrap_mode, C.WRAP_MODES, "wrap_mode")
        C.one_of(self.mixed_policy, C.MIXED_POLICIES, "mixed_policy")
        C.one_of(self.scope, ("all", "touching"), "scope")


class Store:
    """A store in a folder; the folder is made on the first change."""

    def __init__(self, spark: SparkSession, root: str, config: StoreConfig | None = None) -> None:
        self.spark, self.config, self.tables = spark, config or StoreConfig(), Tables(spark, root)

    # -- ingest ---------------------------------------------------------------------------------

    def ingest_file(self, subject: str, snapshot_id: str, path: str, data: bytes, file_class: str) -> None:
        C.one_of(file_class, C.CLASSES, "file_class")
        rows = [(0, subject, snapshot_id, path, bytearray(data), file_class)]
        self.ingest(self.spark.createDataFrame(rows, "seq long, subject string, snapshot_id string, path string, data binary, file_class string"))

    def conflicts(self, chunks: DataFrame) -> DataFrame:
        """Chunks labelled unique that another subject owns or ingested before; chunks: seq, subject, path, file_class, fp."""
        owned = self.tables.read("fp_index").join(self.tables.read("wraps"), "chunk_id").select("fp", F.col("subject").alias("owner")).distinct()
        unique = chunks.where("file_class = 'unique'").select("seq", "subject", "path", "fp").distinct()
        stored = unique.join(owned, "fp").where("owner <> subject").select("seq", "path", "fp")
        # the first owner of a fingerprint, and the first row of anybody else
        first = chunks.groupBy("fp").agg(F.min(F.struct("seq", "subject")).alias("first"))
        tagged = chunks.join(first, "fp")
        other = tagged.where("subject <> first.subject").groupBy("fp").agg(F.min("seq").alias("other_seq"))
        before = unique.join(first, "fp").join(other, "fp", "left")
        batch = before.where("(subject <> first.subject and first.seq < seq) or (subject = first.subject and other_seq < seq)").select("seq", "path", "fp")
        return stored.union(batch).distinct()

    def ingest(self, rows: DataFrame, *, relabel: Callable[[DataFrame], DataFrame] | None = None, state: dict | None = None) -> None:
        """Append files (seq, subject, snapshot_id, path, data, file_class); seq gives their order.

        ``relabel`` makes of the files' pieces (seq, subject, file_class, fp) a table of (seq, file_class) of those
        files that have another class than ``rows`` say.  ``rows`` must be the same each time they are read.

        Raises ValueError, with nothing written, if a class is unknown, a seq is null or repeated, a
        unique file is somebody else's too, or a subject's erasure is pending.
        """
        with scratch.scope(), self.tables.staging():
            self._ingest(rows, relabel, state)

    def _ingest(self, rows: DataFrame, relabel: Callable[[DataFrame], DataFrame] | None, state: dict | None) -> None:
        t, secret = self.tables, C.place_secrets()
        base = t.state.get("next_recipe", 0)
        rows = rows.withColumn("recipe_id", F.col("seq") + base)
        chunks = scratch.table(self._sealed(rows, secret).drop("payload"), "pieces").withColumn("moved", F.lit(False))
        if relabel is not None:
            labels = scratch.table(relabel(chunks.select("seq", "subject", "file_class", "fp")).select("seq", F.col("file_class").alias("label")), "labels")
            chunks = chunks.join(labels, "seq", "left").withColumns({"file_class": F.coalesce("label", "file_class"), "moved": F.col("label").isNotNull()})
        files = chunks.where("pos = 0")
        unknown = files.where(~F.coalesce(F.col("file_class").isin(*C.CLASSES), F.lit(False))).select("file_class").first()
        if unknown:
            raise ValueError(f"file_class must be one of {', '.join(C.CLASSES)}, not {unknown[0]!r}")
        if waits := files.join(t.read("pending"), "subject", "left_semi").select("subject").first():
            raise ValueError(f"the erasure of {waits[0]!r} is pending")
        if twice := files.groupBy("seq").count().where("count > 1 or seq is null").select("seq").first():
            raise ValueError(f"seq must be unique, {twice[0]} isn't")
        if lied := self.conflicts(chunks.select("seq", "subject", "path", "file_class", "fp")).orderBy("seq").first():
            raise ValueError(f"unique label conflict: {lied['path']!r} holds content of another subject")
        placed, made = self._place(chunks.withColumn("share", C.shares("file_class", self.config.wrap_mode, self.config.mixed_policy)))
        body = placed.groupBy("recipe_id", "subject", "snapshot_id", "path", "file_class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"), F.sum("n").cast("long").alias("n_bytes"))
        recipes = t.stage("recipes", body)
        body = t.read_file("recipes", recipes)
        flags = body.select("recipe_id", F.lit(False).alias("erased"), F.lit(False).alias("unrestorable"))
        wraps, keys = self._wrapped(body.select(F.explode("chunk_ids").alias("chunk_id"), "subject"), made, secret)
        append = {"recipes": recipes, "recipe_flags": t.stage("recipe_flags", flags), "chunk_log": self._stage_new(rows, chunks, made, secret), "fp_index": t.stage("fp_index", made), "wraps": t.stage("wraps", wraps), "subject_keys": keys}
        top = chunks.agg(F.max("recipe_id")).first()[0]
        t.commit(append=append, state={"next_recipe": base if top is None else top + 1} | (state or {}))

    def _sealed(self, rows: DataFrame, secret: Callable[[Column], Column]) -> DataFrame:
        """One row for each piece of ``data``, with its position, fingerprint, length n, encrypted payload, and the chunk id it has if it is stored."""
        cut = rows.select("*", F.posexplode(C.pieces("data")).alias("pos", "plain")).withColumn("secret", secret(self._spot()))
        id_ = F.lower(F.hex(F.substring("secret", 33, 16)))
        return cut.select(*[c for c in rows.columns if c != "data"], "pos", C.fingerprint("plain").alias("fp"), F.octet_length("plain").cast("long").alias("n"), id_.alias("chunk_id"), F.aes_encrypt(C.pack("plain"), F.substring("secret", 1, 32)).alias("payload"))

    @staticmethod
    def _spot() -> Column:
        return F.concat_ws(":", F.col("recipe_id").cast("string"), F.col("pos").cast("string")).cast("binary")

    def _place(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks with the ids of what they are stored as; the chunks that are new, each at the first of its places."""
        usable = self.tables.read("fp_index").join(self._live_wraps().select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("fp", "file_class").agg(F.min("chunk_id").alias("old_id"))
        keyed = chunks.join(usable, ["fp", "file_class"], "left").withColumn("old_id", F.when(F.col("share"), F.col("old_id")))
        keyed = keyed.withColumn("own", F.when(~F.col("share"), F.concat_ws(":", F.col("recipe_id").cast("string"), F.col("pos").cast("string"))).otherwise(F.lit("")))
        first = F.min(F.struct("recipe_id", "pos", "chunk_id", "n")).alias("first")
        made = scratch.table(keyed.where("old_id is null").groupBy("fp", "file_class", "own").agg(first).select("fp", "file_class", "own", "first.*"), "new-chunks")
        placed = keyed.drop("chunk_id").join(made.select("fp", "file_class", "own", "chunk_id"), ["fp", "file_class", "own"], "left").withColumn("chunk_id", F.coalesce("old_id", "chunk_id"))
        return placed.select("recipe_id", "subject", "snapshot_id", "path", "file_class", "pos", "chunk_id", "n"), made

    def _stage_new(self, rows: DataFrame, chunks: DataFrame, made: DataFrame, secret: Callable[[Column], Column]) -> str:
        """Write the payloads of the new chunks; only files with a piece that is stored elsewhere, or of another class, are looked up."""
        here = made.select("recipe_id", "pos", F.lit(True).alias("here"))
        apart = chunks.join(here, ["recipe_id", "pos"], "left").where("here is null or moved").select("recipe_id")
        mask = F.broadcast(self._mask(apart, "recipe_id"))
        asked = C.in_mask("recipe_id")
        found = made.join(mask, asked, "left_semi").select("chunk_id", F.col("file_class").alias("label")).hint("shuffle_hash")
        some = self._sealed(rows.join(mask, asked, "left_semi"), secret).join(found, "chunk_id").withColumn("file_class", F.col("label"))
        names = ["chunk_id", "fp", "file_class", "payload", F.col("n").alias("n_bytes")]
        new = self._sealed(rows.join(mask, asked, "left_anti"), secret).select(names).union(some.select(names))
        total = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_id", "fp", "file_class", "n_bytes")).alias("sum")]
        seen = Observation()
        staged = self.tables.stage("chunk_log", new.observe(seen, *total))
        wanted = made.withColumn("n_bytes", F.col("n")).agg(*total).first()
        if (seen.get["n"], seen.get["sum"]) != (wanted["n"], wanted["sum"]):
            raise RuntimeError("the files changed while they were ingested")
        return staged

    @staticmethod
    def _mask(ids: DataFrame, column: str) -> DataFrame:
        """The mask of a column of ids; both are written."""
        return scratch.table(C.mask(scratch.table(ids, "mask-ids"), column), "mask")

    def _wrapped(self, owned: DataFrame, made: DataFrame, secret: Callable[[Column], Column]) -> tuple[DataFrame, str]:
        """New wraps of owned chunks (chunk_id, subject); the staged file of new subjects' keys."""
        t = self.tables
        known = t.read("subject_keys").where("key is not null")
        missing = owned.select("subject").distinct().join(known, "subject", "left_anti")
        staged = t.stage("subject_keys", missing.select("subject", C.random_key().alias("key")))
        keys = known.union(t.read_file("subject_keys", staged))
        wanted = owned.distinct().join(t.read("wraps"), ["chunk_id", "subject"], "left_anti")
        old = wanted.select("chunk_id").distinct().join(self._live_wraps(), "chunk_id").withColumn("dek", F.expr("try_aes_decrypt(wrapped, key)")).where("dek is not null").groupBy("chunk_id").agg(F.min("dek").alias("dek"))
        fresh = wanted.join(made.select("chunk_id", "recipe_id", "pos"), "chunk_id").withColumn("dek", F.substring(secret(self._spot()), 1, 32))
        opened = fresh.select("chunk_id", "subject", "dek").union(wanted.join(old, "chunk_id").select("chunk_id", "subject", "dek"))
        return opened.join(keys, "subject").select("chunk_id", "subject", F.aes_encrypt("dek", "key").alias("wrapped")), staged

    def _live_wraps(self) -> DataFrame:
        """Wraps whose owner's key is there, with the key."""
        return self.tables.read("wraps").join(self.tables.read("subject_keys").where("key is not null"), "subject")

    # -- restore --------------------------------------------------------------------------------

    def _assembled(self, wanted: DataFrame, *, few: bool = False) -> DataFrame:
        """recipe_id and the file's packed pieces (null if any chunk can't be read) of (recipe_id, subject, chunk_ids).

        Payloads are sent twice and not sorted for a join; unpacking them would undo how the rows are dealt, so it comes last.  ``few``: only those that may be wanted are sent.
        """
        log = self.tables.read("chunk_log").select("chunk_id", "payload")
        if few:
            mask = F.broadcast(self._mask(wanted.select(F.explode("chunk_ids").alias("chunk_id")), "chunk_id"))
            log = log.join(mask, C.in_mask("chunk_id"), "left_semi")
        opened = self._opened(wanted).where("dek is not null").hint("shuffle_hash").join(log, "chunk_id").withColumn("packed", F.expr("try_aes_decrypt(payload, dek)"))
        whole = opened.groupBy("recipe_id").agg(F.expr("listagg(packed) within group (order by pos)").alias("packed"), (F.count("packed") == F.max("pieces")).alias("all"))
        return whole.select("recipe_id", F.when(F.col("all"), F.col("packed")).alias("packed"))

    def _opened(self, wanted: DataFrame) -> DataFrame:
        """recipe_id, pos, chunk_id, data key (null if lost) and the file's number of pieces of each chunk of (recipe_id, subject, chunk_ids); no payload is read."""
        chunks = wanted.select("recipe_id", "subject", F.size("chunk_ids").alias("pieces"), F.posexplode("chunk_ids").alias("pos", "chunk_id"))
        keyed = chunks.join(self._live_wraps(), ["chunk_id", "subject"], "left")
        return keyed.select("recipe_id", "pos", "chunk_id", F.expr("try_aes_decrypt(wrapped, key)").alias("dek"), "pieces")

    def files(self, subject: str | None = None, snapshot_id: str | None = None) -> DataFrame:
        """The last file of each path: subject, snapshot_id, path, data, ok, unrestorable, contains_erased_subject, reason, flagged.

        ``flagged`` is true where any version of the subject's snapshot holds a subject whose erasure is pending.
        """
        t = self.tables
        recipes = t.read("recipes")
        for name, value in (("subject", subject), ("snapshot_id", snapshot_id)):
            recipes = recipes if value is None else recipes.where(F.col(name) == value)
        copies = t.read("copyouts").select("recipe_id", F.col("chunk_ids").alias("copy_ids"))
        held = self._held_recipes(recipes).select("recipe_id", F.lit(True).alias("held"))
        pending = t.read("pending").select(F.col("subject").alias("waits"))
        rows = recipes.join(t.read("recipe_flags"), "recipe_id").join(copies, "recipe_id", "left").join(held, "recipe_id", "left")
        rows = rows.join(pending, F.col("subject") == F.col("waits"), "left").withColumn("held", F.coalesce("held", F.lit(False)))
        reason = F.when(F.col("copy_ids").isNotNull(), "copy-out").when(F.col("erased") & ~F.col("held"), "recipe-erased").when(F.col("unrestorable"), "immutable-mixed").otherwise("")
        rows = rows.withColumn("reason", reason).withColumn("chunk_ids", F.when(F.col("reason") == "copy-out", F.col("copy_ids")).when(F.col("reason") == "", F.col("chunk_ids")))
        waiting = not t.read("pending").isEmpty()
        carries = (F.col("reason") == "") & (F.col("waits").isNotNull() | F.lit(waiting) & (F.col("file_class") == "mixed"))
        one = Win.partitionBy("subject", "snapshot_id", "path").orderBy(F.desc("recipe_id"))
        last = rows.withColumn("k", F.row_number().over(one)).where("k = 1")  # bytes of other versions are never read
        data = self._assembled(last.where("chunk_ids is not null").select("recipe_id", "subject", "chunk_ids"))
        last = last.hint("shuffle_hash").join(data, "recipe_id", "left").withColumn("contains_erased_subject", carries & F.col("packed").isNotNull())
        last = last.withColumn("reason", F.when((F.col("reason") == "") & F.col("packed").isNull(), "missing-key").otherwise(F.col("reason")))
        if waiting:
            keys = self._opened(rows.where(carries).select("recipe_id", "subject", "chunk_ids")).groupBy("recipe_id").agg((F.count("dek") == F.count("*")).alias("open"))
            flagged = rows.where(carries).join(keys.where("open"), "recipe_id").select("subject", "snapshot_id").distinct().withColumn("flagged", F.lit(True))
            last = last.join(flagged, ["subject", "snapshot_id"], "left")
        else:
            last = last.withColumn("flagged", F.lit(False))
        return last.select("subject", "snapshot_id", "path", C.unpack("packed").alias("data"), F.col("packed").isNotNull().alias("ok"), (F.col("reason") == "immutable-mixed").alias("unrestorable"), "contains_erased_subject", "reason", F.coalesce("flagged", F.lit(False)).alias("flagged"))

    def restore(self, subject: str, snapshot_id: str) -> DataFrame:
        """path, data, ok, unrestorable, contains_erased_subject, reason of a subject's snapshot."""
        return self.files(subject, snapshot_id).drop("subject", "snapshot_id", "flagged")

    def restore_flag(self, subject: str, snapshot_id: str) -> bool:
        row = self.files(subject, snapshot_id).agg(F.bool_or("flagged")).first()
        return bool(row[0])

    def bytes_for(self, subject: str, snapshot_id: str, path: str) -> bytes | None:
        row = self.restore(subject, snapshot_id).where(F.col("path") == path).select("data").first()
        return None if row is None or row[0] is None else bytes(row[0])

    # -- holds ----------------------------------------------------------------------------------

    def _live_holds(self) -> DataFrame:
        return self.tables.read("holds").where("released_seq is null")

    def _held_recipes(self, recipes: DataFrame) -> DataFrame:
        """Recipes under a live hold, with hold_id; a row for each hold."""
        return recipes.alias("r").join(self._live_holds().alias("h"), C.held("r", "h")).select("r.*", "h.hold_id")

    def pins(self) -> DataFrame:
        """subject and its number of pins: one for each recipe under each hold."""
        return self._held_recipes(self.tables.read("recipes")).groupBy("subject").agg(F.count("*").alias("pins"))

    def chunk_pins(self) -> DataFrame:
        """chunk_id and its number of pins: one for each of its places in each recipe under each hold."""
        return self._held_recipes(self.tables.read("recipes")).select(F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("pins"))

    def _step(self) -> int:
        return self.tables.state.get("step", 0) + 1

    def hold(self, hold_id: str, *, subject: str | None = None, snapshot_id: str | None = None, path: str | None = None) -> None:
        """Pin what matches all that is given; a hold of nothing pins nothing.  An id is used once."""
        if not self.tables.read("holds").where(F.col("hold_id") == hold_id).isEmpty():
            raise ValueError(f"the hold {hold_id!r} is there already")
        row = self.spark.createDataFrame([(hold_id, subject, snapshot_id, path, self._step(), None)], "hold_id string, subject string, snapshot_id string, path string, hold_seq long, released_seq long")
        self.tables.commit(append={"holds": self.tables.stage("holds", row)}, state={"step": self._step()})

    def release(self, hold_id: str) -> None:
        """End a hold, unknown ones too, and finish the pending erasures that nothing defers any more."""
        if self._live_holds().where(F.col("hold_id") == hold_id).isEmpty():
            return
        ended = F.when((F.col("hold_id") == hold_id) & F.col("released_seq").isNull(), F.lit(self._step())).otherwise(F.col("released_seq"))
        self.tables.commit(replace={"holds": self.tables.stage("holds", self.tables.read("holds").withColumn("released_seq", ended))}, state={"step": self._step()})
        for row in self.tables.read("pending").orderBy("requested_seq", "subject").collect():  # open erasures only: a short list
            if self._blocking(row["subject"]).isEmpty():
                self._finish(row["subject"])

    # -- erasure --------------------------------------------------------------------------------

    def _destroyed(self, subject: str) -> DataFrame:
        """Other subjects' recipes that the erasure of ``subject`` destroys or rewrites."""
        recipes = self.tables.read("recipes").where(F.col("subject") != subject)
        touched = self.tables.read("wraps").where(F.col("subject") == subject).select("chunk_id")
        if self.config.wrap_mode == "and-wrap":
            return recipes.withColumn("chunk_id", F.explode("chunk_ids")).join(touched, "chunk_id", "left_semi").select("recipe_id").distinct().join(recipes, "recipe_id")
        if self.config.mixed_policy in ("copy-out-mixed", "drop-for-both") and not touched.join(self.tables.read("chunk_log").where("file_class = 'mixed'"), "chunk_id", "left_semi").isEmpty():
            mixed = recipes.where("file_class = 'mixed'")
            if self.config.scope == "all":
                return mixed
            index = self.tables.read("fp_index")
            equal = index.join(touched.join(index, "chunk_id").select("fp").distinct(), "fp", "left_semi").select("chunk_id")
            return mixed.withColumn("chunk_id", F.explode("chunk_ids")).join(equal, "chunk_id", "left_semi").select("recipe_id").distinct().join(mixed, "recipe_id")
        return recipes.where("false")

    def _blocking(self, subject: str) -> DataFrame:
        """Ids of holds that defer the erasure of ``subject``."""
        found = self._held_recipes(self.tables.read("recipes").where(F.col("subject") == subject)).select("hold_id")
        if self.config.spec_holds:
            found = found.union(self._held_recipes(self._destroyed(subject)).select("hold_id"))
        return found.distinct()

    def erase(self, subject: str) -> None:
        """Make the subject's bytes unrecoverable, or queue that until no hold defers it."""
        blocking = self._blocking(subject)
        if blocking.isEmpty():
            self._finish(subject)
            return
        t, step = self.tables, self._step()
        held = self._held_recipes(t.read("recipes")).select("recipe_id").distinct().withColumn("held", F.lit(True))
        mine = t.read("recipes").where(F.col("subject") == subject).select("recipe_id").withColumn("mine", F.lit(True))
        flags = t.read("recipe_flags").join(mine, "recipe_id", "left").join(held, "recipe_id", "left")
        flags = flags.select("recipe_id", (F.col("erased") | (F.col("mine").isNotNull() & F.col("held").isNull())).alias("erased"), "unrestorable")
        queue = self.spark.createDataFrame([(subject, step)], "subject string, requested_seq long")
        first = t.read("pending").where(F.col("subject") == subject).isEmpty()
        window = blocking.agg(F.sort_array(F.collect_list("hold_id")).alias("holds")).select(F.lit(subject).alias("subject"), F.lit(True).alias("blocked"), "holds", F.lit(step).cast("long").alias("at_seq"), F.lit(None).cast("long").alias("ended_seq"))
        append = {"pending": t.stage("pending", queue), "windows": t.stage("windows", window)} if first else {}
        t.commit(append=append, replace={"recipe_flags": t.stage("recipe_flags", flags)}, state={"step": step})

    def _finish(self, subject: str) -> None:
        with scratch.scope(), self.tables.staging():
            self._shred(subject)

    def _shred(self, subject: str) -> None:
        t, config = self.tables, self.config
        wraps, index = t.read("wraps"), t.read("fp_index")
        touched = wraps.where(F.col("subject") == subject).select("chunk_id").distinct()
        left = wraps.where(F.col("subject") != subject)
        destroyed = self._destroyed(subject).select("recipe_id", "subject", "snapshot_id", "path", "chunk_ids")
        append, extra = {}, None
        copies = t.read("copyouts")
        drops = config.mixed_policy in ("copy-out-mixed", "drop-for-both") and config.wrap_mode != "and-wrap"
        if config.wrap_mode == "and-wrap":
            shredded = touched
        elif drops:
            recipes = destroyed
            if config.mixed_policy == "drop-for-both":
                recipes = destroyed.union(t.read("recipes").where((F.col("subject") == subject) & (F.col("file_class") == "mixed")).select(*destroyed.columns))
            now = recipes.join(copies.select("recipe_id", F.col("chunk_ids").alias("copied")), "recipe_id", "left").select("recipe_id", "subject", "snapshot_id", "path", F.coalesce("copied", "chunk_ids").alias("chunk_ids"))
            shredded = recipes.select(F.explode("chunk_ids").alias("chunk_id")).union(now.select(F.explode("chunk_ids").alias("chunk_id"))).distinct()
            if config.mixed_policy == "copy-out-mixed" and config.redactor is not None:
                whole = self._assembled(now, few=True).where("packed is not null").join(now.drop("chunk_ids"), "recipe_id")
                redacted = whole.withColumn("data", C.unpack("packed")).drop("packed").withColumn("data", self._redacted(subject)).withColumn("file_class", F.lit("unique"))
                secret = C.place_secrets()
                sealed = scratch.table(self._sealed(redacted, secret), "sealed-copies")
                placed, fresh = self._place(sealed.drop("payload").withColumn("share", F.lit(False)))
                made = placed.groupBy("recipe_id", "subject", "snapshot_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
                extra, _ = self._wrapped(placed.select("chunk_id", "subject"), fresh, secret)
                copies = copies.join(made.select("recipe_id"), "recipe_id", "left_anti").unionByName(made)
                append["chunk_log"] = t.stage("chunk_log", sealed.withColumnRenamed("n", "n_bytes"))
                index = index.unionByName(fresh.select("fp", "file_class", "chunk_id"))
            destroyed = recipes
        else:
            shredded, destroyed = touched.where("false"), destroyed.where("false")
        left = left.join(shredded, "chunk_id", "left_anti")
        left = left if extra is None else left.unionByName(extra)
        new_wraps = scratch.table(left, "erase-wraps")  # wrapped keys only
        flags = t.read("recipe_flags")
        mine = t.read("recipes").where(F.col("subject") == subject).select("recipe_id", F.lit(True).alias("mine"))
        gone = destroyed.select("recipe_id").distinct().withColumn("gone", F.lit(drops))
        flags = flags.join(mine, "recipe_id", "left").join(gone, "recipe_id", "left").select("recipe_id", (F.col("erased") | F.col("mine").isNotNull()).alias("erased"), (F.col("unrestorable") | F.coalesce("gone", F.lit(False))).alias("unrestorable"))
        keys = t.read("subject_keys").withColumn("key", F.when(F.col("subject") != subject, F.col("key")))
        waiting = t.read("pending")
        windows = t.read("windows").withColumn("ended_seq", F.when((F.col("subject") == subject) & F.col("ended_seq").isNull(), F.lit(self._step()).cast("long")).otherwise(F.col("ended_seq")))
        replace = {
            "wraps": t.stage("wraps", new_wraps), "fp_index": t.stage("fp_index", index.join(new_wraps.select("chunk_id"), "chunk_id", "left_semi")), "recipe_flags": t.stage("recipe_flags", flags), "subject_keys": t.stage("subject_keys", keys),
            "pending": t.stage("pending", waiting.where(F.col("subject") != subject)), "windows": t.stage("windows", windows), "copyouts": t.stage("copyouts", copies.where(F.col("subject") != subject)),
        }
        t.commit(append=append, replace=replace, state={"step": self._step()})

    def _redacted(self, subject: str) -> Column:
        """``data`` without the subject: by a function of columns, or by one of bytes and the subject's name."""
        redactor = self.config.redactor
        if getattr(redactor, "of_bytes", False):

            def run(rows: pd.Series) -> pd.Series:
                return rows.map(lambda data: redactor(bytes(data), subject))

            return F.pandas_udf(run, "binary")(F.col("data"))
        return redactor(F.col("data"), F.lit(subject))

    # -- views ----------------------------------------------------------------------------------

    def leftover(self, exclude_subject: str | None = None) -> DataFrame:
        """chunk_id and plain of every chunk that the keys left in the store can open."""
        wraps = self._live_wraps()
        wraps = wraps if exclude_subject is None else wraps.where(F.col("subject") != exclude_subject)
        opened = wraps.withColumn("dek", F.expr("try_aes_decrypt(wrapped, key)")).where("dek is not null").groupBy("chunk_id").agg(F.min("dek").alias("dek"))
        return opened.hint("shuffle_hash").join(self.tables.read("chunk_log"), "chunk_id").withColumn("packed", F.expr("try_aes_decrypt(payload, dek)")).where("packed is not null").select("chunk_id", C.unpack("packed").alias("plain"))

    def stats(self) -> DataFrame:
        """physical_bytes, live_bytes, n_chunks, n_live_chunks, n_recipes; payloads aren't read."""
        live = self._live_wraps().select("chunk_id").distinct().withColumn("live", F.lit(True))
        cost = F.col("n_bytes") + C.TAG_BYTES
        chunks = self.tables.read("chunk_log").select("chunk_id", "n_bytes").join(live, "chunk_id", "left")
        space = chunks.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("physical_bytes"), F.coalesce(F.sum(F.when(F.col("live"), cost)), F.lit(0)).alias("live_bytes"), F.count("*").alias("n_chunks"), F.count("live").alias("n_live_chunks"))
        return space.crossJoin(self.tables.read("recipes").agg(F.count("*").alias("n_recipes")))

    def class_mix(self) -> DataFrame:
        """Number of recipes of every class, 0 where there is none."""
        kinds = self.spark.createDataFrame([(c,) for c in C.CLASSES], "file_class string")
        return kinds.join(self.tables.read("recipes").groupBy("file_class").agg(F.count("*").alias("n")), "file_class", "left").select("file_class", F.coalesce("n", F.lit(0)).alias("files"))
