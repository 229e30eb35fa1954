"""Queries that run the store and the container parsers themselves over the driver's tables.

Each query builds its policy's store anew, so what it costs doesn't depend on queries before it: all
documents and transcripts are ingested, encrypted and wrapped, one subject is erased, and the query looks at
what the keys that are left can open.  Their DuckDB SQL is written from the policies' definitions and shares no text with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import columns as C
from lethe.operators.store import Store, StoreConfig
from lethe.plans import scratch
from lethe.plans.registry import BASE
from lethe.sources import containers, mapping

#: Policy: wrap mode, mixed policy, and who is erased; src1 has no mixed files.
POLICIES = {
    "or_wrap": ("or-wrap", "or-wrap", "src0"),
    "and_wrap": ("and-wrap", "or-wrap", "src0"),
    "copy_out": ("or-wrap", "copy-out-mixed", "src0"),
    "drop": ("or-wrap", "drop-for-both", "src0"),
    "drop_unmixed": ("or-wrap", "drop-for-both", "src1"),
}
HOLDS = (("h1", "src1", None, None), ("h2", None, "t3", None), ("h3", None, None, "doc/7"), ("h4", "src2", "t0", None))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, subject, snapshot_id, path, data, file_class; documents are unique but those that ``identical`` finds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("subject"), F.concat(F.lit("t"), F.expr("doc_id div 12")).alias("snapshot_id"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("data"),
    )
    talks = mapping.transcripts(spark, sf_dir).select("conv_id", "data", F.posexplode("roles").alias("k", "role"))
    talks = talks.select(
        (F.lit(mapping.MIXED_FROM) + F.col("conv_id") * 10 + F.col("k")).cast("long").alias("seq"), F.when(F.col("role") == mapping.TOKEN, mapping.ERASED).otherwise(F.col("role")).alias("subject"),
        F.lit("chat").alias("snapshot_id"), F.concat(F.lit("chat/"), F.col("conv_id")).alias("path"), "data", F.lit("mixed").alias("file_class"),
    )
    return docs.withColumn("file_class", F.lit("unique")).unionByName(talks)


def identical(pieces: DataFrame) -> DataFrame:
    """seq, file_class of the documents of a log's pieces that are identical: another subject has one of their pieces."""
    several = pieces.groupBy("fp").agg((F.min("subject") != F.max("subject")).alias("several")).where("several").select("fp")
    return pieces.where("file_class <> 'mixed'").join(several, "fp", "left_semi").select("seq").distinct().withColumn("file_class", F.lit("identical"))


def store(spark: SparkSession, sf_dir: str, policy: str) -> Store:
    """A policy's store after its erasure; ``held``: no sharing, live holds, and an erasure that they defer."""
    wrap, mixed, erased = POLICIES.get(policy, ("no-cross-user", "never-share", "src1"))
    redactor = (lambda data, subject: C.strip_lines(data, F.lit(mapping.TOKEN))) if mixed == "copy-out-mixed" else None
    made = Store(spark, scratch.new_path(spark, "store"), StoreConfig(wrap, mixed, redactor))
    made.ingest(log(spark, sf_dir), relabel=identical)
    if policy == "held":
        for name, subject, snapshot_id, path in HOLDS:
            made.hold(name, subject=subject, snapshot_id=snapshot_id, path=path)
    made.erase(erased)
    return made


def _restored(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: store(spark, sf_dir, policy).files().select("subject", "snapshot_id", "path", "ok", "unrestorable", "reason", F.sha2("data", 256).alias("data_sha256"))


def _leftover(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: store(spark, sf_dir, policy).leftover().groupBy(F.sha2("plain", 256).alias("fp")).agg(F.count("*").alias("chunks"))


def _space(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: store(spark, sf_dir, policy).stats()


def restore_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store(spark, sf_dir, "held").files()
    return found.select("subject", "snapshot_id", "path", "ok", "reason", "contains_erased_subject", "flagged", F.sha2("data", 256).alias("data_sha256"))


def store_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "held").pins()


def store_chunk_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = store(spark, sf_dir, "held")
    return held.chunk_pins().join(held.tables.read("fp_index"), "chunk_id").groupBy("file_class", "fp").agg(F.sum("pins").alias("pins"))


def store_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an empty store would refuse if every document were labelled unique."""
    rows = log(spark, sf_dir).where("file_class <> 'mixed'").select("seq", "subject", "path", F.lit("unique").alias("file_class"), F.explode(C.piece_structs("data")).alias("p"))
    return Store(spark, scratch.new_path(spark, "store")).conflicts(rows.select("seq", "subject", "path", "file_class", "p.fp")).select("seq", "path", "fp")


def store_class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "held").class_mix()


def mailbox_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a mailbox, a message for each turn; every fifth turn is the system's too."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    owners = F.concat(F.col("role"), F.when(F.col("turn") % 5 == 0, ", system").otherwise(""))
    message = F.concat(F.lit("From "), "role", F.lit("@example.org Mon Jan  1 00:00:00 2024\nX-Backup-Subject: "), owners, F.lit("\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("From "), F.lit("from ")), F.lit("\n\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    boxes = turns.groupBy(F.concat(F.lit("conv"), "conv_id", F.lit(".mbox")).alias("container")).agg(F.array_join(ordered, "").cast("binary").alias("data"))
    return containers.mbox(boxes).select("path", "subject", "file_class", F.sha2("data", 256).alias("data_sha256"))


def photo_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a photo named after its host, with the site's address as its bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    site = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    files = pages.select(F.concat(F.lit("album/"), "page_id", F.lit("-"), site, F.lit(".jpg")).alias("path"), site.cast("binary").alias("data"))
    return containers.photos(files, ("th", "er")).select("path", "subject", "file_class", F.sha2("data", 256).alias("data_sha256"))


_PIECES = "select {keep}, i as pos, substr(hex({data}), i * 8192 + 1, 8192) as hx from (select *, unnest(range(0, greatest(1, (octet_length({data}) + 4095) // 4096))) as i from {of})"
_ROWS = f"""with talks as ({BASE["talks"]}), owned as ({BASE["owned"]}),
    rows as (select doc_id as seq, source as subject, 't' || (doc_id // 12) as snapshot_id, 'doc/' || doc_id as path, encode(coalesce(text, '')) as data, null::blob as cut from documents
        union all select seq, subject, snapshot_id, path, data, cut from owned),
    bit as (select seq, subject, pos, sha256(unhex(hx)) as fp, length(hx) // 2 as n from ({_PIECES.format(keep="seq, subject", data="data", of="rows")})),
    popular as (select fp from bit group by fp having count(distinct subject) > 1),
    file as (select r.*, case when cut is not null then 'mixed' when exists (select 1 from bit b join popular p on b.fp = p.fp where b.seq = r.seq) then 'identical' else 'unique' end as file_class from rows r),
    shard as (select sha256(unhex(hx)) as fp, length(hx) // 2 as n, subject from ({_PIECES.format(keep="subject", data="cut", of="(select * from file where cut is not null)")}))"""


def _state(policy: str) -> str:
    """chunk: each stored chunk with whether keys open it after the erasure; made: chunks that the erasure makes."""
    wrap, mixed, erased = POLICIES[policy]
    own = "null" if mixed == "or-wrap" else "case when f.file_class = 'mixed' then b.seq * 100000 + b.pos end"
    dead = "bool_or(b.subject = 'ERASED')" if wrap == "and-wrap" else "bool_and(b.subject = 'ERASED')"
    if mixed != "or-wrap" and policy != "drop_unmixed":
        dead = f"({dead} or f.file_class = 'mixed')"
    made = "select fp, n from shard where subject <> 'ERASED'" if mixed == "copy-out-mixed" else "select fp, n from shard where false"
    return (_ROWS + f""", chunk as (select f.file_class, b.fp, {own} as own, max(b.n) as n, not {dead} as live from bit b join file f using (seq) group by f.file_class, b.fp, {own}),
    made as ({made})""").replace("ERASED", erased)  # fmt: skip


def _restored_sql(policy: str) -> str:
    wrap, mixed, erased = POLICIES[policy]
    lost = "file_class = 'mixed'" if mixed == "drop-for-both" and policy != "drop_unmixed" else "false"
    copied = "file_class = 'mixed'" if mixed == "copy-out-mixed" else "false"
    gone = f"exists (select 1 from bit b join chunk c on b.fp = c.fp and c.file_class = v.file_class and not c.live where b.seq = v.seq)" if wrap == "and-wrap" else "false"  # noqa: F541
    return (
        _state(policy)
        + f""", v as (select * from file qualify row_number() over (partition by subject, snapshot_id, path order by seq desc) = 1),
        judged as (select *, case when subject = '{erased}' then 'recipe-erased' when {copied} then 'copy-out' when {lost} then 'immutable-mixed' when {gone} then 'missing-key' else '' end as reason from v)
        select subject, snapshot_id, path, reason in ('', 'copy-out') as ok, reason = 'immutable-mixed' as unrestorable, reason, case when reason = 'copy-out' then sha256(cut) when reason = '' then sha256(data) end as data_sha256 from judged"""
    )


_PINNED = "(values ('h1', 'src1', null, null), ('h2', null, 't3', null), ('h3', null, null, 'doc/7'), ('h4', 'src2', 't0', null)) as h(id, s, t, p)"
_PINNED_ON = "coalesce(h.s, f.subject) = f.subject and coalesce(h.t, f.snapshot_id) = f.snapshot_id and coalesce(h.p, f.path) = f.path"
_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "restore_bytes_roundtrip": restore_bytes_roundtrip,
    "store_pins": store_pins,
    "store_chunk_pins": store_chunk_pins,
    "store_conflicts": store_conflicts,
    "store_class_mix": store_class_mix,
    "mailbox_members": mailbox_members,
    "photo_members": photo_members,
}
ORACLES: dict[str, str] = {
    "restore_bytes_roundtrip": _ROWS + """, v as (select * from file qualify row_number() over (partition by subject, snapshot_id, path order by seq desc) = 1),
        marked as (select *, subject = 'src1' or file_class = 'mixed' as carries from file),
        groups as (select subject, snapshot_id, bool_or(carries) as flagged from marked group by all)
        select v.subject, v.snapshot_id, path, true as ok, '' as reason, v.subject = 'src1' or file_class = 'mixed' as contains_erased_subject, flagged, sha256(data) as data_sha256 from v join groups g on v.subject = g.subject and v.snapshot_id = g.snapshot_id""",
    "store_pins": _ROWS + f" select f.subject, count(*) as pins from file f join {_PINNED} on {_PINNED_ON} group by f.subject",
    "store_chunk_pins": _ROWS + f" select f.file_class, b.fp, count(*) as pins from file f join {_PINNED} on {_PINNED_ON} join bit b on b.seq = f.seq group by f.file_class, b.fp",
    "store_conflicts": _ROWS + ", own as (select b.seq, b.subject, b.fp, f.path from bit b join file f using (seq) where f.cut is null) select distinct seq, path, fp from own a where exists (select 1 from own e where e.fp = a.fp and e.subject <> a.subject and e.seq < a.seq)",
    "store_class_mix": _ROWS + " select k.file_class, (select count(*) from file f where f.file_class = k.file_class) as files from (values ('unique'), ('identical'), ('mixed')) as k(file_class)",
    "mailbox_members": """with msg as (select 'conv' || conv_id || '.mbox' as box, row_number() over (partition by conv_id order by turn) - 1 as i, trim(replace(coalesce(text, ''), 'From ', 'from '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
            case when turn % 5 = 0 then [role, 'system'] else [role] end as who from conversations),
        alone as (select box, body from msg where len(who) = 1 group by box, body having count(distinct who[1]) > 1)
        select box || '/msg/' || i || case when len(who) > 1 then '' else '/' || who[1] end as path, unnest(who) as subject, case when len(who) > 1 then 'mixed' when (box, body) in (select (box, body) from alone) then 'identical' else 'unique' end as file_class, sha256(body) as data_sha256 from msg""",
    "photo_members": f"""with shot as (select 'photos/album/' || page_id || '-' || site || '.jpg' as path, site, page_id || '-' || lower(site) as stem from (select page_id, {_SITE} as site from pages)),
        seen as (select *, list_filter(['th', 'er'], lambda x: contains(stem, x)) as named from shot),
        judged as (select *, len(named) > 1 or contains(stem, 'group') as mixed from seen),
        copies as (select site from judged where not mixed group by site having count(*) > 1)
        select path, unnest(case when len(named) > 0 then named when mixed then ['th', 'er'] else ['th'] end) as subject, case when mixed then 'mixed' when site in (select site from copies) then 'identical' else 'unique' end as file_class, sha256(site) as data_sha256 from judged""",
}
for _name in POLICIES:
    QUERIES |= {f"store_restored_{_name}": _restored(_name), f"store_leftover_{_name}": _leftover(_name), f"store_space_{_name}": _space(_name)}
    ORACLES |= {
        f"store_restored_{_name}": _restored_sql(_name),
        f"store_leftover_{_name}": _state(_name) + " select fp, count(*) as chunks from (select fp from chunk where live union all select fp from made) group by fp",
        f"store_space_{_name}": _state(_name) + """ select (select sum(n + 16) from chunk) + coalesce((select sum(n + 16) from made), 0) as physical_bytes, coalesce((select sum(n + 16) from chunk where live), 0) + coalesce((select sum(n + 16) from made), 0) as live_bytes,
            (select count(*) from chunk) + (select count(*) from made) as n_chunks, (select count(*) from chunk where live) + (select count(*) from made) as n_live_chunks, (select count(*) from file) as n_recipes""",
    }
