"""Name to query, and name to the DuckDB SQL with the same rows.

Many queries are one SQL text over a few relations.  Spark derives the relations with DataFrame
functions (``lethe.sources.mapping``), DuckDB with the common table expressions in ``BASE``.  Those of
space and restores are DataFrame functions (``lethe.plans.space``) and have SQL for DuckDB alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from lethe.operators import timeline
from lethe.plans import space
from lethe.plans.space import MODES
from lethe.sources import mapping

Query = Callable[[SparkSession, str], DataFrame]

_PIECES = "select {cols}, unnest(range(0, greatest(1, (octet_length(data) + 4095) // 4096))) as pos, hex(data) as hx from {of}"
BASE = {
    "docs": """select doc_id as seq, lang as tenant, source as subject, 't' || (doc_id // 12) as snapshot_id, 'doc/' || doc_id as path, encode(coalesce(text, '')) as data,
        case when min(source) over (partition by coalesce(text, '')) <> max(source) over (partition by coalesce(text, '')) then 'identical' else 'unique' end as file_class from documents""",
    "talks": "select conv_id, encode(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn)) as data, list_sort(list(distinct role)) as roles from conversations group by conv_id",
    "owned": f"""select {mapping.MIXED_FROM} + conv_id * 10 + k as seq, 'chat' as tenant, case when role = '{mapping.TOKEN}' then '{mapping.ERASED}' else role end as subject, 'chat' as snapshot_id, 'chat/' || conv_id as path, data,
        encode(array_to_string(list_filter(string_split(decode(data), chr(10)), lambda x: not contains(lower(x), '{mapping.TOKEN}')), chr(10))) as cut, 'mixed' as file_class
        from (select conv_id, data, unnest(roles) as role, unnest(range(0, len(roles))) as k from talks)""",
    "files": "select seq, tenant, subject, snapshot_id, path, data, file_class from docs union all select seq, tenant, subject, snapshot_id, path, data, file_class from owned",
    "log": "select seq, tenant, subject, snapshot_id, path, file_class, octet_length(data) as n_bytes from files",
    "chunk": f"select seq, tenant, subject, snapshot_id, path, file_class, pos, sha256(unhex(substr(hx, pos * 8192 + 1, 8192))) as fp, length(substr(hx, pos * 8192 + 1, 8192)) // 2 as n from ({_PIECES.format(cols='seq, tenant, subject, snapshot_id, path, file_class', of='files')})",
    "redacted": "select seq, subject, path, octet_length(data) as n_bytes, octet_length(cut) as n_redacted from owned",
    "redacted_chunk": f"select seq, subject, path, pos, sha256(unhex(substr(hx, pos * 8192 + 1, 8192))) as fp, length(substr(hx, pos * 8192 + 1, 8192)) // 2 as n from ({_PIECES.format(cols='seq, subject, path', of='(select seq, subject, path, cut as data from owned)')})",
    "modes": "select * from (values " + ", ".join(f"({i}, '{m}', '{w}', '{p}')" for i, (m, w, p) in enumerate(MODES)) + ") as t(ord, mode, wrap, policy)",
    "hold": "select * from (values ('h1', 'src0', 't0', null), ('h2', 'src1', null, null), ('h3', null, 't3', null), ('h4', null, null, 'doc/7'), ('h5', '', '', null), ('h6', 'src2', 't1', 'doc/22')) as t(hold_id, subject, snapshot_id, path)",
}
_NEEDS = {"owned": ["talks"], "files": ["docs", "owned", "talks"], "log": ["files"], "chunk": ["files"], "redacted": ["owned"], "redacted_chunk": ["owned"]}
RELATIONS: dict[str, Query] = {
    "log": lambda s, d: mapping.log(s, d).drop("pieces"),
    "chunk": lambda s, d: mapping.exploded(mapping.log(s, d)),
    "redacted": lambda s, d: mapping.conversations(s, d).select("seq", "subject", "path", "n_bytes", "n_redacted"),
    "redacted_chunk": lambda s, d: mapping.exploded(mapping.conversations(s, d), "redacted").select("seq", "subject", "path", "pos", "fp", "n"),
    "modes": lambda s, d: s.sql(BASE["modes"]),
    "hold": lambda s, d: s.sql(BASE["hold"]),
}


def _with(needed: list[str]) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    return "with " + ", ".join(f"{n} as ({BASE[n]})" for n in order) + " "


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _oracle(name: str, duck: str) -> None:
    """Register DuckDB SQL over ``{relation}`` names."""
    body = re.sub(r"\{(\w+)\}", r"\1", duck)
    prefix = _with(sorted(set(re.findall(r"\{(\w+)\}", duck))))
    ORACLES[name] = prefix + (", " + body.strip()[5:] if body.strip().lower().startswith("with ") else body)


def _both(name: str, sql: str, duck: str | None = None) -> None:
    """Register one SQL text for Spark, over ``{relation}`` names, and for DuckDB (or its own)."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{r: RELATIONS[r](spark, sf_dir) for r in used})

    QUERIES[name] = query
    _oracle(name, duck or sql)


E0 = mapping.ERASED
_SHARE = "case when file_class = 'unique' then true when file_class = 'identical' then wrap <> 'no-cross-user' else wrap <> 'no-cross-user' and policy = 'or-wrap' end"
_KEYED = f"""select mode, ord, wrap, policy, file_class, fp, n, subject, seq, case when {_SHARE} then 'shared' else concat(cast(seq as varchar(40)), ':', cast(pos as varchar(40))) end as own from {{chunk}} cross join {{modes}}"""
_PHYSICAL = "select ord, mode, wrap, policy, file_class, fp, own, max(n) + 16 as cost, max(case when subject = '" + E0 + "' then 1 else 0 end) as erased, max(case when subject <> '" + E0 + "' then 1 else 0 end) as others from keyed group by ord, mode, wrap, policy, file_class, fp, own"

_both("chunk_sizes", "select path, subject, pos, n from {chunk}")
_both("chunk_fingerprints", "select path, subject, pos, fp from {chunk}")
_both("dedup_first_occurrence", "select file_class, fp, min(seq) as first_seq, min_by(pos, struct(seq, pos)) as first_pos, count(*) as occurrences, max(n) as n from {chunk} group by file_class, fp", "select file_class, fp, min(seq) as first_seq, first(pos order by seq, pos) as first_pos, count(*) as occurrences, max(n) as n from {chunk} group by file_class, fp")
_both("owner_sets", "select file_class, fp, array_join(array_sort(collect_set(subject)), ',') as owners from {chunk} group by file_class, fp", "select file_class, fp, string_agg(distinct subject, ',' order by subject) as owners from {chunk} group by file_class, fp")
_both("owner_count_histogram", "select file_class, owners, count(*) as chunks, cast(sum(n) as bigint) as bytes from (select file_class, fp, count(distinct subject) as owners, max(n) as n from {chunk} group by file_class, fp) group by file_class, owners")
_both(
    "unique_label_conflicts",
    """select c.path, c.pos, c.subject, c.fp from {chunk} c join (select fp, min_by(subject, seq) as s1, min(seq) as q1 from {chunk} group by fp) f on c.fp = f.fp
       left join (select c.fp, min(c.seq) as q2 from {chunk} c join (select fp, min_by(subject, seq) as s1 from {chunk} group by fp) f on c.fp = f.fp and c.subject <> f.s1 group by c.fp) o on c.fp = o.fp
       where c.file_class = 'unique' and (c.subject <> f.s1 and f.q1 < c.seq or c.subject = f.s1 and o.q2 < c.seq)""",
    "select distinct c.path, c.pos, c.subject, c.fp from {chunk} c where c.file_class = 'unique' and exists (select 1 from {chunk} e where e.fp = c.fp and e.subject <> c.subject and e.seq < c.seq)",
)
_both("share_rule", f"select mode, file_class, {_SHARE} as share, count(*) as files from {{log}} cross join {{modes}} group by mode, file_class, {_SHARE}")
_both("class_mix", "select k.file_class, coalesce(n, 0) as files from (select 'unique' as file_class union all select 'identical' union all select 'mixed') k left join (select file_class, count(*) as n from {log} group by file_class) c on k.file_class = c.file_class")
_both("tenant_counts", "select tenant, count(*) as files from {log} group by tenant")
_both("byte_mix", "select file_class, bytes, round(bytes / greatest(sum(bytes) over (), 1), 4) as share from (select file_class, cast(sum(n_bytes) as bigint) as bytes from {log} group by file_class)", "select file_class, bytes, round(bytes / greatest(sum(bytes) over (), 1)::double, 4) as share from (select file_class, cast(sum(n_bytes) as bigint) as bytes from {log} group by file_class)")
_PIVOT = ", ".join(f"cast(coalesce(sum(case when file_class = '{c}' then n_bytes end), 0) as bigint) as {c}_bytes" for c in ("unique", "identical", "mixed"))
_both("tenant_class_pivot", f"select tenant, {_PIVOT} from {{log}} group by tenant")
_both("tenant_class_rollup", "select tenant, file_class, cast(sum(n_bytes) as bigint) as bytes, count(*) as files from {log} group by rollup(tenant, file_class)")
_STATS = "cast(sum(cost) as bigint) as physical_bytes, cast(sum(case when {live} then cost else 0 end) as bigint) as live_bytes, count(*) as n_chunks, cast(sum(case when {live} then 1 else 0 end) as bigint) as n_live_chunks"
_oracle("store_stats", f"with keyed as ({_KEYED}), phys as ({_PHYSICAL}) select mode, " + _STATS.replace("{live}", "true") + " from phys group by mode")
for _name, _mode, _live in (
    ("erase_live_or_wrap", "or-wrap", "others = 1"),
    ("erase_live_and_wrap", "and-wrap", "erased = 0"),
    ("erase_live_no_cross_user", "no-cross-user", "others = 1"),
    ("erase_live_drop", "drop-for-both", "others = 1 and file_class <> 'mixed'"),
):
    _oracle(_name, f"with keyed as ({_KEYED} where mode = '{_mode}'), phys as ({_PHYSICAL}) select file_class, " + _STATS.replace("{live}", _live) + " from phys group by file_class")
_oracle("erase_live_copy_out", f"with keyed as ({_KEYED} where mode = 'copy-out-mixed'), phys as ({_PHYSICAL}) select (select cast(sum(cost) as bigint) from phys where others = 1 and file_class <> 'mixed') as kept_bytes, (select cast(coalesce(sum(n + 16), 0) as bigint) from {{redacted_chunk}} where subject <> '{E0}') as copied_bytes, (select count(*) from {{redacted_chunk}} where subject <> '{E0}') as copied_chunks")
_LIVE_OF = "case when {p}wrap = 'and-wrap' then {p}erased = 0 when {p}policy in ('copy-out-mixed', 'drop-for-both') then {p}others = 1 and {p}file_class <> 'mixed' else {p}others = 1 end"
_LIVE = _LIVE_OF.replace("{p}", "")
_MODE_TABLE = f"""with keyed as ({_KEYED}), phys as ({_PHYSICAL}),
    copied as (select cast(coalesce(sum(n + 16), 0) as bigint) as bytes, count(*) as chunks from {{redacted_chunk}} where subject <> '{E0}'),
    total as (select ord, mode, policy, cast(sum(cost) as bigint) as before_bytes, cast(sum(case when {_LIVE} then cost else 0 end) as bigint) as after_bytes, count(*) as chunks, cast(sum(case when {_LIVE} then 1 else 0 end) as bigint) as live_chunks from phys group by ord, mode, policy),
    done as (select ord, mode, before_bytes as live_bytes_before, after_bytes + case when policy = 'copy-out-mixed' then bytes else 0 end as live_bytes_after, before_bytes + case when policy = 'copy-out-mixed' then bytes else 0 end as physical_bytes_after,
        live_chunks + case when policy = 'copy-out-mixed' then chunks_copied else 0 end as n_live_chunks_after, chunks + case when policy = 'copy-out-mixed' then chunks_copied else 0 end as n_chunks from total cross join (select bytes, chunks as chunks_copied from copied))"""
_oracle("mode_table", _MODE_TABLE + " select mode, live_bytes_before, live_bytes_after, physical_bytes_after, n_live_chunks_after, n_chunks from done")
_oracle("space_vs_never_share", _MODE_TABLE + " select d.mode, round(cast(d.live_bytes_before as double) / nullif(b.live_bytes_before, 0), 4) as ratio_before, round(cast(d.live_bytes_after as double) / nullif(b.live_bytes_after, 0), 4) as ratio_after from done d cross join (select * from done where mode = 'no-cross-user') b")
_both("affected_chunks", f"select file_class, fp, max(n) as n from {{chunk}} group by file_class, fp having max(case when subject = '{E0}' then 1 else 0 end) = 1")
_both("ownerless_chunks", f"select file_class, fp, max(n) as n from {{chunk}} group by file_class, fp having max(case when subject = '{E0}' then 1 else 0 end) = 1 and max(case when subject <> '{E0}' then 1 else 0 end) = 0")
_both("redact_transcripts", "select path, subject, n_bytes, n_redacted, n_bytes - n_redacted as dropped from {redacted}")
_both("copy_out_chunks", f"select path, subject, pos, fp, n from {{redacted_chunk}} where subject <> '{E0}'")
_both("mixed_leak_check", f"select c.path, c.subject, max(case when c.fp <> coalesce(r.fp, '') then 1 else 0 end) as has_erased_lines from {{chunk}} c left join {{redacted_chunk}} r on c.seq = r.seq and c.pos = r.pos where c.file_class = 'mixed' and c.subject <> '{E0}' group by c.path, c.subject")
_oracle("leftover_chunks", f"with keyed as ({_KEYED}), phys as ({_PHYSICAL}) select mode, file_class, count(*) as chunks, cast(sum(cost) as bigint) as bytes from phys where {_LIVE} group by mode, file_class")
_oracle(
    "restore_status",
    f"""with keyed as ({_KEYED}), phys as ({_PHYSICAL}),
        status as (select k.ord, k.mode, k.policy, k.wrap, k.seq, k.subject, k.file_class, min(case when {_LIVE_OF.replace("{p}", "p.")} then 1 else 0 end) as whole
            from keyed k join phys p on k.ord = p.ord and k.file_class = p.file_class and k.fp = p.fp and k.own = p.own group by k.ord, k.mode, k.policy, k.wrap, k.seq, k.subject, k.file_class)
        select mode, reason, count(*) as files from (select mode, case when subject = '{E0}' then 'recipe-erased' when file_class = 'mixed' and policy = 'copy-out-mixed' then 'copy-out' when file_class = 'mixed' and policy = 'drop-for-both' then 'immutable-mixed' when whole = 1 then '' else 'missing-key' end as reason from status) group by mode, reason""",
)
_both("restore_latest_version", "select subject, tenant, max(seq) as seq, max_by(path, seq) as path, max_by(n_bytes, seq) as n_bytes from {log} group by subject, tenant")
_MATCH = "(nullif(h.subject, '') is null or h.subject = r.subject) and (nullif(h.snapshot_id, '') is null or h.snapshot_id = r.snapshot_id) and (nullif(h.path, '') is null or h.path = r.path) and coalesce(nullif(h.subject, ''), nullif(h.snapshot_id, ''), nullif(h.path, '')) is not null"
_both("hold_matches", f"select h.hold_id, r.subject, r.snapshot_id, r.path from {{log}} r join {{hold}} h on {_MATCH}", f"select h.hold_id, r.subject, r.snapshot_id, r.path from {{log}} r join {{hold}} h on {_MATCH}")
_both("hold_pins", f"select r.subject, count(*) as pins, count(distinct h.hold_id) as holds from {{log}} r join {{hold}} h on {_MATCH} group by r.subject", f"select r.subject, count(*) as pins, count(distinct h.hold_id) as holds from {{log}} r join {{hold}} h on {_MATCH} group by r.subject")
_both("chunk_pins", f"select r.file_class, r.fp, count(*) as pins from {{chunk}} r join {{hold}} h on {_MATCH} group by r.file_class, r.fp", f"select r.file_class, r.fp, count(*) as pins from {{chunk}} r join {{hold}} h on {_MATCH} group by r.file_class, r.fp")
_both("held_erase_status", f"select r.subject, r.path, case when max(h.hold_id) is not null then 'deferred' else 'erased' end as status from {{log}} r left join {{hold}} h on {_MATCH} where r.subject = '{E0}' group by r.subject, r.path", f"select r.subject, r.path, case when max(h.hold_id) is not null then 'deferred' else 'erased' end as status from {{log}} r left join {{hold}} h on {_MATCH} where r.subject = '{E0}' group by r.subject, r.path")
_both("cross_tenant_sharing", "select tenants, count(*) as chunks, cast(sum(n) as bigint) as bytes from (select file_class, fp, count(distinct tenant) as tenants, max(n) as n from {chunk} group by file_class, fp) group by tenants")
_both("mixed_share_possible", "select count(*) as chunks, cast(coalesce(sum((copies - 1) * (n + 16)), 0) as bigint) as bytes_saved from (select fp, max(n) as n, count(*) as copies from {chunk} where file_class = 'mixed' group by fp having count(distinct subject) > 1)")

QUERIES |= space.QUERIES | timeline.QUERIES
ORACLES |= timeline.ORACLES
