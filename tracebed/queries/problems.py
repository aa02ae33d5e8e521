"""Queries of the general problems: snapshot changes and dependency hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebed.operators.hierarchy import dependency_hierarchy, dependents
from tracebed.operators.snapshots import finding_changes
from tracebed.sources.tables import table


def p3_found(spark, d):
    return finding_changes(table(spark, d, "findings"))


def p4_found(spark, d):
    return dependency_hierarchy(table(spark, d, "dependencies"))


def p4_paths(spark, d):
    return dependency_hierarchy(table(spark, d, "dependencies"), with_paths=True).select("file", "root", "depth", F.array_join("path", " > ").alias("path"))


def p4_dependents(spark, d):
    return dependents(table(spark, d, "dependencies"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_paths, p4_dependents)}

_CLEAN_PATH = """
create_rows as (
  select distinct file as f0, depends_on as d0, recorded_at from dependencies
), slashed as (
  select regexp_replace(regexp_replace(replace(trim(f0), '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') f,
         regexp_replace(regexp_replace(replace(trim(d0), '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') d, recorded_at from create_rows
), undotted as (
  select regexp_replace(regexp_replace(f, '/(\\./)+', '/', 'g'), '/\\.$', '') f, regexp_replace(regexp_replace(d, '/(\\./)+', '/', 'g'), '/\\.$', '') d, recorded_at from slashed
), folded as (
  select nullif(regexp_replace(regexp_replace(f, '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g'), '') file,
         nullif(regexp_replace(regexp_replace(d, '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g'), '') depends_on, recorded_at from undotted
), latest as (
  select file, depends_on from (
    select file, depends_on, row_number() over (partition by file order by recorded_at desc nulls last, depends_on desc nulls last) rn
    from folded where file is not null and (depends_on is null or depends_on <> file)
  ) where rn = 1
), names as (
  select file from folded where file is not null union select depends_on from folded where depends_on is not null
), up as (
  select names.file, latest.depends_on as parent from names left join latest using (file)
)"""

# a walk ends before a file it has been at, so circles need no bound on depth
_WALK = """, walk(file, node, depth, path) as (
  select file, file, 0, [file] from up
  union all
  select w.file, u.parent, w.depth + 1, list_append(w.path, u.parent) from walk w join up u on w.node = u.file where u.parent is not null and not list_contains(w.path, u.parent)
), ended as (
  select w.file, w.node as root, w.depth, array_to_string(w.path, ' > ') path from walk w join up u on w.node = u.file where u.parent is null
), circle as (
  select distinct w.file from walk w join up u on w.node = u.file where u.parent = w.file
)"""

ORACLE = {
    "p3_found": """
with slim as (
  select snapshot_no, coalesce(nullif(trim(semantic_fingerprint), ''), nullif(trim(fingerprint), '')) k,
    try_cast(regexp_replace(trim(last_seen), 'Z$', '') as timestamp) seen,
    md5(concat_ws(chr(31), coalesce(trim(fingerprint), ''), coalesce(trim(rule_id), ''), coalesce(trim(file), ''), lower(coalesce(trim(severity), '')), coalesce(cast(active as varchar), ''))) h
  from findings
), cur as (
  select snapshot_no, k, h from (
    select *, row_number() over (partition by snapshot_no, k order by seen desc nulls last, h desc) rn from slim where k is not null and snapshot_no is not null
  ) where rn = 1
), snaps as (
  select snapshot_no, lead(snapshot_no) over (order by snapshot_no) nxt from (select distinct snapshot_no from findings where snapshot_no is not null)
), pairs as (
  select s.nxt snapshot_no, coalesce(a.k, b.k) k, a.h ha, b.h hb
  from snaps s join lateral (select 1) on true
  join (select snapshot_no, k, h from cur) a on a.snapshot_no = s.snapshot_no
  left join cur b on b.snapshot_no = s.nxt and b.k = a.k where s.nxt is not null
  union all
  select b.snapshot_no, b.k, null, b.h from cur b join snaps s on s.nxt = b.snapshot_no left join cur a on a.snapshot_no = s.snapshot_no and a.k = b.k where a.k is null
)
select cast(snapshot_no as integer) snapshot_no, k finding_key, case when ha is null then 'added' when hb is null then 'removed' else 'changed' end change_kind
from pairs where ha is null or hb is null or ha <> hb""",
    "p4_found": f"""
with recursive {_CLEAN_PATH}{_WALK}, below as (
  select node as file, count(*) n from walk where depth > 0 group by node
)
select u.file, coalesce(e.root, '') root,
  cast(case when e.file is not null then e.depth when c.file is not null then -1 else -2 end as integer) depth,
  cast(case when e.file is not null then coalesce(b.n, 0) else -1 end as integer) n_descendants
from up u left join ended e using (file) left join below b using (file) left join circle c using (file)""",
    "p4_paths": f"""
with recursive {_CLEAN_PATH}{_WALK}
select u.file, coalesce(e.root, '') root, cast(case when e.file is not null then e.depth when c.file is not null then -1 else -2 end as integer) depth, e.path
from up u left join ended e using (file) left join circle c using (file)""",
    "p4_dependents": f"""
with recursive {_CLEAN_PATH}{_WALK}
select w.node as file, w.file as dependent, cast(w.depth as integer) distance from walk w join ended e using (file) where w.depth > 0""",
}
