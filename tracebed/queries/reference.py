"""Queries of the analytics over findings, files and their history, each with its SQL twin over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebed.operators import code, correlation, duplicates, findings, flows, metrics, packages, state, summary
from tracebed.sources import reports
from tracebed.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql_path(c: str) -> str:
    """A path in one spelling, as SQL."""
    s = f"regexp_replace(regexp_replace(replace(trim({c}), '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
    s = f"regexp_replace(regexp_replace({s}, '/(\\./)+', '/', 'g'), '/\\.$', '')"
    return f"nullif(regexp_replace(regexp_replace({s}, '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g'), '')"


def once(*columns: str) -> str:
    """Findings with the columns asked for, each once, severity and file normalised, as a WITH item named f."""
    exprs = ["finding_no"] + [{"severity": "upper(trim(severity)) severity", "file": f"{sql_path('file')} file"}.get(c, c) for c in columns]
    return f"f as (select {', '.join(exprs)} from (select distinct finding_no, {', '.join(columns)} from scan_findings))"


ACTIVE = "(suppressed is null or not suppressed)"
RANK = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 when 'INFO' then 4 else 5 end"
WEIGHT = "case severity when 'CRITICAL' then 10.0::double when 'HIGH' then 7.0::double when 'MEDIUM' then 4.0::double when 'LOW' then 1.0::double else 0.0::double end"
CWES = "coalesce(array_to_string(list_sort(list_filter(cwe, lambda c: c is not null)), ','), '')"
KIND = f"coalesce(nullif(trim(normalized_type), ''), nullif({CWES}, ''), lower(split_part(coalesce(rule_id, ''), '.', -1)))"
FILES = """files as (
  select file_no, path, lines from (
    select file_no, path, lines, row_number() over (partition by file_no order by indexed_at desc nulls last, path desc nulls last, lines desc nulls last) rn from source_files where file_no is not null
  ) where rn = 1
)"""
LANGUAGE = "coalesce(case lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"when '{e}' then '{x}'" for e, x in code.EXTENSIONS.items()) + " end, 'other')"
LINES = f"""{FILES}, lines as (
  select file_no, path, {LANGUAGE} as language, cast(n as integer) line_no, line from (
    select file_no, {sql_path('path')} path, unnest(lines) line, generate_subscripts(lines, 1) n from files
  ) where line is not null
)"""


# files and lines


@query(f"""with {FILES}, sized as (
  select {LANGUAGE} as language, greatest(coalesce(len(lines), 0), 1) n from (select {sql_path('path')} path, lines from files)
) select language, count(*) files, cast(sum(n) as bigint) n_lines, round(100 * sum(n) / sum(sum(n)) over (), 4) pct from sized group by language""")
def language_share(spark, d):
    return code.language_share(table(spark, d, "source_files"))


RULES = [
    code.LineRule("sql-call", "HIGH", regex=r"(cursor\.execute|db\.query|statement\.setString)\("),
    code.LineRule("log-call", "LOW", contains="LOG.", languages=("python", "go")),
    code.LineRule("handler", "MEDIUM", regex=r"except [A-Za-z]+:", without=r"raise"),
    code.LineRule("long-line", "INFO", min_length=80),
]
_RULE_SQL = """select 'sql-call' rule_id, 'HIGH' severity, 0 r, file_no, line_no from lines where regexp_matches(line, '(cursor\\.execute|db\\.query|statement\\.setString)\\(')
  union all select 'log-call', 'LOW', 1, file_no, line_no from lines where contains(lower(line), 'log.') and language in ('python', 'go')
  union all select 'handler', 'MEDIUM', 2, file_no, line_no from lines where regexp_matches(line, 'except [A-Za-z]+:') and not regexp_matches(line, 'raise')
  union all select 'long-line', 'INFO', 3, file_no, line_no from lines where length(line) >= 80"""


@query(f"with {LINES} select rule_id, severity, file_no, line_no from ({_RULE_SQL})")
def line_rule_match(spark, d):
    return code.rule_matches(table(spark, d, "source_files"), RULES)


@query(f"with {LINES} select rule_id, severity, file_no, line_no from (select *, row_number() over (partition by file_no order by r, line_no) k from ({_RULE_SQL})) where k <= 3")
def per_file_cap(spark, d):
    return code.rule_matches(table(spark, d, "source_files"), RULES, per_file=3)


@query(f"""with {LINES}, anchor as (select file_no, min(line_no) a from lines where regexp_matches(line, '^ *(try|def )') group by file_no)
select 'query-after-start' rule_id, 'MEDIUM' severity, l.file_no, line_no from lines l join anchor using (file_no) where contains(lower(line), 'cursor.execute') and line_no >= a""")
def ordered_anchor_match(spark, d):
    return code.rule_matches(table(spark, d, "source_files"), [code.LineRule("query-after-start", contains="cursor.execute", after=r"^ *(try|def )")])


@query(f"""with {LINES}, gate as (select file_no from lines group by file_no having bool_or(contains(lower(line), 'return')) and not bool_or(contains(lower(line), 'valueerror')))
select 'assert-only' rule_id, 'LOW' severity, file_no, line_no from lines join gate using (file_no) where contains(lower(line), 'assert')""")
def file_gate(spark, d):
    return code.rule_matches(table(spark, d, "source_files"), [code.LineRule("assert-only", "LOW", contains="assert", needs=("return",), unless=("ValueError",))])


@query(f"""with {LINES}, s as (
  select file_no, line_no, length(line) - length(replace(line, '{{', '')) o, length(line) - length(replace(line, '}}', '')) c from lines
), t as (select *, sum(o - c) over (partition by file_no order by line_no) s from s
), u as (select *, s - least(0, min(s) over (partition by file_no order by line_no)) nxt from t
), v as (select file_no, coalesce(lag(nxt) over (partition by file_no order by line_no), 0) + o depth from u)
select file_no, cast(max(depth) as integer) depth from v group by file_no""")
def nesting_depth(spark, d):
    return code.nesting(table(spark, d, "source_files"))


@query(f"""with {LINES}, c as (
  select file_no, line_no, len(list_filter(regexp_extract_all(line, '(?:^|[^0-9A-Za-z_.])(0[xX][0-9a-fA-F]+|[0-9]{{3,}})\\b', 1), lambda x: not regexp_matches(x, '^0[xX]?0*[012]?$'))) n from lines
) select file_no, line_no, cast(n as integer) n from c where n >= 3""")
def magic_numbers(spark, d):
    return code.magic_numbers(table(spark, d, "source_files"))


@query(f"with {FILES} select file_no, cast(coalesce(len(lines), 0) as integer) n_lines, case when len(lines) >= 800 then 'HIGH' when len(lines) >= 400 then 'LOW' end severity from files")
def large_file(spark, d):
    return code.file_sizes(table(spark, d, "source_files"))


@query(f"""with {LINES}, asked as (select distinct file_no, line_no from lines where contains(lower(line), 'cursor.execute')
), near as (select a.file_no, a.line_no, l.line_no n, l.line from asked a join lines l on l.file_no = a.file_no and l.line_no between a.line_no - 2 and a.line_no + 2)
select file_no, line_no, string_agg(n || ': ' || line, chr(10) order by n) snippet from near group by file_no, line_no""")
def snippet_context(spark, d):
    files = table(spark, d, "source_files")
    return code.snippet_context(code.rule_matches(files, [code.LineRule("x", contains="cursor.execute")]), files)


# duplicates


@query("""with l as (select file_no, line_no, min(lower(trim(token_hash))) t from tokenized_lines where token_hash is not null group by 1, 2
), w as (select file_no, line_no a, lead(line_no, 5) over x b, concat_ws('|', t, lead(t, 1) over x, lead(t, 2) over x, lead(t, 3) over x, lead(t, 4) over x, lead(t, 5) over x) s from l window x as (partition by file_no order by line_no))
select file_no, a start_line, b end_line, md5(s) block from w where b - a <= 18""")
def duplicate_windows(spark, d):
    return duplicates.line_windows(table(spark, d, "tokenized_lines"))


@query("""with o as (select distinct block_hash, file_no, start_line from duplicate_blocks where block_hash is not null)
select block_hash, count(*) n, count(distinct file_no) n_files, arg_min(file_no, (file_no, start_line)) first_file, arg_min(start_line, (file_no, start_line)) first_line from o group by block_hash having count(*) > 1""")
def duplicate_groups(spark, d):
    return duplicates.exact_groups(table(spark, d, "duplicate_blocks"))


@query("""with o as (select distinct block_hash, file_no, start_line, end_line from duplicate_blocks where block_hash is not null
), many as (select block_hash from (select distinct block_hash, file_no, start_line from o) group by 1 having count(*) > 1
), s as (select distinct file_no, start_line, end_line from o join many using (block_hash)
), g as (select *, case when start_line > coalesce(max(end_line) over (partition by file_no order by start_line, end_line rows between unbounded preceding and 1 preceding), -9) + 1 then 1 else 0 end opens from s
), r as (select *, sum(opens) over (partition by file_no order by start_line, end_line rows unbounded preceding) region from g)
select file_no, min(start_line) start_line, max(end_line) end_line from r group by file_no, region""")
def duplicate_regions(spark, d):
    return duplicates.duplicate_regions(table(spark, d, "duplicate_blocks"))


@query("""with t as (select distinct file_no, lower(trim(token_hash)) t from (select file_no, line_no, min(lower(trim(token_hash))) token_hash from tokenized_lines where token_hash is not null group by 1, 2)
), size as (select file_no, count(*) n from t group by 1
), rare as (select t from t group by 1 having count(*) > 1
), k as (select * from t join rare using (t)
), p as (select x.file_no a, y.file_no b, count(*) shared from k x join k y on x.t = y.t and x.file_no < y.file_no group by 1, 2)
select a, b, shared, round(shared / least(s1.n, s2.n), 6) overlap from p join size s1 on s1.file_no = a join size s2 on s2.file_no = b where round(shared / least(s1.n, s2.n), 6) >= 0.3""")
def duplicate_near_pairs(spark, d):
    return duplicates.near_file_pairs(table(spark, d, "tokenized_lines"))


@query("""with recursive o as (select file_no, start_line, coalesce(end_line, start_line) end_line, min(list_sort(list_distinct([lower(trim(t)) for t in token_hashes if trim(t) <> '']))) w from duplicate_blocks where file_no is not null and start_line is not null group by 1, 2, 3
), p as (select *, md5(array_to_string(w, '|')) c from o where len(w) > 0
), t as (select distinct c, unnest(w) t, len(w) n from p
), alike as (select x.c a, y.c b from t x join t y on x.t = y.t group by 1, 2 having count(*) >= ceil(0.7 * greatest(any_value(x.n), any_value(y.n)))
), e as (select distinct a, b from alike where exists (select 1 from p x, p y where x.c = a and y.c = b and (x.file_no <> y.file_no or x.end_line < y.start_line or y.end_line < x.start_line))
), label as (select c, c g, 0 round from (select a c from e union select b from e)
  union all select c, g, round + 1 from (select l.c, least(min(l.g), min(k.g)) g, any_value(l.round) round, min(l.g) old from label l join e on e.a = l.c join label k on k.c = e.b group by l.c) where (select count(*) from label l join e on e.a = l.c join label k on k.c = e.b where l.g <> k.g) > 0
), g as (select c, arg_max(g, round) g from label group by 1
), f as (select g, p.* from p join g using (c)
), s as (select g, count(*) n, sum(end_line - start_line + 1) lines, min((file_no, start_line, end_line)) first from f group by 1
), d as (select file_no, start_line, end_line, case when n >= 5 or lines >= 80 then 'HIGH' when n >= 3 or lines >= 40 then 'MEDIUM' else 'LOW' end severity, n, first from f join s using (g) where (file_no, start_line, end_line) <> first
), i as (select *, case when start_line > coalesce(max(end_line) over (partition by file_no order by start_line, end_line rows between unbounded preceding and 1 preceding), -9) + 1 then 1 else 0 end opens from d
), r as (select *, sum(opens) over (partition by file_no order by start_line, end_line rows unbounded preceding) region from i)
select file_no, min(start_line) start_line, max(end_line) end_line, arg_min(severity, (start_line, end_line)) severity, arg_min(n, (start_line, end_line)) n, arg_min(first[1], (start_line, end_line)) primary_file, arg_min(first[2], (start_line, end_line)) primary_line from r group by file_no, region""")
def duplicate_findings(spark, d):
    return duplicates.duplicate_findings(table(spark, d, "duplicate_blocks"))


# findings


@query(f"with {once('file', 'start_line', 'end_line', 'cwe', 'normalized_type', 'rule_id')} select finding_no, sha256(concat_ws('|', coalesce(file, ''), coalesce(start_line::varchar, ''), coalesce(end_line::varchar, ''), {CWES}, {KIND})) fp from f")
def fingerprint_position(spark, d):
    return findings.position_fingerprint(table(spark, d, "scan_findings"))


@query(f"""with {once('file', 'start_line', 'end_line', 'cwe', 'normalized_type', 'rule_id', 'source_kind', 'sink_kind', 'code_snippet')}, g as (
  select *, array_to_string(list_slice(list_filter(list_transform(string_split(coalesce(code_snippet, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^ *[0-9]+: ?', ''), '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), 1, 24), chr(10)) code,
    coalesce(trim(source_kind), '') sk, coalesce(trim(sink_kind), '') nk from f)
select finding_no, sha256(concat_ws('|', 'v2', coalesce(file, ''), {KIND}, {CWES}, sk, nk, code) || case when sk || nk || code = '' then concat_ws('|', '', start_line::varchar, end_line::varchar) else '' end) fp from g""")
def fingerprint_semantic(spark, d):
    return findings.semantic_identity(table(spark, d, "scan_findings"))


_MORE = "(len(list_distinct(case when len(detected_by) > 0 then detected_by else [tool] end)) >= 2 or coalesce(correlation_score, 0) >= 0.85)"


@query(f"""with {once('tool', 'precision_level', 'confidence', 'detected_by', 'correlation_score')}
select finding_no, not (coalesce(trim(tool), '') like '%-engine' and upper(coalesce(trim(confidence), '')) = 'LOW' and not {_MORE}) and not (upper(coalesce(trim(precision_level), '')) = 'EXPERIMENTAL' and not {_MORE}) kept from f""")
def precision_gate(spark, d):
    return findings.precision_gate(table(spark, d, "scan_findings"))


SUPPRESSIONS = [
    {"reason": "over", "rule": "private-key", "path": "*/lib/*", "expires": "2026-01-01"},
    {"reason": "tools are ours", "rule": "password-literal", "path": "*/tools/*", "expires": "2026-03-01", "approved_by": "the team"},
    {"reason": "neither rule nor fingerprint", "path": "harbor-monorepo/*"},
    {"rule": "password-literal"},
]


@query(f"""with {once('rule_id', 'file')}
select finding_no, case when rule_id = 'generic-api-key' then 'rule' when coalesce(file, '') like '%/tools/%' then 'tools are ours (approved by the team)' else 'scoped suppression' end reason from f where rule_id in ('generic-api-key', 'password-literal')""")
def suppression_scoped(spark, d):
    return findings.suppressed_by(table(spark, d, "scan_findings"), SUPPRESSIONS, today="2026-03-01", rules=("generic-api-key",))


POLICIES = [findings.Policy("no-secrets", "LOW", ("secret",)), findings.Policy("services", "HIGH", ("security", "bug"), "*/services/*")]


@query(f"""with {once('rule_id', 'category', 'severity', 'file', 'suppressed')}, a as (select *, {RANK} r from f where {ACTIVE})
select 'no-secrets' policy, finding_no, rule_id, file, severity from a where category = 'secret' and r <= 3
union all select 'services', finding_no, rule_id, file, severity from a where category in ('security', 'bug') and r <= 1 and coalesce(file, '') like '%/services/%'""")
def policy_gate(spark, d):
    return findings.policy_violations(table(spark, d, "scan_findings"), POLICIES)


@query(f"with {once('severity', 'suppressed')} select finding_no, severity from f where {ACTIVE} and severity in ('HIGH', 'CRITICAL')")
def fail_on(spark, d):
    return findings.failing(table(spark, d, "scan_findings"), "high")


@query(f"""with {once('severity', 'confidence', 'file', 'start_line')}, k as (
  select finding_no, {RANK} sr, case upper(coalesce(trim(confidence), '')) when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 3 end cr, coalesce(file, '') file, coalesce(start_line, 0) line from f
) select finding_no, printf('F-2026-%06d', row_number() over (order by sr, cr, file, line, finding_no)) report_id from k""")
def report_ids(spark, d):
    return findings.numbered(table(spark, d, "scan_findings"))


@query(f"""with {once('rule_id', 'severity', 'confidence', 'tool', 'file', 'start_line', 'end_line', 'message', 'fingerprint', 'semantic_fingerprint', 'suppressed')}, k as (
  select *, row_number() over (order by {RANK}, case upper(coalesce(trim(confidence), '')) when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 3 end, coalesce(file, ''), coalesce(start_line, 0), finding_no) n from f where {ACTIVE})
select (n - 1) // 500 log_no, finding_no, coalesce(rule_id, '') rule_id, coalesce(rule_id, '') "named", case when severity in ('CRITICAL', 'HIGH') then 'error' when severity = 'MEDIUM' then 'warning' else 'note' end "level",
  replace(url_encode(coalesce(file, '')), '%2F', '/') uri, greatest(coalesce(start_line, 1), 1) start_line, greatest(coalesce(start_line, 1), coalesce(end_line, 1), 1) end_line,
  cast(length(coalesce(nullif(message, ''), rule_id, '')) as integer) message_chars, cast((coalesce(fingerprint, '') <> '')::integer + (coalesce(semantic_fingerprint, '') <> '')::integer as integer) prints from k""")
def sarif_results(spark, d):
    return reports.sarif_results(reports.sarif_logs(table(spark, d, "scan_findings"), per_log=500))


@query(f"""with {once('file', 'start_line', 'end_line', 'cwe', 'normalized_type', 'rule_id', 'severity', 'detected_by', 'message', 'confidence_score')}, g as (select *, {KIND} kind, {RANK} sr from f
), e as (select coalesce(file, '') file, start_line, end_line, kind, array_to_string(list_sort(list_distinct(flatten(list(coalesce(detected_by, []))))), ',') engines from g group by 1, 2, 3, 4)
select coalesce(g.file, '') file, g.start_line, g.end_line, g.kind, arg_min(finding_no, (sr, finding_no)) finding_no, min(sr) severity_rank, count(*) n, any_value(engines) engines, max(length(coalesce(message, ''))) message_chars, max(confidence_score) confidence_score
from g join e on e.file = coalesce(g.file, '') and e.start_line is not distinct from g.start_line and e.end_line is not distinct from g.end_line and e.kind = g.kind group by 1, 2, 3, 4""")
def merged_findings(spark, d):
    return findings.merged_findings(table(spark, d, "scan_findings"))


# two findings are compared one by one in SQL; the common blocks of two types are cut out longest first
_BLOCK = "list_max(flatten([[{{'k': l, 'i': -i}} for l in range(1, length({0}) - i + 2) if contains({1}, substr({0}, i, l))] for i in range(1, length({0}) + 1)]))"
_LINKED = f"""{once('file', 'start_line', 'end_line', 'cwe', 'category', 'normalized_type', 'rule_id', 'source_kind', 'sink_kind', 'code_snippet', 'fingerprint', 'semantic_fingerprint')}
, d as (select f.finding_no, lower(coalesce(file, '')) path, greatest(coalesce(start_line, 1), 1) lo, greatest(coalesce(start_line, 1), 1, coalesce(end_line, 1)) hi, list_sort(list_distinct([trim(c) for c in coalesce(cwe, []) if trim(c) <> ''])) cwes, coalesce(trim(category), '') category,
  {KIND} kind, coalesce(trim(source_kind), '') source, coalesce(trim(sink_kind), '') sink, coalesce(nullif(lower(trim(fingerprint)), ''), p.fp) fp, coalesce(nullif(lower(trim(semantic_fingerprint)), ''), s.fp) sfp
  from f join ({ORACLE['fingerprint_position']}) p using (finding_no) join ({ORACLE['fingerprint_semantic']}) s using (finding_no)
), c as (select min(finding_no) rep, path, lo, hi, cwes, category, kind, source, sink from d where len(cwes) > 0 group by all
), p as (
  select x.rep a, y.rep b, x.kind ka, y.kind kb, x.lo = y.lo and x.hi = y.hi and x.category = y.category same,
    0.28::double * case when least(x.hi, y.hi) >= greatest(x.lo, y.lo) then (least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) / (greatest(x.hi, y.hi) - least(x.lo, y.lo) + 1) when greatest(x.lo, y.lo) - least(x.hi, y.hi) <= 2 then 0.5::double else 0.0::double end
    + 0.22::double * (len(list_intersect(x.cwes, y.cwes)) / len(list_distinct(x.cwes || y.cwes)))
    + 0.08::double * case when x.source <> '' and x.source = y.source then 1 else 0 end + 0.08::double * case when x.sink <> '' and x.sink = y.sink then 1 else 0 end base
  from c x join c y on x.path = y.path and x.rep < y.rep and list_has_any(x.cwes, y.cwes)
), m as (
  select ka, kb, ka s, kb t, {_BLOCK.format('ka', 'kb')} w from (select distinct ka, kb from p)
  union all select ka, kb, u.s, u.t, {_BLOCK.format('u.s', 'u.t')} from (
    select ka, kb, unnest([{{'s': substr(s, 1, -w.i - 1), 't': substr(t, 1, j - 1)}}, {{'s': substr(s, -w.i + w.k), 't': substr(t, j + w.k)}}]) u from (select *, instr(t, substr(s, -w.i, w.k)) j from m where w is not null)
  ) where u.s <> '' and u.t <> ''
), ratio as (select ka, kb, coalesce(2.0::double * sum(w.k) / nullif(length(ka) + length(kb), 0), 0) r from m group by 1, 2
), links as (select * from (select a, b, case when same then 0.96::double else round(base + 0.22::double * r, 6) end score from p join ratio using (ka, kb)) where score >= 0.72)"""


@query(f"with recursive {_LINKED} select a, b, score from links")
def correlated_links(spark, d):
    return correlation.correlated_links(table(spark, d, "scan_findings"))


@query(f"""with recursive {_LINKED}, one as (
  select finding_no a, min(finding_no) over (partition by fp) b, 1.0::double score from d union all select finding_no, min(finding_no) over (partition by sfp), 1.0::double from d
  union all select finding_no, min(finding_no) over (partition by path, lo, hi, cwes, category, kind, source, sink), 0.96::double from d where len(cwes) > 0 union all select a, b, score from links
), edges as (select a, b, score from one where a <> b), near as (select a, b from edges union select b, a from edges
), reach as (select finding_no n, finding_no x from d union select n, near.b from reach join near on near.a = reach.x
), g as (select n finding_no, min(x) group_no from reach group by 1
), best as (select group_no, max(score) linked from edges join g on g.finding_no = edges.a group by 1
), v as (select distinct finding_no, upper(trim(severity)) severity, tool, detected_by, cwe, message, code_snippet, reachable, exploitability_score, confidence_score, correlation_score from scan_findings
), r as (select *, {RANK} sr from v join g using (finding_no)
), e as (select group_no, array_to_string(list_sort(list_distinct([trim(x) for x in flatten(list(case when len(detected_by) > 0 then detected_by else [tool] end)) if trim(x) <> ''])), ',') engines, array_to_string(list_sort(list_distinct([trim(x) for x in flatten(list(coalesce(cwe, []))) if trim(x) <> ''])), ',') cwes from r group by 1
), t as (select group_no, arg_min(finding_no, (sr, finding_no)) finding_no, count(*) n, arg_min(finding_no, (sr, finding_no)) filter (trim(code_snippet) <> '') snippet_from, arg_min(finding_no, (-length(coalesce(message, '')), sr, finding_no)) message_from,
  arg_min(reachable, (sr, finding_no)) filter (reachable is not null) reachable, max(exploitability_score) exploitability_score, max(confidence_score) confidence_score, max(coalesce(correlation_score, 0)) own from r group by 1)
select group_no, t.finding_no, n, engines, cwes, snippet_from, message_from, reachable, exploitability_score, confidence_score, greatest(own, coalesce(linked, 0)) correlation_score from t join e using (group_no) left join best using (group_no)""")
def correlated_findings(spark, d):
    return correlation.correlated_findings(table(spark, d, "scan_findings"))


@query(f"with {once('severity', 'suppressed')} select s.severity, count(f.finding_no) n from (select unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']) severity) s left join f on f.severity = s.severity and {ACTIVE} group by 1")
def severity_counts(spark, d):
    return metrics.severity_counts(table(spark, d, "scan_findings"))


@query(f"""with {once('project', 'severity', 'category', 'confidence', 'confidence_score', 'reachable', 'exploitability_score', 'detected_by', 'suppressed')}, g as (
  select project, {WEIGHT} * least(1.5::double, greatest(0.1::double, coalesce(confidence_score, case upper(coalesce(trim(confidence), '')) when 'HIGH' then 1.0::double when 'MEDIUM' then 0.85::double when 'LOW' then 0.65::double else 0.85::double end)
    * (case when not reachable then 0.35::double else 1.0::double end) * (case when exploitability_score is not null then 0.5::double + exploitability_score / 200 else 1.0::double end)
    * (1 + least(0.25::double, 0.08::double * greatest(len(list_distinct(coalesce(detected_by, []))) - 1, 0))))) w from f where {ACTIVE} and category in ('security', 'secret')
), h as (select project, count(*) n, cast(round(sum(cast(w as decimal(20, 12))), 6) as double) raw from g group by 1), i as (select *, cast(round_even(100 * (1 - exp(-raw / 40)), 0) as integer) risk from h)
select *, case when risk <= 19 then 'LOW' when risk <= 39 then 'MODERATE' when risk <= 69 then 'HIGH' else 'CRITICAL' end band from i""")
def risk_score(spark, d):
    return metrics.risk_by_project(table(spark, d, "scan_findings"))


_COST = " ".join(f"when category = '{c}' and severity = '{s}' then {m}" for c, t in metrics.DEBT_MINUTES.items() for s, m in t.items())


@query(f"""with {once('project', 'category', 'severity', 'suppressed')}, a as (select project, cast(sum(case {_COST} else 0 end) as bigint) debt_minutes from f where {ACTIVE} group by 1
), b as (select project, count(*) n_lines from (select distinct project, file_no, line_no from tokenized_lines) group by 1
), c as (select a.project, debt_minutes, coalesce(n_lines, 0) n_lines, round(debt_minutes / greatest(coalesce(n_lines, 0) / 10, 1.0), 6) ratio from a left join b using (project))
select *, case when ratio < 0.05 then 'A' when ratio < 0.1 then 'B' when ratio < 0.2 then 'C' when ratio < 0.3 then 'D' else 'E' end rating from c""")
def maintainability(spark, d):
    return metrics.maintainability(table(spark, d, "scan_findings"), table(spark, d, "tokenized_lines"))


@query(f"with {once('category', 'rule_id', 'suppressed')} select category, rule_id, count(*) n from f where {ACTIVE} and category not in ('security', 'secret') group by 1, 2")
def smell_breakdown(spark, d):
    return metrics.smell_breakdown(table(spark, d, "scan_findings"))


@query(f"""with {once('cwe', 'suppressed')}, e as (select unnest(cwe) cwe from f where {ACTIVE}), g as (select cwe, count(*) n from e where trim(cwe) <> '' group by 1)
select cwe, n, round(100 * n / sum(n) over (), 4) pct from g order by n desc, cwe limit 15""")
def cwe_distribution(spark, d):
    return metrics.weakness_distribution(table(spark, d, "scan_findings"))


@query(f"""with {once('file', 'severity', 'suppressed')}, e as (
  select 'file' kind, file place, {WEIGHT} w, {RANK} sr from f where file is not null and {ACTIVE} union all select 'folder', case when contains(file, '/') then split_part(file, '/', 1) || '/' else '(root)/' end, {WEIGHT}, {RANK} from f where file is not null and {ACTIVE}
), g as (select kind, place, sum(w) weight, count(*) n, min(sr) worst from e group by 1, 2)
select kind, place, weight, n, worst from (select *, row_number() over (partition by kind order by weight desc, place) r from g) where r <= 10""")
def hotspots(spark, d):
    return metrics.hotspots(table(spark, d, "scan_findings"))


@query(f"""with {once('endpoint', 'http_method', 'internet_exposed', 'authentication_required', 'exploitability_score', 'suppressed')}
select upper(coalesce(trim(http_method), '')) http_method, trim(endpoint) endpoint, count(*) n, bool_or(internet_exposed) exposed, bool_or(not authentication_required) "open", max(exploitability_score) max_score
from f where {ACTIVE} and trim(endpoint) <> '' group by 1, 2""")
def endpoint_rollup(spark, d):
    return metrics.endpoint_rollup(table(spark, d, "scan_findings"))


@query(f"""with {once('detected_by', 'suppressed')}, e as (select list_distinct(detected_by) b from f where {ACTIVE}), g as (select unnest(b) engine, len(b) k from e)
select engine, count(*) n, cast(sum(case when k > 1 then 1 else 0 end) as bigint) shared from g group by 1""")
def tool_quality(spark, d):
    return metrics.tool_quality(table(spark, d, "scan_findings"))


@query(f"with {once('batch_no', 'lifecycle_status')} select batch_no, coalesce(nullif(upper(trim(lifecycle_status)), ''), 'UNSET') status, count(*) n from f group by 1, 2")
def lifecycle_counts(spark, d):
    return metrics.lifecycle_counts(table(spark, d, "scan_findings"))


@query(f"""with {once('project', 'reachable', 'confidence_score')}, g as (select project, coalesce(reachable, false) t, coalesce(confidence_score >= 0.8, false) p from f
), h as (select project, count(*) filter (t and p) tp, count(*) filter (not t and p) fp, count(*) filter (t and not p) fn from g group by 1)
select *, case when tp + fp = 0 then 1.0::double else round(tp / (tp + fp), 6) end "precision", case when tp + fn = 0 then 1.0::double else round(tp / (tp + fn), 6) end recall, case when 2 * tp + fp + fn = 0 then 0.0::double else round(2 * tp / (2 * tp + fp + fn), 6) end f1 from h""")
def precision_recall_f1(spark, d):
    return metrics.detection_quality(table(spark, d, "scan_findings"), F.col("reachable"), F.col("confidence_score") >= 0.8, ["reachable", "confidence_score"])


@query(f"with {once('project', 'severity', 'suppressed')} select project, severity, count(*) n, cast(grouping(project, severity) as integer) level from f where {ACTIVE} group by rollup (project, severity)")
def folder_rollup(spark, d):
    return metrics.folder_rollup(table(spark, d, "scan_findings"))


# state


_STATE = """num as (select snapshot_no, row_number() over (order by snapshot_no) - 1 i from (select distinct snapshot_no from findings where snapshot_no is not null)
), raw as (select snapshot_no, coalesce(nullif(trim(semantic_fingerprint), ''), nullif(trim(fingerprint), '')) finding_key, try_cast(regexp_replace(trim(last_seen), 'Z$', '') as timestamp) seen,
  concat_ws('|', coalesce(trim(rule_id), ''), coalesce(trim(file), ''), upper(coalesce(trim(severity), ''))) state, upper(coalesce(trim(severity), '')) severity, coalesce(active, 0) active from findings
), st as (select finding_key, snapshot_no, i, state, severity, active from (
  select *, row_number() over (partition by snapshot_no, finding_key order by seen desc nulls last, state desc, active desc, severity desc) rn from raw where finding_key is not null) join num using (snapshot_no) where rn = 1)"""
_PAIRS = """(select n.snapshot_no, coalesce(a.finding_key, b.finding_key) finding_key, a.state sa, b.state sb, b.severity from num n
  join (select i + 1 as i1, * from {0}) a on a.i1 = n.i left join {0} b on b.i = n.i and b.finding_key = a.finding_key
  union all select b.snapshot_no, b.finding_key, null, b.state, b.severity from {0} b where b.i > 0 and not exists (select 1 from {0} a where a.i = b.i - 1 and a.finding_key = b.finding_key))"""


@query(f"with {_STATE} select snapshot_no, finding_key, case when sa is null then 'added' when sb is null then 'removed' when sa = sb then 'same' else 'changed' end change from {_PAIRS.format('st')}")
def change_detection(spark, d):
    return state.snapshot_diff(table(spark, d, "findings"))


@query(f"""with {_STATE}, live as (select * from st where active = 1)
select b.snapshot_no, b.finding_key, case when not exists (select 1 from st p where p.finding_key = b.finding_key and p.i < b.i) then 'NEW' when exists (select 1 from live p where p.finding_key = b.finding_key and p.i = b.i - 1) then 'EXISTING' else 'REOPENED' end status from live b
union all select n.snapshot_no, a.finding_key, 'RESOLVED' from live a join num n on n.i = a.i + 1 where not exists (select 1 from live b where b.finding_key = a.finding_key and b.i = n.i)""")
def lifecycle_diff(spark, d):
    return state.lifecycle(table(spark, d, "findings"))


@query(f"""with {once('fingerprint', 'semantic_fingerprint')}, m as (select finding_no, lower(nullif(trim(fingerprint), '')) f, lower(nullif(trim(semantic_fingerprint), '')) s from f
), b as (select distinct lower(nullif(trim(fingerprint), '')) f, lower(nullif(trim(semantic_fingerprint), '')) s from findings)
select finding_no, coalesce(s, f) finding_key, case when f in (select f from b where f is not null) or s in (select s from b where s is not null) then 'EXISTING' else 'NEW' end status from m
union all select distinct null, coalesce(s, f), 'RESOLVED' from b where coalesce(s, f) is not null and (f is null or f not in (select f from m where f is not null)) and (s is null or s not in (select s from m where s is not null))""")
def baseline_diff(spark, d):
    return state.baseline_status(table(spark, d, "scan_findings"), table(spark, d, "findings"))


@query(f"""with {_STATE}, live as (select * from st where active = 1), c as (
  select snapshot_no, count(*) filter (sa is not null and sb is null) n_removed, count(*) filter (sa is not null and sb is not null) n_persisted, count(*) filter (sa is null and severity in ('HIGH', 'CRITICAL')) n_new_severe from {_PAIRS.format('live')} group by 1)
select snapshot_no, case when n_persisted > 0 then 'NOT_FIXED' when n_new_severe > 0 then 'REGRESSION_DETECTED' when n_removed > 0 then 'VERIFIED_BY_RESCAN' else 'NO_MATCHING_FINDING' end status, n_removed, n_persisted, n_new_severe from c""")
def fix_verification(spark, d):
    return state.fix_check(table(spark, d, "findings"))


def _feedback(spark, d):
    """The index as verdicts: whoever closed a finding said so, later snapshots later."""
    rows = table(spark, d, "findings").where("snapshot_no is not null")
    verdict = F.when(F.col("active") == 0, "fixed").otherwise("confirmed")
    order = F.concat_ws("|", F.lpad(F.col("snapshot_no").cast("string"), 9, "0"), F.lower(F.trim("semantic_fingerprint")), F.trim("rule_id"), verdict)
    return rows.select(order.alias("entry_no"), "semantic_fingerprint", F.trim("rule_id").alias("rule_id"), F.lit("").alias("sink_kind"), verdict.alias("verdict"))


@query(f"""with {once('semantic_fingerprint', 'fingerprint', 'rule_id')}, fb as (select lower(nullif(trim(semantic_fingerprint), '')) s, nullif(trim(rule_id), '') rule_id, case when active = 0 then 'fixed' else 'confirmed' end verdict,
  concat_ws('|', lpad(snapshot_no::varchar, 9, '0'), lower(trim(semantic_fingerprint)), trim(rule_id), case when active = 0 then 'fixed' else 'confirmed' end) e from findings where snapshot_no is not null
), own as (select s, arg_max(verdict, e) verdict from fb where s is not null group by 1), ruled as (select rule_id, arg_max(verdict, e) verdict from fb where rule_id is not null group by 1)
select finding_no, case when own.verdict is not null then 1.0::double else 0.7::double end weight, coalesce(own.verdict, ruled.verdict) verdict
from f left join own on own.s = coalesce(lower(nullif(trim(f.semantic_fingerprint), '')), lower(nullif(trim(f.fingerprint), ''))) left join ruled on ruled.rule_id = f.rule_id where own.verdict is not null or ruled.verdict is not null""")
def feedback_cascade(spark, d):
    return state.feedback_match(table(spark, d, "scan_findings"), _feedback(spark, d))


@query(f"""with recursive r as (select {sql_path('file')} file, {sql_path('depends_on')} o from dependencies), l as (select distinct file, o from r where file is not null and o is not null and file <> o
), seed as (select file from r where file is not null group by 1 having count(distinct coalesce(o, '')) > 1
), reach(file, distance, path) as (select file, 0, [file] from seed where file in (select file from l union select o from l) union select l.file, r.distance + 1, list_append(r.path, l.file) from reach r join l on l.o = r.file where not list_contains(r.path, l.file) and l.file not in (select file from seed))
select file, cast(min(distance) as integer) distance from reach group by file""")
def affected_closure(spark, d):
    dependencies = table(spark, d, "dependencies")
    return state.reached_files(dependencies, state.changed_dependents(dependencies))


@query(f"""with {once('file', 'secret_related_locations', 'detected_at')}, c as (select {sql_path('path')} p, max(indexed_at) t from source_files where path is not null and indexed_at is not null group by 1
), t as (select finding_no, detected_at, file p from f union all select finding_no, detected_at, {sql_path("regexp_replace(x, ':[0-9]+$', '')")} from (select finding_no, detected_at, unnest(secret_related_locations) x from f))
select distinct finding_no from f where finding_no not in (select finding_no from t join c using (p) where detected_at is null or c.t > detected_at)""")
def cache_reuse(spark, d):
    return state.reusable(table(spark, d, "scan_findings"), table(spark, d, "source_files"))


# reports


_NUMBERS = "list_filter(list_transform(coalesce(cwe, []), lambda c: regexp_extract(upper(trim(c)), '^(?:CWE-)?([0-9]+)$', 1)), lambda n: n <> '')"
_CLASS = "case n " + " ".join(f"when '{n}' then '{c}'" for c, numbers in summary.WEAKNESS_CLASSES.items() for n in numbers) + " end"
_DECIDED = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in summary.CATEGORY_CLASSES.items()) + " end"


@query(f"""with {once('category', 'cwe', 'suppressed')}, c as (select coalesce({_DECIDED}, list_filter(list_transform({_NUMBERS}, lambda n: {_CLASS}), lambda x: x is not null)[1], case when category = 'security' then 'Input Validation' else 'Configuration' end) as name from f where {ACTIVE})
select name, count(*) n, round(100 * count(*) / sum(count(*)) over (), 1) pct from c group by name""")
def class_distribution(spark, d):
    return summary.class_distribution(table(spark, d, "scan_findings"))


@query(f"""with {once('suppressed', 'confidence', 'lifecycle_status', 'message', 'rule_id')}, g as (select *, nullif(upper(coalesce(trim(lifecycle_status), '')), '') life,
  regexp_replace(regexp_replace(regexp_replace(trim(coalesce(nullif(message, ''), nullif(rule_id, ''), 'Finding')), '\\*{{6,}}', '************', 'g'), '•{{6,}}', '••••', 'g'), 'X{{8,}}', 'XXXXXXXX', 'gi') t from f)
select finding_no, case when suppressed then 'Suppressed' when upper(coalesce(trim(confidence), '')) = 'LOW' then 'Potential Finding' when life is not null and life <> 'NONE' then life[1] || lower(life[2:]) else 'Needs Review' end status,
  case when length(t) <= 100 then t else rtrim(t[1:97]) || '...' end title from g""")
def display_status(spark, d):
    return summary.display(table(spark, d, "scan_findings"))


@query(f"""with {once('category', 'severity', 'confidence', 'suppressed')}, g as (select *, upper(coalesce(trim(confidence), '')) = 'HIGH' sure from f where {ACTIVE})
select finding_no, case when severity = 'CRITICAL' or severity = 'HIGH' and sure then 'immediate' when severity in ('HIGH', 'MEDIUM') then 'short_term' else 'planned' end bucket,
  case when category = 'secret' then 'Low' when severity in ('CRITICAL', 'HIGH') then case when sure then 'High' else 'Medium' end when severity in ('LOW', 'INFO') then 'Low' else 'Medium' end complexity from g""")
def remediation_buckets(spark, d):
    return summary.remediation(table(spark, d, "scan_findings"))


@query(f"""with {once('category', 'severity', 'confidence', 'file', 'start_line', 'rule_id', 'cwe', 'suppressed')}, g as (
  select finding_no, case when category = 'secret' then '{summary.ROTATE}' when rule_id in ('B105', 'B106', 'B107') or list_has_any({_NUMBERS}, ['798', '259']) then '{summary.USE_STORE}' end as action,
    coalesce(file, '') || ':' || coalesce(start_line, 0) place, severity, {RANK} sr, case upper(coalesce(trim(confidence), '')) when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 3 end cr, coalesce(file, '') f, coalesce(start_line, 0) l from f where {ACTIVE})
select finding_no, action, place, severity from g where action is not null order by sr, cr, f, l, finding_no limit 8""")
def quick_wins(spark, d):
    return summary.quick_wins(table(spark, d, "scan_findings"))


@query(f"""with {once('project', 'reachable', 'internet_exposed', 'authentication_required', 'endpoint', 'exploitability_score', 'code_snippet', 'detected_by', 'suppressed')}
select project, count(*) n, count(*) filter (reachable) reachable, count(*) filter (internet_exposed) internet_exposed, count(*) filter (internet_exposed and not authentication_required and endpoint <> '') open_endpoints,
  count(*) filter (exploitability_score >= 80) highly_exploitable, count(*) filter (code_snippet <> '') with_code, count(*) filter (len(list_distinct(detected_by)) > 1) several_engines from f where {ACTIVE} group by 1""")
def attack_surface(spark, d):
    return summary.exposure(table(spark, d, "scan_findings"))


# flows and packages


FLOW_QUERIES = [
    flows.FlowQuery("exposed", least_score=60.0, exposed=True),
    flows.FlowQuery("injection", cwe=("CWE-78", "CWE-89", "CWE-95"), login=False),
    flows.FlowQuery("http", source="http*", sink="*sql*"),
]


@query(f"""with {once('tool', 'source_kind', 'sink_kind', 'endpoint', 'cwe', 'authentication_required', 'internet_exposed', 'exploitability_score')}, g as (
  select finding_no, concat_ws(',', case when coalesce(exploitability_score, 0) >= 60 and internet_exposed is not distinct from true then 'exposed' end,
    case when list_has_any(cwe, ['CWE-78', 'CWE-89', 'CWE-95']) and not coalesce(authentication_required, false) then 'injection' end,
    case when starts_with(coalesce(trim(source_kind), ''), 'http') and contains(coalesce(trim(sink_kind), ''), 'sql') then 'http' end) queries from f where contains(coalesce(tool, ''), 'semantic'))
select * from g where queries <> ''""")
def flow_queries(spark, d):
    return flows.flow_matches(table(spark, d, "scan_findings"), FLOW_QUERIES)


@query(f"""with {once('endpoint', 'source_kind', 'sink_kind', 'file')}, c as (
  select list_filter(['endpoint:' || nullif(trim(endpoint), ''), 'source:' || nullif(trim(source_kind), ''), 'sink:' || nullif(trim(sink_kind), ''), 'file:' || nullif(trim(file), '')], lambda x: x is not null) n from f
), e as (select unnest(list_zip(n[1:len(n) - 1], n[2:])) p from c where len(n) > 1)
select p[1] src, p[2] dst, count(*) n from e group by 1, 2""")
def attack_path_edges(spark, d):
    return flows.attack_edges(table(spark, d, "scan_findings"))


@query(f"with {once('rule_id', 'file', 'message', 'category', 'severity')} select finding_no, {RANK} severity_rank from f where contains(lower(concat_ws(' ', rule_id, file, message, category)), 'lagoon') and severity = 'HIGH'")
def report_search(spark, d):
    return flows.report_search(table(spark, d, "scan_findings"), "Lagoon", "HIGH")


CONTROLS = {"CWE-89": [("owasp", "A03"), ("asvs", "V5")], "CWE-78": [("owasp", "A03")], "CWE-798": [("owasp", "A07"), ("asvs", "V2")], "CWE-22": [("owasp", "A01")]}


@query(f"""with {once('cwe', 'rule_id')}, m as (select * from (values ('CWE-89', 'owasp', 'A03'), ('CWE-89', 'asvs', 'V5'), ('CWE-78', 'owasp', 'A03'), ('CWE-798', 'owasp', 'A07'), ('CWE-798', 'asvs', 'V2'), ('CWE-22', 'owasp', 'A01')) t(cwe, standard, control)
), h as (select distinct finding_no, rule_id, standard, control from (select finding_no, rule_id, unnest(cwe) c from f) e join m on m.cwe = e.c)
select standard, control, count(*) n, array_to_string(list_sort(list(distinct rule_id)), ',') rules from h group by 1, 2""")
def standards_assessment(spark, d):
    return flows.standards(table(spark, d, "scan_findings"), CONTROLS)


@query(f"""with {once('project', 'category', 'secret_related_locations')}, e as (select finding_no, project, unnest(secret_related_locations) x from f where category = 'secret'
), g as (select distinct finding_no, project, replace(regexp_extract(x, '([^ ]+:[0-9]+)', 1), '\\', '/') place from e)
select place, count(*) n_findings, count(distinct project) n_projects from g where place <> '' group by 1 having count(*) > 1""")
def secret_clusters(spark, d):
    return flows.secret_clusters(table(spark, d, "scan_findings"))


def _packages(spark, d):
    """Order lines stand for packages in use, parts for advisories on them."""
    used = table(spark, d, "lineitem").select("l_orderkey", F.lit("pypi").alias("ecosystem"), F.concat(F.lit("pkg-"), "l_partkey").alias("package"), F.concat_ws(".", F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("version"))
    told = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("PKG-"), "p_partkey").alias("package"),
        F.when(F.col("p_size") % 3 > 0, F.lit("2.0")).alias("introduced"), F.when(F.col("p_size") % 3 < 2, F.concat(F.lit("4."), F.col("p_size"))).alias("fixed"), F.array(F.lit("1.1")).alias("versions"),
    )
    return used, told


@query("""with u as (select l_orderkey, l_partkey, l_linenumber a, cast(trunc(l_quantity) as integer) b from lineitem), p as (select p_partkey, case when p_size % 3 > 0 then 1 else 0 end has_from, case when p_size % 3 < 2 then 1 else 0 end has_to, p_size from part)
select p_partkey advisory, l_orderkey, a || '.' || b as version from u join p on p_partkey = l_partkey
where (a = 1 and b = 1) or ((has_from = 0 or (a, b) >= (2, 0)) and (has_to = 0 or (a, b) < (4, p_size)))""")
def sca_affected(spark, d):
    used, told = _packages(spark, d)
    return packages.affected_packages(used, told).select("advisory", "l_orderkey", "version")
