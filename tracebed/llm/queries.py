"""Queries of the problems on training data. Where SQL can't express one, its test holds it against brute force."""

from __future__ import annotations

from tracebed.llm.batches import repeated_findings
from tracebed.llm.garbled import damaged_documents, restored_documents
from tracebed.llm.mixing import mixture, mixture_shares
from tracebed.llm.secrets import credential_lines, redacted_texts
from tracebed.llm.spans import shared_lines, shared_share
from tracebed.llm.tokens import appended_ids, encode_texts
from tracebed.session import Scratch
from tracebed.sources.tables import table


def p1_found(spark, d):
    return repeated_findings(table(spark, d, "scan_findings"), table(spark, d, "findings"))


def p2_found(spark, d):
    return credential_lines(table(spark, d, "source_files"), table(spark, d, "scan_findings"))


def p2_redacted(spark, d):
    return redacted_texts(table(spark, d, "source_files"), table(spark, d, "scan_findings"))


def p5_found(spark, d):
    return shared_lines(table(spark, d, "tokenized_lines"))


def p5_share(spark, d):
    return shared_share(table(spark, d, "tokenized_lines"))


def p6_ids(spark, d):
    return encode_texts(table(spark, d, "documents"))


def p6_updated(spark, d):
    return appended_ids(table(spark, d, "documents"), Scratch(spark, "updates"))


def p7_shares(spark, d):
    return mixture_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mixture(spark, d):
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    return damaged_documents(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark, d):
    return restored_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_redacted, p5_found, p5_share, p6_ids, p6_updated, p7_mixture, p7_shares, p8_found, p8_restored)}

_SPAN = """
with lines as (
  select file_no, line_no, min(nullif(lower(trim(token_hash)), '')) t from tokenized_lines where file_no is not null and line_no is not null group by 1, 2
), numbered as (
  select *, row_number() over (partition by file_no order by line_no) pos from lines
), grams as (
  select file_no, pos, string_agg(t, ' ') over w g, count(t) over w n from numbered window w as (partition by file_no order by pos rows between current row and 9 following)
), shared as (
  select g from grams where n = 10 group by g having count(distinct file_no) > 1
), starts as (
  select file_no, pos from grams join shared using (g) where n = 10
), hit as (
  select distinct l.file_no, l.line_no from numbered l join starts s on s.file_no = l.file_no and l.pos between s.pos and s.pos + 9
)"""

ORACLE = {
    "p5_found": _SPAN + " select file_no, line_no from hit",
    "p5_share": _SPAN
    + " select file_no, count(*) n_lines, count(h.line_no) n_shared, round(count(h.line_no) / count(*), 6) share from lines l left join hit h using (file_no, line_no) group by file_no",
}
