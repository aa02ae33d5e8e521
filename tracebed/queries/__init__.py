"""All registered queries outside the llm subpackage, and their SQL twins."""

from tracebed.queries import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
ORACLE = {**problems.ORACLE, **reference.ORACLE}
