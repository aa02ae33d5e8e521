"""Source files and their lines: languages, declarative line rules, structure measures, snippets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.functions.text import plain_path

# fixed values: language by file extension
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "cs": "csharp",
    "go": "go", "rb": "ruby", "php": "php", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "scala": "scala", "swift": "swift", "sh": "shell", "yml": "yaml", "yaml": "yaml",
    "tf": "terraform", "ini": "ini", "sql": "sql", "json": "json", "xml": "xml", "md": "markdown",
}


#: file numbers up to which the set of files delivered more than once is broadcast; a larger one is joined by a shuffle
FEW = 500_000


def files_once(source_files: DataFrame, *columns: str) -> DataFrame:
    """Each file once: of several deliveries the latest indexed_at, ties by the greater content.

    Most files come once. Those that don't are found by their numbers alone, and only their texts are shuffled.
    """
    wanted = [c for c in dict.fromkeys(columns) if c != "file_no"]
    files = source_files.where("file_no is not null").select("file_no", "indexed_at", *(c for c in wanted if c != "indexed_at"))
    again = files.groupBy("file_no").agg(F.count("*").alias("n")).where("n > 1").select("file_no")
    if "lines" not in wanted:
        return _latest(files, wanted)
    if again.limit(FEW + 1).count() <= FEW:
        again = F.broadcast(again)
    return files.join(again, "file_no", "left_anti").select("file_no", *wanted).unionByName(_latest(files.join(again, "file_no", "left_semi"), wanted))


def _latest(files: DataFrame, wanted: list[str]) -> DataFrame:
    return files.groupBy("file_no").agg(F.max(F.struct("indexed_at", *wanted)).alias("v")).select("file_no", *(F.col(f"v.{c}").alias(c) for c in wanted))


def language_of(path: Column) -> Column:
    """The language of a path by its extension, 'other' where it has none that is known."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension), F.lit("other"))


def language_share(source_files: DataFrame) -> DataFrame:
    """language, files, n_lines, pct of all lines (one at least for each file)."""
    files = files_once(source_files, "path", "lines").select(language_of(plain_path(F.col("path"))).alias("language"), F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(1)).alias("n"))
    counted = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("n").alias("n_lines"))
    return counted.withColumn("pct", F.round(100 * F.col("n_lines") / F.sum("n_lines").over(Window.partitionBy()), 4))


def source_lines(source_files: DataFrame) -> DataFrame:
    """file_no, path, language, line_no (from 1), line; null lines are left out."""
    files = files_once(source_files, "path", "lines")
    rows = files.select("file_no", plain_path(F.col("path")).alias("path"), F.posexplode("lines").alias("at", "line"))
    return rows.where("line is not null").select("file_no", "path", language_of(F.col("path")).alias("language"), (F.col("at") + 1).alias("line_no"), "line")


@dataclass(frozen=True)
class LineRule:
    """A declarative rule on lines.

    A line matches when it holds ``contains`` (letter case aside) and ``regex``, and not ``without``. With ``after``, a
    line counts only at or below the file's first line that matches that regex. The file must hold every text of
    ``needs`` and none of ``unless``. ``languages`` are exact or '*'.
    """

    id: str
    severity: str = "MEDIUM"
    contains: str | None = None
    regex: str | None = None
    without: str | None = None
    after: str | None = None
    needs: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("*",)
    min_length: int = 0
    cwe: tuple[str, ...] = field(default=())

    def on_line(self) -> Column:
        line = F.col("line")
        test = F.length(line) >= self.min_length
        if "*" not in self.languages:
            test = test & F.col("language").isin(*self.languages)
        if self.contains:
            test = test & F.contains(F.lower(line), F.lit(self.contains.lower()))
        if self.regex:
            test = test & line.rlike(self.regex)
        if self.without:
            test = test & ~line.rlike(self.without)
        return test


def rule_matches(source_files: DataFrame, rules: list[LineRule], per_file: int | None = None) -> DataFrame:
    """rule_id, severity, file_no, line_no of every match.

    Rules are few and become one expression over each line, so matching is a single pass without a join; only rules
    with file conditions or anchors look at the file as a whole, through one window-free aggregate. With ``per_file``
    each file keeps its first matches in order of rule and line, which is what the limit means.
    """
    lines = source_lines(source_files)
    hits = F.filter(F.array(*(F.when(r.on_line(), F.lit(i)) for i, r in enumerate(rules))), lambda i: i.isNotNull())
    found = lines.select("file_no", "line_no", F.explode(hits).alias("r"))
    table = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r in rules)), F.col("r") + 1)
    gated = [(i, r) for i, r in enumerate(rules) if r.after or r.needs or r.unless]
    if gated:
        low = F.lower("line")
        checks = []
        for i, r in gated:
            if r.after:
                checks.append(F.min(F.when(F.col("line").rlike(r.after), F.col("line_no"))).alias(f"after{i}"))
            checks += [F.max(F.contains(low, F.lit(t.lower()))).alias(f"needs{i}_{j}") for j, t in enumerate(r.needs)]
            checks += [F.max(F.contains(low, F.lit(t.lower()))).alias(f"unless{i}_{j}") for j, t in enumerate(r.unless)]
        files = lines.groupBy("file_no").agg(*checks)
        ok = F.lit(True)
        for i, r in gated:
            mine = F.lit(True)
            if r.after:
                mine = mine & F.coalesce(F.col("line_no") >= F.col(f"after{i}"), F.lit(False))
            for j in range(len(r.needs)):
                mine = mine & F.col(f"needs{i}_{j}")
            for j in range(len(r.unless)):
                mine = mine & ~F.col(f"unless{i}_{j}")
            ok = ok & ((F.col("r") != i) | mine)
        found = found.join(files, "file_no").where(ok).select("file_no", "line_no", "r")
    if per_file is not None:
        order = F.row_number().over(Window.partitionBy("file_no").orderBy("r", "line_no"))
        found = found.withColumn("k", order).where(F.col("k") <= per_file).drop("k")
    return found.select(table(lambda r: r.id).alias("rule_id"), table(lambda r: r.severity).alias("severity"), "file_no", "line_no")


def nesting(source_files: DataFrame) -> DataFrame:
    """file_no, depth: the deepest nesting of braces.

    Depth never falls below zero; the clamped running sum is S_i - min(0, min of S up to i), S the plain running sum, so two
    windows give it without a loop.
    """
    lines = source_lines(source_files).select("file_no", "line_no", (F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit("")))).alias("opens"), (F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit("")))).alias("closes"))
    upto = Window.partitionBy("file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file_no").orderBy("line_no")
    s = lines.withColumn("s", F.sum(F.col("opens") - F.col("closes")).over(upto))
    s = s.withColumn("next", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    depth = F.coalesce(F.lag("next").over(before), F.lit(0)) + F.col("opens")
    return s.withColumn("depth", depth).groupBy("file_no").agg(F.max("depth").cast("int").alias("depth"))


# fixed values: what counts as a number that needs a name, how many of them on a line, and lines of a large and of a huge file
NUMBER = r"(?:^|[^0-9A-Za-z_.])(0[xX][0-9a-fA-F]+|[0-9]{3,})\b"
PLAIN_NUMBER = r"^0[xX]?0*[012]?$"
NUMBERS_ON_A_LINE, LARGE_FILE, HUGE_FILE = 3, 400, 800


def magic_numbers(source_files: DataFrame, least: int = NUMBERS_ON_A_LINE) -> DataFrame:
    """file_no, line_no, n of lines with ``least`` numbers of three digits or more, or hexadecimal; 0, 1 and 2 don't count however they are written."""
    n = F.size(F.filter(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(1)), lambda x: ~x.rlike(PLAIN_NUMBER)))
    return source_lines(source_files).select("file_no", "line_no", n.alias("n")).where(F.col("n") >= least)


def file_sizes(source_files: DataFrame, low: int = LARGE_FILE, high: int = HUGE_FILE) -> DataFrame:
    """file_no, n_lines, severity: LOW for files of many lines, HIGH for far too many, null for others."""
    files = files_once(source_files, "lines").select("file_no", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"))
    return files.withColumn("severity", F.when(F.col("n_lines") >= high, "HIGH").when(F.col("n_lines") >= low, "LOW"))


def snippet_context(places: DataFrame, source_files: DataFrame, context: int = 2) -> DataFrame:
    """file_no, line_no, snippet: the lines around each place, ``n: text`` joined by line breaks.

    ``places`` has file_no and line_no. The range join becomes an equi join: each place asks for its lines by number.
    """
    asked = places.select("file_no", "line_no").distinct().select("file_no", "line_no", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("n"))
    lines = source_lines(source_files).select("file_no", F.col("line_no").alias("n"), "line")
    rows = asked.join(lines, ["file_no", "n"]).select("file_no", "line_no", F.struct("n", F.concat_ws(": ", F.col("n").cast("string"), "line").alias("t")).alias("x"))
    return rows.groupBy("file_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("snippet"))
