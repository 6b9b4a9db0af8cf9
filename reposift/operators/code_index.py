"""From a repository's listing to searchable chunks of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.operators import embedding

# File name extensions that are indexed.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java")
# Folders that are left out.
DENIED = ("node_modules", "dist", "build", "out", "target", "vendor", ".git", "coverage", "__snapshots__", ".next", ".nuxt", ".cache")
MAX_FILE_BYTES, HOST_BYTES = 100 * 1024, 1024 * 1024
MAX_FILES = 20
MAX_LINES, WINDOW, OVERLAP = 80, 40, 10
SNIPPET = 240
CHUNK_SEED = 5382

# What a folder adds to a path's score.
FOLDER_SCORES = {
    "src": 5, "lib": 5, "test": -3, "tests": -3, "spec": -3, "__tests__": -3, "__test__": -3, "examples": -2, "example": -2, "demo": -2,
}
# Languages by name and extension.
LANGUAGES = {
    "javascript": "javascript", "typescript": "typescript", "python": "python", "rust": "rust", "go": "go", "java": "java",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "rs": "rust",
}
# Patterns of header lines by language; the first that matches gives the kind.
HEADERS = {
    "javascript": (
        ("class", r"^(?:export\s+)?(?:default\s+)?class\s+\w+"),
        ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*\w+\s*\("),
        ("function", r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:function|\()"),
        ("method", r"^\s+(?:static\s+)?(?:async\s+)?#?\w+\s*\([^)]*\)\s*\{"),
    ),
    "typescript": (
        ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+\w+"),
        ("type", r"^(?:export\s+)?(?:type|interface)\s+\w+"),
        ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*\w+\s*[<(]"),
        ("function", r"^(?:export\s+)?(?:const|let|var)\s+\w+(?:\s*:[^=]+)?\s*=\s*(?:async\s*)?(?:function|\(|<)"),
        ("method", r"^\s+(?:public|private|protected|static|readonly|async|\s)*\w+\s*[<(]"),
    ),
    "python": (
        ("class", r"^class\s+\w+"),
        ("function", r"^(?:async\s+)?def\s+\w+"),
        ("method", r"^\s+(?:@\w+(?:\([^)]*\))?\s*)*(?:async\s+)?def\s+\w+"),
    ),
    "rust": (
        ("impl", r"^impl(?:\s*<[^>]*>)?\s+\w+"),
        ("function", r"^(?:pub\s+)?(?:async\s+)?fn\s+\w+"),
        ("type", r"^(?:pub\s+)?(?:struct|enum|trait|type)\s+\w+"),
        ("method", r"^\s+(?:pub\s+)?(?:async\s+)?fn\s+\w+"),
    ),
    "go": (
        ("function", r"^func\s+(?:\([^)]+\)\s+)?\w+\s*\("),
        ("type", r"^type\s+\w+\s+(?:struct|interface)"),
    ),
    "java": (
        ("class", r"^(?:public|private|protected|abstract|final|\s)*class\s+\w+"),
        ("method", r"^\s+(?:public|private|protected|static|final|abstract|synchronized|\s)*\w+(?:<[^>]+>)?\s+\w+\s*\("),
    ),
}


def filter_tree(tree: DataFrame, max_file_bytes: int = MAX_FILE_BYTES, extensions=EXTENSIONS, denied=DENIED) -> DataFrame:
    """Listing entries worth indexing: files of a fair size, outside denied folders, with a known extension."""
    size = F.col("size")
    words = lambda found: F.array(*(F.lit(x) for x in found))
    keep = (F.col("type") == "blob") & (size > 0) & (size <= min(max_file_bytes, HOST_BYTES))
    keep &= ~F.arrays_overlap(F.split("path", "/"), words(denied))
    keep &= F.contains(F.col("path"), F.lit(".")) & F.lower(F.substring_index("path", ".", -1)).isin(*extensions)
    return tree.where(keep)


def path_score(path: Column) -> Column:
    """Folders add their scores, and files near the root one point for each level below five."""
    parts = F.split(path, "/")
    table = F.create_map(*(F.lit(x) for pair in FOLDER_SCORES.items() for x in pair))
    folders = F.aggregate(parts, F.lit(0), lambda s, x: s + F.coalesce(F.try_element_at(table, x), F.lit(0)))
    return folders + F.greatest(F.lit(0), 5 - F.size(parts))


def top_files(tree: DataFrame, n: int = MAX_FILES) -> DataFrame:
    """Each repository's n best files with rank: score, then shorter paths, then listing order."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("score"), F.length("path"), "pos"))
    return tree.withColumn("score", path_score(F.col("path"))).withColumn("rank", place).where(F.col("rank") <= n)


def language_of(path: Column) -> Column:
    """Language by the extension; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)))


def normalize_language(label: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, text.trim(F.lower(label)))


def _window_spans(lines: Column, size: int, overlap: int) -> Column:
    """(start, end, kind, header) of overlapping windows of lines, from 0 on and without end; the last one ends with the file."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    stride, n = size - overlap, F.size(lines)
    windows = F.when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), windows - 1), lambda k: _span(k * stride, F.least(k * stride + size, n), F.lit("window"), F.lit("")))


def _span(start: Column, end: Column, kind: Column, header: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"), header.alias("header"))


def _cut(files: DataFrame, columns: list[str]) -> DataFrame:
    """One row per span of files (__lines, __spans): a file is one row, so nothing is shuffled."""
    # The outer form: with the plain one the optimizer works the spans out a second time, to drop files without any at the scan.
    each = files.select(*columns, "__lines", F.posexplode_outer("__spans").alias("part", "__span")).where("__span IS NOT NULL")
    start, end = F.col("__span.start"), F.col("__span.end")
    return each.select(
        *columns, "part", F.array_join(F.slice("__lines", start + 1, end - start), "\n").alias("text"),
        (start + 1).alias("start_line"), end.alias("end_line"), F.col("__span.kind").alias("kind"), F.col("__span.header").alias("header_line"),
    )


def window_chunks(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of lines; the last one ends with the file; an empty file has none. No shuffle."""
    lines = files.where("content <> ''").withColumn("__lines", F.split("content", "\n"))
    return _cut(lines.withColumn("__spans", _window_spans(F.col("__lines"), size, overlap)), [x for x in files.columns if x != "content"])


def header_kind(line: Column, language: Column) -> Column:
    """Kind of the header that the raw line is in its language, else null."""
    out = F.lit(None).cast("string")
    for name, patterns in HEADERS.items():
        kind = F.when(F.lit(False), F.lit(""))
        for found, pattern in patterns:
            kind = kind.when(F.regexp_like(line, F.lit(pattern.replace(r"\s", text.WS))), F.lit(found))
        out = F.when(language == name, kind).otherwise(out)
    return out


def _header_spans(lines: Column, heads: Column, max_lines: int) -> Column:
    """(start, end, kind, header) of the sections from one header line (heads: line, kind) to the next, cut every max_lines lines."""

    def section(head: Column, k: Column) -> Column:
        line, stop = head["line"], F.coalesce(F.get(heads, k + 1)["line"], F.size(lines))
        cut = lambda c: _span(line + c * max_lines, F.least(line + (c + 1) * max_lines, stop), head["kind"], F.when(c == 0, text.trim(F.get(lines, line))).otherwise(""))
        return F.transform(F.sequence(F.lit(0), F.floor((stop - line - 1) / max_lines).cast("int")), cut)

    return F.flatten(F.transform(heads, section))


def _headed(files: DataFrame) -> DataFrame:
    """files with __lines and __heads, the header lines of their language; each line is looked at once."""
    lines = files.withColumn("__lines", F.split("content", "\n"))
    kinds = F.transform("__lines", lambda x, i: F.struct(i.alias("line"), header_kind(x, F.col("language")).alias("kind")))
    known = F.coalesce(F.col("language").isin(*HEADERS), F.lit(False))
    return lines.withColumn("__heads", F.when(known, F.filter(kinds, lambda x: x["kind"].isNotNull())).otherwise(F.array().cast("array<struct<line:int,kind:string>>")))


def header_chunks(files: DataFrame, max_lines: int = MAX_LINES, keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """Sections from one header line to the next, cut every max_lines lines; continuations have an empty header.

    Text before the first header is left out, and so are files without one. A
    section whose length is a multiple of max_lines ends there: no empty chunk
    follows. Nothing is shuffled.
    """
    spans = _header_spans(F.col("__lines"), F.col("__heads"), max_lines)
    return _cut(_headed(files).withColumn("__spans", spans), list(keys))


def chunks(files: DataFrame, max_lines: int = MAX_LINES, size: int = WINDOW, overlap: int = OVERLAP, keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """Header chunks of files in a known language (by name or any label for it) that have a header, windows of all others; one pass, no shuffle."""
    found = _headed(files.where("content <> ''").withColumn("language", normalize_language(F.col("language"))))
    lines, heads = F.col("__lines"), F.col("__heads")
    spans = F.when(F.size(heads) > 0, _header_spans(lines, heads, max_lines)).otherwise(_window_spans(lines, size, overlap))
    return _cut(found.withColumn("__spans", spans), list(keys))


def chunk_rows(found: DataFrame, parity: bool = True) -> DataFrame:
    """Vector-table columns of the chunks, without vectors. found: repo_id, path and the columns of chunks()."""
    name = F.concat(F.lit("code:"), F.col("repo_id").cast("string"), F.lit(":"), F.col("path"), F.lit(":"), F.col("part").cast("string"))
    return found.select(
        name.alias("id"), F.col("repo_id").alias("star_id"), "path", F.col("part").cast("int").alias("chunk_index"), "start_line", "end_line",
        F.col("kind").alias("chunk_kind"), "header_line", F.substring("text", 1, SNIPPET).alias("snippet"),
        embedding.content_hash(F.col("text"), parity, CHUNK_SEED).alias("content_hash"), F.col("text").alias("input"),
    )


def mark_indexed(repos: DataFrame, landed: DataFrame, at: Column) -> DataFrame:
    """repos (repo_id) with n chunks that landed, deep_indexed, the time of indexing, and a reason where none landed."""
    counts = landed.groupBy("repo_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return repos.join(counts, "repo_id", "left").select(
        "repo_id", n.alias("n"), (n > 0).alias("deep_indexed"), F.when(n > 0, at).alias("last_deep_indexed_at"), F.when(n == 0, "no chunks").alias("reason")
    )
