"""Parsers: source files, documents, notebooks, diffs and logs to rows.

Line-structured formats are parsed with Column expressions; only syntax trees
need Python (Arrow batches, errors as a column, never exceptions).
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Languages by extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "java": "java", "go": "go", "rs": "rust", "kt": "kotlin", "md": "markdown", "rst": "rst", "txt": "text", "ipynb": "notebook"}


def language_of(path: Column) -> Column:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.element_at(F.split(path, r"\."), -1)))


def discovered(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(LANGUAGES), ignore: tuple[str, ...] = ("**/.git/**", "**/node_modules/**")) -> DataFrame:
    """path, content of files below ``root`` by extension whitelist and ignore globs."""
    from ..functions.text import glob_regex

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    for g in ignore:
        files = files.where(~F.regexp_like("path", F.lit(glob_regex(g))))
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def normalized_path(path: Column) -> Column:
    """Forward slashes, without ``./``, doubled slashes and ``x/..`` steps; a path that leaves the root is null."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, "(^|/)(\\./)+", "$1"), "^/", "")
    for _ in range(4):
        p = F.regexp_replace(p, "(^|/)(?!\\.\\./)[^/]+/\\.\\./", "$1")
    return F.when(~F.regexp_like(p, F.lit("(^|/)\\.\\.(/|$)")), p)


def lines(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """path, line (from 1), text."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def line_range(text: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def markdown_sections(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """path, section, level, title, body: text under each heading; code fences are not headings; what precedes the first is section 0."""
    ls = lines(files, key, text)
    by = Window.partitionBy(key).orderBy("line")
    ls = ls.withColumn("fence", F.sum(F.regexp_like("text", F.lit("^\\s*```")).cast("int")).over(by) % 2)
    head = F.regexp_extract("text", r"^(#{1,6})\s+\S", 1)
    ls = ls.withColumn("mark", F.when((F.col("fence") == 0), head).otherwise(""))
    ls = ls.withColumn("section", F.sum((F.col("mark") != "").cast("int")).over(by))
    return ls.groupBy(key, "section").agg(
        F.max(F.length("mark")).alias("level"), F.max(F.when(F.col("mark") != "", F.regexp_replace("text", r"^#+\s+", ""))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mark") == "", F.struct("line", "text")))), lambda s: s["text"]), "\n").alias("body"),
    )


def notebook_cells(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """path, cell, cell_type, source of notebooks; a broken file has no cells."""
    cells = F.from_json(F.get_json_object(text, "$.cells"), "array<struct<cell_type:string,source:string>>")
    e = files.select(key, F.posexplode(cells).alias("cell", "c"))
    lines_ = F.from_json("c.source", "array<string>")
    return e.select(key, "cell", "c.cell_type", F.coalesce(F.array_join(lines_, ""), F.col("c.source")).alias("source"))


def git_log(text: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """commit, date, file, adds, dels from ``commit|date`` heads and tabbed counts; binary files (``-``) are left out."""
    ls = lines(text, key, column)
    by = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.contains("text", F.lit("|")) & ~F.contains("text", F.lit("\t")), F.col("text"))
    ls = ls.withColumn("head", F.last(head, ignorenulls=True).over(by)).where(F.regexp_like("text", F.lit("^\\d+\\t\\d+\\t.")))
    part, top = F.split("text", "\t"), F.split("head", "\\|")
    return ls.select(top[0].alias("commit"), top[1].alias("date"), part[2].alias("file"), part[0].cast("long").alias("adds"), part[1].cast("long").alias("dels"))


def diff_hunks(text: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """file, old_start, old_count, new_start, new_count, added, removed of each hunk of unified diffs."""
    ls = lines(text, key, column)
    by = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda mark, prefix: F.last(F.when(F.regexp_like("text", F.lit(f"^{mark} ")), F.regexp_replace("text", f"^{mark} ({prefix}/)?", "")), ignorenulls=True).over(by)
    # a deleted file has no new name
    ls = ls.withColumn("old", side("---", "a")).withColumn("new", side(r"\+\+\+", "b")).withColumn("file", F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.col("new"))).withColumn("hunk", F.sum(F.regexp_like("text", F.lit("^@@ ")).cast("int")).over(by))
    ls = ls.where("hunk > 0 and file is not null")
    spec = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    nums = [F.max(F.when(F.regexp_like("text", F.lit("^@@ ")), F.when(F.regexp_extract("text", spec, i) == "", "1").otherwise(F.regexp_extract("text", spec, i)))).cast("int").alias(n) for i, n in ((1, "old_start"), (2, "old_count"), (3, "new_start"), (4, "new_count"))]
    added, removed = F.regexp_like("text", F.lit(r"^\+(?!\+\+ )")), F.regexp_like("text", F.lit("^-(?!-- )"))
    return ls.groupBy(key, "file", "hunk").agg(*nums, F.sum(added.cast("int")).alias("added"), F.sum(removed.cast("int")).alias("removed")).drop("hunk")


SYMBOL = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("kind", T.StringType()), ("name", T.StringType()), ("fqn", T.StringType()), ("parent", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("docstring", T.StringType()), ("complexity", T.IntegerType()), ("error", T.StringType()))])
RELATION = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("kind", T.StringType()), ("src", T.StringType()), ("dst", T.StringType()), ("line", T.IntegerType()))])


def _module(path: str) -> str:
    bare = path.rsplit(".", 1)[0]
    return (bare.split("src/", 1)[1] if "src/" in bare else bare.lstrip("/")).replace("/", ".")


def _complexity(node: ast.AST) -> int:
    return 1 + sum(isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)) for n in ast.walk(node))


def parse_source(path: str, code: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations (CONTAINS, CALLS, IMPORTS, INHERITS, WRITES, READS) of one Python file; an error is a row."""
    module = _module(path)
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "module", module, module, None, 1, 1, None, 0, f"{type(e).__name__}: {e}")], []
    symbols = [(path, "module", module.rsplit(".", 1)[-1], module, None, 1, len((code or "").split("\n")), ast.get_docstring(tree), _complexity(tree), None)]
    relations: list[tuple] = []

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        return None

    def visit(node: ast.AST, owner: str, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside == "class" else "function"
                fqn = f"{owner}.{child.name}"
                symbols.append((path, kind, child.name, fqn, owner, child.lineno, child.end_lineno, ast.get_docstring(child), _complexity(child), None))
                relations.append((path, "CONTAINS", owner, fqn, child.lineno))
                if isinstance(child, ast.ClassDef):
                    relations.extend((path, "INHERITS", fqn, b, child.lineno) for b in map(dotted, child.bases) if b)
                visit(child, fqn, kind)
                continue
            if isinstance(child, ast.Call) and (name := dotted(child.func)):
                relations.append((path, "CALLS", owner, name, child.lineno))
            elif isinstance(child, ast.Import):
                relations.extend((path, "IMPORTS", module, a.name, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                relations.extend((path, "IMPORTS", module, "." * child.level + (child.module or "") + ("." if child.module else "") + a.name, child.lineno) for a in child.names)
            elif isinstance(child, ast.Name):
                relations.append((path, "WRITES" if isinstance(child.ctx, ast.Store) else "READS", owner, f"{owner}.{child.id}", child.lineno))
            visit(child, owner, inside)

    visit(tree, module, "module")
    return symbols, relations


def spread(files: DataFrame) -> DataFrame:
    """path, content dealt to all cores: a table of few bytes is read by few tasks, however long its files take to parse."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.select("path", "content").repartition(tasks, "path")


def _rows(files: DataFrame, rows_of, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [r for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(*parse_source(path, code))]
            columns = list(zip(*rows, strict=True)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return spread(files).mapInArrow(run, schema)


def python_symbols(files: DataFrame) -> DataFrame:
    return _rows(files, lambda symbols, relations: symbols, SYMBOL)


def python_relations(files: DataFrame) -> DataFrame:
    return _rows(files, lambda symbols, relations: relations, RELATION)


def python_graph(files: DataFrame) -> DataFrame:
    """path, part (node or edge), kind, src (a node's name), dst, line of the symbols and relations of files, each parsed once."""
    schema = T.StructType([RELATION["path"], T.StructField("part", T.StringType()), *RELATION.fields[1:]])
    return _rows(files, lambda symbols, relations: [(s[0], "node", s[1], s[3], None, s[5]) for s in symbols] + [(r[0], "edge", *r[1:]) for r in relations], schema)


def document_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk, content: windows of ``size`` characters that overlap; a short text is one chunk."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step).cast("int") - 1))
    e = docs.select(key, text, F.explode(starts).alias("chunk"))
    return e.select(key, "chunk", F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)).alias("content"))


def index_documents(chunks: DataFrame) -> DataFrame:
    """chunk_id, search_text, identifiers, error: rows ready for the indexes; a chunk without content has an error."""
    words = F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))
    return chunks.select("chunk_id", F.concat_ws(" ", "file_path", "content").alias("search_text"), F.coalesce(F.array_sort(words), F.array().cast("array<string>")).alias("identifiers"), F.when(F.col("content").isNull(), "no content").alias("error"))
