"""Readers and writers of sequence and tree text formats.

Readers keep everything in DataFrames; a file's rows carry their order in ``ord``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.functions import names
from cladeweave.sources import ranges


def read_fasta(spark: SparkSession, path: str, keep_file: bool = False) -> DataFrame:
    """``marker, name, ord, seq`` of all FASTA files under a path; wrapped lines are joined.

    Records are split at ``>`` at the start of a line, so a file is never held whole.  ``keep_file`` adds
    the file's path as ``file``.
    """
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    more = [file.alias("file")] if keep_file else []
    rows = raw.select(names.strip_marker_prefix(file).alias("marker"), F.monotonically_increasing_id().alias("ord"), text.alias("t"), *more).where("trim(t) != ''")
    return rows.select(*(["file"] if keep_file else []), "marker", F.trim(F.split_part("t", F.lit("\n"), F.lit(1))).alias("name"), "ord", F.regexp_replace(F.regexp_replace("t", "^[^\n]*", ""), r"\s+", "").alias("seq"))


def write_fasta(aln: DataFrame, path: str, mode: str = "error") -> None:
    """One folder of FASTA text for each marker, in row order within each."""
    lines = F.format_string(">%s\n%s", "name", "seq").alias("value")
    aln.repartition("marker").sortWithinPartitions("marker", "ord").select("marker", lines).write.mode(mode).partitionBy("marker").text(path)


def _plain_uri(file: Column) -> Column:
    """One form of a file's path: a scheme and one slash, or for local files none."""
    return F.regexp_replace(F.regexp_replace(file, "^([a-z0-9]+):/+", "$1:/"), "^file:", "")


def fasta_status(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_records, status`` of every file under a path: OK, EMPTY or NOT_FASTA (text before the first ``>``)."""
    return ranges.fasta_file_status(spark, path).withColumn("file", _plain_uri(F.col("file")))


def read_fasta_safe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sequences of all files that are FASTA, and the status of every file."""
    status = fasta_status(spark, path)
    rows = read_fasta(spark, path, keep_file=True).withColumn("file", _plain_uri(F.col("file"))).join(status.where("status = 'OK'").select("file"), "file", "left_semi")
    return rows.drop("file"), status


def phylip_lines(matrix: DataFrame) -> DataFrame:
    """``ord, line``: the header and one line for each taxon in order of names."""
    head = matrix.agg(F.concat_ws(" ", F.count("*").cast("string"), F.max(F.length("seq")).cast("string")).alias("line")).select(F.lit("").alias("ord"), "line")
    return head.union(matrix.select(F.col("name").alias("ord"), F.concat_ws(" ", "name", "seq").alias("line")))


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq`` of sequential PHYLIP text."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[0-9]+\s+[0-9]+\s*$") & (F.trim("value") != ""))
    return rows.select(F.regexp_extract("value", r"^\s*(\S+)\s", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^\s*\S+\s+", ""), r"\s+", "").alias("seq"))


def nexus_lines(matrix: DataFrame) -> DataFrame:
    """``ord, line`` of a NEXUS data block."""
    size = matrix.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("w"))
    head = F.array(*(F.struct(F.lit(f"0{k}").alias("ord"), c.alias("line")) for k, c in enumerate((
        F.lit("#NEXUS"), F.lit("BEGIN DATA;"), F.format_string("  DIMENSIONS NTAX=%d NCHAR=%d;", "n", "w"), F.lit("  FORMAT DATATYPE=DNA MISSING=N GAP=- INTERLEAVE=NO;"), F.lit("  MATRIX")))))
    tail = F.array(F.struct(F.lit("20").alias("ord"), F.lit("  ;").alias("line")), F.struct(F.lit("21").alias("ord"), F.lit("END;").alias("line")))
    frame = size.select(F.explode(F.concat(head, tail)).alias("r")).select("r.*")
    return frame.union(matrix.select(F.concat(F.lit("1"), "name").alias("ord"), F.concat(F.lit("    "), "name", F.lit(" "), "seq").alias("line")))


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Ordered lines as one text file (a rendered document, not a data set)."""
    lines.orderBy("ord").select(F.col("line").alias("value")).coalesce(1).write.mode(mode).text(path)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with an explicit schema; blanks around fields are dropped."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"', multiLine=True)


def read_table(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Text columns separated by runs of blanks; quotes around a field are dropped; short rows end in nulls."""
    rows = ranges.read_lines(spark, path).select("file", "at", F.trim(F.regexp_replace("value", "\\s", " ")).alias("v")).where("v != ''")
    if header:
        rows = rows.join(rows.groupBy("file").agg(F.min("at").alias("at")), ["file", "at"], "left_anti")
    fields = F.regexp_extract_all("v", F.lit(r"\"[^\"]*\"|\S+"), F.lit(0))
    return rows.select(fields.alias("x")).select(*(F.regexp_replace(F.get("x", F.lit(k)), "^\"|\"$", "").alias(c) for k, c in enumerate(columns)))


def read_excel(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """All cells of one sheet of a workbook as text, with the first row as column names.

    A workbook is small by its format; the driver reads it.  Empty cells are null.
    """
    import io
    import zipfile
    from xml.etree import ElementTree

    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{space}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        root = ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows = []
    for row in root.iter(f"{space}row"):
        cells = {}
        for k, cell in enumerate(row.iter(f"{space}c")):
            letters = re.match("[A-Z]*", cell.get("r", ""))[0]
            at = k
            if letters:
                at = -1
                for c in letters:
                    at = (at + 1) * 26 + ord(c) - 65
            value = cell.find(f"{space}v")
            if cell.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{space}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        rows.append(cells)
    if not rows:
        raise ValueError(f"empty sheet {sheet} in {path}")
    width = max(rows[0], default=-1) + 1
    header = [rows[0].get(k) or f"column_{k + 1}" for k in range(width)]
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.createDataFrame([tuple(r.get(k) for k in range(width)) for r in rows[1:]], schema)


def write_csv_dual(df: DataFrame, folder: str, legacy: str, standard: str, mode: str = "error") -> None:
    """The same table under an old and a new name, nulls as empty fields."""
    for name in dict.fromkeys((legacy, standard)):
        df.write.mode(mode).csv(f"{folder}/{name}", header=True, nullValue="", emptyValue="")


# Newick

_NEWICK = re.compile(r"\[(?P<comment>[^\]]*)\]|'(?P<quoted>(?:[^']|'')*)'|(?P<mark>[(),:;])|(?P<plain>[^\s()\[\],:;']+)")
NODE_SCHEMA = "tree_id string, node_id long, parent_id long, label string, branch_length double, support double, is_tip boolean, comment string"


def parse_newick(text: str) -> list[tuple]:
    """Nodes ``(node_id, parent_id, label, branch_length, support, is_tip, comment)`` in pre-order.

    Node 0 is the root.  Labels of inner nodes that are numbers are supports.  No recursion: depth is
    bounded by memory only.
    """
    nodes: list[list] = [[0, None, None, None, None, None]]  # id, parent, label, length, comment, has children
    at, want_length, open_nodes = 0, False, []
    for m in _NEWICK.finditer(text):
        mark = m["mark"]
        if m["comment"] is not None:
            nodes[at][4] = m["comment"]
        elif mark == "(":
            nodes[at][5] = True
            open_nodes.append(at)
            nodes.append([len(nodes), at, None, None, None, None])
            at = len(nodes) - 1
        elif mark == ",":
            if not open_nodes:
                raise ValueError("comma outside of a group")
            nodes.append([len(nodes), open_nodes[-1], None, None, None, None])
            at = len(nodes) - 1
        elif mark == ")":
            if not open_nodes:
                raise ValueError("unbalanced parentheses")
            at = open_nodes.pop()
        elif mark == ":":
            want_length = True
        elif mark == ";":
            break
        elif want_length:
            nodes[at][3], want_length = float(m["plain"]), False
        else:
            nodes[at][2] = m["quoted"].replace("''", "'") if m["quoted"] is not None else m["plain"]
    if open_nodes:
        raise ValueError("unbalanced parentheses")
    out = []
    for n, parent, label, length, comment, inner in nodes:
        support = None
        if inner and label is not None:
            try:
                support = float(label)
            except ValueError:
                pass
        out.append((n, parent, label, length, support, not inner, comment))
    return out


def format_newick(nodes: list[tuple]) -> str:
    """The inverse of ``parse_newick`` (children in the order of node ids)."""
    children: dict = {}
    for n in sorted(nodes, key=lambda n: n[0]):
        children.setdefault(n[1], []).append(n)

    def name(n: tuple) -> str:
        label = n[2] or ""
        label = "'" + label.replace("'", "''") + "'" if re.search(r"[\s()\[\],:;']", label) else label
        return label + (f"[{n[6]}]" if n[6] is not None else "") + (f":{n[3]!r}" if n[3] is not None else "")

    parts, stack = [], [(children[None][0], False)]
    while stack:
        n, done = stack.pop()
        below = children.get(n[0], []) if n[0] is not None else []
        if done:
            parts.append(")" + name(n))
        elif below:
            parts.append("(")
            stack.append((n, True))
            for k, c in enumerate(reversed(below)):
                stack.append((c, False))
                if k < len(below) - 1:
                    stack.append(((None, None, ",", None, None, None, None), None))
        elif n[0] is None:
            parts.append(",")
        else:
            parts.append(name(n))
    return "".join(parts) + ";"


def comment_values(comment: str | Column) -> Column:
    """The ``key=value`` pairs of a node's comment ``&k=v,set={a,b}`` as a map of texts; null if there are none."""
    c = F.col(comment) if isinstance(comment, str) else comment
    pairs = F.regexp_extract_all(F.regexp_replace(c, "^&", ""), F.lit(r"([^,={}]+)=(\{[^}]*\}|\"[^\"]*\"|[^,]*)"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), "^\"|\"$", "")))
    first = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, F.lit(1), k), lambda x: x.col1 == e.col1))
    return F.when(F.size(pairs) > 0, F.map_from_entries(first))


def newick_nodes(trees: DataFrame) -> DataFrame:
    """Node rows of ``trees(tree_id, newick)``, parsed in Arrow tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree_id", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("label", pa.string()), ("branch_length", pa.float64()), ("support", pa.float64()), ("is_tip", pa.bool_()), ("comment", pa.string())])
        for b in batches:
            for tree, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(tree, *n) for n in parse_newick(text)] if text else []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, schema.types, strict=True)], schema=schema)

    return trees.select(F.col("tree_id").cast("string"), "newick").mapInArrow(run, NODE_SCHEMA)


def newick_texts(nodes: DataFrame, values: list[str] | None = None) -> DataFrame:
    """``tree_id, newick`` of node rows; a tree is written in one task.

    Inner nodes are labelled with their support where they have one.  ``values`` are columns that go into the comment of each node as
    ``&name=value`` (numbers plain, arrays in braces, texts in quotes), as readers of annotated trees expect; nulls are left out.
    """
    values = values or []

    def pair(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, '["\\[\\]]', "_"), F.lit('"'))
        if kind.startswith("array"):
            text = F.concat(F.lit("{"), F.array_join(c.cast("array<string>"), ","), F.lit("}"))
        else:
            text = quoted(c) if kind == "string" else c.cast("string")
        return F.concat(F.lit(f"{name}="), text)

    kinds = dict(nodes.dtypes)
    pairs = F.array_compact(F.array(*(pair(c, kinds[c]) for c in values))) if values else F.array().cast("array<string>")
    comment = F.when(F.size(pairs) > 0, F.concat(F.lit("&"), F.array_join(pairs, ",")))
    label = F.when(F.col("is_tip") | F.col("support").isNull(), F.col("label")).otherwise(F.col("support").cast("string"))
    rows = nodes.select(F.col("tree_id").cast("string"), F.col("node_id").cast("long"), F.col("parent_id").cast("long"), label.alias("label"), F.col("branch_length").cast("double"), comment.alias("comment"))

    def one(tree: pa.Table) -> pa.Table:
        columns = (tree[c].to_pylist() for c in ("node_id", "parent_id", "label", "branch_length", "comment"))
        text = format_newick([(n, p, label, length, None, None, comment) for n, p, label, length, comment in zip(*columns, strict=True)])
        return pa.table([tree["tree_id"][:1], pa.array([text], pa.string())], names=["tree_id", "newick"])

    return rows.groupBy("tree_id").applyInArrow(one, "tree_id string, newick string")


def tree_block(texts: DataFrame) -> DataFrame:
    """``ord, line`` of a NEXUS file with a tree line for each ``tree_id, newick`` (rooted)."""
    name = F.regexp_replace("tree_id", r"[^A-Za-z0-9_.]", "_")
    lines = texts.select(F.concat(F.lit("1"), "tree_id").alias("ord"), F.concat(F.lit("  TREE "), name, F.lit(" = [&R] "), "newick").alias("line"))
    frame = texts.sparkSession.createDataFrame([("0", "#NEXUS"), ("00", "BEGIN TREES;"), ("2", "END;")], "ord string, line string")
    return frame.unionByName(lines)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """``tree_id, newick`` of Newick or NEXUS tree files: one row for each tree line."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("value"))
    tree = F.when(F.col("value").startswith("("), F.col("value")).otherwise(F.regexp_extract("value", r"(?i)^u?tree\s+[^=]+=\s*(?:\[[^\]]*\]\s*)*(\(.*)$", 1))
    return rows.select(F.concat_ws(":", "file", F.col("ord").cast("string")).alias("tree_id"), tree.alias("newick")).where("newick != ''")


def collect_bootstraps(spark: SparkSession, path: str) -> DataFrame:
    """Trees of all bootstrap files below a folder."""
    return read_trees(spark, path).where(F.col("tree_id").rlike(r"\.raxml\.bootstraps:"))


def parse_config(lines: DataFrame) -> DataFrame:
    """``key, value`` of configuration lines ``line_no, line``; the last value of a key counts."""
    pair = lines.where(F.col("line").rlike(r"^[^#=]+=")).select("line_no", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))
    return pair.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))
